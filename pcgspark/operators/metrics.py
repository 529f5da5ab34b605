"""Rate, variability, slope and recovery metrics of beat tables (recording_id, t_us, t_sec)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcgspark.operators import rolling
from pcgspark.params import DEFAULTS, Params

BY = ("recording_id",)


def _w(order="t_us", by=BY):
    return Window.partitionBy(*by).orderBy(order)


def rate_series(beats: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """recording_id, t_us, t_sec, rr, instant_bpm, smoothed_bpm for beats 2..n whose interval is positive."""
    rr = (F.col("t_us") - F.lag("t_us").over(_w())) / 1e6
    rated = beats.withColumn("rr", rr).filter(F.col("rr") > 1e-6).withColumn("instant_bpm", 60.0 / F.col("rr"))
    return rated.withColumn("smoothed_bpm", rolling.time_mean("instant_bpm", "t_us", p.output_smoothing_window_sec))


def hrv_windows(beats: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Sliding variability over full windows of ``hrv_window_size_beats`` intervals, each ``hrv_step_size_beats``."""
    n, step = p.hrv_window_size_beats, p.hrv_step_size_beats
    w = _w()
    end_of = F.lead("t_us", n).over(w)  # over beats: the last beat of the window that starts here
    gaps = beats.select(*BY, "t_us", F.lead("t_us").over(w).alias("next_us"), end_of.alias("end_us"), (F.row_number().over(w) - 1).alias("i")).filter("next_us is not null")
    rr = (F.col("next_us") - F.col("t_us")) / 1e6
    gaps = gaps.withColumn("rr", rr).withColumn("d", F.col("rr") - F.lag("rr").over(_w("i")))
    frame, inner = _w("i").rowsBetween(0, n - 1), _w("i").rowsBetween(1, n - 1)
    out = gaps.withColumns(
        {
            "full": F.count("rr").over(frame),
            "mean_rr": F.avg("rr").over(frame),
            "sdnn": F.stddev_pop(F.col("rr") * 1000).over(frame),
            "rmssd": F.sqrt(F.avg(F.col("d") * F.col("d")).over(inner)) * 1000,
        }
    ).filter((F.col("full") == n) & (F.col("i") % step == 0))
    positive = F.col("mean_rr") > 0
    return out.select(
        *BY,
        (F.col("i") / step).cast("bigint").alias("window_no"),
        ((F.col("t_us") + F.col("end_us")) / 2e6).alias("t_mid"),
        F.when(positive, F.col("rmssd") / F.col("mean_rr")).otherwise(0.0).alias("rmssdc"),
        "sdnn",
        F.when(positive, 60.0 / F.col("mean_rr")).otherwise(0.0).alias("bpm"),
    )


def rr_stats(beats: DataFrame) -> DataFrame:
    gaps = beats.select(*BY, ((F.col("t_us") - F.lag("t_us").over(_w())) / 1e6).alias("rr")).filter("rr is not null")
    return gaps.groupBy(*BY).agg(
        F.count("rr").alias("n_rr"), F.median("rr").alias("median_rr"), F.percentile("rr", F.lit(0.25)).alias("q1"), F.percentile("rr", F.lit(0.75)).alias("q3"), F.avg("rr").alias("mean_rr")
    )


def stable_intervals(beats: DataFrame) -> DataFrame:
    """Intervals inside the 1.5 IQR fence. Quartiles come from the same partition, so nothing is joined."""
    part = Window.partitionBy(*BY)
    gaps = beats.select(*BY, "t_us", ((F.col("t_us") - F.lag("t_us").over(_w())) / 1e6).alias("rr")).filter("rr is not null")
    gaps = gaps.withColumns({"q1": F.percentile("rr", F.lit(0.25)).over(part), "q3": F.percentile("rr", F.lit(0.75)).over(part)})
    spread = (F.col("q3") - F.col("q1")) * 1.5
    return gaps.filter((F.col("rr") > F.col("q1") - spread) & (F.col("rr") < F.col("q3") + spread))


def slope_partners(series: DataFrame, seconds: float = 20) -> DataFrame:
    """Each point with the first one at least ``seconds`` later, and the slope to it."""
    w = rolling.mirrored(BY, ("t_us",)).rangeBetween(Window.unboundedPreceding, -int(seconds * 1_000_000))
    later = F.last(F.struct(F.col("t_us"), F.col("smoothed_bpm"))).over(w)
    out = series.withColumn("later", later).filter("later is not null")
    duration = (F.col("later.t_us") - F.col("t_us")) / 1e6
    return out.select(
        *BY, "t_us", (F.col("t_us") / 1e6).alias("start_sec"), (F.col("later.t_us") / 1e6).alias("end_sec"), F.col("smoothed_bpm").alias("start_bpm"), F.col("later.smoothed_bpm").alias("end_bpm"),
        duration.alias("duration_sec"), ((F.col("later.smoothed_bpm") - F.col("smoothed_bpm")) / duration).alias("slope"),
    )


_PERIOD = ("start_sec", "end_sec", "start_bpm", "end_bpm", "duration_sec", "slope")


def _steepest(slopes: DataFrame, best: Column) -> DataFrame:
    return slopes.groupBy(*BY).agg(best.alias("b")).select(*BY, *[F.col(f"b.{c}").alias(c) for c in _PERIOD])


def peak_exertion(series: DataFrame, seconds: float = 20) -> DataFrame:
    """The steepest rise over the offset; of equals the first."""
    rising = slope_partners(series, seconds).filter("slope > 0")
    return _steepest(rising, F.max_by(F.struct(*_PERIOD), F.struct("slope", -F.col("t_us"))))


def after_maximum(series: DataFrame) -> DataFrame:
    """Rows from the first maximum on."""
    part = Window.partitionBy(*BY)
    top = F.max_by("t_us", F.struct("smoothed_bpm", -F.col("t_us"))).over(part)
    return series.withColumn("top_us", top).filter("t_us >= top_us").drop("top_us")


def peak_recovery(series: DataFrame, seconds: float = 20) -> DataFrame:
    """The steepest fall over the offset, from the maximum on; of equals the first."""
    falling = slope_partners(after_maximum(series), seconds).filter("slope < 0")
    return _steepest(falling, F.min_by(F.struct(*_PERIOD), F.struct("slope", "t_us")))


def rate_recovery(series: DataFrame, seconds: int = 60, floor_seconds: bool = True) -> DataFrame:
    """Drop from the maximum to the rate ``seconds`` later, interpolated; none if the series ends before.

    With ``floor_seconds`` the abscissa is whole seconds rounded down, the place to look up is not.
    """
    part = Window.partitionBy(*BY)
    top = series.withColumns({"top": F.max_by(F.struct("t_us", "smoothed_bpm"), F.struct("smoothed_bpm", -F.col("t_us"))).over(part), "end_us": F.max("t_us").over(part)})
    at = F.col("top.t_us") + seconds * 1_000_000
    x = F.floor(F.col("t_us") / 1_000_000) if floor_seconds else F.col("t_us") / 1e6
    rows = top.withColumns({"at_us": at, "x": x.cast("double")}).filter("at_us <= end_us")
    before = F.max_by(F.struct("x", "smoothed_bpm"), F.when(F.col("x") <= F.col("at_us") / 1e6, F.col("t_us")))
    after = F.min_by(F.struct("x", "smoothed_bpm"), F.when(F.col("x") > F.col("at_us") / 1e6, F.col("t_us")))
    got = rows.groupBy(*BY).agg(F.first("top").alias("top"), F.first("at_us").alias("at_us"), before.alias("b"), after.alias("a"))
    line = F.col("b.smoothed_bpm") + (F.col("a.smoothed_bpm") - F.col("b.smoothed_bpm")) * ((F.col("at_us") / 1e6 - F.col("b.x")) / (F.col("a.x") - F.col("b.x")))
    value = F.when(F.col("a").isNull(), F.col("b.smoothed_bpm")).otherwise(line)
    return got.select(*BY, F.col("top.smoothed_bpm").alias("peak_bpm"), (F.col("top.t_us") / 1e6).alias("peak_sec"), value.alias("recovery_bpm"), (F.col("top.smoothed_bpm") - value).alias("hrr_bpm"))


def recovery_phase(series: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Time of the first maximum and the end of the phase after it; needs two points."""
    got = series.groupBy(*BY).agg(F.max_by("t_us", F.struct("smoothed_bpm", -F.col("t_us"))).alias("top"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return got.select(*BY, (F.col("top") / 1e6).alias("peak_sec"), (F.col("top") / 1e6 + p.recovery_phase_duration_sec).alias("end_sec"))


def global_estimate(beats: DataFrame, hint: str | None = None, least: int = 10) -> DataFrame:
    """Starting rate: the hint, else 60 / median interval with enough beats, else 80."""
    gaps = beats.withColumn("rr", (F.col("t_us") - F.lag("t_us").over(_w())) / 1e6)
    columns = [F.first(hint).alias("hint")] if hint else [F.lit(None).cast("double").alias("hint")]
    got = gaps.groupBy(*BY).agg(F.median("rr").alias("m"), F.count(F.lit(1)).alias("n"), *columns)
    estimate = F.when((F.col("n") >= least) & (F.col("m") > 0), 60.0 / F.col("m"))
    return got.select(*BY, estimate.alias("estimate_bpm"), F.coalesce("hint", estimate, F.lit(80.0)).alias("start_bpm"))


def mean_at(rows: DataFrame, at: str, x: str, into: str) -> DataFrame:
    """The mean of ``x`` over rows with an equal ``at``."""
    return rows.groupBy(*BY, at).agg(F.avg(x).alias(into))


def summary(series: DataFrame) -> DataFrame:
    return series.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_points"), F.avg("smoothed_bpm").alias("avg_bpm"), F.min("smoothed_bpm").alias("min_bpm"), F.max("smoothed_bpm").alias("max_bpm"))


def hrv_summary(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*BY).agg(F.count(F.lit(1)).alias("n_windows"), F.avg("rmssdc").alias("avg_rmssdc"), F.avg("sdnn").alias("avg_sdnn"))


def turning_points(series: DataFrame) -> DataFrame:
    """Prominent peaks and troughs of the smoothed rate, at least about five seconds apart."""
    from pcgspark.operators import peaks

    part = Window.partitionBy(*BY)
    rows = series.select(*BY, "t_us", "smoothed_bpm").withColumns({"__at": F.row_number().over(_w()).cast("bigint") - 1, "__gap": F.col("t_us") / 1e6 - F.lag(F.col("t_us") / 1e6).over(_w())})
    mean = F.avg("__gap").over(part)
    rows = rows.withColumn("__far", F.when(F.coalesce(mean, F.lit(0.0)) == 0, F.lit(5)).otherwise(F.greatest(F.lit(1), (F.lit(5) / mean).cast("int")))).drop("__gap")
    out = [peaks.find_peaks(rows, "smoothed_bpm", "__at", prominence=5.0, distance="__far", negate=kind == "trough").select(*BY, "t_us", "smoothed_bpm", F.lit(kind).alias("kind")) for kind in ("peak", "trough")]
    return out[0].unionByName(out[1])


def major_changes(points: DataFrame, rising: bool, least_sec: float = 10, least_bpm: float = 15) -> DataFrame:
    """From each trough to the next peak (or the reverse), if long and large enough, in no order."""
    start, end = ("trough", "peak") if rising else ("peak", "trough")
    following = rolling.next_known(F.when(F.col("kind") == end, F.struct("t_us", "smoothed_bpm")), BY, ("t_us",), 1)
    out = points.withColumn("e", following).filter((F.col("kind") == start) & F.col("e").isNotNull())
    duration, change = (F.col("e.t_us") - F.col("t_us")) / 1e6, F.col("e.smoothed_bpm") - F.col("smoothed_bpm")
    out = out.select(*BY, (F.col("t_us") / 1e6).alias("start_sec"), (F.col("e.t_us") / 1e6).alias("end_sec"), F.col("smoothed_bpm").alias("start_bpm"), F.col("e.smoothed_bpm").alias("end_bpm"), duration.alias("duration_sec"), change.alias("change_bpm"), (change / duration).alias("slope"))
    size = F.col("change_bpm") if rising else -F.col("change_bpm")
    return out.filter((F.col("duration_sec") >= least_sec) & (size >= least_bpm))
