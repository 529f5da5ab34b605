"""The whole analysis of many recordings, and its reports, as lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pcgspark import schema
from pcgspark.functions import exprs as X
from pcgspark.functions.reasons import reason_lines
from pcgspark.operators import classify, metrics
from pcgspark.operators import signal as sig
from pcgspark.operators.rolling import fill_forward
from pcgspark.params import DEFAULTS, Params

BY = ("recording_id",)


def _shown(pattern: str, *columns: str, absent: str = "n/a"):
    """Formatted values; printf itself would show a null as text."""
    return F.when(F.col(columns[0]).isNotNull(), X.printf(pattern, *columns)).otherwise(absent)


@dataclass
class Analysis:
    """Tables of an analysis; nothing runs before an action."""

    prepared: DataFrame
    analyses: DataFrame
    beats: DataFrame
    series: DataFrame
    hrv: DataFrame
    turning: DataFrame
    params: Params

    @property
    def summary(self) -> DataFrame:
        """One row for each recording: status, averages, variability, recovery, steepest slopes."""
        own = self.analyses.select("recording_id", "status", "start_bpm")
        exertion = metrics.peak_exertion(self.series).select("recording_id", F.struct("start_sec", "end_sec", "start_bpm", "end_bpm", "duration_sec", "slope").alias("peak_exertion"))
        recovery = metrics.peak_recovery(self.series).select("recording_id", F.struct("start_sec", "end_sec", "start_bpm", "end_bpm", "duration_sec", "slope").alias("peak_recovery"))
        out = own
        for part in (metrics.summary(self.series), metrics.hrv_summary(self.hrv), metrics.rate_recovery(self.series).select("recording_id", "hrr_bpm"), exertion, recovery):
            out = out.join(part, "recording_id", "left")
        return out

    @property
    def inclines(self) -> DataFrame:
        return metrics.major_changes(self.turning, True)

    @property
    def declines(self) -> DataFrame:
        return metrics.major_changes(self.turning, False)

    def release(self) -> None:
        """Drops the kept tables; results that are read later compute them anew."""
        self.prepared.unpersist()
        self.analyses.unpersist()


def analyse(recordings: DataFrame, settings: DataFrame | None = None, p: Params = DEFAULTS, raw: bool = False) -> Analysis:
    """From recordings (recording_id, sample_rate, samples). The tables of one row for each recording are kept, since
    several results start from them, until ``release``; they are small beside the samples."""
    prepared = sig.prepare(recordings, p, raw=raw).persist()
    analyses = classify.analyse(prepared, settings, p).persist()
    beats = classify.beats_of(analyses)
    series = metrics.rate_series(beats, p)
    return Analysis(prepared, analyses, beats, series, metrics.hrv_windows(beats, p), metrics.turning_points(series), p)


def events(a: Analysis) -> DataFrame:
    """Peaks and troughs in order, with the state at each: floor, smoothed rate and belief, carried forward."""
    peaks = classify.peaks_of(a.analyses).select("recording_id", "sample_idx", "t_sec", "amp", F.col("peak_type").alias("kind"), "reasons", "floor")
    rate = a.analyses.select("recording_id", "sample_rate")
    flat = a.prepared.filter(F.size("troughs") > 0).select("recording_id", "sample_rate", "env", "floor", F.explode("troughs").alias("sample_idx"))
    at = lambda c: F.element_at(c, (F.col("sample_idx") + 1).cast("int"))
    troughs = flat.select("recording_id", "sample_idx", (F.col("sample_idx") / F.col("sample_rate")).alias("t_sec"), at("env").alias("amp"), F.lit("Trough").alias("kind"), F.lit(None).cast(peaks.schema["reasons"].dataType).alias("reasons"), at("floor").alias("floor"))
    belief = metrics.mean_at(classify.belief_of(a.analyses), "t_sec", "bpm", "belief").join(rate, "recording_id")
    belief = belief.select("recording_id", F.round(F.col("t_sec") * F.col("sample_rate")).cast("bigint").alias("sample_idx"), "belief")
    smooth = a.series.join(rate, "recording_id").select("recording_id", F.round(F.col("t_sec") * F.col("sample_rate")).cast("bigint").alias("sample_idx"), "smoothed_bpm")
    out = peaks.unionByName(troughs).join(belief, ["recording_id", "sample_idx"], "left").join(smooth, ["recording_id", "sample_idx"], "left")
    return out.withColumns({"belief": fill_forward("belief", order=("sample_idx",)), "smoothed_bpm": fill_forward("smoothed_bpm", order=("sample_idx",))})


def debug_log(a: Analysis) -> DataFrame:
    """recording_id and a chronological log as text."""
    reasons = F.array_join(F.flatten(F.transform(F.coalesce("reasons", F.array().cast(f"array<{schema.REASON}>")), reason_lines)), "\n")
    line = X.printf("%s [%.3f s] %s, amplitude %.1f, floor %.1f, rate %s, belief %s", X.clock("t_sec"), F.col("t_sec"), F.coalesce("kind", F.lit("Unclassified")), F.col("amp"), F.col("floor"), _shown("%.1f", "smoothed_bpm", absent="-"), _shown("%.1f", "belief", absent="-"))
    text = F.concat(line, F.when(reasons != "", F.concat(F.lit("\n"), reasons)).otherwise(F.lit("")))
    rows = events(a).select("recording_id", F.struct("t_sec", "sample_idx", text.alias("line")).alias("e"))
    return rows.groupBy(*BY).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e.line), "\n").alias("value"))


def _periods(df: DataFrame, title: str) -> DataFrame:
    line = X.printf("| %s - %s | %.1f s | %.1f to %.1f BPM | %+.1f BPM | %+.2f BPM/s |", X.clock("start_sec"), X.clock("end_sec"), "duration_sec", "start_bpm", "end_bpm", "change_bpm", "slope")
    ordered = df.select("recording_id", F.struct((-F.abs("slope")).alias("o"), "start_sec", line.alias("line")).alias("x"))
    return ordered.groupBy(*BY).agg(F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.line), "\n")).alias(title))


def rate_table(series: DataFrame) -> DataFrame:
    """recording_id and the rows of the report's rate table in order, as text; reads nothing but the rate series."""
    rates = series.select("recording_id", F.struct("t_sec", X.printf("| %.2f | %.1f |", "t_sec", "smoothed_bpm").alias("line")).alias("x"))
    return rates.groupBy(*BY).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.line), "\n").alias("rates"))


def report(a: Analysis) -> DataFrame:
    """recording_id and a Markdown summary: metrics, steepest slopes, significant changes, rate table."""
    fmt = lambda label, c, pattern: F.concat(F.lit(f"| {label} | "), _shown(pattern, c), F.lit(" |"))
    span = F.concat(F.lit("| BPM range | "), _shown("%.1f - %.1f BPM", "min_bpm", "max_bpm"), F.lit(" |"))
    slope = lambda label, c: F.concat(F.lit(f"| {label} | "), _shown("%+.2f BPM/s over %.1f s (%.1f to %.1f BPM)", f"{c}.slope", f"{c}.duration_sec", f"{c}.start_bpm", f"{c}.end_bpm"), F.lit(" |"))
    head = F.concat_ws(
        "\n", F.concat(F.lit("# Analysis of "), "recording_id"), F.lit(""), F.lit("| Metric | Value |"), F.lit("|---|---|"), fmt("Average BPM", "avg_bpm", "%.1f BPM"), span,
        fmt("Corrected RMSSD", "avg_rmssdc", "%.2f"), fmt("Windowed SDNN", "avg_sdnn", "%.2f ms"), fmt("1-minute recovery", "hrr_bpm", "%.1f BPM"), slope("Peak exertion", "peak_exertion"), slope("Peak recovery", "peak_recovery"),
    )
    rates = rate_table(a.series).withColumn("rates", F.concat(F.lit("## Rate\n\n| Time (s) | BPM |\n|---|---|\n"), "rates"))
    out = a.summary.select("recording_id", head.alias("head")).join(_periods(a.inclines, "Exertion periods"), "recording_id", "left").join(_periods(a.declines, "Recovery periods"), "recording_id", "left").join(rates, "recording_id", "left")
    return out.select("recording_id", F.concat_ws("\n\n", "head", "`Exertion periods`", "`Recovery periods`", "rates").alias("value"))


def traces(a: Analysis, thin: int | None = None) -> dict[str, DataFrame]:
    """The tables behind a plot: envelope and floor, markers by bucket, troughs, rate, belief, variability, slopes, extremes."""
    samples = sig.plot_thin(sig.samples_of(a.prepared), thin or a.params.plot_downsample_factor)
    peaks = classify.peaks_of(a.analyses)
    bucket = F.when(X.is_s1("peak_type"), "S1").when(X.is_s2("peak_type"), "S2").otherwise("noise")
    part = Window.partitionBy(*BY)
    extremes = a.series.withColumns({"hi": F.max("smoothed_bpm").over(part), "lo": F.min("smoothed_bpm").over(part)})
    axis = samples.groupBy(*BY).agg((F.percentile("env", F.lit(0.95)) * a.params.plot_amplitude_scale_factor).alias("y_max"))
    return {
        "samples": samples,
        "markers": peaks.withColumn("bucket", F.coalesce(bucket, F.lit("noise"))),
        "events": events(a),
        "rate": a.series,
        "belief": classify.belief_of(a.analyses),
        "hrv": a.hrv,
        "slopes": metrics.peak_exertion(a.series).withColumn("kind", F.lit("exertion")).unionByName(metrics.peak_recovery(a.series).withColumn("kind", F.lit("recovery"))),
        "extremes": extremes.filter("smoothed_bpm = hi or smoothed_bpm = lo").drop("hi", "lo"),
        "axis": axis,
    }
