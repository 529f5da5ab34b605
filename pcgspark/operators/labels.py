"""Manual labels (recording_id, t_sec, bpm, peak_type): pairs, groups and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pcgspark.operators import align, rolling

BY = ("recording_id",)


def pairs(labels: DataFrame) -> DataFrame:
    """S1_Time, S2_Time, Delta_t, S1_BPM of greedily matched labels."""
    s1 = labels.filter("peak_type = 'S1'").select(*BY, "t_sec", "bpm")
    s2 = labels.filter("peak_type = 'S2'").select(*BY, "t_sec")
    met = align.greedy_pairs(s1, s2, "t_sec")
    return met.select("a.recording_id", F.col("a.t_sec").alias("S1_Time"), F.col("b.t_sec").alias("S2_Time"), (F.col("b.t_sec") - F.col("a.t_sec")).alias("Delta_t"), F.col("a.bpm").alias("S1_BPM"))


def range_average(paired: DataFrame, start: float, end: float) -> DataFrame:
    """Mean interval and rate of the pairs whose S1 lies in a closed time range, and these ``pairs`` in order of time."""
    pair = F.struct("S1_Time", "S2_Time", "Delta_t", "S1_BPM")
    return paired.filter(F.col("S1_Time").between(start, end)).groupBy(*BY).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("Delta_t").alias("avg_delta_t"), F.avg("S1_BPM").alias("avg_bpm"), F.array_sort(F.collect_list(pair)).alias("pairs"))


def in_range(labels: DataFrame, start: float, end: float) -> DataFrame:
    """Labels in a closed time range."""
    return labels.filter(F.col("t_sec").between(start, end))


def groups(labels: DataFrame, gap: float = 1.0) -> DataFrame:
    """S1 labels with group_id; a gap of at least ``gap`` starts a group. Recordings with under two S1 have none."""
    s1 = labels.filter("peak_type = 'S1'").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*BY))).filter("n >= 2").drop("n")
    return s1.withColumn("group_id", rolling.islands("t_sec", gap))


def group_stats(labels: DataFrame, gap: float = 5.0) -> DataFrame:
    """Span, counts and mean pair interval of each group with two S1 or more and a pair. A pair belongs to the group
    of its S1, which carries its number through the match, so nothing is joined."""
    s1 = groups(labels, gap).select(*BY, "t_sec", "bpm", "group_id")
    met = align.greedy_pairs(s1, labels.filter("peak_type = 'S2'").select(*BY, "t_sec"), "t_sec", keep_unmatched=True)
    paired = F.col("b").isNotNull()
    stats = met.groupBy(F.col("a.recording_id").alias("recording_id"), F.col("a.group_id").alias("group_id")).agg(
        F.min("a.t_sec").alias("start_time"), F.max("a.t_sec").alias("end_time"), F.count(F.lit(1)).alias("s1_count"),
        F.avg(F.col("b.t_sec") - F.col("a.t_sec")).alias("avg_delta_t"), F.avg(F.when(paired, F.col("a.bpm"))).alias("avg_bpm"), F.count(F.when(paired, 1)).alias("pairs_count"),
    )
    return stats.filter("s1_count >= 2 and pairs_count >= 1").withColumn("duration", F.col("end_time") - F.col("start_time"))


def add_label(labels: DataFrame, click: DataFrame, series: DataFrame) -> DataFrame:
    """Appends clicks (recording_id, t_sec, peak_type), clamped to the axis and snapped to the nearest point of
    ``series`` (t_sec, bpm), of equally near ones the earlier; times and rates are rounded to three places. A click on a
    recording without a point is left out. Clicks and points stand in one order, so no click meets all points."""
    clicks = click.select(*BY, F.greatest(F.lit(0.0), F.col("t_sec")).alias("t_sec"), "peak_type")
    points = series.select(*BY, "t_sec", F.struct(F.col("t_sec").alias("at"), F.col("bpm").alias("at_bpm")).alias("point"))
    near = align.asof_nearest(clicks, points, "t_sec", "point", "n", float("inf")).filter("n is not null")
    return labels.unionByName(near.select(*BY, F.round("n.at", 3).alias("t_sec"), F.round("n.at_bpm", 3).alias("bpm"), "peak_type"))


def remove_labels(labels: DataFrame, gone: DataFrame) -> DataFrame:
    """Labels without those equal to a row of ``gone``."""
    return labels.join(gone.select("recording_id", "t_sec", "bpm", "peak_type"), ["recording_id", "t_sec", "bpm", "peak_type"], "left_anti")


UNDO_DEPTH = 20


def replay(log: DataFrame, order: str = "seq", depth: int = UNDO_DEPTH) -> DataFrame:
    """The labels after a log (recording_id, action, t_sec, bpm, peak_type) in the order of ``order``.

    ``add`` appends a label, ``undo`` takes back the latest of the last ``depth`` additions that are not taken back yet, and
    with it all labels equal to it; ``clear`` drops all labels and forgets the additions. An undo without a label or an
    addition does nothing, other actions neither. What comes before a recording's last ``clear`` is left out by a window; the
    rest, a person's clicks on one recording, is replayed by a fold over it.
    """
    w = Window.partitionBy(*BY).orderBy(order)
    cleared = F.sum((F.col("action") == "clear").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last = F.sum((F.col("action") == "clear").cast("int")).over(Window.partitionBy(*BY))
    label = F.struct("t_sec", "bpm", "peak_type")
    recent = log.withColumns({"__n": cleared, "__all": last}).filter("__n = __all and action in ('add', 'undo')")
    packed = recent.groupBy(*BY).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col("action"), label.alias("label")))).alias("e"))
    none = F.array().cast("array<struct<t_sec:double,bpm:double,peak_type:string>>")

    def step(acc, e):
        added = F.struct(F.slice(F.concat(acc.stack, F.array(e.label)), -F.least(F.lit(depth), F.size(acc.stack) + 1), depth).alias("stack"), F.concat(acc.kept, F.array(e.label)).alias("kept"))
        top = F.element_at(acc.stack, -1)
        taken = F.struct(F.slice(acc.stack, 1, F.size(acc.stack) - 1).alias("stack"), F.filter(acc.kept, lambda k: ~k.eqNullSafe(top)).alias("kept"))
        return F.when(e.action == "add", added).when((F.size(acc.stack) > 0) & (F.size(acc.kept) > 0), taken).otherwise(acc)

    start = F.struct(none.alias("stack"), none.alias("kept"))
    folded = packed.select(*BY, F.explode(F.aggregate("e", start, step, lambda acc: acc.kept)).alias("k"))
    return folded.select(*BY, "k.t_sec", "k.bpm", "k.peak_type")


def latest(labels: DataFrame, n: int = 20, order: str = "t_sec") -> DataFrame:
    """The last ``n`` labels of each recording; ties in time are decided by the other columns."""
    w = Window.partitionBy(*BY).orderBy(F.desc(order), *[F.desc(c) for c in labels.columns if c not in (*BY, order)])
    return labels.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).drop("r")
