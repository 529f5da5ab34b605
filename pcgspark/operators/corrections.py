"""Corrections of classified peaks by rhythm, natively and in rounds that only go on with recordings that changed.

A round looks at the intervals between beats. Where one is much longer than usual, the first two neighbouring noise peaks in
it that look like a pair become one, and the first of them a beat. Then, where two beats are much closer than usual, the
weaker goes (of equals the later), from the first to the last. What is usual is the median of the intervals inside the
1.5 IQR fence; ``margin`` beats at either end stay as they are, and recordings with fewer than twice as many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pcgspark import schema
from pcgspark.functions.exprs import TINY, strength
from pcgspark.params import DEFAULTS, NOISE, ORIGINAL, S1_FROM_GAP, S2_FROM_GAP, Params

BY = ("recording_id",)
TASK_ROWS = 100_000  # peaks that a task sorts at once


def _all() -> WindowSpec:
    return Window.partitionBy(*BY)


def _order() -> WindowSpec:
    return _all().orderBy("sample_idx")


def _so_far(last: int = 0) -> WindowSpec:
    return _order().rowsBetween(Window.unboundedPreceding, last)


def _numbered(beat: Column) -> tuple[Column, Column]:
    """The number of a beat among the beats of its recording, from 0, and how many there are."""
    one = F.when(beat, 1).otherwise(0)
    return F.sum(one).over(_so_far()) - 1, F.sum(one).over(_all())


def _before(x: str) -> Column:
    """``x`` of the beat before."""
    return F.last(F.when(F.col("__beat"), F.col(x)), ignorenulls=True).over(_so_far(-1))


def _next(x: str) -> Column:
    """``x`` of the next beat, in the one order that all windows here share, so that a round sorts once."""
    return F.expr(f"lead(if(__beat, {x}, null), 1) ignore nulls over (partition by {', '.join(BY)} order by sample_idx)")


def _inner(margin: int, j: Column) -> Column:
    return (j >= margin) & (j <= F.col("__n") - 2 - margin)


def _filled(rows: DataFrame, p: Params, margin: int) -> DataFrame:
    """One round's additions: ``kind``, ``__beat`` and ``__made`` (of a corrected first peak), with ``__usual``."""
    j, n = _numbered(F.col("__beat"))
    rows = rows.withColumns({"__j": j, "__n": n, "__gap": F.when(F.col("__beat"), _next("t_sec") - F.col("t_sec"))})
    quartile = lambda q: F.percentile("__gap", F.lit(q)).over(_all())
    rows = rows.withColumns({"__q1": quartile(0.25), "__q3": quartile(0.75)})
    spread = 1.5 * (F.col("__q3") - F.col("__q1"))
    stable = F.when((F.col("__gap") > F.col("__q1") - spread) & (F.col("__gap") < F.col("__q3") + spread), F.col("__gap"))
    rows = rows.withColumn("__stable", stable).withColumn("__usual", F.when(F.col("__n") >= 2 * margin, F.median("__stable").over(_all())))
    missed = F.col("__beat") & _inner(margin, F.col("__j")) & (F.col("__gap") > F.col("__usual") * p.rr_correction_long_interval_pct)
    rows = rows.withColumn("__open", F.last(F.when(F.col("__beat"), F.coalesce(missed, F.lit(False))), ignorenulls=True).over(_so_far()))
    noise = lambda ahead: F.coalesce(F.lead(F.col("kind").contains(NOISE) & ~F.col("__beat"), ahead).over(_order()) if ahead else F.col("kind").contains(NOISE) & ~F.col("__beat"), F.lit(False))
    strong = strength("amp", "floor") > F.col("floor") * p.penalty_waiver_strength_ratio
    plausible = F.lead("amp").over(_order()) / (F.col("amp") + TINY) < p.penalty_waiver_max_s2_s1_ratio
    rows = rows.withColumn("__pair", F.coalesce(F.col("__open") & noise(0) & noise(1) & strong & plausible, F.lit(False)))
    # pairs up to here less those up to the last beat are those of this gap
    rows = rows.withColumn("__pairs", F.sum(F.col("__pair").cast("int")).over(_so_far()))
    earlier = F.last(F.when(F.col("__beat"), F.col("__pairs")), ignorenulls=True).over(_so_far())
    rows = rows.withColumn("__made", F.col("__pair") & (F.col("__pairs") - earlier == 1))
    second = F.coalesce(F.lag("__made").over(_order()), F.lit(False))
    kind = F.when(F.col("__made"), S1_FROM_GAP).when(second, S2_FROM_GAP).otherwise(F.col("kind"))
    before = F.struct(F.lit(ORIGINAL).alias("tag"), F.col("kind").alias("note"), F.array().cast("array<struct<kind:string,by:double,of:double,against:double>>").alias("steps"))
    reasons = F.when(F.col("__made") | second, F.concat(F.array(before), "reasons")).otherwise(F.col("reasons")).cast(f"array<{schema.REASON}>")
    return rows.withColumns({"__kind": kind, "__reasons": reasons, "__beat": F.col("__beat") | F.col("__made")}).drop("kind", "reasons").withColumnsRenamed({"__kind": "kind", "__reasons": "reasons"})


def _thinned(rows: DataFrame, p: Params, margin: int) -> DataFrame:
    """One round's removals: beats that are too close to their neighbour lose ``__beat``, and count as ``__made``.

    A beat that is close to the one before and not louder goes unless that one is gone. So in a run of such beats the first
    goes, the second stays, the third goes; a louder one ends the run, and the one before it goes if it is still there.
    """
    j, n = _numbered(F.col("__beat"))
    rows = rows.withColumns({"__j": j, "__n": n, "__lower": F.col("amp") <= _before("amp"), "__since": F.col("t_sec") - _before("t_sec")})
    close = F.coalesce(F.col("__beat") & _inner(margin, F.col("__j") - 1) & (F.col("__since") < F.col("__usual") * p.rr_correction_threshold_pct), F.lit(False))
    rows = rows.withColumn("__close", close).withColumns({"__falls": F.col("__close") & F.col("__lower"), "__rises": F.col("__close") & ~F.col("__lower")})
    run = F.col("__j") - F.last(F.when(F.col("__beat") & ~F.col("__falls"), F.col("__j")), ignorenulls=True).over(_so_far())
    rows = rows.withColumns({"__odd": F.col("__beat") & (run % 2 == 1), "__passed": F.coalesce(_next("__rises"), F.lit(False))})
    gone = F.col("__beat") & (F.col("__odd") | F.col("__passed"))
    return rows.withColumns({"__made": F.col("__made") | gone, "__beat": F.col("__beat") & ~gone})


def correct(peaks: DataFrame, p: Params = DEFAULTS, rounds: int = 5, margin: int = 3) -> DataFrame:
    """Classified peaks (``classify.peaks_of``) with the corrections of up to ``rounds`` rounds, which end for a recording with
    the first that changes nothing. The peaks and what goes into the next round are kept, so that they are worked out once; only
    the number of peaks, and whether recordings go on, comes to the driver. Tasks get about TASK_ROWS peaks, so what
    one of them sorts doesn't grow with the table."""
    names, done = peaks.columns, None
    peaks = peaks.withColumn("is_final_beat", F.coalesce("is_final_beat", F.lit(False)))
    if not p.enable_correction_pass:
        return peaks
    rows = peaks.persist()
    tasks = max(int(peaks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    rows = rows.repartition(tasks, *BY).withColumnRenamed("peak_type", "kind").withColumn("__beat", F.col("is_final_beat"))
    plain = rows.columns
    for _ in range(rounds):
        made = _thinned(_filled(rows, p, margin), p, margin)
        made = made.select(*plain, F.max("__made").over(_all()).alias("__changed")).persist()
        still = made.filter("not __changed").select(*plain)
        done = still if done is None else done.unionByName(still)
        rows = made.filter("__changed").select(*plain)
        if rows.isEmpty():
            break
    out = rows if done is None else done.unionByName(rows)
    return out.withColumn("is_final_beat", F.col("__beat")).withColumnRenamed("kind", "peak_type").select(*names)
