"""Alignments between ordered tables, as window functions and equi-joins on the recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pcgspark.operators.rolling import mirrored, next_known

BY = ("recording_id",)


def _stacked(left: DataFrame, right: DataFrame, on: str, value: str, by) -> DataFrame:
    rows = left.select(*by, on, F.struct(*left.columns).alias("l"), F.lit(None).cast(right.schema[value].dataType).alias("v"), F.lit(None).cast(right.schema[on].dataType).alias("at"))
    marks = right.select(*by, on, F.lit(None).cast(rows.schema["l"].dataType).alias("l"), F.col(value).alias("v"), F.col(on).alias("at"))
    return rows.unionByName(marks)


def asof_backward(left: DataFrame, right: DataFrame, on: str, value: str, into: str, by=BY) -> DataFrame:
    """The last ``value`` of ``right`` at or before each row of ``left``; one sort of both instead of a range join."""
    w = Window.partitionBy(*by).orderBy(F.col(on), F.col("l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("at").isNotNull(), F.struct(F.col("v").alias("v")))
    out = _stacked(left, right, on, value, by).withColumn("m", F.last(mark, ignorenulls=True).over(w))
    return out.filter("l is not null").select("l.*", F.col("m.v").alias(into))


def asof_nearest(left: DataFrame, right: DataFrame, on: str, value: str, into: str, tolerance: float, by=BY) -> DataFrame:
    """The nearest ``value`` within the tolerance; of two equally near, the earlier."""
    stacked = _stacked(left, right, on, value, by)
    mark = F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("at"), F.col("v").alias("v")))
    w = Window.partitionBy(*by).orderBy(F.col(on), F.col("l").isNotNull())
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = next_known(mark, by, (on, F.col("l").isNotNull()), 1)
    out = stacked.withColumns({"b": before, "a": after}).filter("l is not null")
    db, da = F.col(f"l.{on}") - F.col("b.at"), F.col("a.at") - F.col(f"l.{on}")
    best = F.when(F.col("a").isNull() | (db <= da), F.when(db <= tolerance, F.col("b.v"))).otherwise(F.when(da <= tolerance, F.col("a.v")))
    return out.select("l.*", best.alias(into))


def first_at(rows: DataFrame, on: str, value: str, order: str, by=BY) -> DataFrame:
    """(by, on, value): one row for each place; of several at one place the first by ``order``."""
    return rows.groupBy(*by, on).agg(F.min_by(value, order).alias(value))


def interpolate_at(left: DataFrame, right: DataFrame, on: str, value: str, into: str, by=BY) -> DataFrame:
    """``value`` of ``right`` interpolated at the times of ``left``, constant beyond the ends. Which of several
    values at one time counts is for ``first_at`` to say before."""
    mark = F.when(F.col("at").isNotNull(), F.struct(F.col("at").alias("at"), F.col("v").alias("v")))
    w = Window.partitionBy(*by).orderBy(F.col(on), F.col("l").isNotNull())
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = next_known(mark, by, (on, F.col("l").isNotNull()), 1)
    out = _stacked(left, right, on, value, by).withColumns({"b": before, "a": after}).filter("l is not null")
    line = F.col("b.v") + (F.col("a.v") - F.col("b.v")) * (F.col(f"l.{on}") - F.col("b.at")) / (F.col("a.at") - F.col("b.at"))
    return out.select("l.*", F.when(F.col("b").isNull(), F.col("a.v")).when(F.col("a").isNull(), F.col("b.v")).otherwise(line).alias(into))


def with_next(rows: DataFrame, x: str, into: str, order: str = "idx", by=BY) -> DataFrame:
    """Adds ``x`` of the next row."""
    return rows.withColumn(into, F.lead(x).over(Window.partitionBy(*by).orderBy(order)))


def stacked(**tables: DataFrame) -> DataFrame:
    """All rows of tables with equal columns, and ``kind``, the table's name."""
    parts = [df.withColumn("kind", F.lit(kind)) for kind, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def among(rows: DataFrame, known: DataFrame, on: str, by=BY) -> DataFrame:
    """Rows whose place is one of ``known``."""
    return rows.join(known.select(*by, on), [*by, on], "left_semi")


def not_among(rows: DataFrame, known: DataFrame, on: str, by=BY) -> DataFrame:
    """Rows whose place is none of ``known``."""
    return rows.join(known.select(*by, on), [*by, on], "left_anti")


def first_following(rows: DataFrame, wanted: str, order: str, by=BY) -> DataFrame:
    """Adds ``following``: the struct of the next row for which the boolean column ``wanted`` holds."""
    return rows.withColumn("following", next_known(F.when(F.col(wanted), F.struct(*rows.columns)), by, (order,), 1))


def inside_gaps(points: DataFrame, beats: DataFrame, order: str, by=BY) -> DataFrame:
    """Points strictly between two neighbouring beats, with gap_start and gap_end. A range join done by carrying
    beats along one ordered pass."""
    rows = points.select(*by, order, F.struct(*points.columns).alias("p"), F.lit(None).cast(beats.schema[order].dataType).alias("beat"))
    marks = beats.select(*by, order, F.lit(None).cast(rows.schema["p"].dataType).alias("p"), F.col(order).alias("beat"))
    w = Window.partitionBy(*by).orderBy(order)
    out = rows.unionByName(marks)
    before = F.last("beat", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1))
    after = F.last("beat", ignorenulls=True).over(mirrored(by, (order,)).rangeBetween(Window.unboundedPreceding, -1))
    same = F.count("beat").over(w.rangeBetween(0, 0))
    out = out.withColumns({"gap_start": before, "gap_end": after, "same": same}).filter("p is not null and same = 0 and gap_start is not null and gap_end is not null")
    return out.select("p.*", "gap_start", "gap_end")


def greedy_pairs(first: DataFrame, second: DataFrame, on: str, by=BY, keep_unmatched: bool = False) -> DataFrame:
    """One-to-one forward match: each row of ``first`` takes the earliest unused row of ``second`` strictly later.

    Closed form: with c_k rows of ``second`` at or before the k-th of ``first`` (k from 0), it takes number
    k + max over m <= k of (c_m - m), while there are that many. Matching numbers then stand next to each other in
    one ordering, so nothing is joined and both sides are shuffled once. Returns structs (a, b).
    """
    sides = first.select(F.struct(*first.columns).alias("a")).schema["a"].dataType, second.select(F.struct(*second.columns).alias("b")).schema["b"].dataType
    rows = first.select(*by, on, F.lit(0).alias("is_b"), F.struct(*first.columns).alias("a"), F.lit(None).cast(sides[1]).alias("b"))
    marks = second.select(*by, on, F.lit(1).alias("is_b"), F.lit(None).cast(sides[0]).alias("a"), F.struct(*second.columns).alias("b"))
    w, own = Window.partitionBy(*by).orderBy(on), Window.partitionBy(*by, "is_b").orderBy(on, "a", "b")  # equal times in the order of the other columns
    counted = rows.unionByName(marks).withColumns({"c": F.sum("is_b").over(w.rangeBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(own) - 1})
    ahead = F.max(F.col("c") - F.col("k")).over(own.rowsBetween(Window.unboundedPreceding, 0))
    numbered = counted.withColumn("j", F.when(F.col("is_b") == 1, F.col("k")).otherwise(F.col("k") + ahead))
    beside = F.lag(F.struct("j", "is_b", "b")).over(Window.partitionBy(*by).orderBy("j", F.desc("is_b")))
    met = numbered.withColumn("l", beside).filter("is_b = 0")
    out = met.select("a", F.when((F.col("l.is_b") == 1) & (F.col("l.j") == F.col("j")), F.col("l.b")).alias("b"))
    return out if keep_unmatched else out.filter("b is not null")
