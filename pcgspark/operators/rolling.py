"""Rolling functions over an ordered partition. ``by`` names the partition, ``order`` the order in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pcgspark.functions.exprs import ColumnOr, col, fused

BY, ORDER = ("recording_id",), ("idx",)


def window(by=BY, order=ORDER) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def mirrored(by=BY, order=ORDER) -> WindowSpec:
    """``window`` in reverse order, in which what follows a row stands before it. Spark carries a frame that begins at the
    partition's start from row to row, and computes one that ends at its end anew for each row."""
    return Window.partitionBy(*by).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])


def next_known(x: ColumnOr, by=BY, order=ORDER, ahead: int = 0) -> Column:
    """The first value that is not null from ``ahead`` rows after the current one on."""
    return F.last(col(x), ignorenulls=True).over(mirrored(by, order).rowsBetween(Window.unboundedPreceding, -ahead))


def centred(width: int, by=BY, order=ORDER) -> WindowSpec:
    """``width`` rows around the current one; of an even width, one more before it."""
    return window(by, order).rowsBetween(-(width // 2), (width - 1) // 2)


def centred_mean(x: ColumnOr, width: int, by=BY, order=ORDER) -> Column:
    return F.avg(col(x)).over(centred(width, by, order))


def centred_mean_by_share(rows: DataFrame, x: str, into: str, share: float, least: int = 5, by=BY, order=ORDER) -> DataFrame:
    """Adds the centred mean whose width follows the partition's rows: max(least, int(rows * share)); nulls are skipped.

    The width differs by partition, which a frame can't express, so each row subtracts two running sums. It asks for
    them by rank: questions and sums stand in one order, in which the last sum is carried on to the questions after it.
    That is linear in the rows, and all steps follow one shuffle by partition.
    """
    whole, ordered = Window.partitionBy(*by), window(by, order)
    running = ordered.rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumns({"__at": F.row_number().over(ordered), "__n": F.count(F.lit(1)).over(whole), "__sum": F.sum(x).over(running), "__count": F.count(x).over(running)})
    width = F.greatest(F.lit(least), F.floor(F.col("__n") * share).cast("int"))
    before, last = F.col("__at") - F.floor(width / 2).cast("int") - 1, F.least(F.col("__n"), F.col("__at") + F.floor((width - 1) / 2).cast("int"))
    none = F.lit(None).cast("struct<s:double,n:bigint>")
    row = F.struct(*rows.columns)
    tell = F.struct(F.col("__at").cast("bigint").alias("place"), F.lit(0).alias("kind"), F.struct(F.col("__sum").cast("double").alias("s"), F.col("__count").alias("n")).alias("t"))
    asks = [F.struct(place.cast("bigint").alias("place"), F.lit(kind).alias("kind"), none.alias("t")) for kind, place in ((1, before), (2, last))]
    stacked = ranked.select(*by, F.col("__at"), row.alias("__row"), F.explode(F.array(tell, *asks)).alias("e")).select(*by, "__at", "__row", "e.*")
    carried = F.last("t", ignorenulls=True).over(Window.partitionBy(*by).orderBy("place", "kind").rowsBetween(Window.unboundedPreceding, 0))
    told = stacked.withColumn("c", carried).filter("kind > 0")
    pair = told.groupBy(*by, "__at").agg(F.first("__row").alias("__row"), *[F.max(F.when(F.col("kind") == k, F.col("c"))).alias(f"c{k}") for k in (1, 2)])
    total = F.coalesce("c2.s", F.lit(0.0)) - F.coalesce("c1.s", F.lit(0.0))
    count = F.coalesce("c2.n", F.lit(0)) - F.coalesce("c1.n", F.lit(0))
    return pair.select("__row.*", F.when(count > 0, total / count).alias(into))


def quantiles(rows: DataFrame, x: ColumnOr, by=BY, **shares: float) -> DataFrame:
    """(by, a column for each share): exact quantiles, of which the two neighbours are weighted with one rounding less than
    ``percentile`` has, as the SQL's engine weights them; values that stand just at a multiple of one compare alike."""
    part = Window.partitionBy(*by)
    ranked = rows.select(*by, col(x).cast("double").alias("__x")).withColumns({"__k": F.row_number().over(part.orderBy(F.col("__x").asc_nulls_last())) - 1, "__end": F.count("__x").over(part) - 1})
    met = []
    for name, q in shares.items():
        place = F.col("__end") * F.lit(q)
        low = F.floor(place)
        at = lambda k: F.max(F.when(F.col("__k") == k, F.col("__x")))
        met += [at(low).alias(f"{name}_a"), at(F.least(low + 1, F.col("__end"))).alias(f"{name}_b"), F.max(place - low).alias(f"{name}_d")]
    found = ranked.groupBy(*by).agg(*met)
    return found.select(*by, *[fused(F.col(f"{n}_a"), 1.0 - F.col(f"{n}_d"), F.col(f"{n}_b") * F.col(f"{n}_d")).alias(n) for n in shares])


def time_mean(x: ColumnOr, micros: str, seconds: float, by=BY) -> Column:
    """Mean over the half-open time frame (t - s/2, t + s/2], on integer microseconds."""
    half = int(round(seconds * 1_000_000)) // 2
    return F.avg(col(x)).over(Window.partitionBy(*by).orderBy(micros).rangeBetween(-half + 1, half))


def piece_of(at: Column, length: int) -> Column:
    """Number of the piece of an integer place, exact and rounded down."""
    return F.call_function("div", at - F.pmod(at, F.lit(length)), F.lit(length))


def in_pieces(rows: DataFrame, at: str, length: int, before: int, after: int, piece: str = "piece", own: str = "own") -> DataFrame:
    """Cuts a series at multiples of ``length`` of its integer axis, so that one series is worked on in many tasks: adds its
    ``piece`` and whether the row is the piece's ``own``. Rows up to ``before`` ahead of a piece or ``after`` behind it stand
    in that piece too, so frames of that reach are whole for own rows; filter by ``own`` after them."""
    pieces = F.sequence(piece_of(F.col(at) - after, length), piece_of(F.col(at) + before, length))
    cut = rows.withColumn(piece, F.explode(F.when(F.col(at).isNotNull(), pieces)))
    return cut.withColumn(own, F.col(piece) == piece_of(F.col(at), length))


def fill_forward(x: ColumnOr, by=BY, order=ORDER) -> Column:
    return F.last(col(x), ignorenulls=True).over(window(by, order).rowsBetween(Window.unboundedPreceding, 0))


def fill_backward(x: ColumnOr, by=BY, order=ORDER) -> Column:
    return next_known(x, by, order)


def fill_both(x: ColumnOr, by=BY, order=ORDER) -> Column:
    """Backward first, so that inner gaps take the later value; then forward for the tail."""
    return F.coalesce(fill_backward(x, by, order), fill_forward(x, by, order))


def interpolate_gaps(x: ColumnOr, at: str, by=BY, order=ORDER) -> Column:
    """Linear between known values; the last one carries on; before the first one null."""
    x = col(x)
    known = F.when(x.isNotNull(), F.struct(F.col(at).alias("at"), x.alias("v")))
    before, after = fill_forward(known, by, order), fill_backward(known, by, order)
    line = before.v + (after.v - before.v) * ((F.col(at) - before.at) / (after.at - before.at))
    return F.when(x.isNotNull(), x).when(before.isNull(), None).when(after.isNull(), before.v).otherwise(line)


def difference(x: ColumnOr, by=BY, order=ORDER) -> Column:
    return col(x) - F.lag(col(x)).over(window(by, order))


def islands(t: str, gap: float, by=BY, order=None) -> Column:
    """Number (from 1) of the run in which neighbours are closer than ``gap``; a gap of exactly ``gap`` splits."""
    w = window(by, order or (t,))
    return F.sum(F.when(F.col(t) - F.lag(t).over(w) >= gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
