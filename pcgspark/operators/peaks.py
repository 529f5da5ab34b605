"""Peak detection over sample tables of any length. Maxima and the distance rule are Catalyst expressions; prominences come from
stacks over blocks of samples, which are merged (``blocks``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcgspark.functions.shipping import ship
from pcgspark.operators import blocks

BY = ("recording_id",)


def _marked_maxima(rows: DataFrame, x: str, into: str, order: str = "idx", by=BY) -> DataFrame:
    """Adds whether a row is a strict local maximum; of a plateau the middle row (rounded down), never one at an end.

    Runs of equal values are numbered, compared with the runs beside them, and reduced to their middle row.
    """
    w = Window.partitionBy(*by).orderBy(order)
    names = rows.columns
    rows = rows.withColumns({"__before": F.lag(x).over(w), "__after": F.lead(x).over(w)})
    changed = F.when(F.col("__before") == F.col(x), 0).otherwise(1)
    rows = rows.withColumn("__run", F.sum(changed).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy(*by, "__run")
    rows = rows.withColumns(
        {
            "__first": F.min(order).over(part),
            "__last": F.max(order).over(part),
            "__left": F.min_by("__before", order).over(part),
            "__right": F.max_by("__after", order).over(part),
        }
    )
    top = F.coalesce((F.col("__left") < F.col(x)) & (F.col("__right") < F.col(x)), F.lit(False))
    middle = F.floor((F.col("__first") + F.col("__last")) / 2)
    return rows.select(*names, (top & (F.col(order) == middle)).alias(into))


def local_maxima(rows: DataFrame, x: str, order: str = "idx", by=BY) -> DataFrame:
    """Rows at strict local maxima; of a plateau the middle one (rounded down), never at an end."""
    return _marked_maxima(rows, x, "__top", order, by).filter("__top").drop("__top")


def prominent_maxima(rows: DataFrame, x: str, order: str = "idx", by=BY) -> DataFrame:
    """``local_maxima`` with their ``prominence``, in one pass over the samples."""
    return blocks.prominences(_marked_maxima(rows, x, "__top", order, by), "__top", x, order=order, by=by).drop("__top")


def prominences(peaks: DataFrame, rows: DataFrame, x: str, order: str = "idx", by=BY) -> DataFrame:
    """Adds ``prominence`` to peak rows: the height above the higher of the two lowest points passed on the way to a
    strictly higher sample (or the end) on either side. Values are not null."""
    marks = peaks.select(*by, order).distinct().withColumn("__top", F.lit(True))
    flagged = rows.select(*by, order, x).join(marks, [*by, order], "left").na.fill(False, ["__top"])
    found = blocks.prominences(flagged, "__top", x, order=order, by=by).select(*by, order, "prominence")
    return peaks.drop("prominence").join(found, [*by, order], "left").na.fill(0.0, ["prominence"]).select(*[c for c in peaks.columns if c != "prominence"], "prominence")


def far_apart(peaks: DataFrame, x: str, distance: int | str, order: str = "idx", by=BY) -> DataFrame:
    """Peaks left when higher ones drop their neighbours closer than ``distance`` (a number, or a column that is the same for
    a whole series); of equals the later one stays.

    A peak that none within the distance tops stays for sure and drops these, so what is left of it and what is right of it
    do not touch each other. The others are cut into groups wherever neighbours are far enough apart, and only within such a
    short group is there a choice, made from the highest to the lowest by a fold.
    """
    names = peaks.columns
    rows = peaks
    if isinstance(distance, int):
        near = Window.partitionBy(*by).orderBy(order).rangeBetween(1 - distance, distance - 1)
        rows = rows.withColumn("__sure", F.max(F.struct(x, order)).over(near) == F.struct(x, order))
        rows = rows.withColumn("__met", F.max("__sure").over(near)).filter("__sure or not __met")
    gap = F.lit(distance) if isinstance(distance, int) else F.col(distance)
    w = Window.partitionBy(*by).orderBy(order)
    apart = F.coalesce(F.col(order) - F.lag(order).over(w) >= gap, F.lit(True))
    rows = rows.withColumn("__group", F.sum(apart.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    item = F.struct(F.col(x).alias("x"), F.col(order).alias("at"), gap.alias("gap"), F.struct(*names).alias("row"))
    grouped = rows.groupBy(*by, "__group").agg(F.sort_array(F.collect_list(item), asc=False).alias("__p"))

    def choose(kept: Column, p: Column) -> Column:
        return F.when(F.exists(kept, lambda k: F.abs(k.at - p.at) < p.gap), kept).otherwise(F.concat(kept, F.array(p)))

    chosen = F.when(F.size("__p") == 1, F.col("__p")).otherwise(F.aggregate("__p", F.slice("__p", 1, 0), choose))
    return grouped.select(F.explode(chosen).alias("__k")).select("__k.row.*")


def find_peaks(
    rows: DataFrame, x: str, order: str = "idx", height: str | float | None = None, prominence: str | float | None = None, distance: int | str | None = None, negate: bool = False, by=BY
) -> DataFrame:
    """Rows of ``rows`` at peaks of ``x`` (troughs with ``negate``) by height, then distance, then prominence; limits are
    numbers or columns. A prominence does not depend on which peaks are chosen, so it is found in the one pass over all
    samples, and what follows goes over peaks only. Values are not null."""
    names = rows.columns
    found = _marked_maxima(rows.withColumn("__v", (-F.col(x) if negate else F.col(x)).cast("double")), "__v", "__top", order, by)
    found = found.filter("__top") if prominence is None else blocks.prominences(found, "__top", "__v", "__prominence", order, by)
    limit = lambda v: F.col(v) if isinstance(v, str) else F.lit(v)
    if height is not None:
        found = found.filter(F.col("__v") >= limit(height))
    if distance is not None and (isinstance(distance, str) or distance > 1):
        found = far_apart(found, "__v", distance if isinstance(distance, str) else int(distance), order, by)
    return (found if prominence is None else found.filter(F.col("__prominence") >= limit(prominence))).select(*names)


def register_find_peaks(spark, name: str = "find_peaks") -> None:
    """Registers a table function: find_peaks(values, height, prominence, distance) -> (idx, value)."""
    from pyspark.sql.functions import udtf

    ship(spark)

    class FindPeaks:
        def eval(self, values, height, prominence, distance):
            import numpy as np

            from pcgspark.functions import kernels

            x = np.asarray(values or [], float)
            for i in kernels.find_peaks(x, height, prominence, distance):
                yield int(i), float(x[i])

    spark.udtf.register(name, udtf(FindPeaks, returnType="idx bigint, value double"))
