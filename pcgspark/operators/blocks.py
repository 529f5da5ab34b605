"""One long series in many tasks: it is cut into blocks of consecutive places, a kernel works on each block, and where a result
depends on the whole series, blocks are summed up in a few numbers that combine like a monoid.

``order`` numbers the rows of a series from 0 without gaps. ``by`` names the series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from pcgspark.functions.shipping import ship
from pcgspark.operators.rolling import in_pieces

SIZE = 4096
BY = ("recording_id",)
PIECE, OWN = "__piece", "__own"


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by key to the session's number of shuffle partitions. Adaptive execution leaves a number that is asked for,
    while it would put small rows into few tasks, however long a kernel takes for them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Places at which a new group begins."""
    new = np.zeros(max(0, len(rows) - 1), bool)
    for k in keys if len(new) else []:
        a, b = (pa.concat_arrays(x.chunks) if x.num_chunks > 1 else x.chunk(0) for x in (rows[k][1:], rows[k][:-1]))
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | pc.xor(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new) + 1


def map_groups(rows: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table], pa.Table], schema: StructType | str) -> DataFrame:
    """``kernel`` on the rows of each group, in order. Groups follow each other in a task's batches, so many small ones cost
    little; a group is in memory as a whole, which is meant for blocks and for what sums up the blocks of a series."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the group that is not at its end yet

        def done(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
            parts = [kernel(table.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield from pa.concat_tables(parts).combine_chunks().to_batches(max_chunksize=1 << 16)

        for batch in batches:
            if not batch.num_rows:
                continue
            last = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            cuts = (_changes(pa.Table.from_batches([*last, batch]), keys) - len(last)).tolist()
            if cuts:
                end, before = cuts[-1], sum(x.num_rows for x in held)
                yield from done(pa.Table.from_batches([*held, batch.slice(0, end)]), [0, *[c + before for c in cuts if c + before]])
                held = [batch.slice(end)]
            else:
                held.append(batch)
        if held:
            table = pa.Table.from_batches(held)
            yield from done(table, [0, len(table)])

    return spread(rows, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def map_blocks(rows: DataFrame, kernel: Callable[[pa.Table], pa.Table], schema: StructType | str, before: int = 0, after: int = 0, order: str = "idx", by=BY, size: int = SIZE) -> DataFrame:
    """``kernel`` on each block of ``size`` places, with ``before`` and ``after`` rows of the blocks beside it, which have
    ``__own`` false; ``__piece`` is the block's number."""
    return map_groups(in_pieces(rows, order, size, before, after, PIECE, OWN), [*by, PIECE], [order], kernel, schema)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    """Doubles; null is NaN."""
    return np.concatenate([c.to_numpy(zero_copy_only=False) for c in table[column].chunks]).astype(float) if table.num_rows else np.empty(0)


def _fused(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """a * b + c, rounded once (see ``exprs.fused``)."""
    ah, bh = (134217729.0 * x - (134217729.0 * x - x) for x in (a, b))
    p = a * b
    error = ((ah * bh - p) + ah * (b - bh) + (a - ah) * bh) + (a - ah) * (b - bh)
    s = p + c
    return s + (((p - (s - (s - p))) + (c - (s - p))) + error)


# -- rolling quantiles ------------------------------------------------------------------------------------------------
def centred_quantile(rows: DataFrame, x: str, into: str, q: float, width: int, least: int = 3, order: str = "idx", by=BY) -> DataFrame:
    """Adds the exact quantile of a centred frame of ``width`` rows (of an even width, one more before); null with fewer than
    ``least`` values. Within a block the frame's sorted values gain one and lose one from row to row."""
    import pandas as pd

    def kernel(table: pa.Table) -> pa.Table:
        frame = pd.Series(numbers(table, x)).rolling(width, min_periods=min(least, width), center=True)
        low, high = (frame.quantile(q, interpolation=side).to_numpy() for side in ("lower", "higher"))
        place = (frame.count().to_numpy() - 1) * q
        share = place - np.floor(place)
        found = _fused(low, 1.0 - share, high * share)
        return table.append_column(into, pa.array(found, from_pandas=True, type=pa.float64())).filter(table[OWN]).drop_columns([PIECE, OWN])

    kind = StructType([*rows.schema.fields, StructField(into, DoubleType())])
    return map_blocks(rows, kernel, kind, width // 2, (width - 1) // 2, order, by, max(SIZE, 4 * width))


# -- prominence -------------------------------------------------------------------------------------------------------
def _stack(height: list[float], low: list[float]) -> tuple[list[float], list[bool], list[int]]:
    """For hills and the lowest points before them: the lowest point since the last strictly higher hill, whether there is
    none, and the hills that are seen from the end."""
    open_, out = [], []
    stack: list[int] = []
    reach: list[float] = []
    for i, (h, least) in enumerate(zip(height, low, strict=True)):
        while stack and height[stack[-1]] <= h:
            least = min(least, reach[stack.pop()])
        out.append(least)
        reach.append(least)
        open_.append(not stack)
        stack.append(i)
    return out, open_, stack


def _hills(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that no neighbour tops, both ends among them, and the least value from the last hill to each, and from each to
    the next."""
    wall = np.concatenate(([-np.inf], x, [-np.inf]))
    top = (wall[1:-1] >= wall[:-2]) & (wall[1:-1] >= wall[2:])
    top[0] = top[-1] = True
    at = np.flatnonzero(top)
    between = np.minimum.reduceat(x, at)  # from a hill to the one before the next
    return at, np.minimum(np.concatenate(([np.inf], between[:-1])), x[at]), between


_SIDES = ("low_l", "low_r", "open_l", "open_r")


def _block_prominence(table: pa.Table, x: str, flag: str) -> pa.Table:
    """Rows of flagged hills with the low points on both sides as far as the block goes, and rows of the block's records:
    hills that are seen from its end (kind 1) and from its start (kind 2). A flagged row that is no hill has no prominence."""
    values = numbers(table, x)
    at, before, after = _hills(values)
    height = values[at].tolist()
    low_l, open_l, right = _stack(height, before.tolist())
    low_r, open_r, left = _stack(height[::-1], after[::-1].tolist())
    low_r, open_r, left = low_r[::-1], open_r[::-1], [len(at) - 1 - i for i in left]
    flags = table[flag].to_numpy().astype(bool)
    mine = np.flatnonzero(flags[at])
    flags[at] = False
    chosen = np.concatenate((mine, right, left)).astype(int)
    flat = np.flatnonzero(flags)
    kind = np.repeat([0, 1, 2, 0], [len(mine), len(right), len(left), len(flat)])
    out = table.take(pa.array(np.concatenate((at[chosen], flat))))
    for name, found, level in zip(_SIDES, (low_l, low_r, open_l, open_r), (values, values, np.zeros(len(values), bool), np.zeros(len(values), bool)), strict=True):
        out = out.append_column(name, pa.array(np.concatenate((np.array(found)[chosen], level[flat]))))
    return out.append_column("kind", pa.array(kind.astype(np.int64))).drop_columns([OWN])


def _carried(rows: pa.Table, x: str, place: np.ndarray, side: str, record: int) -> np.ndarray:
    """Final low points of open hills, from the records of the blocks passed before; ``place`` orders rows along the way."""
    value, kind, piece = numbers(rows, x), rows["kind"].to_numpy(), rows[PIECE].to_numpy()
    low, open_ = rows[f"low_{side}"].to_numpy(), rows[f"open_{side}"].to_numpy()
    out = low.copy()
    way = np.argsort(place, kind="stable")
    seen: list[tuple[float, float]] = []
    piece_way = piece[way]
    for block in np.split(way, np.flatnonzero(piece_way[1:] != piece_way[:-1]) + 1):
        passed = np.inf
        records = block[kind[block] == record]
        for i in block[(kind[block] == 0) & open_[block]].tolist():
            while seen and seen[-1][0] <= value[i]:
                passed = min(passed, seen.pop()[1])
            out[i] = min(low[i], passed)
        for n, i in enumerate(records.tolist()):
            if n == 0:  # the block's highest
                while seen and seen[-1][0] <= value[i]:
                    passed = min(passed, seen.pop()[1])
            seen.append((value[i], min(low[i], passed) if n == 0 else low[i]))
    return out


def prominences(rows: DataFrame, flag: str, x: str, into: str = "prominence", order: str = "idx", by=BY) -> DataFrame:
    """The rows of which the boolean ``flag`` holds, with their prominence: the height above the higher of the two lowest
    points passed on the way to a strictly higher row (or the end) on either side; 0 where a neighbour is higher.

    Each block finds what lies in it by a stack over its hills. What is still open at a block's edge is one of the block's
    running maxima; these few meet the blocks' records in one task for each series, in which stacks are merged. Values are not
    null."""
    fields = rows.schema.fields
    sides = [StructField(c, DoubleType() if c.startswith("low") else BooleanType()) for c in _SIDES]
    met = map_blocks(rows, lambda t: _block_prominence(t, x, flag), StructType([*fields, StructField(PIECE, LongType()), *sides, StructField("kind", LongType())]), order=order, by=by)
    height = lambda: F.col(x) - F.greatest("low_l", "low_r")
    names = [f.name for f in fields]
    closed = met.filter("kind = 0 and not open_l and not open_r").select(*names, height().alias(into))

    def merge(table: pa.Table) -> pa.Table:
        place = table[order].to_numpy().astype(float)
        lows = np.maximum(_carried(table, x, place, "l", 1), _carried(table, x, -place, "r", 2))
        out = table.select(names).append_column(into, pa.array(numbers(table, x) - lows))
        return out.filter(pc.equal(table["kind"], 0))

    opened = map_groups(met.filter("kind > 0 or open_l or open_r"), list(by), [order], merge, StructType([*fields, StructField(into, DoubleType())]))
    return closed.unionByName(opened)


# -- band pass --------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=64)
def _coefficients(rate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    from pcgspark.functions import kernels

    b, a = kernels.bandpass(rate)
    return b / a[0], a / a[0], kernels.steady_state(b, a)


PAD = 15  # samples by which a signal is extended at either end: three times the filter's five coefficients
_FIELDS = {"__rate": pa.int32(), "__first": pa.bool_(), "__last": pa.bool_(), "__at": pa.int64(), "__x": pa.list_(pa.float64()), "__end": pa.list_(pa.float64()), "__start": pa.float64()}
_MAPPED = "__rate int, __first boolean, __last boolean, __at bigint, __x array<double>, __end array<double>, __start double"


def _run(x: np.ndarray, rate: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from pcgspark.functions import kernels

    b, a, _ = _coefficients(rate)
    return kernels.filtered(b, a, x, state)


def _row(table: pa.Table, keys: list[str], values: list) -> pa.Table:
    """One row of ``_FIELDS`` with the keys of a group's first."""
    out = table.slice(0, 1).select(keys)
    for (name, kind), v in zip(_FIELDS.items(), values, strict=True):
        out = out.append_column(name, pa.array([v], kind))
    return out


def _scanned(blocks: DataFrame, by, backward: bool) -> DataFrame:
    """(by, piece, __state): the state in which the filter comes to each block, by applying the blocks' maps one after another.
    Only the maps go to the task of a series."""
    keys = [*by, PIECE]

    def scan(table: pa.Table) -> pa.Table:
        from pcgspark.functions import kernels

        way = range(len(table) - 1, -1, -1) if backward else range(len(table))
        rates, ends, starts, sizes = (table[c].to_pylist() for c in ("__rate", "__end", "__start", "__size"))
        b, a, steady = _coefficients(rates[0])
        m, _ = kernels.transition(b, a)
        states, z = [[]] * len(table), None
        for i in way:
            z = steady * starts[i] if z is None else z
            states[i] = z.tolist()
            z = np.linalg.matrix_power(m, sizes[i]) @ z + np.array(ends[i])
        return table.select(keys).append_column("__state", pa.array(states, pa.list_(pa.float64())))

    small = blocks.select(*keys, "__rate", "__end", "__start", F.size("__x").alias("__size"))
    kinds = blocks.select(*keys).schema.fields
    return map_groups(small, list(by), [PIECE], scan, StructType([*kinds, StructField("__state", ArrayType(DoubleType()))]))


def band_pass(rows: DataFrame, x: str, rate: str, into: str = "filtered", order: str = "idx", by=BY, size: int = SIZE) -> DataFrame:
    """(by, order, into): the zero-phase band-passed signal of each series, whose sampling rate is ``rate``.

    The filter's recursion is an affine map of four numbers for each block. Blocks find their maps from a state of zero, the
    maps of a series are applied one after another, and then each block is filtered from its true state; first forward, then
    backward over the result. A signal that lies in one block is filtered at once. Signals of ``PAD`` samples or fewer are too
    short and left out; null samples count as 0.
    """
    keys = [*by, PIECE]
    key_kinds = [*rows.select(*by).schema.fields, StructField(PIECE, LongType())]
    mapped = StructType([*key_kinds, *StructType.fromDDL(_MAPPED).fields])
    slim = rows.select(*by, F.col(order).cast("bigint").alias(order), F.coalesce(F.nanvl(F.col(x).cast("double"), F.lit(0.0)), F.lit(0.0)).alias("__v"), F.col(rate).cast("int").alias("__rate"))

    def cut(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A block's places and own rows, and whether the signal begins and ends in it."""
        at, mine = table[order].to_numpy(), np.flatnonzero(table[OWN].to_numpy())
        # a block that has only rows of its neighbours begins beyond the end of the signal
        return at, mine, np.array([at[mine[0]] == 0, mine[-1] == len(at) - 1]) if len(mine) else np.zeros(2, bool)

    def widened(table: pa.Table, mine: np.ndarray, first: bool, last: bool) -> np.ndarray:
        values = numbers(table, "__v")
        ahead = 2 * values[0] - values[PAD:0:-1] if first else []
        behind = 2 * values[-1] - values[-2 : -PAD - 2 : -1] if last else []
        return np.concatenate((ahead, values[mine], behind))

    def pack(table: pa.Table) -> pa.Table:
        at, mine, ends = cut(table)
        r = table["__rate"][0].as_py()
        if not len(mine) or ends.all():
            return _row(table, keys, [r, False, False, 0, [], [], 0.0]).slice(0, 0)
        wide = widened(table, mine, *ends)
        _, end = _run(wide, r, np.zeros(4))
        return _row(table, keys, [r, bool(ends[0]), bool(ends[1]), int(at[mine[0]]), wide, end, wide[0]])

    def whole(table: pa.Table) -> pa.Table:
        at, mine, ends = cut(table)
        y = np.empty(0)
        if ends.all() and len(at) > PAD:
            wide, r = widened(table, mine, True, True), table["__rate"][0].as_py()
            steady = _coefficients(r)[2]
            y, _ = _run(wide, r, steady * wide[0])
            y = _run(y[::-1], r, steady * y[-1])[0][::-1][PAD : len(wide) - PAD]
        return table.select([*by, order]).slice(0, len(y)).append_column(into, pa.array(y))

    def forward(table: pa.Table) -> pa.Table:
        (row,) = table.to_pylist()
        y, _ = _run(np.array(row["__x"]), row["__rate"], np.array(row["__state"]))
        _, end = _run(y[::-1], row["__rate"], np.zeros(4))
        return _row(table, keys, [row["__rate"], row["__first"], row["__last"], row["__at"], y, end, y[-1]])

    def backward(table: pa.Table) -> pa.Table:
        (row,) = table.to_pylist()
        y = _run(np.array(row["__x"])[::-1], row["__rate"], np.array(row["__state"]))[0][::-1]
        y, at = y[PAD if row["__first"] else 0 : len(y) - (PAD if row["__last"] else 0)], row["__at"]
        same = table.select(list(by)).take(pa.array(np.zeros(len(y), np.int64)))
        return same.append_column(order, pa.array(np.arange(at, at + len(y)))).append_column(into, pa.array(y))

    out = StructType([*rows.select(*by).schema.fields, StructField(order, LongType()), StructField(into, DoubleType())])
    packed = map_blocks(slim, pack, mapped, PAD + 1, PAD + 1, order, by, size)
    once = map_groups(packed.join(_scanned(packed, by, False), keys).select(*packed.columns, "__state"), keys, [], forward, mapped)
    long = map_groups(once.join(_scanned(once, by, True), keys).select(*once.columns, "__state"), keys, [], backward, out)
    return map_blocks(slim, whole, out, PAD + 1, PAD + 1, order, by, size).unionByName(long)
