"""Jaccard self-join of documents on word shingles, by universe partition and pigeonhole.

Sets with similarity t or more differ in at most H = (1-t)/(1+t) * (|r|+|s|) shingles. The shingle universe (64-bit
hashes) is cut into segments by hash range, their number fixed for each band of set sizes (a power of two wide). A
set indexes the subsets in its first H+1 segments that aren't empty (all segments, if these are fewer), in the band of
its own size and, if a partner may be larger, in the next one. Two such sets have one in common: of the H+1 of the set
that stops first, at most H differ, and the other set has not stopped before the one that agrees. Which pairs are then
compared is decided by their costs:

1. copies (equal words, by SHA-256) are one class from the start, and one of them stands for all;
2. each member of a bucket (documents with equal subsets) is paired with the bucket's first document; verified links
   give classes, and a bucket is open if its members are of two classes or more. Then each member of an open bucket is
   paired with the bucket's hub, the member in the most open buckets, which links most of a family of near copies;
3. of two documents of an open bucket that of the smaller class searches for the other. A document's search costs as
   many pairs as its open buckets have members of other classes, and nothing where it ranks highest;
4. a document to which that costs more pairs than it has shingles and segments gets its neighbourhoods indexed, as do
   all members of its open buckets, where its partners are: the subsets of all segments, and each less one shingle. A
   document gives its segments weights 0, 1 (equal subsets are found) or 2 (also those that differ in one shingle);
   weights that add up to H+1 find every partner, since differing shingles use up H at most. The index's entries are
   counted, which gives the cost of each unit of weight, and the cheapest units are taken.

So no document meets more others than it has entries, unless the cheapest weights of all cost more. Pairs pass two
lossless filters (set sizes, and parity bits: sets that differ in d shingles differ in at most d bits). They are then
compared by their shingles' hashes, and those that pass by the words of their texts.

Words are maximal runs of characters other than space and U+0009-U+000D, A-Z in lower case; a text with fewer than k
words is one shingle; null and empty texts have none and link with nothing. Very long texts are read whole, one at a
time. Rows with one doc_id are one document, whatever their texts: it has the links of each, and each row gets the
document's component. A row with a null doc_id has its set's size, no links and a null component; an empty table gives an empty result. Ties go to
the least doc_id. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcgspark.llm.common import Scratch, bounded_batches, column_kernel, give_back, slices
from pcgspark.llm.components import components
from pcgspark.llm.wordkernel import U64, find_words, mix, raw, window_hash

SLICE_BYTES = 1 << 20  # text that a kernel takes at once; its arrays are some fifty times as large
LOCAL = 8  # members of a segment in one slice of texts from which on the task sends one and holds the others back
REMEMBERED = 1 << 20  # copies and held segments that a task remembers; beyond it sends more rows than it need
SURPLUS = 15  # per cent of segments beyond the needed ones
ENTRY_COST = 1  # pairs that an entry of the index of neighbourhoods costs as much as
GROUP = 512  # members verified with one copy of their centre
BROADCAST_ROWS = 200_000  # pairs (40 bytes) that may be broadcast to fetch texts
WIDE_FROM, WIDE_BITS = 512, 4096  # sets of so many shingles also have so many parity bits, since 256 are soon used up
_SEGMENT, _BAND, _DELETED = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Spec:
    """Shingles of k words; similarity num/den or more."""

    k: int
    num: int
    den: int

    def most_different(self, total):
        return (self.den - self.num) * total // (self.den + self.num)

    def segments(self, low):
        """Segments of the band of sizes low .. 2 low - 1."""
        least = self.most_different(2 * (2 * low - 1)) + 1
        return least + least * SURPLUS // 100 + np.where(least > 4, 2, 0)

    def needed(self, n, low):
        """Weight that a set of n shingles needs in a band: one more than the shingles it may differ in."""
        partner = np.minimum(2 * low - 1, n * self.den // self.num)
        return self.most_different(n + partner) + 1


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and the text of each."""
    data, offsets = raw(column)
    words = find_words(data, offsets, lower=True)
    hashes, first = words.windows(k)
    docs = words.docs[first] if len(first) else np.empty(0, np.int64)
    parts_h, parts_d = [hashes], [docs]
    for j in range(1, k):
        short = np.flatnonzero(words.counts == j)
        if len(short):
            at = words.first[short]
            parts_h.append(window_hash([words.hashes[at + i] for i in range(j)]))
            parts_d.append(short)
    h, d = np.concatenate(parts_h), np.concatenate(parts_d)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def similar(a: list[bytes], b: list[bytes], spec: Spec) -> bool:
    """Whether the shingle sets of two word lists reach the similarity, by the words themselves."""
    if a == b:
        return bool(a)
    x, y = ({b" ".join(w[i : i + spec.k]) for i in range(max(1, len(w) - spec.k + 1))} for w in (a, b))
    common = len(x & y)
    return bool(a and b) and spec.den * common >= spec.num * (len(x) + len(y) - common)


def _segment_of(h: np.ndarray, m) -> np.ndarray:
    return (((h >> U64(32)) * np.asarray(m).astype(U64)) >> U64(32)).astype(np.int64)


def signature(sums, index, low):
    return mix(mix(sums + np.asarray(index).astype(U64) * _SEGMENT) + np.asarray(low).astype(U64) * _BAND)


def _subsets(h: np.ndarray, d: np.ndarray, docs: np.ndarray, low: np.ndarray, count: int, spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of the documents ``docs`` in the bands ``low``, where each subset starts, its segment and its row of ``docs``."""
    row = np.full(count, -1, np.int64)
    row[docs] = np.arange(len(docs))
    of = row[d]
    h, of = h[of >= 0], of[of >= 0]
    if not len(h):
        return h, np.empty(0, np.int64), np.empty(0, np.int64), of
    seg = _segment_of(h, spec.segments(low)[of])
    starts = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (of[1:] != of[:-1]))))
    return h, starts, seg[starts], of[starts]


def segment_signatures(h: np.ndarray, d: np.ndarray, n: np.ndarray, docs: np.ndarray, low: np.ndarray, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the indexed subsets of ``docs`` in the bands ``low``, and their documents."""
    h, starts, seg, of = _subsets(h, d, docs, low, len(n), spec)
    if not len(starts):
        return np.empty(0, U64), np.empty(0, np.int64)
    need, sums = spec.needed(n[docs], low), np.add.reduceat(mix(h), starts)
    filled = np.bincount(of, minlength=len(docs))
    keep = np.arange(len(of)) - np.concatenate(([0], np.cumsum(filled)))[of] < need[of]
    sums, segs, of = [sums[keep]], [seg[keep]], [of[keep]]
    for r in np.flatnonzero(filled < need):  # the empty segments count as well
        empty = np.setdiff1d(np.arange(spec.segments(low[r])), segs[0][of[0] == r])
        sums.append(np.zeros(len(empty), U64))
        segs.append(empty)
        of.append(np.full(len(empty), r))
    sums, segs, of = (np.concatenate(x) for x in (sums, segs, of))
    return signature(sums, segs, low[of]), docs[of]


def bands(n: np.ndarray, spec: Spec) -> list[tuple[np.ndarray, np.ndarray]]:
    """(documents, low end of the band) for the band of each size and for the next if a partner may lie there."""
    some = np.flatnonzero(n)
    low = np.left_shift(1, np.floor(np.log2(np.maximum(n[some], 1))).astype(np.int64))
    higher = n[some] * spec.den // spec.num >= 2 * low
    return [(some, low), (some[higher], 2 * low[higher])]


PARITY = ["b0", "b1", "b2", "b3"]
INDEX = (
    "i bigint, doc_id bigint, t bigint, digest binary, n bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint, wide array<bigint>, "
    "leads boolean, sent array<struct<sig:bigint,code:tinyint>>, held array<struct<sig:bigint,code:tinyint,center:bigint>>"
)
LED = 2  # in a code: the band (0 or 1), and this where others are held back with this member as their centre


class Indexer:
    """Indexes slices of texts; lives as long as a task, whose rows it numbers. It remembers the task's copies, whose
    subsets it sends once, and the segments with many members, of which it sends one and holds back the others with
    that one as centre."""

    def __init__(self, spec: Spec, task: int = 0):
        self.spec = spec
        self.next = task << 33
        self.copies: set[bytes] = set()
        self.sigs, self.centers = np.empty(0, U64), np.empty(0, np.int64)

    def _lead(self, digests: list[bytes]) -> np.ndarray:
        lead = np.zeros(len(digests), bool)
        here: set[bytes] = set()
        for i, x in enumerate(digests):
            if x not in self.copies and x not in here:
                lead[i] = True
                here.add(x)
        if len(self.copies) + len(here) <= REMEMBERED:
            self.copies |= here
        return lead

    def index(self, part: pa.RecordBatch) -> pa.RecordBatch:
        spec, count = self.spec, part.num_rows
        ids = np.arange(self.next, self.next + count)
        self.next += count
        h, d = shingle_sets(part.column("text"), spec.k)
        n = np.bincount(d, minlength=count).astype(np.int64)
        digests = [hashlib.sha256(b" ".join(plain_words(x))).digest() for x in part.column("text").to_pylist()]
        parity = np.bincount(d * 256 + (h & U64(255)).astype(np.int64), minlength=count * 256) & 1
        bits = np.packbits(parity.astype(np.uint8)).view(np.int64).reshape(count, 4)
        lead = self._lead(digests)
        large = np.flatnonzero((n >= WIDE_FROM) & lead)
        row = np.full(count, -1, np.int64)
        row[large] = np.arange(len(large))
        of = row[d]
        at = of[of >= 0] * WIDE_BITS + ((h[of >= 0] >> U64(8)) & U64(WIDE_BITS - 1)).astype(np.int64)
        wide = np.packbits((np.bincount(at, minlength=len(large) * WIDE_BITS) & 1).astype(np.uint8)).view(np.int64)
        wide = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(row >= 0, WIDE_BITS // 64, 0)))), pa.int32()), pa.array(wide))

        parts = [(*segment_signatures(h, d, n, docs, low, spec), band) for band, (docs, low) in enumerate(bands(np.where(lead, n, 0), spec))]
        s, of = (np.concatenate([x[j] for x in parts]) for j in (0, 1))
        code = np.concatenate([np.full(len(x[0]), x[2], np.int8) for x in parts])
        order = np.lexsort((of, s))
        s, of, code = s[order], of[order], code[order]
        known, center = self._known(s)
        head = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.empty(0, bool)
        starts = np.flatnonzero(head)
        sizes = np.diff(np.append(starts, len(s)))
        big = np.repeat(sizes >= LOCAL, sizes) & ~known
        center[big] = ids[of[np.repeat(starts, sizes)[big]]]
        led = big & head
        held = (big & ~head) | known
        code[led] += LED
        self._remember(s[led], ids[of[led]])

        def lists(mask: np.ndarray, columns: dict[str, np.ndarray]) -> pa.ListArray:
            at = np.flatnonzero(mask)
            at = at[np.argsort(of[at], kind="stable")]
            bounds = np.concatenate(([0], np.cumsum(np.bincount(of[at], minlength=count))))
            return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(c[at]) for c in columns.values()], list(columns)))

        signed = s.view(np.int64)
        columns = [pa.array(ids), part.column("doc_id"), part.column("t"), pa.array(digests, pa.binary()), pa.array(n), *[pa.array(np.ascontiguousarray(bits[:, j])) for j in range(4)]]
        columns += [wide, pa.array(lead), lists(~held, {"sig": signed, "code": code}), lists(held, {"sig": signed, "code": code, "center": center})]
        return pa.record_batch(columns, names=["i", "doc_id", "t", "digest", "n", *PARITY, "wide", "leads", "sent", "held"])

    def _known(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.sigs):
            return np.zeros(len(s), bool), np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.sigs, s), len(self.sigs) - 1)
        return self.sigs[at] == s, self.centers[at]

    def _remember(self, s: np.ndarray, ids: np.ndarray) -> None:
        if not len(s) or len(self.sigs) + len(s) > REMEMBERED:
            return
        sigs, centers = np.concatenate((self.sigs, s)), np.concatenate((self.centers, ids))
        order = np.argsort(sigs, kind="stable")
        self.sigs, self.centers = sigs[order], centers[order]


def neighbourhoods(part: pa.RecordBatch, spec: Spec, deep: bool) -> pa.RecordBatch:
    """(i, low, over, seg, key, kind) for every segment of each text: kind 0 is the subset; with ``deep``, kind 1 is the
    subset less one shingle. ``over`` is the needed weight less the units of weight that the band's segments can take."""
    h, d = shingle_sets(part.column("text"), spec.k)
    n = np.bincount(d, minlength=part.num_rows).astype(np.int64)
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    for docs, low in bands(n, spec):
        if not len(docs):
            continue
        flat, starts, seg, of = _subsets(h, d, docs, low, len(n), spec)
        values = mix(flat)
        m = np.asarray(spec.segments(low))
        first = np.concatenate(([0], np.cumsum(m)))
        sums = np.zeros(first[-1], U64)  # of every segment, empty ones too
        cell = first[of] + seg
        sums[cell] = np.add.reduceat(values, starts)
        doc = np.repeat(np.arange(len(docs)), m)
        number = np.arange(first[-1]) - first[doc]
        over = spec.needed(n[docs], low) - (2 if deep else 1) * m
        rows = [(0, signature(sums + _DELETED, number, low[doc]), np.arange(first[-1]))]
        if deep:
            each = np.repeat(cell, np.diff(np.append(starts, len(flat))))
            rows.append((1, signature(sums[each] - values + _DELETED, number[each], low[doc[each]]), each))
        for kind, key, at in rows:
            for column, x in zip(out, (docs[doc[at]], low[doc[at]], over[doc[at]], number[at], key.view(np.int64), np.full(len(at), kind)), strict=True):
                column.append(x)
    doc, low, over, seg, key, kind = (np.concatenate([np.empty(0, np.int64), *x]) for x in out)
    columns = [part.column("i").take(pa.array(doc)), pa.array(low), pa.array(over), pa.array(seg), pa.array(key), pa.array(kind, pa.int8())]
    return pa.record_batch(columns, names=["i", "low", "over", "seg", "key", "kind"])


def _alike(spec: Spec, a: str, b: str) -> Column:
    """The lossless filters on two rows with n and b0 .. b3."""
    differ = sum((F.bit_count(F.col(f"{a}{p}").bitwiseXOR(F.col(f"{b}{p}"))) for p in PARITY[1:]), F.bit_count(F.col(f"{a}b0").bitwiseXOR(F.col(f"{b}b0"))))
    total = F.col(f"{a}n") + F.col(f"{b}n")
    sized = F.least(f"{a}n", f"{b}n") * spec.den >= F.greatest(f"{a}n", f"{b}n") * spec.num
    return sized & (differ * (spec.den + spec.num) <= total * (spec.den - spec.num))


def _alike_wide(spec: Spec) -> Column:
    """The parity filter again on the wide bits, which only large sets have."""
    both = (F.size("a_wide") > 0) & (F.size("b_wide") > 0)
    differ = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    total = F.col("a_n") + F.col("b_n")
    return F.when(both, differ * (spec.den + spec.num) <= total * (spec.den - spec.num)).otherwise(True)


def _side(df: DataFrame, prefix: str, key: str = "sig") -> DataFrame:
    return df.select(key, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c != key])


def _higher(a: str, b: str) -> Column:
    """Whether b ranks higher than a and is of another class: its class is the larger."""
    more, equal = F.col(f"{b}members") > F.col(f"{a}members"), F.col(f"{b}members") == F.col(f"{a}members")
    return more | (equal & (F.col(f"{b}class") > F.col(f"{a}class")))


class Join:
    """One run of the join; ``keep`` stores its tables. Texts are known by the number ``i`` of their row in the index.

    Joins with a table of all texts or all members are merge joins, so that the plan is the same at every size.
    """

    def __init__(self, docs: DataFrame, spec: Spec, keep: Scratch):
        self.spec, self.keep = spec, keep
        self.texts = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("t"), "text")

    def _kernel(self, rows: DataFrame, kernel, schema: str) -> DataFrame:
        """``rows`` through ``kernel`` on slices of texts; ``kernel(number of the task)`` gives the function for a task."""
        bounded_batches(rows.sparkSession)

        def run(batches):
            from pyspark import TaskContext

            of_task = kernel(TaskContext.get().partitionId())
            for batch in batches:
                for part in slices(batch, limit=SLICE_BYTES):
                    yield of_task(part)
                    give_back()  # a slice's arrays are large
            del of_task
            give_back()

        return self.keep(rows.mapInArrow(run, schema))

    def index(self) -> None:
        """``rows``: the index; ``equal``: copies and what stands for them; ``facts``: texts that stand for themselves;
        ``members``: of buckets of two or more, with a centre to link them by."""
        spec = self.spec
        self.rows = self._kernel(self.texts, lambda task: Indexer(spec, task).index, INDEX)
        some = self.rows.filter("n > 0")
        least = some.groupBy("digest").agg(F.min(F.when(F.col("leads"), F.col("i"))).alias("b"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
        # tables, not subplans, on either side of a join: only then Spark can split a large group
        self.equal = self.keep(some.select("digest", F.col("i").alias("a")).join(self.keep(least), "digest").filter("a <> b").select("a", "b"))
        facts = some.filter("leads").select("i", "n", *PARITY, "wide")
        self.facts = self.keep(facts.join(self.equal.select(F.col("a").alias("i")).hint("merge"), "i", "left_anti"))
        # one number for a text and its code keeps the shuffle of the index small
        sent = self.rows.select("i", F.explode("sent").alias("x")).select("x.sig", (F.col("i") * 4 + F.col("x.code")).alias("k"))
        by_sig = Window.partitionBy("sig")
        met = sent.select("sig", "k", F.min("k").over(by_sig).alias("first"), F.max("k").over(by_sig).alias("last"))
        # a held member needs its centre's row, also if that is alone
        met = met.filter((F.col("first") != F.col("last")) | (F.col("k").bitwiseAND(LED) > 0))
        buckets = met.select("sig", F.shiftright("k", 2).alias("i"), F.shiftright("first", 2).alias("center"))
        held = self.rows.select("i", F.explode("held").alias("x")).select("x.sig", "i", "x.center")
        self.members = self.keep(buckets.unionByName(held))

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) that pass the filters with the wide bits. Texts that another one stands for drop out."""
        pairs = self.keep(pairs.select("a", "b").filter("a <> b").distinct())
        for side in "ab":
            pairs = pairs.join(_side(self.facts, side, "i").withColumnRenamed("i", side).hint("merge"), side)
        return pairs.filter(_alike(self.spec, "a_", "b_") & _alike_wide(self.spec)).select("a", "b")

    def _fetch(self, wanted: DataFrame, on: str) -> DataFrame:
        """``wanted`` with the text of the row numbered ``on``. Only a small table of numbers is broadcast."""
        ids = self.rows.select(F.col("i").alias(on), "doc_id", "t")
        wanted = self.keep(wanted.join(ids.hint("merge"), on))
        small = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        return self.texts.join(F.broadcast(wanted) if small else wanted, ["doc_id", "t"]).drop("doc_id", "t")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts' sets reach the similarity. b is the centre; its members are verified in groups."""
        spec = self.spec
        pairs = self.keep(pairs)
        groups = self.keep(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("members")))
        salted = pairs.join(groups, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("members") / GROUP)).alias("salt"))
        wanted = salted.select("a", "b", "salt", F.lit(1).alias("role"))
        wanted = wanted.unionByName(salted.select(F.col("b").alias("a"), "b", "salt", F.lit(0).alias("role")).distinct())
        dealt = self._fetch(wanted, "a").repartition("b", "salt").sortWithinPartitions("b", "salt", "role").select("a", "text", "b", "role")

        def kernel(_):
            center, center_set, center_words = None, np.empty(0, U64), []

            def run(part: pa.RecordBatch) -> pa.RecordBatch:
                nonlocal center, center_set, center_words
                h, d = shingle_sets(part.column("text"), spec.k)
                bounds = np.searchsorted(d, np.arange(part.num_rows + 1))
                met: list[int] = []
                rows = zip(*(part.column(c).to_pylist() for c in ("text", "b", "role")), strict=True)
                for i, (text, b, role) in enumerate(rows):
                    own = h[bounds[i] : bounds[i + 1]]
                    if role == 0:
                        center, center_set, center_words = b, own, plain_words(text)
                    elif center == b:
                        common = len(np.intersect1d(own, center_set, assume_unique=True))
                        if spec.den * common >= spec.num * (len(own) + len(center_set) - common) and similar(plain_words(text), center_words, spec):
                            met.append(i)
                at = pa.array(met, pa.int64())
                return pa.record_batch([part.column("a").take(at), part.column("b").take(at)], names=["a", "b"])

            return run

        return self._kernel(dealt, kernel, "a bigint, b bigint")

    def _open(self, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(i, class) of all texts, and the members (sig, i, class) of buckets of two classes or more."""
        classes = components(links, self.keep).select(F.col("node").alias("i"), F.col("component").alias("class"))
        of = self.keep(self.facts.select("i").join(classes.hint("merge"), "i", "left").select("i", F.coalesce("class", "i").alias("class")))
        rows = self.keep(self.buckets.join(of.hint("merge"), "i"))
        mixed = rows.groupBy("sig").agg(F.min("class").alias("x"), F.max("class").alias("y")).filter("x <> y").select("sig")
        return of, self.keep(rows.join(self.keep(mixed).hint("merge"), "sig"))

    def by_hubs(self, links: DataFrame) -> DataFrame:
        """Links of members of open buckets with the bucket's hub, the member that is in the most open buckets: of many
        near copies of one text the one nearest to it, with which most of them link."""
        _, rows = self._open(links)
        self.buckets = rows.drop("class")
        rank = self.keep(rows.groupBy("i").agg(F.count(F.lit(1)).alias("buckets")))
        rows = self.keep(rows.join(rank.hint("merge"), "i"))
        hub = self.keep(rows.groupBy("sig").agg(F.max(F.struct("buckets", "i", "class")).alias("hub")))
        pairs = rows.join(hub, "sig").filter("class <> hub.class").select(F.col("i").alias("a"), F.col("hub.i").alias("b"))
        return self.verify(self.filtered(pairs))

    def open_members(self, links: DataFrame) -> None:
        """Members of buckets of two classes or more: sig, i, class, members of the class, n, parity."""
        of, rows = self._open(links)
        sizes = self.keep(of.groupBy("class").agg(F.count(F.lit(1)).alias("members")))
        facts = self.keep(self.facts.drop("wide").join(of.hint("merge"), "i").join(sizes.hint("merge"), "class"))
        self.open = self.keep(rows.drop("class").join(facts.hint("merge"), "i"))

    def price(self) -> DataFrame:
        """What each document's search costs: i, sigs to ask, cost, own (class and facts)."""
        by_class = self.keep(self.open.groupBy("sig", "members", "class").agg(F.count(F.lit(1)).alias("mine")))
        by_sig = by_class.groupBy("sig").agg(F.sum("mine").alias("every"), F.max(F.struct("members", "class")).alias("top"))
        priced = by_class.join(self.keep(by_sig), "sig").filter(F.struct("members", "class") < F.col("top"))
        priced = self.keep(priced.select("sig", "class", (F.col("every") - F.col("mine")).alias("cost")))
        own = F.struct("class", "members", "n", *PARITY)
        asks = self.open.join(priced, ["sig", "class"]).groupBy("i").agg(F.collect_set("sig").alias("sigs"), F.sum("cost").alias("cost"), F.first(own).alias("own"))
        return self.keep(asks)

    def _meet(self, asking: DataFrame, asked: DataFrame, key: str) -> DataFrame:
        """Pairs of a row of ``asking`` (key, i, own) and one of ``asked`` that ranks higher in another class."""
        a = asking.select(key, F.col("i").alias("a"), *[F.col(f"own.{c}").alias(f"a_{c}") for c in ("class", "members", "n", *PARITY)])
        b = _side(asked.select(key, "i", "class", "members", "n", *PARITY), "b", key)
        met = a.join(b, key).filter(_higher("a_", "b_") & _alike(self.spec, "a_", "b_"))
        return met.select("a", F.col("b_i").alias("b"))

    def search(self) -> DataFrame:
        """Pairs (a, b) of different classes that may be similar: all that are, and others."""
        priced = self.price()
        dear = F.col("cost") > ENTRY_COST * F.col("own.n")
        found = self._meet(priced.filter(~dear).select(F.explode("sigs").alias("sig"), "i", "own"), self.open, "sig")
        searching = priced.filter(dear).drop("cost")
        for deep in (False, True):
            searching = self.keep(searching)
            if searching.isEmpty():
                break
            more, searching = self._deal(searching, deep)
            found = found.unionByName(more)
        return found

    def _deal(self, searching: DataFrame, deep: bool) -> tuple[DataFrame, DataFrame]:
        """Deals weights of 0 and 1, with ``deep`` also 2, to all segments of the documents ``searching``, and returns the
        pairs they meet and, unless ``deep``, the documents that are still too dear."""
        spec = self.spec
        reach = self.keep(searching.select(F.explode("sigs").alias("sig")).distinct())
        told = self.keep(self.open.join(reach.hint("merge"), "sig", "left_semi").drop("sig").dropDuplicates(["i"]))
        near = self._kernel(self._fetch(told.select("i"), "i"), lambda _: lambda part: neighbourhoods(part, spec, deep), "i bigint, low bigint, over bigint, seg bigint, key bigint, kind tinyint")
        # a key that stands for no whole subset, or for one alone, costs nothing, so most entries drop out here
        often = self.keep(near.groupBy("key").agg(F.sum(1 - F.col("kind")).alias("whole"), F.sum("kind").alias("less")).filter("whole > 0 and whole + less > 1"))
        mine = near.join(searching.select("i"), "i").join(often, "key")
        # the second unit of weight costs no less than the first, which it includes
        cost = {1: F.when(F.col("kind") == 0, F.col("whole") - 1).otherwise(0), 2: F.when(F.col("kind") == 0, F.col("whole") + F.col("less") - 1).otherwise(F.col("whole"))}
        cost = {w: c for w, c in cost.items() if deep or w == 1}
        segs = mine.groupBy("i", "low", "over", "seg").agg(*[F.sum(c).alias(f"cost{w}") for w, c in cost.items()])
        units = F.filter(F.array(*[F.struct(F.col(f"cost{w}").alias("cost"), F.lit(w).alias("weight"), "seg") for w in cost]), lambda u: u.cost > 0)
        dealt = segs.groupBy("i", "low").agg(F.array_sort(F.flatten(F.collect_list(units))).alias("u"), F.first("over").cast("int").alias("over"))
        # units without a cost are taken first and only counted
        dealt = self.keep(dealt.select("i", "low", F.slice("u", F.lit(1), F.greatest(F.lit(0), F.col("over") + F.size("u"))).alias("u")))
        still = dealt.groupBy("i").agg(F.sum(F.aggregate("u", F.lit(0).cast("bigint"), lambda t, x: t + x.cost)).alias("cost")).join(searching, "i")
        still = self.keep(still.select("i", "sigs", "own", (F.lit(not deep) & (F.col("cost") > ENTRY_COST * F.col("own.n"))).alias("dear")))
        taken = dealt.join(still.filter("not dear").select("i", "own"), "i").select("i", "own", "low", F.explode("u").alias("u"))
        taken = taken.groupBy("i", "low", "u.seg").agg(F.max("u.weight").alias("weight"), F.first("own").alias("own"))
        asks = self.keep(near.join(taken, ["i", "low", "seg"]).filter("weight = 2 or kind = 0").select("key", "kind", "weight", "i", "own"))
        found = None
        for kind in (0, 1) if deep else (0,):
            asking = asks.filter("kind = 0 and weight = 2") if kind else asks
            asked = near.filter(f"kind = {kind}").select("key", "i").join(asking.select("key"), "key", "left_semi")
            met = self._meet(asking, self.keep(asked.join(told.hint("merge"), "i")), "key")
            found = met if found is None else found.unionByName(met)
        return found, still.filter("dear").drop("dear")

    def links(self) -> DataFrame:
        """Verified links (a, b) that connect every class of texts."""
        self.index()
        # a centre may be a copy that does not stand for its class
        stands = self.equal.select(F.col("a").alias("center"), F.col("b").alias("rep"))
        first = self.members.select("i", "center").filter("i <> center").distinct().join(stands, "center", "left")
        first = first.select(F.col("i").alias("a"), F.coalesce("rep", "center").alias("b"))
        links = self.keep(self.verify(self.filtered(first)).unionByName(self.equal))
        self.buckets = self.members.select("sig", "i")
        links = self.keep(self.by_hubs(links).unionByName(links))
        self.open_members(links)
        return self.keep(self.verify(self.filtered(self.search())).unionByName(links))

    def classes(self, links: DataFrame) -> DataFrame:
        """(i, doc_id, t, least): each linked text with the least doc_id of its class."""
        of = self.keep(self.rows.select("i", "doc_id", "t").join(components(links, self.keep).select(F.col("node").alias("i"), "component"), "i"))
        least = self.keep(of.groupBy("component").agg(F.min("doc_id").alias("least")))
        return of.join(least, "component").select("i", "doc_id", "t", "least")


def join_classes(docs: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, n_shingles, component_id for every input row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with Scratch(docs.sparkSession) as keep:
        join = Join(docs, spec, keep)
        links = join.links()
        # the texts of one document are linked through it
        several = join.rows.groupBy("doc_id").agg(F.min("i").alias("b"), F.max("i").alias("last")).filter("b <> last").drop("last")
        own = join.rows.select("doc_id", F.col("i").alias("a")).join(keep(several), "doc_id").filter("a <> b").select("a", "b")
        least = join.classes(links.unionByName(own)).select("i", "least")
        out = join.rows.select("i", "doc_id", "n").join(least, "i", "left")
        out = keep.result(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id")))
    # a row without an id has the size of its set, and no component, since that is an id
    lost = docs.filter("doc_id is null").select("doc_id", set_sizes("text", spec).alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    return out.unionByName(lost)


def set_sizes(text: str, spec: Spec) -> Column:
    """The number of a text's distinct shingles."""

    def kernel(column: pa.Array) -> pa.Array:
        return pa.array(np.bincount(shingle_sets(column, spec.k)[1], minlength=len(column)).astype(np.int64))

    return column_kernel(kernel, "bigint")(F.col(text))


def keep_one(docs: DataFrame, spec: Spec) -> DataFrame:
    """The rows of ``docs`` without those whose text is in a class with a text of a lesser doc_id."""
    with Scratch(docs.sparkSession) as keep:
        join = Join(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), spec, keep)
        dropped = join.classes(join.links()).filter("doc_id <> least").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"))
        dropped = keep.result(dropped.distinct())
    return docs.join(dropped, (F.col("doc_id").cast("bigint") == F.col("__id")) & (F.xxhash64("text") == F.col("__t")), "left_anti")
