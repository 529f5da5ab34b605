"""Spot-signature fingerprints.

Words are taken in lower case and without punctuation and symbols at their ends; a word of nothing else is none. At
every anchor (a very common word) a signature is the chain of the anchor and the next two content words, whatever
number of anchors stand between them (a break of line or tab beside a content word counts as an anchor without a
letter); a text's fingerprint is the set of its signatures' 64-bit hashes.

A text with fewer than FEW chains, or fewer than one in SPARSE words (another language, no spaces, lists, junk), also
gets chains at hash-chosen tokens: of each PICK consecutive ones that with the least hash, so that an edit changes only
chains near it. A token is a word; in scripts without spaces and in words of over LONG characters it is a character,
and chains that begin with a single character are longer. Only a text of fewer than CHAIN + 1 tokens and without a chain
has one signature of its whole lower-case text. Fingerprints are compared by Jaccard similarity.
``similar_pairs`` partitions the sets by length, so that a set's partners lie in its own partition and the two beside
it, and joins within a partition by an index of each set's rarest signatures.

Null texts are empty; all empty texts are equal. Repeated rows have equal fingerprints. Ties of doc_id are ordered by
text, and a null doc_id comes first; rows of one doc_id are dealt to one task. Very long texts are read whole; an empty
table stays empty. Other columns are ignored, whatever their names. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcgspark.llm.common import materialise

# Very common words of English, German, French and Spanish.
ANCHORS = (
    "a and at be by for in is it of on that the this to was with "
    "das dem den der des die im ist mit sich und von zu "
    "dans des du en est et la le les pour que qui un une "
    "con de del el las los no para por se y"
).split()
CHAIN = 2
_BREAK = "\n"
FEW, SPARSE = 3, 50
PICK, LONG, CHARACTERS = 4, 32, 6
_EDGE = r"[\p{P}\p{S}]"
# most characters fail the first look ahead, so that the costlier looks behind are for few
_STRIP = rf"(?={_EDGE})(?:(?<!\S){_EDGE}++(?:(?!\S)\s*+)?+|(?<!{_EDGE}){_EDGE}++(?!\S))"
# scripts are looked up only for characters from Thai on, the first of them
_UNSPACED = r"[\x{0E00}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]]"
_TOKEN = rf"[{_UNSPACED}]\p{{M}}*+|(?<![^\s{_UNSPACED}])[^\s{_UNSPACED}]{{1,{LONG}}}+(?![^\s{_UNSPACED}])|[^\s{_UNSPACED}]"
BUCKET_ROWS = 500
FREQUENCIES = 1 << 16  # counters of signatures, the order in which an index takes them
MAX_BUCKETS, SEGMENTS = 100_000, 64


def _chains(words: Column, anchors: list[str], then: Callable[[Column, Column], Column]) -> Column:
    """``then(hashes, number)`` of the chains: their hashes, equal ones too, and how many the runs of anchors have, of which
    each counts its different anchors. A break of line, tab or such beside a content word is an anchor without a letter.

    Words are told by a set and found by their places, without a regular expression and without making new strings: the
    j-th anchor, at place i, has i - j content words before it.
    """
    tokens = F.array_remove(F.split(F.regexp_replace(words, r"[\t\n\x0B\f\r]\s*+", f" {_BREAK} "), " "), "")
    anchor = lambda w: w.isin(anchors)
    beside = lambda w, i, x: (w != _BREAK) | (i == 0) | ~anchor(F.get(x, i - 1)) | ~anchor(F.get(x, i + 1))
    kept = _once(tokens, lambda x: F.when(F.array_contains(x, _BREAK), F.filter(x, lambda w, i: beside(w, i, x))).otherwise(x))
    stands = lambda w: w.isin([*anchors, _BREAK])
    parts = _once(kept, lambda x: F.struct(x.alias("w"), F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: stands(F.get(x, i))).alias("at"), F.filter(x, lambda w: ~stands(w)).alias("c")))

    def of(x: Column) -> Column:
        at = F.filter(x.at, lambda i, j: i - j + CHAIN <= F.size(x.c))
        word = lambda w: F.when(w == _BREAK, "").otherwise(w)
        hashed = lambda at: F.transform(at, lambda i, j: F.xxhash64(word(F.get(x.w, i)), *[F.get(x.c, i - j + k) for k in range(CHAIN)]))
        number = lambda at: F.size(F.array_distinct(F.transform(at, lambda i, j: F.xxhash64(F.get(x.w, i), i - j))))
        return _once(at, lambda at: _once(hashed(at), lambda h: then(h, number(at))))

    return _once(parts, of)


def _chosen(tokens: Column) -> Column:
    """Hashes of the chains at hash-chosen tokens."""

    def picked(x: Column) -> Column:
        starts = F.size(x.h) - CHAIN
        width = F.least(F.lit(PICK), starts)
        least = lambda i: F.array_min(F.slice(x.h, i, width))
        at = F.transform(F.sequence(F.lit(1), starts - width + 1), lambda i: (i - 1 + F.array_position(F.slice(x.h, i, width), least(i))).cast("int"))
        chain = lambda i: F.xxhash64(F.slice(x.t, i, F.when(F.length(F.element_at(x.t, i)) == 1, CHARACTERS).otherwise(CHAIN + 1)))
        return F.when(starts > 0, F.transform(F.array_distinct(at), chain)).otherwise(F.array().cast("array<bigint>"))

    hashed = _once(tokens, lambda t: F.struct(t.alias("t"), F.transform(t, lambda x: F.xxhash64(x)).alias("h")))
    return _once(hashed, picked)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, where ``value`` is evaluated once however often it is used."""
    return F.transform(F.array(value), then)[0]


def signatures(text: Column, anchors: list[str] = ANCHORS) -> Column:
    """The sorted set of signature hashes."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def of(words: Column) -> Column:
        def all_of(found: Column, number: Column) -> Column:
            # a word has two characters or more with its space, so longer texts with so many chains need no count
            maybe = lambda n: (n < FEW) | (n * (2 * SPARSE) < F.length(words))
            few = lambda n, t: (n < FEW) | (n * SPARSE < F.size(t))
            more = _once(F.regexp_extract_all(words, F.lit(_TOKEN), 0), lambda t: F.when(few(number, t), F.concat(found, _chosen(t))).otherwise(found))
            # different hashes are no more than chains, so where they are enough, chains are not counted
            return _once(F.array_distinct(found), lambda h: F.when(maybe(F.size(h)), F.array_distinct(more)).otherwise(h))

        return _chains(words, anchors, all_of)

    hashes = _once(F.regexp_replace(low, _STRIP, ""), of)
    return _once(hashes, lambda h: F.when(F.size(h) > 0, F.sort_array(h)).otherwise(F.array(F.xxhash64(low))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def render(s: Column) -> Column:
    """The low 32 bits of each signature in hex, in the set's order."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(0xFFFFFFFF))), 8, "0")), "")


def with_next(docs: DataFrame, columns: dict[str, str], order: list[str], key: str, derive: dict[str, Column] | None = None) -> DataFrame:
    """Adds, for each ``{name: column}``, the column's value in the next row by ``order`` (after the last: the first).
    ``derive`` names columns to be made once the rows are dealt, so that they aren't shuffled.

    Rows are dealt to consecutive ranges of ``key`` (a not-null number): between approximate percentiles, ranges of
    equal width. Of each range only the least key is known to all tasks (at most MAX_BUCKETS numbers are broadcast);
    rows with that key are also dealt to the range before, so every range finds its last row's successor itself.
    """
    known = F.when(F.col(key) > -(1 << 63), F.col(key))
    shape = docs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(known, [i / SEGMENTS for i in range(SEGMENTS + 1)], 10_000).alias("p")).first()
    buckets = max(1, min(MAX_BUCKETS, shape["n"] // BUCKET_ROWS))
    edges = sorted(set(shape["p"] or []))
    each = -(-buckets // max(1, len(edges) - 1))

    def bucket(lo: int, hi: int) -> Column:
        if hi - lo <= 1:
            width = max(1, edges[hi] - edges[lo]) / each
            place = F.floor((F.col(key).cast("double") - float(edges[lo])) / width)
            return F.lit(lo * each).cast("bigint") + F.greatest(F.lit(0), F.least(F.lit(each - 1), place))
        mid = (lo + hi) // 2
        return F.when(F.col(key) < edges[mid], bucket(lo, mid)).otherwise(bucket(mid, hi))

    placed = docs.withColumn("__own", bucket(0, len(edges) - 1) if buckets > 1 and len(edges) > 1 else F.lit(0).cast("bigint"))
    firsts = materialise(placed.groupBy("__own").agg(F.min(key).alias("__first")))  # at most MAX_BUCKETS + SEGMENTS rows
    in_turn = Window.orderBy("__own")
    firsts = firsts.select(F.col("__first"), F.lag("__own").over(in_turn).alias("__before"), F.max("__own").over(in_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__last"))
    met = placed.join(F.broadcast(firsts), F.col(key) == F.col("__first"), "left")
    place = lambda b, again, lap: F.struct(b.alias("b"), F.lit(again).alias("again"), lap.alias("lap"))
    own = place(F.col("__own"), False, F.lit(0))
    ahead = place(F.coalesce("__before", "__last"), True, F.when(F.col("__before").isNull(), 1).otherwise(0))
    places = F.when(F.col("__first").isNotNull(), F.array(own, ahead)).otherwise(F.array(own))
    dealt = met.withColumn("__place", F.explode(places)).drop("__own", "__first", "__before", "__last")
    dealt = dealt.withColumns({"__b": F.col("__place.b"), "__again": F.col("__place.again"), "__lap": F.col("__place.lap")}).drop("__place")
    dealt = dealt.repartition("__b").withColumns(derive or {})
    by = Window.partitionBy("__b").orderBy("__lap", *order)
    return dealt.withColumns({into: F.lead(column).over(by) for into, column in columns.items()}).filter("not __again").drop("__b", "__again", "__lap")


def fingerprints(docs: DataFrame) -> DataFrame:
    """The digest: fingerprints of each text and of its edited text, and their likeness."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("__key"))
    follow = with_next(base, {"__next": "text", "__n": "__s"}, ["__key", "text"], "__key", {"__s": signatures(F.col("text"))})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 4)))"), F.substring("__next", F.lit(1), cut))
    out = follow.withColumn("__edited", edited)
    out = out.withColumn("__e", signatures(F.col("__edited")))
    return out.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("__edited", 256).alias("edited_sha256"),
        render(F.col("__s")).alias("fingerprint"),
        render(F.col("__e")).alias("edited_fingerprint"),
        likeness(F.col("__s"), F.col("__e")).alias("near_edited"),
        likeness(F.col("__s"), F.col("__n")).alias("near_next"),
        F.size("__s").cast("bigint").alias("n_signatures"),
    )


def _partition(n: Column, threshold: float) -> Column:
    """Partition of a set of n signatures: each begins at 1 / threshold times the size at which the one before begins."""
    return F.floor(F.log(n.cast("double")) / F.lit(-math.log(threshold)) + 1e-9)


def _parity(s: str) -> list[Column]:
    """256 bits, each the parity of the signatures that fall on it."""
    return [F.expr(f"aggregate({s}, 0L, (b, x) -> b ^ if(((x >> 6) & 3) = {k}, shiftleft(1L, cast(x & 63 as int)), 0L))").alias(f"b{k}") for k in range(4)]


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, likeness) for classes of equal fingerprints, a < b their least doc_ids, at or above the threshold.

    A set is filed in the partition of its length and, if a larger partner may lie there, in the next one; so two sets
    that reach the threshold t meet in the partition of the larger. In one global order of signatures (rare first, by
    counters of their hashes) they share one of the first |s| - ceil(t |s|) + 1. Pairs of a bucket pass lossless filters
    on sizes and parity bits inside the join, and only then are sets compared.
    """
    spark = docs.sparkSession
    sets = docs.filter("doc_id is not null").select("doc_id", signatures(F.col("text")).alias("s")).groupBy("s").agg(F.min("doc_id").alias("doc_id"))
    sets = materialise(sets.select("doc_id", "s", F.size("s").alias("n")))
    counts = sets.select(F.explode("s").alias("g")).groupBy(F.pmod("g", F.lit(FREQUENCIES)).alias("at")).agg(F.count(F.lit(1)).alias("f"))
    counters = [0] * FREQUENCIES
    for r in counts.collect():  # at most FREQUENCIES rows
        counters[r["at"]] = min(r["f"], (1 << 31) - 1)
    table = F.broadcast(spark.createDataFrame([(1, counters)], "one int, counters array<int>"))
    least = F.ceil(F.col("n") * F.lit(threshold) - 1e-9)
    ordered = F.sort_array(F.transform("s", lambda x: F.struct(F.get("counters", F.pmod(x, F.lit(FREQUENCIES)).cast("int")).alias("f"), x.alias("g"))))
    part = _partition(F.col("n"), threshold)
    higher = _partition(F.floor(F.col("n") / F.lit(threshold) + 1e-9), threshold)
    prefix = sets.withColumn("one", F.lit(1)).join(table, "one").select("doc_id", "n", *_parity("s"), F.slice(ordered, F.lit(1), (F.col("n") - least + 1).cast("int")).alias("x"), F.array_distinct(F.array(part, higher)).alias("parts"), part.alias("own"))
    # both sides of the join read one shuffle of these rows, which are not stored besides
    filed = prefix.select("*", F.explode("parts").alias("part")).select("doc_id", "n", "b0", "b1", "b2", "b3", "own", "part", F.explode("x.g").alias("g"))
    a, b = (filed.select("part", "g", *[F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "n", "own", "b0", "b1", "b2", "b3")]) for x in "ab")
    total = F.col("a_n") + F.col("b_n")
    differ = sum((F.bit_count(F.col(f"a_b{k}").bitwiseXOR(F.col(f"b_b{k}"))) for k in range(1, 4)), F.bit_count(F.col("a_b0").bitwiseXOR(F.col("b_b0"))))
    alike = (F.least("a_n", "b_n") >= threshold * F.greatest("a_n", "b_n") - 1e-9) & (differ <= total * (1 - threshold) / (1 + threshold) + 1e-9)
    meets = F.col("part") == F.greatest("a_own", "b_own")
    pairs = materialise(a.join(b, ["part", "g"]).filter((F.col("a_doc_id") < F.col("b_doc_id")) & alike & meets).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b")).distinct())
    met = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("s_a")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("s_b")), "b")
    return met.select("a", "b", likeness(F.col("s_a"), F.col("s_b")).alias("likeness")).filter(F.col("likeness") >= threshold)
