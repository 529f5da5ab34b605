"""Phrases that occur together more than their parts explain, mined over positional inverted lists.

Texts in lower case (A-Z only) are split at punctuation and line ends into pieces, and these at blanks into words. Words of
a block of texts are numbered in order, with a free number wherever a piece ends; a word's list in a block is the array of
its places (the vertical layout). A block's lists are stored once, packed into one value, beside a row for each list with
its length. A list's length is a count, so summing lengths gives exact frequencies without touching places.

A phrase grows by a word: in each block the lists of frequent phrases, moved by the phrase's length, are merged with the
lists of adjacent frequent words, and places on both make the lists of the longer phrases. A place counts only if a frequent
phrase of the same length begins at the next place too, since the longer phrase is not frequent otherwise. Lengths of a
level are summed over blocks before the next one. No list leaves its block, so a very common word is as long as its share of a
block; what goes through joins are rows (block, number of the list, words, length), one for a list. The lists of phrases are
built anew from those of words at each level, which is cheaper than storing them.

Each phrase is cut after its first k words; a cut's score is floor(10^6 a^2 / (l r)), with the phrase's frequency a and
those of its parts. The least score counts, of equals the first cut. Products are decimals of 38 digits, exact up to a = 10^15.
A phrase that lies in a longer one with at least ``inside`` percent of its occurrences is left out; it is enough to look at
phrases longer by one word, since a still longer one holds such a one that is at least as frequent.

Null languages are ``und``; null and empty texts have no words. Very long texts stand in a block of their own. Repeated rows
count as often as they occur, ties are ordered by frequency and then by phrase in bytes, and no other columns are read. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcgspark.llm.common import Scratch, bounded_batches

BLOCK_BYTES = 8 << 20  # of text in a block
NO_LANG = "und"
SALTS = (128, 4)  # groups of a language whose best phrases are taken first
MARK = "\n"  # between pieces; no word holds one
ROWS = 1 << 16  # of an Arrow batch that leaves a kernel
_INDEX = "block bigint, g bigint, lang string, word string, n bigint, data binary"


# -- lists of a block -------------------------------------------------------------------------------------------------
def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts, counts) of equal keys; the order within a key is kept."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(key) else np.empty(0, np.int64)
    return order, starts, np.diff(np.append(starts, len(key)))


def pack(counts: np.ndarray, places: np.ndarray) -> bytes:
    """Lists one after another, as lengths and differences."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(([len(counts)], counts, np.diff(places, prepend=0))).astype(np.int32).tobytes())


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.int32)
    return flat[1 : flat[0] + 1], np.cumsum(flat[flat[0] + 1 :], dtype=np.int64)


def block_lists(text: pa.Array, lang: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """The lists of one block's words: their languages, words, lengths and places."""
    large = pa.large_string()
    lowered = pc.ascii_lower(pc.fill_null(text, "").cast(large))
    marked = pc.replace_substring_regex(lowered, r"[.,;:!?\x0A-\x0D]", f" {MARK} ")
    split = pc.split_pattern_regex(pc.binary_join_element_wise(pa.scalar(MARK, large), marked, pa.scalar(" ", large)), r"[ \t]+")
    words = split.flatten().dictionary_encode()
    langs = pc.fill_null(lang, NO_LANG).cast(pa.string()).dictionary_encode()
    code, n_words = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary)
    of_row = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key = np.repeat(of_row, pc.list_value_length(split).to_numpy(zero_copy_only=False)) * n_words + code
    no_word = [i for x in (MARK, "") if (i := words.dictionary.index(pa.scalar(x, large)).as_py()) >= 0]
    at = np.flatnonzero(~np.isin(code, no_word))
    order, starts, counts = _runs(key[at])
    keys = key[at][order[starts]]
    return langs.dictionary.take(pa.array(keys // n_words)), words.dictionary.take(pa.array(keys % n_words)).cast(pa.string()), counts, at[order]


def word_lists(docs: DataFrame) -> DataFrame:
    """(block, g, lang, word, n, data): a row for each list, whose number g is its own in the whole table, and for each block
    one with all its lists packed and the least g. Store it before use, since blocks are cut as rows come."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, g = [], 0, TaskContext.get().partitionId() << 33

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, g
            both = pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
            langs, words, counts, places = block_lists(*[both[c].chunk(0) for c in ("text", "lang")])
            n, block = len(counts), g
            if not n:
                return
            rows = pa.record_batch([pa.array(np.full(n, block)), pa.array(np.arange(g, g + n)), langs, words, pa.array(counts), pa.nulls(n, pa.binary())], names=["block", "g", "lang", "word", "n", "data"])
            g += n
            yield from (rows.slice(i, ROWS) for i in range(0, n, ROWS))
            yield pa.record_batch([pa.array([x], kind) for x, kind in ((block, pa.int64()), (block, pa.int64()), (None, pa.string()), (None, pa.string()), (None, pa.int64()), (pack(counts, places), pa.binary()))], names=rows.schema.names)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(0).nbytes
                if size >= BLOCK_BYTES:
                    yield from built()
        if held:
            yield from built()

    return docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).mapInArrow(run, _INDEX)


# -- growth -----------------------------------------------------------------------------------------------------------
def _on(places: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``places`` are ``known``, and where; both in order, so this is a merge."""
    met = np.searchsorted(known, places)
    there = known[np.minimum(met, len(known) - 1)] == places if len(known) else np.zeros(len(places), bool)
    return there, met


def grown(data: bytes, ids: tuple[np.ndarray, np.ndarray], frequent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts) of the lists of one block's phrases of ``len(frequent)`` + 2 words, in a fixed order. ``ids``: numbers
    in the block of frequent words' lists, and the words' ids; ``frequent``: for each length from 2 the numbers of the lists
    of frequent phrases."""
    counts, places = unpack(data)
    id_of = np.full(len(counts), -1)
    id_of[ids[0]] = ids[1]
    of_place = np.full(places.max(initial=-1) + 1, -1, np.int32)  # the lists side by side, in order of place
    of_place[places] = np.repeat(np.where(id_of >= 0, np.arange(len(counts)), -1), counts)
    at = np.flatnonzero(of_place >= 0)
    ending = of_place[at].astype(np.int64)
    place, phrase, words = at, ending, id_of[:, None]
    for length, chosen in enumerate([*frequent, None], 1):
        there, met = _on(place + length, at)
        if length > 1:
            there &= _on(place + 1, place)[0]
        place, phrase, last = place[there], phrase[there], ending[met[there]]
        order, starts, counts = _runs(phrase * len(id_of) + last)
        one = order[starts]
        words = np.column_stack((words[phrase[one]], id_of[last[one]]))
        if chosen is not None:
            number = np.full(len(counts), -1)
            number[chosen] = chosen
            phrase = np.empty(len(place), np.int64)
            phrase[order] = np.repeat(number, counts)
            place, phrase = place[phrase >= 0], phrase[phrase >= 0]
    return words, counts


def _w(length: int) -> list[str]:
    return [f"w{i}" for i in range(1, length + 1)]


def _grow(lists: DataFrame, tags: list[DataFrame]) -> DataFrame:
    """(block, g, w1, w2, ..., n): a row for each list of phrases by a word longer than the last of ``tags``, which are the
    frequent lists of 1, 2, ... words."""
    length = len(tags) + 1
    none = lambda kind: F.lit(None).cast(kind)
    rows = lists.filter("data is not null").select("block", F.lit(0).alias("side"), "g", none("bigint").alias("id"), "data")
    for side, t in enumerate(tags, 1):
        rows = rows.unionByName(t.select("block", F.lit(side).alias("side"), "g", F.col("id") if side == 1 else none("bigint").alias("id"), none("binary").alias("data")))
    names = ["block", "g", *_w(length), "n"]

    def run(rows: pa.Table) -> pa.Table:
        block = rows["block"][0].as_py()
        of = [rows.filter(pc.equal(rows["side"], s)) for s in range(length)]
        numbers = [x["g"].to_numpy() for x in of]
        if len(numbers[1]):
            words, counts = grown(of[0]["data"][0].as_py(), (numbers[1] - block, of[1]["id"].to_numpy()), [np.sort(x) for x in numbers[2:]])
        else:
            words, counts = np.empty((0, length), np.int64), np.empty(0, np.int64)
        n = len(counts)
        whole = pa.table([pa.array(np.full(n, block)), pa.array(np.arange(n)), *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(length)], pa.array(counts.astype(np.int64))], names=names)
        return pa.Table.from_batches(whole.to_batches(max_chunksize=ROWS), whole.schema)

    return rows.groupBy("block").applyInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _tagged(rows: DataFrame, key: list[str], least: int) -> DataFrame:
    """(block, g, id, a, key) of the lists of frequent keys. A key's id is its least number of a list; only the row of
    the first block has a frequency a and the key, so these rows are the table of keys. Counting and looking up share one exchange, for
    which both use all columns. A key has a row for each block at most, and the count of a key is one row of the join."""
    dealt = rows.select("block", "g", *key, "n").repartition(*key)
    counted = dealt.groupBy(*key).agg(F.sum("n").alias("__a"), F.min("block").alias("__block"), F.min("g").alias("id")).filter(F.col("__a") >= least)
    met = dealt.join(counted.hint("merge"), key)
    own = F.col("block") == F.col("__block")  # a key has one list in a block
    # a is at least n; the n in it keeps the two sides alike
    return met.select("block", "g", "id", F.when(own, F.greatest("__a", "n")).alias("a"), *[F.when(own, F.col(c)).alias(c) for c in key])


# -- phrases ----------------------------------------------------------------------------------------------------------
def _with_parts(counted: DataFrame, before: DataFrame, length: int) -> DataFrame:
    """Phrases with their words and the frequencies of their first and last parts, from those that are a word shorter."""
    key, short = _w(length), _w(length - 1)
    heads = before.select(*short, "lang", "words", F.col("a").alias("head_a"), "firsts")
    tails = before.select(*[F.col(c).alias(d) for c, d in zip(short, key[1:], strict=True)], F.element_at("words", -1).alias("end"), F.col("a").alias("tail_a"), "lasts")
    met = counted.select(*key, "a").join(heads.hint("merge"), short).join(tails.hint("merge"), key[1:])
    return met.select(*key, "lang", F.concat("words", F.array("end")).alias("words"), "a", F.concat("firsts", F.array("head_a")).alias("firsts"), F.concat(F.array("tail_a"), "lasts").alias("lasts"))


def frequent_phrases(docs: DataFrame, keep: Scratch, longest: int = 3, least: int = 10) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1 to ``longest`` words, and (lang, n) of all words. A phrase has the ids of its words
    (w1, w2, ...), the words, its frequency a, and the frequencies of its first and of its last parts, by the number of
    words before the cut."""
    lists = keep(word_lists(docs))
    named = lists.filter("data is null")
    totals = keep(named.groupBy("lang").agg(F.sum("n").alias("n")))
    none = F.array().cast("array<bigint>")
    tags = [keep(_tagged(named, ["lang", "word"], least))]
    words = tags[0].filter("a is not null").select(F.col("id").alias("w1"), "lang", F.array("word").alias("words"), "a", none.alias("firsts"), none.alias("lasts"))
    levels = [words]
    for length in range(2, longest + 1):
        rows, key = _grow(lists, tags), _w(length)
        if length < longest:
            rows = keep(rows)
            tags.append(keep(_tagged(rows, key, least)))
            keep.drop(rows)
            counted = tags[-1].filter("a is not null")
        else:
            counted = rows.groupBy(*key).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
        levels.append(keep(_with_parts(counted, levels[-1], length)))
    return levels, totals


def score_of(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)) by exact decimals."""
    wide = lambda x: x.cast("decimal(19,0)")
    top, under = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")
    return F.call_function("div", top, under)


def least_cut(phrases: DataFrame) -> DataFrame:
    """Adds the struct ``cut`` (score, k, l, r) of the lowest-scoring cut, ties to the least k."""
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(F.get("firsts", k - 1).alias("l"), F.get("lasts", k - 1).alias("r"), k.alias("k")))
    scored = F.transform(cuts, lambda c: F.struct(score_of(F.col("a"), c.l, c.r).alias("score"), c.k.alias("k"), c.l.alias("l"), c.r.alias("r")))
    return phrases.withColumn("cut", F.array_min(scored))


def without_parts(phrases: DataFrame, longer: DataFrame, length: int, inside: int) -> DataFrame:
    """Phrases of ``length`` words without those that lie in one of ``longer`` (longer by a word) with ``inside`` percent of
    their occurrences."""
    key = _w(length)
    part = lambda first: F.struct(*[F.col(f"w{i + first}").alias(c) for i, c in enumerate(key)])
    most = longer.select(F.explode(F.array(part(1), part(2))).alias("x"), "a").select("x.*", "a").groupBy(*key).agg(F.max("a").alias("most"))
    met = phrases.join(most.hint("merge"), key, "left")
    return met.filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("most")


def best(rows: DataFrame, first: int) -> DataFrame:
    """Adds ``rank`` and keeps each language's first rows; those of salted groups are taken before the language's, so that no
    task gets more than some thousand rows for a language after the first round."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for salts in SALTS:
        group = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        rows = rows.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= first)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= first)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, first: int = 2000) -> DataFrame:
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    if longest < 2:
        raise ValueError("a phrase has two words or more")
    with Scratch(docs.sparkSession) as keep:
        levels, totals = frequent_phrases(docs, keep, longest, least)
        found = None
        for i, phrases in enumerate(levels[1:], 1):
            left = without_parts(phrases, levels[i + 1], i + 1, inside) if i + 1 < len(levels) else phrases
            part = least_cut(left).select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
            found = part if found is None else found.unionByName(part)
        ranked = best(found, first).join(F.broadcast(totals), "lang") if _few(totals) else best(found, first).join(totals.hint("merge"), "lang")
        return keep.result(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def _few(totals: DataFrame, most: int = 10_000) -> bool:
    """Whether there are so few languages that their totals can be sent to every task."""
    return totals.limit(most + 1).count() <= most
