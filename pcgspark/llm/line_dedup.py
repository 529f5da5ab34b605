"""Removal of repeated passages of lines, found by content-defined windows of lines.

Lines are the parts between ``\n``. A passage is a run of two lines or more with ``MIN_CHARS`` characters or more (line
ends don't count). At every line a least window begins, and one ends: the fewest lines that make a passage. Their ends
depend on their own lines only, so a repeated passage has the same windows wherever it stands; and each of its lines
lies in one of its windows (the one that begins there or, near the passage's end, the one that ends with it). So every
repeated passage is found with its exact edges, and nothing that isn't one. A stretch of ``LOOK`` lines with under
``MIN_CHARS`` characters in all ends a passage.

A window whose hash occurs again anywhere is matched with the first occurrence (least doc_id, then text, then line).
Matched windows that follow each other in both documents are one run; a run's bytes are taken from the first occurrence
and compared with the document's own, and where they agree, its lines are removed from all but the first. A run that overlaps
its own first occurrence leaves that one's lines. A line that is removed is always kept somewhere earlier. Where a run's bytes disagree (a hash met by chance), none of its
lines goes.

Only row numbers of lines move until bytes are compared; texts are shuffled once by document, which serves both the
first occurrences and the rewriting. The bytes of a run that very many documents share are dealt in salted groups.
Nothing is broadcast but what Spark finds small at run time.

Null and empty texts and texts of one line stay as they are, so do rows with a null doc_id. Rows with the same doc_id
and the same text are one document and stay alike. Very long texts are rewritten whole; a table without rows stays
empty. Other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcgspark.llm.common import Scratch, free_name

MIN_CHARS = 60
NEAR, LOOK = 64, 256  # lines looked at for a window's end: at first, and where these have too few characters
GROUP = 512  # documents that are sent one copy of a shared run


def _part(array: Column, s: Column, e: Column) -> Column:
    """Elements s .. e - 1 (from 0). In a lambda, ``slice`` reads the whole array first."""
    return F.transform(F.sequence(s + 1, e), lambda i: F.element_at(array, i))


def _ends(size: Column, n: Column) -> Column:
    """For each line but the last, the line after the least window that begins there, or null. ``size`` is used in every line,
    so it must be a column or a variable: an expression would be evaluated as often."""
    bits = MIN_CHARS.bit_length()
    chars = lambda acc: acc.bitwiseAND((1 << bits) - 1)

    def end(s: Column) -> Column:
        at = [F.coalesce(F.try_element_at(size, s + j), F.lit(0)).cast("bigint") for j in (1, 2, 3)]

        def within(look: int) -> Column:
            """Counts lines above, and characters up to MIN_CHARS in the low bits."""
            step = lambda acc, x: F.when(chars(acc) >= MIN_CHARS, acc).otherwise(acc + (1 << bits) + F.least(MIN_CHARS - chars(acc), x.cast("bigint")))
            return F.aggregate(_part(size, s, F.least(s + look, n)), F.lit(0).cast("bigint"), step, lambda acc: F.when(chars(acc) >= MIN_CHARS, s + F.shiftright(acc, bits).cast("int")))

        found = F.when(at[0] + at[1] >= MIN_CHARS, s + 2).when((s + 3 <= n) & (at[0] + at[1] + at[2] >= MIN_CHARS), s + 3)
        return found.otherwise(F.coalesce(within(NEAR), F.when(s + NEAR < n, within(LOOK))))

    return F.transform(F.sequence(F.lit(0), n - 2), end)


def _windows(size: Column, n: Column) -> Column:
    """The least windows (first line s, line after the last e) that begin or end at each line. One that ends at a line counts
    unless it is the one that begins where it does."""
    window = lambda s, e: F.struct(s.alias("s"), e.alias("e"))

    def both(ahead: Column, back: Column) -> Column:
        begun = F.transform(ahead, lambda e, s: window(s, e))
        ended = F.transform(back, lambda e, s: window(n - e, n - s))
        new = F.filter(ended, lambda w: w.s.isNotNull() & ~F.coalesce(F.get(ahead, w.s) == w.e, F.lit(False)))
        return F.concat(F.filter(begun, lambda w: w.e.isNotNull()), new)

    def of(reversed_: Column) -> Column:
        ends = F.array(F.struct(_ends(size, n).alias("ahead"), _ends(reversed_, n).alias("back")))
        return F.flatten(F.transform(ends, lambda x: both(x.ahead, x.back)))

    return F.flatten(F.transform(F.array(F.reverse(size)), of))


def _known(docs: DataFrame) -> DataFrame:
    """Rows with the keys of a document and its text; the keys are never null."""
    return docs.withColumns({"__k": F.xxhash64(F.lit(2), "doc_id", "text"), "__t": F.xxhash64("text")})


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, k, t, s, e, h): k and t are the keys of the document and its text; lines s .. e - 1."""
    known = _known(docs.filter("doc_id is not null and text is not null").select("doc_id", "text"))
    lined = known.select("doc_id", F.col("__k").alias("k"), F.col("__t").alias("t"), F.split("text", "\n", -1).alias("lines"))
    hashed = lined.filter(F.size("lines") > 1).select(
        "doc_id", "k", "t", F.transform("lines", lambda x: F.xxhash64(x)).alias("lh"), F.transform("lines", lambda x: F.length(x)).alias("len"), F.size("lines").alias("n")
    )
    # hashed before they become rows, so that no row carries the whole text's lines
    chunks = F.transform(_windows(F.col("len"), F.col("n")), lambda c: F.struct(c.s.alias("s"), c.e.alias("e"), F.xxhash64(_part(F.col("lh"), c.s, c.e)).alias("h")))
    return hashed.select("doc_id", "k", "t", F.explode(chunks).alias("c")).select("doc_id", "k", "t", "c.*")


def _bytes(lines: Column, c: Column) -> Column:
    return F.array_join(_part(lines, c.s, c.e), "\n")


def matched_runs(docs: DataFrame, keep: Scratch) -> DataFrame:
    """(k, t, s, e, ok, ot, os, oe, n): lines of a document that seem to repeat those of an earlier one (or place), and
    the number of runs that repeat these."""
    rows = keep(chunk_rows(docs))
    first = rows.groupBy("h").agg(F.min(F.struct("doc_id", "t", "k", "s")).alias("o"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = keep(first.select("h", F.col("o.k").alias("ok"), F.col("o.t").alias("ot"), F.col("o.s").alias("os")))
    again = rows.drop("doc_id").join(first.hint("merge"), "h").filter("not (k = ok and t = ot and s = os)").withColumn("off", F.col("s") - F.col("os"))
    by = ["k", "t", "ok", "ot", "off"]
    w = Window.partitionBy(*by).orderBy("s", "e")
    reached = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = again.select(*by, "s", "e", F.when(reached >= F.col("s"), 0).otherwise(1).alias("new"))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*by, "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    # where a run overlaps its own first occurrence, that one's lines stay
    same = (F.col("k") == F.col("ok")) & (F.col("t") == F.col("ot"))
    runs = runs.withColumn("s", F.when(same, F.greatest("s", F.col("e") - F.col("off"))).otherwise(F.col("s"))).filter("s < e")
    runs = keep(runs.select("k", "t", "s", "e", "ok", "ot", (F.col("s") - F.col("off")).alias("os"), (F.col("e") - F.col("off")).alias("oe")))
    place = ["ok", "ot", "os", "oe"]
    return keep(runs.join(keep(runs.groupBy(*place).agg(F.count(F.lit(1)).alias("n"))).hint("merge"), place))


def dedup_lines(docs: DataFrame, text: str = "text", into: str = "line_dedup") -> DataFrame:
    """``docs`` with ``text`` rewritten, and the counts n_lines and n_removed in the struct ``into`` (with underscores
    behind it if there is such a column), which is the last."""
    names, into = docs.columns, free_name(docs.columns, into)
    with Scratch(docs.sparkSession) as keep:
        runs = keep.result(matched_runs(docs.select("doc_id", F.col(text).alias("text")), keep))
    groups = F.ceil(F.col("n") / GROUP)
    place = ["ok", "ot", "os", "oe", "salt"]
    wanted = runs.select("ok", "ot", "os", "oe", groups.alias("groups")).distinct().groupBy(F.col("ok").alias("__k"), F.col("ot").alias("__t")).agg(F.collect_list(F.struct(F.col("os").alias("s"), F.col("oe").alias("e"), "groups")).alias("__c"))
    # both joins below take this exchange, since their left sides are the same
    known = _known(docs.select("doc_id", F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text]).alias("__rest")))
    texts = known.join(wanted.hint("merge"), ["__k", "__t"])
    # a use of the other columns, without which they are pruned and the exchange is another one
    texts = texts.select(F.col("__k").alias("ok"), F.col("__t").alias("ot"), F.split("text", "\n", -1).alias("lines"), F.xxhash64("__rest").alias("used"), F.explode("__c").alias("c"))
    texts = texts.select("ok", "ot", F.col("c.s").alias("os"), F.col("c.e").alias("oe"), F.struct(_bytes(F.col("lines"), F.col("c")).alias("bytes"), "used").alias("x"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("c.groups") - 1)).alias("salt"))
    texts = texts.groupBy(*place).agg(F.first("x").alias("x"))  # of repeated rows one
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("k", "t"), groups))
    marked = salted.join(texts.hint("merge"), place).groupBy(F.col("k").alias("__k"), F.col("t").alias("__t")).agg(F.collect_list(F.struct("s", "e", F.col("x.bytes").alias("bytes"))).alias("__marked"))
    out = known.join(marked.hint("merge"), ["__k", "__t"], "left").withColumn("__lines", F.split("text", "\n", -1))
    lines = F.col("__lines")
    agreed = F.filter("__marked", lambda c: _bytes(lines, c) == c.bytes)
    gone = F.array_distinct(F.flatten(F.transform(agreed, lambda c: F.sequence(c.s, c.e - 1))))
    out = out.withColumn("__gone", F.when(F.col("__marked").isNotNull(), gone))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone"))
    rewritten = F.when(F.size("__gone") > 0, F.array_join(F.transform(left, lambda i: lines[i]), "\n")).otherwise(F.col("text"))
    counts = F.struct(F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint").alias("n_lines"), F.greatest(F.lit(0), F.coalesce(F.size("__gone"), F.lit(0))).cast("bigint").alias("n_removed"))
    return out.select(*[rewritten.alias(c) if c == text else F.col(f"__rest.`{c}`").alias(c) for c in names], counts.alias(into))
