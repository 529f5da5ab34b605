"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a text; the ledger keeps the measurements and one bit for each failed rule.
Policies are versioned masks over those bits, so a change of policy reads only the ledger, and ablations are
bitwise aggregations over the few distinct bit patterns.

Words are maximal runs of characters other than space and U+0009-U+000D. Null and empty texts have no words and
fail ``too_few_words``. Repeated rows are judged one by one, very long texts whole; a measure that equals a limit
passes; an empty table stays empty. Other columns pass through; ``ledger`` puts everything it adds into one struct
column, so names of the input never clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pcgspark.llm.common import bounded_batches, column_kernel, free_name
from pcgspark.llm.wordkernel import find_words, per_text, raw

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_exclaim")
MEASURE_TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"

#: Rule name -> SQL condition of failure over the measurements; the position is the bit.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 4 * word_chars",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "shouting": "100 * n_upper > 60 * (n_upper + n_lower)",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "exclamations": "n_exclaim > n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a text is kept if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_words"))
WEB = Policy("web", 1, tuple(RULES))

_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _lines(column: pa.Array) -> tuple[list[int], list[int]]:
    """Lines with a word, and those among them that equal an earlier line."""
    total, again = [], []
    for text in column.to_pylist():
        lines = [x for x in (text or "").split("\n") if x and x.strip(" \t\n\r\x0b\x0c")]
        total.append(len(lines))
        again.append(len(lines) - len(set(lines)))
    return total, again


def _repeat_words(words) -> np.ndarray:
    """For each text, the words that lie in a 3-word window found twice or more in that text."""
    hashes, first = words.windows(3)
    if not len(hashes):
        return np.zeros(words.n, np.int64)
    docs = words.docs
    order = np.lexsort((hashes, docs[first]))
    h, d = hashes[order], docs[first][order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    repeated = np.zeros(len(h), bool)
    repeated[1:] |= same
    repeated[:-1] |= same
    covered = np.zeros(len(docs), bool)
    at = first[order[repeated]]
    for j in range(3):
        covered[at + j] = True
    return per_text(covered, words.first)


def measure(column: pa.Array) -> pa.StructArray:
    """All measurements of a slice of texts."""
    data, offsets = raw(column)
    words = find_words(data, offsets)
    n_lines, n_dup = _lines(column)
    count = lambda table: per_text(table[data], offsets)
    values = {
        "n_words": words.counts,
        "word_chars": per_text(((data & 0xC0) != 0x80) & ~_SPACE[data], offsets),
        "n_symbols": count(_SYMBOL),
        "n_lines": n_lines,
        "n_dup_lines": n_dup,
        "n_repeat_words": _repeat_words(words),
        "n_upper": count(_UPPER),
        "n_lower": count(_LOWER),
        "n_exclaim": per_text(data == ord("!"), offsets),
    }
    return pa.StructArray.from_arrays([pa.array(values[m], pa.int64()) for m in MEASURES], list(MEASURES))


def fail_bits(measures: str) -> Column:
    """The bitmask of failed rules from a struct column of measurements."""
    import re

    names = re.compile("|".join(rf"\b{m}\b" for m in MEASURES))
    bits = F.lit(0).cast("bigint")
    for name, failed in RULES.items():
        condition = names.sub(lambda m: f"{measures}.{m[0]}", failed)
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, text: str = "text", into: str = "ledger") -> DataFrame:
    """Adds the struct ``into``: the measurements and ``fail_bits``, in the last column (with underscores behind its name if
    there is such a column). One pass, no shuffle."""
    into = free_name(docs.columns, into)
    bounded_batches(docs.sparkSession)
    kernel = column_kernel(measure, MEASURE_TYPE)
    out = docs.withColumn(into, kernel(F.col(text)))
    return out.withColumn(into, F.col(into).withField("fail_bits", fail_bits(into)))


def passes(bits: Column, policy: Policy) -> Column:
    return bits.bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def ablation(bits: DataFrame, policy: Policy, column: str = "fail_bits") -> DataFrame:
    """For each rule of a policy: texts that fail it, that fail it alone, and that would be kept without it.

    The bits are first counted by pattern (map-side combined, at most 2**rules groups), then joined with the
    policy's rules, of which there are few; nothing else is broadcast.
    """
    patterns = bits.groupBy(F.col(column).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    failed = F.col("bits").bitwiseAND(F.lit(policy.mask).cast("bigint"))
    if not policy.rules:
        raise ValueError("a policy without rules has no ablation")
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("bigint").alias("bit")) for r in policy.rules])
    exploded = patterns.select("n", failed.alias("failed"), F.explode(each).alias("r"))
    return exploded.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("failed").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def judge(docs: DataFrame, policy: Policy = WEB) -> DataFrame:
    """The digest: doc_id, measurements, base_failed, kept, fail_bits. ``kept`` is false if a base rule fails."""
    m = ledger(docs.select("doc_id", "text"))
    bits = F.col("ledger.fail_bits")
    return m.select(
        "doc_id",
        *[F.col(f"ledger.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        (~passes(bits, BASE)).alias("base_failed"),
        (passes(bits, BASE) & passes(bits, policy)).alias("kept"),
        bits.alias("fail_bits"),
        F.lit(policy.version).alias("policy_version"),
    )
