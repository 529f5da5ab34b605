"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 for each language: characters are lower-case letters with their combining marks, and the word
boundary (any run of other characters); contexts don't cross the boundary before a word. Discounted probabilities and back-off weights of all
orders lie in two arrays sorted by the n-gram's 64-bit hash, a column for each language. A text gets the language of
the lowest cross-entropy for each predicted character (ties: the first in alphabetical order). A text whose best
cross-entropy passes the language's limit, calibrated on training rows kept out of the counts, is marked rejected.

Fitting uses a bounded sample: the first rows of each language in the order of a hash of doc_id, at most ``SAMPLE`` rows
and ``SAMPLE_CHARS`` characters (a first row that is longer is taken alone). All n-grams of the sample count. Counts,
discounts, probabilities and back-off weights are aggregates of tables; one table of at most ORDER + 1 rows for each
character of the samples is collected. Prediction reads every whole text, very long ones too. Null texts, texts without
a letter, and every text where nothing was learned get ``und`` with score 0. Repeated rows agree, rows of one doc_id
with different texts are predicted one by one, and an empty table stays empty. What is added is one struct column.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcgspark.llm.common import bounded_batches, column_kernel, crc_mod, free_name, materialise, slices
from pcgspark.llm.wordkernel import U64, mix

ORDER = 4
SAMPLE, SAMPLE_CHARS = 1200, 8 << 20
CALIBRATION_SHARE = 0.2
CALIBRATION_ROWS = 20  # a language with fewer rows is learned from all of them and has no limit of its own
REJECT_QUANTILE, REJECT_SLACK = 0.999, 1.1
#: Score: softmax over languages of minus this times the cross-entropy in nats.
SHARPNESS = 8.0
CACHE = 1 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point 1 if it is a letter, 2 if it is a mark that combines with one, else 0."""
    if not _letters:
        kinds = (1 if (c := chr(i)).isalpha() else 2 if unicodedata.category(c)[0] == "M" else 0 for i in range(0x110000))
        _letters.append(np.fromiter(kinds, np.uint8, 0x110000))
    return _letters[0]


def grams(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 4-grams (columns oldest to newest, 0 is the boundary) that predict each letter and word end, and each text's
    span, which is empty for a text without a letter."""
    lowered = [(t or "").lower() for t in values]
    joined = "\n".join([*lowered, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = letters()[np.minimum(codes, 0x10FFFF)]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in lowered), np.int64, len(lowered)))
    none = np.add.reduceat(kinds == 1, np.concatenate(([0], ends[:-1]))) == 0 if len(lowered) else np.empty(0, bool)
    codes = np.where((kinds > 0) & ~np.repeat(none, np.diff(np.concatenate(([0], ends)))), codes, 0)
    columns = [codes]
    for _ in range(ORDER - 1):
        back = np.zeros(len(codes), np.uint32)
        back[1:] = columns[-1][:-1]
        if len(columns) > 1:  # nothing beyond the boundary
            back[columns[-1] == 0] = 0
        columns.append(back)
    predicted = np.flatnonzero((codes != 0) | (columns[1] != 0))
    spans = np.searchsorted(predicted, np.concatenate(([0], ends)))
    return np.stack([c[predicted] for c in reversed(columns)], 1), spans


def hashes(g: np.ndarray) -> np.ndarray:
    """Hash of the rows of an n-gram array; the number of columns counts."""
    h = np.full(len(g), g.shape[1] * 0x9E3779B97F4A7C15 & (2**64 - 1), U64)
    for j in range(g.shape[1]):
        h = mix(h * U64(0xD1342543DE82EF95) + g[:, j].astype(U64))
    return h


@dataclass
class Model:
    """Sorted hash arrays of all languages."""

    langs: list[str]
    gram_hash: np.ndarray
    alpha: np.ndarray  # discounted probability, a row for each n-gram, a column for each language
    context_hash: np.ndarray
    gamma: np.ndarray  # weight of the lower order
    base: np.ndarray  # uniform probability of each language's alphabet
    limit: dict[str, float] = field(default_factory=dict)

    def log_probabilities(self, g: np.ndarray) -> np.ndarray:
        p = np.broadcast_to(self.base, (len(g), len(self.langs))).astype(np.float64)
        for k in range(1, ORDER + 1):
            gram, context = hashes(g[:, ORDER - k :]), hashes(g[:, ORDER - k : ORDER - 1])
            p = _find(self.context_hash, self.gamma, context, 1.0) * p + _find(self.gram_hash, self.alpha, gram, 0.0)
        return np.log(p)


def _find(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), rows.shape[1]), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where((keys[at] == wanted)[:, None], rows[at], default)


class Scorer:
    """Cross-entropies of texts; log probabilities of n-grams met before are kept, sorted by hash."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.rows = np.empty(0, U64), np.empty((0, len(model.langs)), np.float32)

    def _known(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, h)
        missing = np.ones(len(h), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] != h
        if missing.any():
            new, first = np.unique(h[missing], return_index=True)
            rows = self.model.log_probabilities(g[missing][first]).astype(np.float32)
            if len(self.keys) + len(new) > CACHE:  # starts anew with this slice's n-grams
                new, first = np.unique(h, return_index=True)
                self.keys, self.rows = new, self.model.log_probabilities(g[first]).astype(np.float32)
            else:
                keys = np.concatenate((self.keys, new))
                order = np.argsort(keys, kind="stable")
                self.keys, self.rows = keys[order], np.concatenate((self.rows, rows))[order]
            at = np.searchsorted(self.keys, h)
        return at

    def entropies(self, values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean cross-entropy of each text under each language (texts by languages), and the predicted characters."""
        g, spans = grams(values)
        n = np.diff(spans)
        total = np.zeros((len(values), len(self.model.langs)))
        if len(g):
            at = self._known(hashes(g), g)
            full = np.flatnonzero(n)
            for k in range(len(self.model.langs)):
                total[full, k] = -np.add.reduceat(self.rows[at, k].astype(np.float64), spans[:-1][full])
        return total / np.maximum(n, 1)[:, None], n


def probabilities(counted: DataFrame) -> DataFrame:
    """(lang, size, g0 .. g3, alpha, gamma) from 4-gram counts (lang, g0 .. g3, n): the discounted probability of each
    n-gram of ``size`` characters (the last columns) and the weight that its ``size`` - 1 first leave to the lower order.

    The n-grams of a lower order are counted by the characters before them. A discount comes from how many n-grams of
    an order are counted once and twice in the language.
    """
    columns = [f"g{j}" for j in range(ORDER)]
    level, out = counted.select("lang", *columns, F.col("n").cast("bigint").alias("c")), None
    for size in range(ORDER, 0, -1):
        own, context = columns[ORDER - size :], columns[ORDER - size : -1]
        of = level.groupBy("lang").agg(F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("ones"), F.sum(F.when(F.col("c") == 2, 1).otherwise(0)).alias("twos"))
        share = F.col("ones") / F.expr("nullif(ones + 2 * twos, 0)")
        of = of.select("lang", F.coalesce(F.when(F.col("ones") + F.col("twos") > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.coalesce(share, F.lit(0.0))))), F.lit(0.5)).alias("discount"))
        sums = level.groupBy("lang", *context).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("kinds"))
        rows = level.join(sums, ["lang", *context]).join(of, "lang")
        blank = [F.lit(None).cast("bigint").alias(c) for c in columns[: ORDER - size]]
        rows = rows.select("lang", F.lit(size).alias("size"), *blank, *own, ((F.col("c") - F.col("discount")) / F.col("total")).alias("alpha"), (F.col("discount") * F.col("kinds") / F.col("total")).alias("gamma"))
        out = rows if out is None else out.unionByName(rows)
        level = level.groupBy("lang", *own[1:]).agg(F.count(F.lit(1)).alias("c"))
    return out


def assemble(found: pd.DataFrame) -> Model:
    """The sorted hash arrays of a collected table of probabilities."""
    langs = sorted(found["lang"].unique())
    column = found["lang"].map({lang: k for k, lang in enumerate(langs)}).to_numpy()
    alphas, gammas = [], []
    base = np.ones(len(langs))
    for size in range(1, ORDER + 1):
        at = np.flatnonzero((found["size"] == size).to_numpy())
        g = found.iloc[at][[f"g{j}" for j in range(ORDER - size, ORDER)]].to_numpy(dtype=np.int64).astype(np.uint32)
        alphas.append((hashes(g), column[at], found["alpha"].to_numpy()[at]))
        gammas.append((hashes(g[:, :-1]), column[at], found["gamma"].to_numpy()[at]))
        if size == 1:
            base = 1.0 / (np.bincount(column[at], minlength=len(langs)) + 1)

    def table(parts: list, default: float) -> tuple[np.ndarray, np.ndarray]:
        keys, of, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        uniq, inverse = np.unique(keys, return_inverse=True)
        out = np.full((len(uniq), len(langs)), default)
        out[inverse, of] = values
        return uniq, out

    return Model(langs, *table(alphas, 0.0), *table(gammas, 1.0), base)


def _share(salt: int) -> Column:
    """A number in [0, 1) from doc_id."""
    return F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sample_of(train: DataFrame, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """The bounded sample: (doc_id, text, lang, held). ``held`` rows are for calibration."""
    train = train.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    # twice the rows by chance, so that the exact cut below sorts few of them
    drawn = train.join(F.broadcast(sizes), "lang").withColumn("u", _share(1)).filter(F.col("u") * F.col("n") < 2 * rows)
    w = Window.partitionBy("lang").orderBy("u", "doc_id", "text")
    drawn = drawn.withColumns({"r": F.row_number().over(w), "before": F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "size": F.length("text")})
    kept = drawn.filter((F.col("r") <= rows) & ((F.col("r") == 1) | (F.col("before") + F.col("size") <= chars)))
    return materialise(kept.select("doc_id", "text", "lang", ((F.col("n") >= CALIBRATION_ROWS) & (_share(2) < CALIBRATION_SHARE)).alias("held")))


def fit(train: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fits on rows with doc_id, text, lang. Collected: the n-grams of the bounded sample, and a limit for each language."""
    rows = sample_of(train, sample)
    bounded_batches(rows.sparkSession)

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                by: dict[str, list] = {}
                for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                    by.setdefault(lang, []).append(text)
                for lang, values in by.items():
                    g, _ = grams(values)
                    kinds, n = np.unique(g, axis=0, return_counts=True) if len(g) else (g, np.empty(0, np.int64))
                    yield pa.record_batch([pa.array([lang] * len(n), pa.string()), *[pa.array(kinds[:, j].astype(np.int64)) for j in range(ORDER)], pa.array(n.astype(np.int64))], names=["lang", *[f"g{j}" for j in range(ORDER)], "n"])

    names = [f"g{j}" for j in range(ORDER)]
    counted = rows.filter("not held").mapInArrow(count, f"lang string, {', '.join(f'{c} bigint' for c in names)}, n bigint")
    found = probabilities(materialise(counted.groupBy("lang", *names).agg(F.sum("n").alias("n")))).toPandas()
    if not len(found):
        return None
    model = assemble(found)
    scored = predict(rows.filter("held"), model, into="found").groupBy("lang").agg(F.percentile_approx("found.entropy", REJECT_QUANTILE, 10_000).alias("q"))
    model.limit = {r["lang"]: r["q"] * REJECT_SLACK for r in scored.collect() if r["q"] is not None}
    return model


KIND = "struct<lang_pred:string,score:double,entropy:double,rejected:boolean>"


def predict(docs: DataFrame, model: Model | None, text: str = "text", into: str = "language") -> DataFrame:
    """Adds the struct ``into``: lang_pred, score, entropy (nats a character) and rejected. It is the last column, with
    underscores behind its name if there is such a column."""
    into = free_name(docs.columns, into)
    names = ["lang_pred", "score", "entropy", "rejected"]
    if model is None:
        return docs.withColumn(into, F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected")))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    bounded_batches(docs.sparkSession)
    made: dict[int, Scorer] = {}

    def kernel(column: pa.Array) -> pa.StructArray:
        if 0 not in made:
            made[0] = Scorer(shipped.value)
        m = shipped.value
        h, n = made[0].entropies(column.to_pylist())
        best = h.argmin(1)
        least = h[np.arange(len(h)), best]
        score = 1.0 / np.exp(-SHARPNESS * (h - least[:, None])).sum(1)
        some = n > 0
        return pa.StructArray.from_arrays(
            [
                pa.array([m.langs[b] if s else "und" for b, s in zip(best, some, strict=True)]),
                pa.array(np.where(some, score, 0.0)),
                pa.array(least, mask=~some),
                pa.array([not s or x > m.limit.get(m.langs[b], np.inf) for b, s, x in zip(best, some, least, strict=True)]),
            ],
            names=names,
        )

    return docs.withColumn(into, column_kernel(kernel, KIND)(F.col(text)))


def identify(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """The digest: learns outside one fold of documents and predicts all of them."""
    held = crc_mod("doc_id", folds) == fold
    model = fit(docs.filter(~held))
    found = predict(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), model, into="found")
    return found.select("doc_id", "held_out", "found.*")
