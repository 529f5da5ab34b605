"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text: one of words typical of toxic texts, one of ordinary text,
above a common base of frequent words. Every window of ``WINDOW`` words of a text is compressed with either; the
bytes that the toxic dictionary saves are compared with thresholds, and a logistic curve over the counts of windows
beyond each threshold, calibrated on labelled rows, gives the score.

The toxic dictionary takes words whose distinct left neighbours in toxic texts are many, and far more frequent than
in ordinary texts; counting distinct neighbours instead of occurrences keeps copied passages from looking typical.
The ordinary dictionary takes words of ordinary windows that the toxic dictionary would save most on, found in
``ROUNDS`` rounds.

Fitting uses a bounded sample: about ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` labelled rows, chosen by a hash of doc_id;
what is collected is bounded by the constants below (words of equal weight in alphabetical order). Scoring reads every
whole text, very long ones too. Null and empty texts are one empty window. Without rows of both labels there is nothing
to compare: the score is the share of toxic rows (0 if there is none). Repeated label rows of a document count once,
toxic if any of them is. Repeated rows agree; rows of one doc_id with different texts are scored one by one, and an
empty table stays empty. What is added is one struct column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcgspark.llm.common import bounded_batches, column_kernel, crc_mod, free_name, materialise, slices

WINDOW = 6
LEVEL = 4
BASE_BYTES = 4096
TOXIC_ROWS, ORDINARY_ROWS = 3000, 9000
TOXIC_WORDS, HARD_WORDS, BASE_WORDS = 400, 2000, 3000
MIN_SUPPORT, MIN_RATIO = 0.008, 8.0
ROUNDS = 2
ORDINARY_WEIGHT = 0.7
THRESHOLDS = (2, 3, 4, 5, 6, 7, 8, 10)


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of words in lower case, each between spaces; an empty text is one empty window."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(0, len(words), size)] or [b""]


@dataclass
class Dictionaries:
    toxic: bytes
    ordinary: bytes
    level: int = LEVEL

    def compressors(self) -> tuple:
        import zstandard

        out = []
        for content in (self.toxic, self.ordinary):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(self.level)
            out.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
        return tuple(out)


def savings(compressors: tuple, text: str | None) -> np.ndarray:
    """For each window, the bytes that the toxic dictionary saves beyond the ordinary one."""
    toxic, ordinary = compressors
    return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], np.int64)


def features(saved: np.ndarray) -> list[float]:
    n = len(saved)
    return [math.log1p(int((saved >= t).sum())) for t in THRESHOLDS] + [min(int(saved.max()), 12) / 4, math.log(n), math.log1p(int((saved <= -4).sum()))]


@dataclass
class Model:
    dictionaries: Dictionaries
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weights
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, dictionaries: Dictionaries, ridge: float = 0.5) -> Model:
    """Logistic regression by Newton's method; ordinary rows have ORDINARY_WEIGHT of the weight, so that few of them pass."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    weight = np.where(y > 0, (1 - ORDINARY_WEIGHT) / max(y.sum(), 1), ORDINARY_WEIGHT / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1.0 / (1.0 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, z.T @ (weight * (p - y)) + ridge * w)
    return Model(dictionaries, mean, scale, w)


def _join_words(words: list[str], size: int | None = None) -> bytes:
    """Words in ascending weight, the most useful last (nearest to the data); repeated or cut to a size in bytes."""
    content = b" " + b" ".join(w.encode() for w in words) + b" "
    if size is None:
        return content
    return (content * (size // len(content) + 1))[-size:] if size else b""


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """Labelled texts (doc_id, text, toxic) of the bounded sample, and the rows of either label.

    The sampled labels are at most about toxic_rows + ordinary_rows rows of two numbers; only that is broadcast.
    """
    one = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.when(F.col("toxic") == 1, toxic_rows / max(1, sizes.get(1, 0))).otherwise(ordinary_rows / max(1, sizes.get(0, 0)))
    chosen = one.filter("toxic in (0, 1)").filter(share < rate)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), sizes


def _typical_words(rows: DataFrame, n_toxic: int, n_ordinary: int) -> tuple[list[str], list[str]]:
    """Toxic-typical words and frequent ordinary words, each in ascending weight."""
    words = rows.select("toxic", F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0).alias("w"))
    pairs = words.select("toxic", F.explode(F.arrays_zip(F.col("w").alias("w"), F.concat(F.array(F.lit("")), F.col("w")).alias("p"))).alias("x"))
    pairs = pairs.filter("length(x.w) between 3 and 64").select("toxic", F.col("x.w").alias("w"), F.xxhash64("x.p").alias("p")).distinct()
    counts = materialise(pairs.groupBy("w").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("o")))
    lift = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("o") + 0.5) / (n_ordinary + 1))
    typical = counts.filter((F.col("t") >= max(3, MIN_SUPPORT * n_toxic)) & (lift > math.log(MIN_RATIO)))
    top = [r["w"] for r in typical.orderBy(F.desc(F.col("t") * lift), "w").limit(TOXIC_WORDS).collect()]
    base = [r["w"] for r in counts.orderBy(F.desc("o"), "w").limit(BASE_WORDS).select("w").collect()]
    return top[::-1], base[::-1]


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model, or a constant score if one of the labels is absent."""
    chosen, sizes = sample(docs, labels)
    if not sizes.get(1) or not sizes.get(0):
        return 1.0 if sizes.get(1) else 0.0
    bounded_batches(docs.sparkSession)
    rows = materialise(chosen)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    typical, base = _typical_words(rows, n.get(1, 0), n.get(0, 0))
    if not typical:
        return n.get(1, 0) / max(1, n.get(0, 0) + n.get(1, 0))
    toxic, base_bytes = _join_words(typical), _join_words(base)[-BASE_BYTES:]
    hard: list[str] = base[: len(typical)]
    for _ in range(ROUNDS):
        d = Dictionaries(toxic + _join_words(hard) + base_bytes, _join_words(hard, len(toxic)) + _join_words(hard) + base_bytes)
        hard = [r["w"] for r in _hard_words(rows.filter("toxic = 0"), d).limit(HARD_WORDS).collect()][::-1] or hard
    d = Dictionaries(toxic + _join_words(hard) + base_bytes, _join_words(hard, len(toxic)) + _join_words(hard) + base_bytes)
    measured = score_rows(rows.select("toxic", "text"), d).select("toxic", "x").toPandas()
    return calibrate(np.array(measured["x"].tolist(), float), measured["toxic"].to_numpy(float), d)


def _hard_words(rows: DataFrame, d: Dictionaries) -> DataFrame:
    """Words of ordinary windows on which the toxic dictionary saves, by the bytes saved."""
    shipped = rows.sparkSession.sparkContext.broadcast(d)

    def run(batches):
        compressors = shipped.value.compressors()
        for batch in batches:
            for part in slices(batch):
                saved: dict[str, int] = {}
                for text in part.column("text").to_pylist():
                    w = windows(text)
                    for i in np.flatnonzero((s := savings(compressors, text)) >= 3):
                        for word in w[i].decode("utf-8", "replace").split():
                            saved[word] = saved.get(word, 0) + int(s[i])
                yield pa.record_batch([pa.array(list(saved), pa.string()), pa.array(list(saved.values()), pa.int64())], names=["w", "saved"])

    found = rows.select("text").mapInArrow(run, "w string, saved bigint").filter("length(w) <= 64")
    return found.groupBy("w").agg(F.sum("saved").alias("saved")).orderBy(F.desc("saved"), "w")


def score_rows(docs: DataFrame, d: Dictionaries, into: str = "x") -> DataFrame:
    """Adds the features of every whole text."""
    bounded_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(d)
    made: list[tuple] = []

    def kernel(column: pa.Array) -> pa.Array:
        if not made:
            made.append(shipped.value.compressors())
        return pa.array([features(savings(made[0], t)) for t in column.to_pylist()], pa.list_(pa.float64()))

    return docs.withColumn(into, column_kernel(kernel, "array<double>")(F.col("text")))


def predict(docs: DataFrame, model: Model | float, into: str = "toxicity") -> DataFrame:
    """Adds the struct ``into``: score and predicted. It is the last column, with underscores behind its name if there is such
    a column."""
    into = free_name(docs.columns, into)
    if isinstance(model, float):
        scored, score = docs, F.lit(model)
    else:
        scored = score_rows(docs, model.dictionaries, into)
        z = F.lit(float(model.weights[-1]))
        for i, (m, s, w) in enumerate(zip(model.mean, model.scale, model.weights[:-1], strict=True)):
            z = z + (F.col(into)[i] - float(m)) / float(s) * float(w)
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return scored.withColumn(into, score).withColumn(into, F.struct(F.col(into).alias("score"), F.when(F.col(into) >= 0.5, 1).otherwise(0).alias("predicted")))


def classify(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5) -> DataFrame:
    """The digest: learns outside one fold of documents and scores all of them."""
    model = fit(docs, labels.filter(crc_mod("doc_id", folds) != fold))
    held = F.coalesce(crc_mod("doc_id", folds) == fold, F.lit(False)).alias("held_out")
    return predict(docs.select("doc_id", "text", held), model, "found").select("doc_id", "held_out", "found.*")
