"""Token counts through a digest cache.

A cache row is keyed by the tokenizer's version digest and the digest of the normalised text. Counting joins the
documents' digests with the cache, encodes each distinct miss once, appends the new counts and joins again.

Normalisation is exactly the tokenizer's own (it maps a space to U+2581 and changes nothing else), so texts with
equal digests have equal counts. Null and empty texts have 0 tokens. Repeated rows share one cache row. Digests are
SHA-256; counts are of whole texts, very long ones too, without special tokens or truncation. Rows of one doc_id are
counted one by one; an empty table stays empty; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pcgspark.llm.common import bounded_batches, free_name, scratch_dir, slices, texts

CACHE_SCHEMA = "digest binary, n_tokens bigint"
OVER_LIMIT = 4096
_loaded: dict[str, object] = {}


class SentencePieceCounter:
    """Counts of one model file; the file's bytes (under a few MB) are shipped, so executors need no file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = Path(path).read_bytes()
        self.version = hashlib.sha256(self.model + f"|sentencepiece {sentencepiece.__version__}".encode()).hexdigest()[:32]

    def counts(self, values: list[str]) -> list[int]:
        import sentencepiece

        if self.version not in _loaded:
            _loaded[self.version] = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return [len(ids) for ids in _loaded[self.version].encode(values, num_threads=1)]


def digest(text: str | Column) -> Column:
    """SHA-256 of the normalised text; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("▁")), 256))


def cache_path(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/tokenizer={version}"


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored counts of one tokenizer version; None before the first append."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    exists = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(CACHE_SCHEMA).parquet(path) if exists else None


def _distinct(cache: DataFrame) -> DataFrame:
    """One row for each digest. Two writers may have appended the same one; where none did, the stored rows are used
    as they are, so that Spark can split a hot digest in a join (it can't below an aggregate)."""
    n, kinds = cache.agg(F.count(F.lit(1)), F.count_distinct("digest")).first()
    return cache if n == kinds else cache.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_misses(docs: DataFrame, tokenizer: SentencePieceCounter, root: str, text: str = "text") -> str:
    """Encodes each distinct text that the cache lacks and appends its count. Returns the cache's path.

    Texts are first reduced to one for each digest in every map task (a hot text is shuffled once a task), then
    meet by digest; that partitioning also serves the anti join.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    path = cache_path(root, tokenizer.version)
    one = docs.groupBy(digest(text).alias("digest")).agg(F.first(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    if (cache := read_cache(spark, path)) is not None:
        one = one.join(cache, "digest", "left_anti")
    shipped = spark.sparkContext.broadcast(tokenizer)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                n = shipped.value.counts(texts(part.column("text")))
                yield pa.record_batch([part.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    one.mapInArrow(run, CACHE_SCHEMA).write.mode("append").parquet(path)
    return path


def count_tokens(docs: DataFrame, tokenizer: SentencePieceCounter, root: str, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """Adds the token count of every row in the last column, with underscores behind its name if there is such a column. Rows
    with equal contents get equal counts. Only digests are shuffled in this last join, not texts; AQE splits a hot digest."""
    path = append_misses(docs, tokenizer, root, text)
    key, into = free_name(docs.columns, "__digest"), free_name(docs.columns, into)
    cache = _distinct(read_cache(docs.sparkSession, path)).select(F.col("digest").alias(key), F.col("n_tokens").alias(into))
    return docs.withColumn(key, digest(text)).join(cache, key, "left").select(*[F.col(f"`{c}`") for c in docs.columns], into)


def count_documents(docs: DataFrame, model: str, root: str | None = None, limit: int = OVER_LIMIT) -> DataFrame:
    """The digest columns: doc_id, n_bytes, n_tokens, over_limit. Without ``root``, a new cache in the scratch folder."""
    tokenizer = SentencePieceCounter(model)
    root = root or scratch_dir(docs.sparkSession)
    path = append_misses(docs.select("text"), tokenizer, root)
    cache = _distinct(read_cache(docs.sparkSession, path))
    keyed = docs.select("doc_id", digest("text").alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    out = keyed.join(cache, "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
