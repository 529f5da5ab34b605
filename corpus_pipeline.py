"""A corpus pipeline: quality rules, line dedup, near-duplicate join, mixing, tokenisation.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's
``docs``. All but the last return the columns of ``documents``, and whatever other columns came with them.

Odd rows: a null or empty text has no words, so the quality rules drop it; further on, null and empty texts pass all
stages unchanged and get no tokens. A row with a null doc_id is never removed as a repetition, a near duplicate or by
the draw. Rows of one doc_id with different texts are judged, deduplicated and drawn one by one; rows that are equal in
doc_id and text stay or go together. Of near duplicates the least doc_id stays. Very long texts are taken whole, and an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pcgspark.llm import bpe, jaccard_join, line_dedup, mixing, quality
from pcgspark.llm.common import free_name, materialise, remove, scratch_dir, table

#: Near duplicates: five-word shingles, similarity 0.8 or more.
NEAR = jaccard_join.Spec(5, 80, 100)
#: The mixture's tokens by domain. Junk and toxic text is drawn down to its share; documents of KEPT all stay.
WEIGHTS = {"clean": 0.97, "junk": 0.02, "toxic": 0.01}
KEPT = "clean"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base or the web policy; the others pass unchanged."""
    into = free_name(docs.columns, "__ledger")
    bits = F.col(f"{into}.fail_bits")
    return quality.ledger(docs, into=into).filter(quality.passes(bits, quality.BASE) & quality.passes(bits, quality.WEB)).drop(into)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages; a document of which no word is left goes. n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    into = out.columns[-1]
    out = out.filter((F.col(f"{into}.n_removed") == 0) | F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).drop(into)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each class of near duplicates."""
    return jaccard_join.keep_one(docs, NEAR)


def draw(rated: DataFrame) -> DataFrame:
    """Adds ``chance``, with which a document of ``mixing.mix`` stays, and ``stays``. Rates are at most 1, so they are the
    chances; documents of KEPT all stay. A domain with less than its weight stays whole."""
    chance = F.when(F.col("domain") == KEPT, F.lit(1.0)).otherwise(F.col("rate"))
    return rated.withColumn("chance", chance).withColumn("stays", F.col("u") < F.col("chance"))


def shares(drawn: DataFrame) -> DataFrame:
    """(domain, before, after): shares of the tokens by posterior's best domain, before and after the draw."""
    tokens = F.sum("tokens"), F.sum(F.when(F.col("stays"), F.col("tokens")).otherwise(0))
    by = drawn.groupBy("domain").agg(tokens[0].alias("before"), tokens[1].alias("after"))
    whole = Window.partitionBy(F.lit(1))  # a row for each domain
    return by.select("domain", *[(F.col(c) / F.sum(c).over(whole)).alias(c) for c in ("before", "after")])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each document with its fitted rate; the documents of KEPT all stay, and the others come down to their
    weights beside them. Texts of one doc_id are drawn by their own rates."""
    rated, _ = mixing.mix(docs, mixing.domains_of(table(spark, sf_dir, "labels")), WEIGHTS, most=1.0, whole=KEPT)
    gone = draw(rated).filter("not stays").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__t")), "left_anti")


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 by byte-level BPE."""
    import public_tokenizers

    return bpe.round_trip(docs, bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", tokenise),
]

#: SQL can't express the chunking, the fitted rates or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared scratch folder and read again. A stage's table goes when the
    next one is written; that of the last but one stays, since the result is read from it."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark) + "-" + name
        docs = materialise(stage(spark, docs, sf_dir), path)
        remove(spark, before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
