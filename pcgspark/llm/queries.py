"""Registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pcgspark.llm import bpe, collocations, jaccard_join, langid, line_dedup, merge_bpe, mixing, quality, spotsigs, token_counts, toxicity, url_filter
from pcgspark.llm.common import table
from pcgspark.llm.oracle import ORACLE


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed", "text")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_classes(table(spark, sf_dir, "documents"), jaccard_join.Spec(3, 90, 100))


#: Fixed values of the contract: host, path, verdict.
CURATED = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), CURATED)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def spotsigs_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comparison of fingerprints: links between classes of equal ones."""
    return spotsigs.similar_pairs(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = bpe.Vocabulary(tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary)


def op11_merge_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_bpe.round_trip(table(spark, sf_dir, "documents"), merge_bpe.Vocabulary(tokenizer_file("byte_bpe_50k.json")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_mixing, op2_line_dedup, op3_token_counts, op4_language_id, op5_quality_rules, op6_jaccard_join, op7_url_filters, op8_toxicity, op9_spotsigs, op10_byte_bpe, op11_merge_bpe, op12_collocations, pipeline, spotsigs_pairs)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
