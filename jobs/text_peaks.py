"""Incremental job: texts that stand out of their source, like beats out of the noise of a recording.

    python jobs/text_peaks.py --documents /data/documents.parquet --out /watch --checkpoint /watch-checkpoint [--config mine.json]

The texts of a source, in order of doc_id, are a series whose amplitude is the number of words. Its baseline is the mean over
``window`` ids around a text, and a peak is a text of at least ``ratio`` times its baseline that no text of its source within
``distance`` ids reaches (of equals the first). Each text becomes a row: doc_id, source, lang, n_words, baseline, is_peak.

A file stream takes the files that are new since the last run; its checkpoint says which. A batch stores the lengths of its
texts (``out/lengths``, partitioned by batch and by block of ids) and writes the rows anew (``out/rows``, partitioned by block)
of every block that it touches and of those beside it, from the stored lengths of these and their neighbours. Both writes
replace partitions whole, so a batch that is run again after a failure, or a run without new files, leaves the same rows.
Blocks also cut a very large source into many tasks.

A doc_id that comes again replaces its row (the last batch counts, within a batch the greatest row). Rows without a doc_id
are left out, a null text has no words, and texts without a source are a source of their own. Before there is any file with
rows, there is nothing to write.
"""

from __future__ import annotations

import sys
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import Counted, log, main
from pcgspark.operators import rolling

LENGTHS, ROWS = "lengths", "rows"
_MEASURES = ("source", "lang", "n_words")
_STORED = "doc_id bigint, source string, lang string, n_words bigint, batch bigint, block bigint"


def lengths(documents: DataFrame, config: dict) -> DataFrame:
    """doc_id, source, lang, n_words and the block of each text."""
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " "))
    n = F.when(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")) == "", 0).otherwise(words)
    rows = documents.filter("doc_id is not null")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.coalesce(n, F.lit(0)).cast("bigint").alias("n_words"), rolling.piece_of(F.col("doc_id").cast("bigint"), config["block"]).alias("block"))


def peaks(stored: DataFrame, config: dict) -> DataFrame:
    """The rows of all texts of ``stored``, which has a text for each doc_id, with their block."""
    half, distance = config["window"] // 2, config["distance"]
    reach = max(half, distance)
    cut = rolling.in_pieces(stored.drop("block"), "doc_id", config["block"], reach, reach, "block")
    by = ("source", "block")
    order = Window.partitionBy(*by).orderBy("doc_id")
    baseline = rolling.time_mean("n_words", "doc_id", config["window"] / 1e6, by)
    earlier, later = F.max("n_words").over(order.rangeBetween(-distance, -1)), F.max("n_words").over(order.rangeBetween(1, distance))
    out = cut.withColumns({"baseline": baseline, "earlier": earlier, "later": later}).filter("own")
    alone = F.coalesce(F.col("earlier") < F.col("n_words"), F.lit(True)) & F.coalesce(F.col("later") <= F.col("n_words"), F.lit(True))
    loud = F.col("n_words") >= config["ratio"] * F.col("baseline")
    return out.select("doc_id", *_MEASURES, "baseline", (alone & loud & (F.col("n_words") > 0)).alias("is_peak"), "block")


def _take(batch: DataFrame, number: int, out: str, config: dict) -> None:
    """One batch of new documents; may be run again."""
    spark, count = batch.sparkSession, Counted()
    replacing = lambda df, *by: df.repartition("block").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    new = count("texts stored", lengths(count("documents read", batch), config)).withColumn("batch", F.lit(number).cast("bigint"))
    replacing(new, "batch", "block").parquet(f"{out}/{LENGTHS}")
    stored = spark.read.schema(_STORED).parquet(f"{out}/{LENGTHS}")
    touched = stored.filter(F.col("batch") == number).select("block").distinct()
    beside = lambda blocks: blocks.select(F.explode(F.array(*[F.col("block") + i for i in (-1, 0, 1)])).alias("block")).distinct()
    anew = beside(touched)
    near = stored.join(beside(anew), "block", "left_semi")
    latest = near.groupBy("doc_id").agg(F.max(F.struct("batch", *_MEASURES)).alias("x"))
    latest = latest.select("doc_id", *[f"x.{c}" for c in _MEASURES], rolling.piece_of(F.col("doc_id"), config["block"]).alias("block"))
    rows = count("rows written", peaks(latest, config).join(anew, "block", "left_semi"))
    replacing(rows.select("doc_id", *_MEASURES, "baseline", "is_peak", "block"), "block").parquet(f"{out}/{ROWS}")
    count.told(batch=number)


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> dict:
    """Takes the documents that are new since the last run, and ends when there are no more."""
    if max(config["window"] // 2, config["distance"]) > config["block"]:
        raise ValueError("a block must be longer than the window's half and the distance")
    log.info("reading %s from where %s says, writing %s with %s", documents, checkpoint, out, config)
    schema = spark.read.parquet(documents).select("doc_id", "text", "lang", "source").schema
    new = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(_listed(documents))
    query = new.writeStream.foreachBatch(lambda batch, number: _take(batch, number, out, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    read = sum(p["numInputRows"] for p in map(_progress, query.recentProgress))
    log.info("documents read in this run: %s", read)
    return {"documents read": read}


def _listed(path: str) -> str:
    """The path as a pattern that only it fits, since a file stream takes a single file in no other way."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def _progress(p) -> dict:
    return p if isinstance(p, dict) else {"numInputRows": p.numInputRows}


def result(spark: SparkSession, out: str) -> DataFrame:
    """The rows as they stand."""
    return spark.read.schema("doc_id bigint, source string, lang string, n_words bigint, baseline double, is_peak boolean, block bigint").parquet(f"{out}/{ROWS}")


if __name__ == "__main__":
    main("text_peaks", {"documents": "table of documents", "out": "folder of lengths and rows", "checkpoint": "folder of the stream's checkpoint"}, run)
