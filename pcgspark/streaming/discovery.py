"""New recordings in a folder, each analysed once.

A file stream lists the folder and keeps in its checkpoint which files it has taken, so a later run takes only new ones (and
those written anew). A batch of recordings goes through the whole analysis, and what it finds is stored in partitions of the
batch: ``out/summary`` and ``out/rates``. Both writes replace the batch's partitions, so a batch that is run again after a failure
leaves the same rows; ``latest`` shows for each recording what its last batch found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pcgspark.params import DEFAULTS, Params
from pcgspark.plans import analysis
from pcgspark.sources import wav

_FILES = "path string, modificationTime timestamp, length bigint, content binary"
_PERIOD = "struct<start_sec:double,end_sec:double,start_bpm:double,end_bpm:double,duration_sec:double,slope:double>"
SUMMARY = (
    "recording_id string, status string, start_bpm double, n_points bigint, avg_bpm double, min_bpm double, max_bpm double, n_windows bigint, avg_rmssdc double, avg_sdnn double, hrr_bpm double, "
    f"peak_exertion {_PERIOD}, peak_recovery {_PERIOD}, batch bigint"
)
RATES = "recording_id string, t_sec double, instant_bpm double, smoothed_bpm double, batch bigint"


def recordings_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """(recording_id, path, content) of the WAV files under a folder, as they come."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return files.load(path).select(wav.recording_id().alias("recording_id"), "path", "content")


def _take(batch: DataFrame, number: int, out: str, settings: DataFrame | None, p: Params) -> None:
    found = analysis.analyse(wav.decoded(batch), settings, p)
    try:
        own = F.lit(number).cast("bigint").alias("batch")
        for name, rows in (("summary", found.summary), ("rates", found.series.select("recording_id", "t_sec", "instant_bpm", "smoothed_bpm"))):
            rows.select("*", own).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{out}/{name}")
    finally:
        found.release()


def analyse_new(spark: SparkSession, path: str, out: str, checkpoint: str, settings: DataFrame | None = None, p: Params = DEFAULTS, files_per_batch: int = 100) -> int:
    """Analyses the recordings that are new since the last run with this checkpoint; returns how many files that were."""
    stream = recordings_stream(spark, path, files_per_batch)
    query = stream.writeStream.foreachBatch(lambda batch, number: _take(batch, number, out, settings, p)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return sum(x["numInputRows"] if isinstance(x, dict) else x.numInputRows for x in query.recentProgress)


def latest(spark: SparkSession, out: str, name: str = "summary") -> DataFrame:
    """``summary`` or ``rates`` of each recording by its last batch."""
    rows = spark.read.schema({"summary": SUMMARY, "rates": RATES}[name]).parquet(f"{out}/{name}")
    summary = rows if name == "summary" else spark.read.schema(SUMMARY).parquet(f"{out}/summary")
    last = summary.groupBy("recording_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["recording_id", "batch"]).drop("batch")
