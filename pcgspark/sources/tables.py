"""Settings, rate tables and label files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pcgspark import schema
from pcgspark.sources.wav import SUFFIXES, recording_id

BY = ("recording_id",)


#: Folder of one recording, as the sinks write it.
_FOLDER = r"recording_id=([^/]+)/[^/]+$"


def _named(df: DataFrame, suffix: str, folders: bool = False) -> DataFrame:
    pattern = _FOLDER if folders else rf"([^/]+){suffix}$"
    return df.withColumn("recording_id", F.regexp_extract(F.input_file_name(), pattern, 1))


def _lookup(reader, glob: str, folders: bool):
    """``folders``: a folder for each recording, instead of files with the recording's name."""
    return reader.option("recursiveFileLookup", "true") if folders else reader.option("pathGlobFilter", glob)


def is_recording(path: str = "path"):
    """Accepted suffix, in any case."""
    return F.lower(F.col(path)).rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")


def list_recordings(spark: SparkSession, path: str) -> DataFrame:
    """recording_id, path, length and modificationTime of files with an accepted suffix, in any case, under a folder; their
    content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return found.filter(is_recording()).select(recording_id().alias("recording_id"), "path", "length", "modificationTime")


def read_settings(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """recording_id, start_bpm_hint of ``<id>_Analysis_Settings.json`` files; a corrupt file gives no hint."""
    rows = _lookup(spark.read.option("multiLine", "true").option("mode", "PERMISSIVE"), "*_Analysis_Settings.json", folders).schema(schema.SETTINGS).json(path)
    return _named(rows, "_Analysis_Settings\\.json", folders).select("recording_id", "start_bpm_hint")


def read_rates(spark: SparkSession, path: str, folders: bool = False) -> DataFrame:
    """recording_id, t_sec, bpm of ``<id>_bpm_plot.csv`` files."""
    rows = _lookup(spark.read.option("header", "true"), "*_bpm_plot.csv", folders).schema(schema.BPM_CSV).csv(path)
    return _named(rows, "_bpm_plot\\.csv", folders).select("recording_id", F.col("Time (s)").alias("t_sec"), F.col("Average BPM").alias("bpm"))


def processed_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Ids of recordings that have a rate table; lists files without reading them."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*_bpm_plot.csv").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)_bpm_plot\.csv$", 1).alias("recording_id")).distinct()


def read_labels(spark: SparkSession, path: str, suffix: str = "_labels", folders: bool = False) -> DataFrame:
    """recording_id, t_sec, bpm, peak_type of label files, plain or with ``# Peak Labels`` / ``# S1-S2 Intervals``
    sections. Lines that are no labels are left out."""
    lines = _lookup(spark.read.option("wholetext", "true"), f"*{suffix}.csv", folders).text(path)
    rows = _named(lines, f"{suffix}\\.csv", folders).select("recording_id", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    w = Window.partitionBy(*BY).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("line").startswith("#"), F.trim(F.col("line"))), ignorenulls=True).over(w)
    rows = rows.withColumn("section", section).filter("section is null or section = '# Peak Labels'")
    parsed = rows.select("recording_id", F.from_csv("line", "t double, b double, p string", {"mode": "PERMISSIVE"}).alias("c"))
    return parsed.filter("c.t is not null and c.p in ('S1', 'S2')").select("recording_id", F.col("c.t").alias("t_sec"), F.col("c.b").alias("bpm"), F.col("c.p").alias("peak_type"))
