"""Files with names of their own: a data source writer that makes one file of each row.

Spark's file writers choose names themselves. Here a row is (name, content), and its content becomes ``<path>/<name>`` when
the whole write is committed. Tasks write into a folder of their attempt below ``<path>/.pending-<write>``; committing moves the
files of the attempts that counted to their places, each at once, and both committing and aborting remove the folder. So a
failed task leaves nothing, and a write that is run again replaces its files; tasks tell the driver their folder only. The folder must be one that all workers see
by the same path; for stores that only Spark reaches, the sinks write a folder for each recording.

Of rows with one name the last one to be moved counts; names with a separator or without a letter are refused, a null content is
an empty file.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from pcgspark.functions.shipping import ship
from pcgspark.sources import sinks

SCHEMA = "name string, content binary"


@dataclass
class _Written(WriterCommitMessage):
    folder: str


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.pending = os.path.join(self.path, f".pending-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[Row]) -> _Written:
        folder = os.path.join(self.pending, uuid.uuid4().hex)
        os.makedirs(folder)
        for row in iterator:
            name = row["name"]
            if not name or os.path.basename(name) != name or not any(c.isalnum() for c in name):
                raise ValueError(f"not a file's name: {name!r}")
            with open(os.path.join(folder, name), "wb") as f:
                f.write(row["content"] or b"")
        return _Written(folder)

    def commit(self, messages: list[_Written | None]) -> None:
        folders = [m.folder for m in messages if m is not None]
        os.makedirs(self.path, exist_ok=True)
        if self.overwrite:
            for name in os.listdir(self.path):
                if os.path.isfile(old := os.path.join(self.path, name)) and not any(os.path.exists(os.path.join(f, name)) for f in folders):
                    os.remove(old)
        for folder in folders:
            for name in os.listdir(folder):
                os.replace(os.path.join(folder, name), os.path.join(self.path, name))
        shutil.rmtree(self.pending, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.pending, ignore_errors=True)


class NamedFilesDataSource(DataSource):
    """``df.write.format("pcg_named_files").mode("append").save(folder)`` for rows (name, content); ``overwrite`` also removes
    the folder's other files."""

    @classmethod
    def name(cls) -> str:
        return "pcg_named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


def local_path(path: str) -> str | None:
    """The path below a ``file:`` URL or a plain path; None for what only Spark reaches."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return path
    return "/" + rest.lstrip("/") if scheme == "file" else None


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Rows (name, content) as files in a folder that all workers see."""
    ship(files.sparkSession)
    files.sparkSession.dataSource.register(NamedFilesDataSource)
    files.select("name", "content").write.format("pcg_named_files").mode("overwrite" if overwrite else "append").save(path)


def _of(rows: DataFrame, suffix: str, content: Column) -> DataFrame:
    return rows.select(F.concat(F.col("recording_id").cast("string"), F.lit(suffix)).alias("name"), content.alias("content"))


def text_files(texts: DataFrame, suffix: str) -> DataFrame:
    """Files of (recording_id, value): label files, reports, logs."""
    return _of(texts, suffix, F.encode("value", "utf-8"))


def rate_files(series: DataFrame) -> DataFrame:
    """``<id>_bpm_plot.csv``: time and rate with three places, in order of time; rows without a value are left out."""
    known = series.filter(F.col("smoothed_bpm").isNotNull() & ~F.isnan("smoothed_bpm"))
    line = F.format_string("%.3f,%.3f", "t_sec", "smoothed_bpm")
    lines = known.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_sec", line.alias("line")))), lambda x: x.line).alias("lines"))
    return text_files(lines.select("recording_id", F.concat(F.lit("Time (s),Average BPM\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("value")), "_bpm_plot.csv")


def settings_files(settings: DataFrame) -> DataFrame:
    """``<id>_Analysis_Settings.json``: the hint, null where there is none."""
    hint = F.to_json(F.struct("start_bpm_hint"), {"ignoreNullFields": "false"})
    return text_files(settings.select("recording_id", hint.alias("value")), "_Analysis_Settings.json")


def debug_files(prepared: DataFrame) -> DataFrame:
    """``<id>_filtered_debug.wav``: the band-passed signal."""
    return _of(sinks.debug_wav(prepared), "_filtered_debug.wav", F.col("content"))
