"""WAV recordings as rows. Files are read by Spark (any store it knows) and decoded in Arrow batches."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from pcgspark import schema
from pcgspark.functions.shipping import ship

# Suffixes of accepted recordings. Only .wav is decoded here; the others need an outside converter.
SUFFIXES = (".wav", ".mp3", ".m4a", ".flac", ".ogg", ".mp4", ".mkv", ".mov")
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Layout:
    """Where a file's frames lie and what they are."""

    rate: int
    kind: int
    channels: int
    width: int  # bytes of a sample
    at: int  # of the first frame
    frames: int

    def samples(self, data: bytes) -> np.ndarray:
        """Whole frames as mono samples; channels are averaged."""
        if self.kind == FLOAT:
            x = np.frombuffer(data, {4: "<f4", 8: "<f8"}[self.width]).astype(float)
        elif self.width == 1:
            x = np.frombuffer(data, np.uint8).astype(float)
        elif self.width == 3:
            raw = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8).astype(float)
        else:
            x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[self.width]).astype(float)
        return x.reshape(-1, self.channels).mean(1) if self.channels > 1 else x


def layout(f: BinaryIO) -> Layout:
    """Of a RIFF file, from the heads of its chunks: unsigned 8-bit, signed 16/24/32-bit or float PCM."""
    size = f.seek(0, io.SEEK_END)
    f.seek(0)
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, form, data = 12, None, None
    while at + 8 <= size:
        f.seek(at)
        name, length = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            body = f.read(min(length, 40))
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == EXTENSIBLE and len(body) >= 26:
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif name == b"data":
            data = at + 8, min(length, size - at - 8)
        at += 8 + length + length % 2
    if form is None or data is None:
        raise ValueError("a fmt or data chunk is missing")
    kind, channels, rate, _, _, bits = form
    if channels == 0 or bits % 8 or bits == 0 or kind not in (PCM, FLOAT):
        raise ValueError(f"unsupported encoding {kind} with {bits} bits")
    return Layout(rate, kind, channels, bits // 8, data[0], data[1] // (bits // 8 * channels))


def decode(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, mono samples) of a file's bytes."""
    found = layout(io.BytesIO(content))
    return found.rate, found.samples(content[found.at : found.at + found.frames * found.width * found.channels])


def encode(rate: int, x: np.ndarray) -> bytes:
    """A 16-bit mono file, scaled to the largest magnitude; silence stays silent."""
    x = np.asarray(x, float)
    top = np.abs(x).max() if len(x) else 0.0
    data = (x / top * 32767 if top > 0 else x * 0).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, PCM, 1, rate, 2 * rate, 2, 16, b"data", len(data))
    return head + data


def recording_id(path: str = "path"):
    """File name without folder and suffix."""
    return F.regexp_extract(F.col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, modificationTime, length and content of the WAV files under the given folders or files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]").option("recursiveFileLookup", "true").load(path)


def _decoded(batches: Iterator) -> Iterator:
    import pandas as pd

    for pdf in batches:
        rows = []
        for rid, path, content in zip(pdf["recording_id"], pdf["path"], pdf["content"], strict=True):
            try:
                rate, x = decode(bytes(content))
                rows.append((rid, path, rate, x.tolist()))
            except (ValueError, KeyError, struct.error):
                rows.append((rid, path, None, None))
        out = pd.DataFrame(rows, columns=["recording_id", "path", "sample_rate", "samples"])
        yield out.assign(sample_rate=out["sample_rate"].astype("Int32"))


def read_recordings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """recording_id, path, sample_rate, samples; both last are null for a file that can't be decoded."""
    return decoded(files(spark, path).select(recording_id().alias("recording_id"), "path", "content"))


def decoded(contents: DataFrame) -> DataFrame:
    """Recordings from rows (recording_id, path, content) of WAV bytes."""
    ship(contents.sparkSession)
    return contents.select("recording_id", "path", "content").mapInPandas(_decoded, schema.RECORDINGS)


def with_fallback(processed: DataFrame, original: DataFrame) -> DataFrame:
    """Processed recordings, and originals of those that have none. Ids of processed files end in _filtered_debug."""
    named = processed.withColumn("recording_id", F.regexp_replace("recording_id", "_filtered_debug$", ""))
    return named.unionByName(original.join(named.select("recording_id"), "recording_id", "left_anti").select(named.columns))


def _wav_files(path: str) -> list[tuple[str, str]]:
    """(id, path) of the WAV files under a folder, or of one file."""
    import os

    found = [path] if os.path.isfile(path) else [os.path.join(folder, name) for folder, _, names in os.walk(path) for name in names]
    return [(os.path.splitext(os.path.basename(f))[0], f) for f in sorted(found) if f.lower().endswith(".wav")]


@dataclass
class _Stretch(InputPartition):
    """Frames first .. last - 1 of a file; without a layout the whole file."""

    recording_id: str
    path: str
    layout: Layout | None = None
    first: int = 0
    last: int = 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [_Stretch(*x) for x in _wav_files(self.path)]

    def read(self, partition: _Stretch):
        with open(partition.path, "rb") as f:
            rate, x = decode(f.read())
        yield partition.recording_id, partition.path, rate, x.tolist()


class WavDataSource(DataSource):
    """``spark.read.format("pcg_wav").load(folder)`` for folders that all workers see; a task for each file."""

    @classmethod
    def name(cls) -> str:
        return "pcg_wav"

    def schema(self) -> str:
        return schema.RECORDINGS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _SampleReader(DataSourceReader):
    """A long file is cut into stretches of frames, a task each."""

    def __init__(self, options: dict):
        self.path, self.stretch = options["path"], int(options.get("stretch", 4_000_000))
        if self.stretch < 1:
            raise ValueError("a stretch has a sample or more")
        self.ids: set[str] | None = None
        self.first, self.last = 0, 1 << 62

    def partitions(self) -> list[InputPartition]:
        out = []
        for rid, path in _wav_files(self.path):
            if self.ids is None or rid in self.ids:
                try:
                    with open(path, "rb") as f:
                        found = layout(f)
                except (ValueError, struct.error):
                    continue  # no recording; ``read_recordings`` lists such files
                end = min(found.frames, self.last)
                out += [_Stretch(rid, path, found, i, min(i + self.stretch, end)) for i in range(self.first, end, self.stretch)]
        return out or [_Stretch("", "")]

    def read(self, partition: _Stretch):
        import pyarrow as pa

        at, found = partition.first, partition.layout
        if found is None:
            return
        frame = found.width * found.channels
        with open(partition.path, "rb") as f:
            f.seek(found.at + at * frame)
            while at < partition.last:
                n = min(1 << 16, partition.last - at)
                x = found.samples(f.read(n * frame))
                yield pa.record_batch([pa.array([partition.recording_id] * n, pa.string()), pa.array(np.full(n, found.rate, np.int32)), pa.array(np.arange(at, at + n)), pa.array(x)], names=["recording_id", "sample_rate", "idx", "amp"])
                at += n


class _FilteredSampleReader(_SampleReader):
    """Filters on the id choose files before any is opened, and those on ``idx`` choose the frames that are read; Spark applies
    what is left."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (Spark's name)
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("recording_id",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.ids = wanted if self.ids is None else self.ids & wanted
            elif column == ("idx",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value + (not isinstance(f, LessThan)))
            else:
                yield f


class WavSamplesDataSource(DataSource):
    """``spark.read.format("pcg_wav_samples").option("stretch", n).load(folder)``: a row for each sample, of folders that all
    workers see. With the option ``push``, which needs ``spark.sql.python.filterPushdown.enabled`` (Spark refuses a reader that
    takes filters otherwise), filters on recording_id and idx choose what is read."""

    @classmethod
    def name(cls) -> str:
        return "pcg_wav_samples"

    def schema(self) -> str:
        return "recording_id string, sample_rate int, idx bigint, amp double"

    def reader(self, schema) -> DataSourceReader:
        return (_FilteredSampleReader if self.options.get("push") == "true" else _SampleReader)(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    for source in (WavDataSource, WavSamplesDataSource):
        spark.dataSource.register(source)


def read_samples(spark: SparkSession, path: str, stretch: int = 4_000_000) -> DataFrame:
    """recording_id, sample_rate, idx, amp of all samples under a folder that all workers see; long files span many tasks, and
    filters reach the files where the session lets Python sources take them."""
    register(spark)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("pcg_wav_samples").options(stretch=str(stretch), push=push).load(path)
