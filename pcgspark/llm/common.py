"""Helpers shared by the operators: tables, the shared scratch folder, Arrow batches of bounded size."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pcgspark.functions.shipping import ship

#: Bytes of text that a kernel takes at once; a longer text is taken alone.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``. Where that is unset, a temporary folder of this process, which only
    a session on one machine can use; it goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="pcgspark-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/pcgspark/{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared scratch folder and read it back; cuts lineage and survives lost executors.
    Nobody reads the shuffles behind a stored table again, so their files go when it is written."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator's run: ``keep(df)`` stores one, and on exit all go but those stored by ``keep.result``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []
        self.of: dict[int, str] = {}

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(scratch_dir(self.spark))
        stored = materialise(df, self.paths[-1])
        self.of[id(stored)] = self.paths[-1]
        return stored

    def drop(self, stored: DataFrame) -> None:
        """Deletes a table that is not read again, before the run ends."""
        path = self.of.pop(id(stored))
        self.paths.remove(path)
        remove(self.spark, [path])

    def result(self, df: DataFrame) -> DataFrame:
        return materialise(df)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders in the file system they lie in. A session without a JVM of its own leaves them."""
    if (jvm := getattr(spark, "_jvm", None)) is None:
        return
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """Workers get the package, and Arrow batches a bound in bytes; a longer text stands alone in its batch."""
    ship(spark)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as make it differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Returns a worker's freed memory to the machine. A worker waits for its next task between stages, and what its
    allocators hold meanwhile counts beside the JVM's memory and that of the other workers."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def map_arrow(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``df.mapInArrow`` with a kernel on slices of about SLICE_BYTES of the column ``text``."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield kernel(part)
        give_back()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, cut before ``column`` passes ``limit`` bytes; a longer value stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null becomes the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def crc_mod(column: str, m: int):
    """crc32 of the decimal id modulo m, the fold of a labelled row."""
    return F.crc32(F.col(column).cast("string")) % m


def column_kernel(kernel: Callable[[pa.Array], pa.Array], returns: str):
    """A scalar Arrow UDF: ``kernel`` gets slices of a text column and returns as many values.

    It counts as nondeterministic only so that Catalyst doesn't evaluate it a second time below a filter.
    """
    from pyspark.sql.functions import arrow_udf

    def run(column: pa.Array) -> pa.Array:
        batch = pa.record_batch([column], names=["text"])
        parts = [kernel(part.column(0)) for part in slices(batch)]
        if not parts:
            return kernel(column)
        give_back()
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return arrow_udf(run, returns).asNondeterministic()
