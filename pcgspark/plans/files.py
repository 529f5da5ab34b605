"""Queries that write files through the sinks and read them again through the sources."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pcgspark.functions import exprs as X
from pcgspark.operators import labels as lab
from pcgspark.operators import metrics
from pcgspark.plans.adapter import beats, labels, series, signal
from pcgspark.plans.catalogue import out, query
from pcgspark.sources import named, sinks, tables, wav

_own: list[str] = []


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share: under ``spark.checkpoint.dir``; a temporary one on a single machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="pcgspark-files-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        base = f"file://{_own[0]}"
    return f"{base.rstrip('/')}/pcgspark-files/{uuid.uuid4().hex}"


def _id(rows: DataFrame) -> DataFrame:
    """Rows without an id are a recording of their own, with a name that no id of the event table has."""
    return rows.withColumn("recording_id", F.coalesce(F.col("recording_id").cast("string"), F.lit(_NONE)))


def _read(spark: SparkSession, files: DataFrame, write: Callable[[str], None], read: Callable) -> DataFrame:
    """What is read from a file for each recording, with the name that the reference gives it; where only Spark reaches the
    folder, from the folders that ``write`` makes."""
    path = _folder(spark)
    if (local := named.local_path(path)) is None:
        write(path)
    else:
        named.write_files(files, local)
    found = read(spark, path, folders=local is None)
    return found.withColumn("recording_id", F.expr(f"nullif(recording_id, '{_NONE}')"))


_NONE = "no-recording"
_MILLIS = "((t_us + 500) // 1000) / 1000.0"


@query(f"select cast(recording_id as varchar) as recording_id, {_MILLIS} as t_sec, round(smoothed_bpm, 3) as bpm from series")
def rate_files(spark, sf):
    rates = _id(series(spark, sf))
    return _read(spark, named.rate_files(rates), partial(sinks.write_rates, rates), tables.read_rates)


@query(f"select cast(recording_id as varchar) as recording_id, {_MILLIS} as t_sec, round(amp, 3) as bpm, case event_type when 'click' then 'S1' else 'S2' end as peak_type from signal where event_type in ('click', 'view')")
def label_files(spark, sf):
    rows = _id(labels(spark, sf))
    texts = sinks.label_text(rows, lab.pairs(rows))
    return _read(spark, named.text_files(texts, "_labels.csv"), partial(sinks.write_text, texts), tables.read_labels)


@query("select cast(recording_id as varchar) as recording_id, round(case when count(*) % 2 = 0 then max(amp) end, 6) as start_bpm_hint from signal group by 1")
def settings_files(spark, sf):
    hint = F.when(F.count(F.lit(1)) % 2 == 0, F.max("amp")).alias("start_bpm_hint")
    settings = _id(beats(spark, sf).groupBy("recording_id").agg(hint))
    found = _read(spark, named.settings_files(settings), partial(sinks.write_settings, settings), tables.read_settings)
    return out(found, "recording_id", start_bpm_hint="start_bpm_hint")


@query("select cast(recording_id as varchar) as recording_id, idx, cast(trunc(amp / max(abs(amp)) over (partition by recording_id) * 32767) as integer) as pcm from signal")
def wav_round_trip(spark, sf):
    """Samples as the bytes of a WAV file, decoded again."""
    packed = signal(spark, sf).groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("idx", "amp"))).alias("s"))
    rows = packed.select(F.col("recording_id").cast("string"), F.lit(400).alias("sample_rate"), F.transform("s", lambda x: x.amp).alias("filtered"))
    found = wav.decoded(sinks.debug_wav(rows).withColumn("path", F.lit(None).cast("string")))
    return found.select("recording_id", F.posexplode("samples").alias("idx", "x")).select("recording_id", F.col("idx").cast("bigint").alias("idx"), F.col("x").cast("int").alias("pcm"))


@query(
    """, done as (select recording_id || '' as recording_id, count(*) as n from signal where recording_id % 3 = 0 group by 1)
select recording_id, n, 'processed' as kind from done union all
select cast(recording_id as varchar), count(*), 'original' from signal where cast(recording_id as varchar) not in (select recording_id from done) group by 1"""
)
def processed_fallback(spark, sf):
    rows = signal(spark, sf).groupBy(F.col("recording_id").cast("string").alias("recording_id")).agg(F.count(F.lit(1)).alias("n"))
    done = rows.filter(F.col("recording_id").cast("bigint") % 3 == 0).withColumns({"recording_id": F.concat("recording_id", F.lit("_filtered_debug")), "kind": F.lit("processed")})
    return wav.with_fallback(done, rows.withColumn("kind", F.lit("original")))


@query("select cast(recording_id as varchar) || ',' || printf('%.2f', avg(smoothed_bpm)) as line from series group by recording_id")
def rate_lines(spark, sf):
    return metrics.summary(series(spark, sf)).select(F.concat_ws(",", F.col("recording_id").cast("string"), X.printf("%.2f", "avg_bpm")).alias("line"))
