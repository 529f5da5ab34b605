"""Batch job: one row of rate, variability, exertion and recovery for each recording of an event table.

    python jobs/rate_report.py --events /data/events.parquet --out /reports/rates [--config mine.json]

Events are beats of the recording ``user_id``. The report is partitioned by the day on which a recording starts. A run
replaces the whole report, so running it again gives the same rows, and recordings that are gone leave it. Recordings with
fewer than ``least_beats`` beats have the status ``too few beats`` and no values. Rows without a recording, time or value
are left out; a table without rows gives a report without any. A recording is worked on in one task of each step, in order
of time, as long as sorted rows of one recording fit on one machine's disk.
"""

from __future__ import annotations

import sys
from dataclasses import replace
from pathlib import Path

if __package__ in (None, ""):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import Counted, log, main
from pcgspark.operators import metrics
from pcgspark.params import DEFAULTS
from pcgspark.plans import adapter

COUNTS = (
    "n_points bigint, avg_bpm double, min_bpm double, max_bpm double, n_windows bigint, avg_rmssdc double, avg_sdnn double, hrr_bpm double, "
    "exertion_start_sec double, exertion_duration_sec double, exertion_slope double, recovery_start_sec double, recovery_duration_sec double, recovery_slope double"
)
SLOPE = ("start_sec", "duration_sec", "slope")


def report(events: DataFrame, config: dict) -> DataFrame:
    """The report's rows, from a table with user_id, ts and value."""
    p = replace(DEFAULTS, hrv_window_size_beats=config["hrv_window_beats"], hrv_step_size_beats=config["hrv_step_beats"])
    events = events.filter("user_id is not null and ts is not null and value is not null")
    starts = events.groupBy(F.col("user_id").alias("recording_id")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("start_day"), F.count(F.lit(1)).alias("n_beats"))
    beats = adapter.signal_of(events).select("recording_id", "idx", "t_us", "t_sec", "amp")
    series = metrics.rate_series(beats, p)
    slope = lambda df, name: df.select("recording_id", *[F.col(c).alias(f"{name}_{c}") for c in SLOPE])
    parts = [
        metrics.summary(series),
        metrics.hrv_summary(metrics.hrv_windows(beats, p)),
        metrics.rate_recovery(series, config["recovery_sec"]).select("recording_id", "hrr_bpm"),
        slope(metrics.peak_exertion(series, config["slope_sec"]), "exertion"),
        slope(metrics.peak_recovery(series, config["slope_sec"]), "recovery"),
    ]
    out = starts
    for part in parts:
        out = out.join(part, "recording_id", "left")
    enough = F.col("n_beats") >= config["least_beats"]
    own = ("recording_id", "start_day", "n_beats")
    return out.select("recording_id", "n_beats", F.when(enough, "ok").otherwise("too few beats").alias("status"), *[F.when(enough, F.col(c)).alias(c) for c in out.columns if c not in own], "start_day")


def run(spark: SparkSession, events: str, out: str, config: dict) -> dict:
    """Writes the rate report of all recordings, partitioned by the day they start."""
    count = Counted()
    log.info("reading %s, writing %s with %s", events, out, config)
    rows = count("rows written", report(count("events read", spark.read.parquet(events)), config))
    rows.repartition("start_day", F.pmod(F.xxhash64("recording_id"), F.lit(config["files_a_day"]))).write.mode("overwrite").partitionBy("start_day").parquet(out)
    return count.told()


def result(spark: SparkSession, out: str) -> DataFrame:
    """The report as it stands."""
    return spark.read.schema(f"recording_id bigint, n_beats bigint, status string, {COUNTS}, start_day string").parquet(out)


if __name__ == "__main__":
    main("rate_report", {"events": "table of events", "out": "folder of the report"}, run)
