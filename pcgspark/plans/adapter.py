"""The event table as recordings: one per user, ordered by time, amplitude = value; a minute of event time is a millisecond."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pcgspark.operators import metrics

SCALE = 60_000


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_of(spark.read.parquet(f"{sf_dir}/events.parquet"))


def signal_of(events: DataFrame) -> DataFrame:
    """recording_id, event_id, event_type, amp, idx (from 0), t_us, t_sec."""
    w = Window.partitionBy("recording_id").orderBy("ts", "event_id")
    rows = events.select(F.col("user_id").alias("recording_id"), "event_id", "event_type", F.col("value").alias("amp"), "ts")
    # in order of time the least so far is the least of all, so both need one sort
    rows = rows.withColumns({"first_ts": F.min("ts").over(w.rowsBetween(Window.unboundedPreceding, 0)), "idx": F.row_number().over(w).cast("bigint") - 1})
    return rows.select("recording_id", "event_id", "event_type", "amp", "idx", F.expr(f"timestampdiff(MICROSECOND, first_ts, ts) div {SCALE}").alias("t_us")).withColumn("t_sec", F.col("t_us") / 1e6)


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a beat."""
    return signal(spark, sf_dir).select("recording_id", "idx", "t_us", "t_sec", "amp")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rate_series(beats(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks are S1 labels, views S2 labels; the rate is the value."""
    kind = F.when(F.col("event_type") == "click", "S1").when(F.col("event_type") == "view", "S2")
    return signal(spark, sf_dir).select("recording_id", "t_sec", F.col("amp").alias("bpm"), kind.alias("peak_type")).filter("peak_type is not null")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw peaks for the classifier: the sample grid is t_us / 10000 (rate 100), the floor a tenth of the median."""
    rows = signal(spark, sf_dir).select("recording_id", (F.col("t_us") / 10_000).cast("bigint").alias("i"), "amp")
    middle = F.median("amp").over(Window.partitionBy("recording_id"))
    points = rows.withColumn("m", middle).groupBy("recording_id", "i").agg(F.max("amp").alias("v"), F.first("m").alias("m"))
    packed = points.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"), F.first("m").alias("m"))
    n = F.element_at("s", -1).i + 1
    gap = lambda x, k: F.coalesce(F.try_element_at("s", k + 2).i, n) - x.i - 1
    env = F.flatten(F.transform("s", lambda x, k: F.concat(F.array(x.v), F.array_repeat(F.lit(0.0), gap(x, k).cast("int")))))
    return packed.select(
        F.col("recording_id").cast("string").alias("recording_id"), F.lit(100).alias("sample_rate"), n.cast("bigint").alias("n_samples"), env.alias("env"),
        F.array_repeat(F.col("m") / 10, n.cast("int")).alias("floor"), F.array().cast("array<bigint>").alias("troughs"), F.array_distinct(F.transform("s", lambda x: x.i)).alias("raw_peaks"), F.lit("ok").alias("status"),
    )


SQL = f"""with base as (
  select user_id as recording_id, event_id, event_type, value as amp,
         row_number() over (partition by user_id order by ts, event_id) - 1 as idx,
         (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) // {SCALE} as t_us
  from events),
signal as (select *, t_us / 1e6 as t_sec from base),
gaps as (select *, (t_us - lag(t_us) over (partition by recording_id order by t_us)) / 1e6 as rr from signal),
rated as (select *, 60.0 / rr as instant_bpm from gaps where rr > 1e-6),
series as (select *, avg(instant_bpm) over (partition by recording_id order by t_us range between 2499999 preceding and 2500000 following) as smoothed_bpm from rated),
labels as (select recording_id, t_sec, amp as bpm, case event_type when 'click' then 'S1' when 'view' then 'S2' end as peak_type
           from signal where event_type in ('click', 'view'))
"""


def interp_sql(x: str, xs, ys) -> str:
    """The piecewise-linear map of a SQL expression."""
    parts = [f"when {x} is null then null when {x} <= {xs[0]} then {ys[0]}"]
    parts += [f"when {x} < {b} then {c} + ({x} - {a}) * (({d}) - ({c})) / (({b}) - ({a}))" for a, b, c, d in zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True)]
    return "(case " + " ".join(parts) + f" else {ys[-1]} end)"
