"""Outputs as text, CSV, JSON and WAV; each takes tables of many recordings and writes a folder for each id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("recording_id",)


def _fixed(c: str, places: int = 3) -> Column:
    return F.format_string(f"%.{places}f", F.col(c))


def write_rates(series: DataFrame, path: str) -> None:
    """``Time (s),Average BPM`` with three places, rows without a value left out, one folder for each recording."""
    rows = series.filter(F.col("smoothed_bpm").isNotNull() & ~F.isnan("smoothed_bpm"))
    out = rows.select("recording_id", _fixed("t_sec").alias("Time (s)"), _fixed("smoothed_bpm").alias("Average BPM"))
    out.repartition("recording_id").sortWithinPartitions("recording_id", F.col("Time (s)").cast("double")).write.mode("overwrite").option("header", "true").partitionBy("recording_id").csv(path)


def write_settings(settings: DataFrame, path: str) -> None:
    settings.select("recording_id", "start_bpm_hint").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("recording_id").json(path)


def label_text(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """recording_id and the text of a label file: sectioned if there is a pair, else plain."""
    line = F.concat_ws(",", F.round("t_sec", 3).cast("string"), F.round("bpm", 3).cast("string"), F.col("peak_type"))
    rows = labels.groupBy(*BY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t_sec", line.alias("line")))), lambda x: x.line), "\n").alias("rows"))
    pair = F.concat_ws(",", *[F.round(c, 3).cast("string") for c in ("S1_Time", "S2_Time", "Delta_t", "S1_BPM")])
    intervals = pairs.groupBy(*BY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("S1_Time", pair.alias("line")))), lambda x: x.line), "\n").alias("intervals"))
    plain = F.concat(F.lit("Time (s),Average BPM,Peak Type\n"), F.col("rows"))
    sectioned = F.concat(F.lit("# Peak Labels\n"), plain, F.lit("\n\n# S1-S2 Intervals\nS1_Time,S2_Time,Delta_t,S1_BPM\n"), F.col("intervals"))
    return rows.join(intervals, "recording_id", "left").select("recording_id", F.coalesce(sectioned, plain).alias("value"))


def write_text(texts: DataFrame, path: str) -> None:
    """(recording_id, value) as one text file in a folder for each recording."""
    texts.select("recording_id", "value").write.mode("overwrite").partitionBy("recording_id").text(path)


def debug_wav(prepared: DataFrame) -> DataFrame:
    """recording_id and the band-passed signal as the bytes of a 16-bit WAV file; recordings without one are left out."""
    from pcgspark.functions.shipping import ship

    ship(prepared.sparkSession)

    def run(batches):
        from pcgspark.sources.wav import encode

        for pdf in batches:
            yield pdf.assign(content=[encode(int(r), e) for r, e in zip(pdf["sample_rate"], pdf["filtered"], strict=True)])[["recording_id", "content"]]

    return prepared.filter("filtered is not null").select("recording_id", "sample_rate", "filtered").mapInPandas(run, "recording_id string, content binary")


def status_counts(analyses: DataFrame) -> DataFrame:
    """Recordings by outcome."""
    return analyses.groupBy(F.when(F.col("status") == "ok", "processed").otherwise("failed").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*BY).orderBy(order)))
