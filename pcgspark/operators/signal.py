"""From recordings to envelopes, noise floors and raw peaks.

Sample-level tables (recording_id, idx, amp) use native functions and kernels over blocks of samples (``band_passed``,
``floored``, ``raw_peaks``), so that a long recording spans many tasks. ``prepare`` gives the same for tables of whole short
recordings, a row each, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pcgspark import schema
from pcgspark.functions import kernels
from pcgspark.functions.exprs import ColumnOr, col, safe_decimation, sound_trough
from pcgspark.functions.shipping import ship
from pcgspark.operators import blocks, peaks, rolling
from pcgspark.params import DEFAULTS, Params

BY = ("recording_id",)


def channel_mean(channels: ColumnOr) -> Column:
    """Mean of an array of channels."""
    c = col(channels)
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)


def checked_rate(rate: ColumnOr, high_hz: float = 150.0) -> Column:
    """The rate; fails where the pass band does not fit below half of it."""
    return F.when(col(rate) > 2 * high_hz, col(rate)).otherwise(F.raise_error(F.concat(F.lit("sample rate too low for the pass band: "), col(rate).cast("string"))))


def decimate(samples: DataFrame, factor: ColumnOr, idx: str = "idx") -> DataFrame:
    """Every k-th sample, renumbered. A filter on the index, which is pushed to the scan."""
    k = col(factor).cast("bigint")
    return samples.filter(F.col(idx) % k == 0).withColumn(idx, (F.col(idx) / k).cast("bigint"))


def decimated_rate(rate: ColumnOr, factor: ColumnOr = DEFAULTS.downsample_factor) -> Column:
    return F.floor(col(rate) / safe_decimation(rate, factor)).cast("int")


def plot_thin(rows: DataFrame, k: int, idx: str = "idx") -> DataFrame:
    """Every k-th point where there are at least k."""
    if k <= 1:
        return rows
    n = F.count(F.lit(1)).over(Window.partitionBy(*BY))
    return rows.withColumn("__n", n).filter((F.col("__n") < k) | (F.col(idx) % k == 0)).drop("__n")


def peak_normalised(x: ColumnOr, by=BY, full_scale: float = 32767.0) -> Column:
    """Scaled to the largest magnitude and cut to 16-bit integers; silence stays 0."""
    top = F.max(F.abs(col(x))).over(Window.partitionBy(*by))
    return F.when(top > 0, (col(x) / top * full_scale).cast("int")).otherwise(0).cast("smallint")


def envelope(x: ColumnOr, width: int) -> Column:
    """Centred mean of the rectified signal."""
    return rolling.centred_mean(F.abs(col(x)), width)


def with_floor(rows: DataFrame, trough: str, width: int, q: float = DEFAULTS.noise_floor_quantile, into: str = "floor") -> DataFrame:
    """Adds a floor through known troughs: the line between them, its exact rolling quantile in blocks, and its ends filled."""
    line = rows.withColumn("__line", rolling.interpolate_gaps(trough, "idx"))
    found = blocks.centred_quantile(line, "__line", "__q", q, width)
    return found.select(*rows.columns, rolling.fill_both("__q").alias(into))


def band_passed(samples: DataFrame, rate: int, p: Params = DEFAULTS) -> tuple[DataFrame, int]:
    """(recording_id, idx, filtered) of the decimated and band-passed samples (recording_id, idx, amp) of recordings of one
    rate, and the rate after decimation. A recording spans many tasks."""
    factor = kernels.decimation(rate, p)
    rows = decimate(samples, F.lit(factor)).withColumn("__hz", F.lit(rate // factor))
    return blocks.band_pass(rows, "amp", "__hz"), rate // factor


def floored(rows: DataFrame, rate: int, p: Params = DEFAULTS) -> DataFrame:
    """Adds ``floor``, ``is_trough`` and ``peak_level`` to samples (recording_id, idx, env) of recordings of one rate. A draft
    through all troughs judges them, and the rest make the floor, as in ``prepare``, with a recording in many tasks. Troughs
    and peaks rise over quantiles of the envelope."""
    width, distance = max(1, int(p.noise_window_sec * rate)), max(1, int(p.min_peak_distance_sec * rate))
    known = rolling.quantiles(rows, "env", __trough_level=p.trough_prominence_quantile, __flat=p.noise_floor_quantile, __low=0.1, peak_level=p.peak_prominence_quantile)
    levelled = rows.join(known, [*BY])
    found = peaks.find_peaks(levelled, "env", prominence="__trough_level", distance=distance, negate=True)
    marked = levelled.join(found.select(*BY, "idx", F.lit(True).alias("__found")), [*BY, "idx"], "left").withColumn("__trough", F.when(F.col("__found"), F.col("env")))
    draft = with_floor(marked, "__trough", width, p.noise_floor_quantile, "__draft")
    judged = draft.withColumn("__sound", F.when(sound_trough("env", "__draft", p), F.col("__trough")))
    final = with_floor(judged, "__sound", width, p.noise_floor_quantile, "__final")
    part = Window.partitionBy(*BY)
    counted = final.withColumns({"__n": F.count("__trough").over(part), "__kept": F.count("__sound").over(part)})
    floor = F.coalesce(F.when(F.col("__n") < 5, F.col("__flat")).when(F.col("__kept") > 2, F.col("__final")).otherwise(F.col("__draft")), F.col("__low"))
    trough = F.when(F.col("__n") < 5, F.col("__trough")).otherwise(F.col("__sound")).isNotNull()
    return counted.select(*rows.columns, floor.alias("floor"), trough.alias("is_trough"), "peak_level")


def raw_peaks(rows: DataFrame, rate: int, p: Params = DEFAULTS) -> DataFrame:
    """The raw peaks among the rows of ``floored``."""
    return peaks.find_peaks(rows, "env", height="floor", prominence="peak_level", distance=max(1, int(p.min_peak_distance_sec * rate)))


def _prepared(batches: Iterator, p: Params, filter_first: bool, raw: bool) -> Iterator:
    import numpy as np
    import pandas as pd

    for pdf in batches:
        rows = []
        for rid, rate, samples in zip(pdf["recording_id"], pdf["sample_rate"], pdf["samples"], strict=True):
            rate = 0 if rate is None or rate != rate else int(rate)
            status, env, floor, troughs, found, new_rate, passed = "ok", np.empty(0), np.empty(0), np.empty(0, int), np.empty(0, int), rate, None
            try:
                if rate <= 0:
                    raise ValueError("no sample rate")
                x = np.nan_to_num(np.asarray(samples if samples is not None else [], float))
                env, new_rate, passed = (kernels.centred_mean(np.abs(x), rate // 10), rate, None) if raw else kernels.envelope_of(x, rate, p, filter_first)
                floor, troughs = kernels.noise_floor(env, new_rate, p)
                found = kernels.raw_peaks(env, floor, new_rate, p)
                if len(found) < 2:
                    status = "too few peaks"
            except (ValueError, ZeroDivisionError, TypeError) as error:
                status = str(error) or type(error).__name__
            rows.append((rid, int(new_rate), len(env), env.tolist(), floor.tolist(), troughs.tolist(), found.tolist(), status, passed.tolist() if passed is not None and p.save_filtered_wav else None))
        yield pd.DataFrame(rows, columns=["recording_id", "sample_rate", "n_samples", "env", "floor", "troughs", "raw_peaks", "status", "filtered"])


def prepare(recordings: DataFrame, p: Params = DEFAULTS, filter_first: bool = False, raw: bool = False) -> DataFrame:
    """Envelope, floor, troughs and raw peaks of each recording (a row each). A recording that fails has its reason in
    ``status`` and the others go on. ``raw``: the samples are taken as they are, without decimation and filter. With
    ``save_filtered_wav`` the band-passed signal comes along for the debug file. Arrow batches are cut by bytes, so few
    whole recordings are in a worker at once."""
    ship(recordings.sparkSession)
    rows = recordings.select(F.col("recording_id").cast("string").alias("recording_id"), "sample_rate", "samples")
    return rows.mapInPandas(lambda it: _prepared(it, p, filter_first, raw), schema.ENVELOPES)


def samples_of(prepared: DataFrame) -> DataFrame:
    """One row for each sample: idx, t_sec, env, floor."""
    out = prepared.select("recording_id", "sample_rate", F.posexplode(F.arrays_zip("env", "floor")).alias("idx", "s"))
    return out.select("recording_id", F.col("idx").cast("bigint").alias("idx"), (F.col("idx") / F.col("sample_rate")).alias("t_sec"), "s.env", "s.floor")
