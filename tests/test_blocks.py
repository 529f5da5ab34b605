"""Operators on long series in blocks: against the kernels on whole arrays, with series over many blocks and tasks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pcgspark.functions import kernels as k
from pcgspark.operators import align, blocks, metrics, peaks, rolling
from pcgspark.operators import signal as sig
from pcgspark.params import DEFAULTS

SMALL = 32


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    waves = {"noise": rng.normal(size=1500), "walk": np.cumsum(rng.normal(size=900)), "steps": np.repeat(rng.integers(0, 4, 200), rng.integers(1, 9, 200)).astype(float)}
    waves |= {"rise": np.linspace(0, 5, 300), "fall": np.linspace(5, 0, 300), "flat": np.zeros(200), "humps": np.abs(np.sin(np.arange(700) / 9)) * np.linspace(1, 3, 700)}
    waves |= {"edges": np.tile([9.0, *[0.0] * (SMALL - 2), 8.0], 9), "one": np.ones(1), "short": rng.normal(size=15), "sixteen": rng.normal(size=16), "block": rng.normal(size=SMALL), "two": rng.normal(size=2 * SMALL + 1)}
    return {**waves, "ties": rng.integers(0, 3, 800).astype(float)}


@pytest.fixture
def rows(spark, series, monkeypatch):
    monkeypatch.setattr(blocks.map_blocks, "__defaults__", (*blocks.map_blocks.__defaults__[:-1], SMALL))
    pdf = pd.concat([pd.DataFrame({"recording_id": n, "idx": np.arange(len(x)), "amp": x}) for n, x in series.items()])
    return spark.createDataFrame(pdf).repartition(5)


def by_id(df, *columns):
    out = df.toPandas().sort_values(["recording_id", "idx"])
    return {n: g[list(columns)].to_numpy().T for n, g in out.groupby("recording_id")}


@pytest.mark.parametrize("limits", [{"prominence": 0.5}, {"distance": 7}, {"prominence": 0.3, "distance": 40, "height": 0.2}, {"distance": 2, "negate": True}, {"prominence": 1.0, "distance": 5, "negate": True}, {}])
def test_peaks(rows, series, limits):
    got = by_id(peaks.find_peaks(rows, "amp", **limits), "idx")
    plain = {a: v for a, v in limits.items() if a != "negate"}
    for name, x in series.items():
        want = k.find_peaks(-x if limits.get("negate") else x, **plain)
        assert got.get(name, np.empty((1, 0)))[0].tolist() == want.tolist(), name


def test_prominences_of_any_rows(rows, series):
    """All rows flagged, hills or not, and only some of the maxima."""
    got = by_id(blocks.prominences(rows.withColumn("mine", F.col("idx") >= 0), "mine", "amp"), "idx", "prominence")
    for name, x in series.items():
        assert got[name][0].tolist() == list(range(len(x))) and np.allclose(got[name][1], k.prominences(x, np.arange(len(x)))), name
    some = by_id(peaks.prominences(peaks.local_maxima(rows, "amp").filter("idx % 3 = 0"), rows, "amp"), "idx", "prominence")
    for name, x in series.items():
        at = [i for i in k.local_maxima(x) if i % 3 == 0]
        assert np.allclose(some[name][1], k.prominences(x, np.array(at))) if at else name not in some


def test_long_chain_of_peaks(spark):
    """Peaks that all touch each other: rising, so that one choice follows from the last, and of equal height."""
    n = 400
    for height in (F.col("id").cast("double"), F.lit(1.0)):
        rows = spark.range(n).select(F.lit("r").alias("recording_id"), (2 * F.col("id")).alias("idx"), height.alias("x"))
        for far in (5, "far"):
            got = sorted(r["idx"] for r in peaks.far_apart(rows.withColumn("far", F.lit(5)), "x", far).collect())
            x = np.array([h for (h,) in rows.orderBy("idx").select("x").collect()])
            assert got == (2 * np.arange(n))[k.far_apart(2 * np.arange(n), x, 5)].tolist()


@pytest.mark.parametrize(("width", "q", "least"), [(21, 0.2, 3), (8, 0.5, 1), (1, 0.9, 3), (300, 0.2, 3)])
def test_quantiles(rows, series, width, q, least):
    holes = rows.withColumn("amp", F.when(F.col("idx") % 4 != 1, F.col("amp")))
    got = by_id(blocks.centred_quantile(holes, "amp", "q", q, width, least), "idx", "q")
    for name, x in series.items():
        x = np.where(np.arange(len(x)) % 4 != 1, x, np.nan)
        want = pd.Series(x).rolling(width, min_periods=min(least, width), center=True).quantile(q)
        assert np.allclose(got[name][1].astype(float), want, equal_nan=True) and len(got[name][0]) == len(x)


def test_signals_of_one_block_are_filtered_at_once(rows, series, monkeypatch):
    """Only signals of several blocks are cut into maps and dealt from task to task."""
    cut, scanned = [], blocks._scanned
    monkeypatch.setattr(blocks, "_scanned", lambda found, *more: cut.append(found) or scanned(found, *more))
    got = by_id(blocks.band_pass(rows.withColumn("hz", F.lit(600)), "amp", "hz", size=SMALL), "idx", "filtered")
    assert set(got) == {name for name, x in series.items() if len(x) > 15}
    assert any(15 < len(x) <= SMALL for x in series.values())
    assert {r["recording_id"] for r in cut[0].select("recording_id").collect()} == {name for name, x in series.items() if len(x) > SMALL}


def test_band_pass(rows, series):
    got = by_id(blocks.band_pass(rows.withColumn("hz", F.lit(600)), "amp", "hz", size=SMALL), "idx", "filtered")
    for name, x in series.items():
        if len(x) <= 15:
            assert name not in got
            continue
        assert got[name][0].tolist() == list(range(len(x)))
        assert abs(got[name][1] - k.filtfilt(*k.bandpass(600), x)).max() < 1e-9, name


def test_filter_against_its_definition():
    rng = np.random.default_rng(3)
    b, a = k.bandpass(700)
    for n in (0, 1, 63, 64, 65, 640, 1000):
        x, z = rng.normal(size=n), rng.normal(size=4)
        y, state = k.filtered(b, a, x, z)
        old = [*z, 0.0]
        for i, v in enumerate(x):
            out = b[0] * v + old[0]
            old = [b[j + 1] * v - a[j + 1] * out + old[j + 1] for j in range(4)] + [0.0]
            assert abs(y[i] - out) < 1e-9
        assert np.allclose(state, old[:4])


def test_floor_and_raw_peaks(spark, rows, series):
    """The same as the kernel on whole recordings."""
    p = DEFAULTS.but(noise_window_sec=2.1, min_peak_distance_sec=0.3)
    found = sig.floored(rows.select("recording_id", "idx", F.abs("amp").alias("env")), 10, p)
    floors, troughs, raw = by_id(found, "idx", "floor"), by_id(found.filter("is_trough"), "idx"), by_id(sig.raw_peaks(found, 10, p), "idx")
    for name, x in series.items():
        floor, at = k.noise_floor(np.abs(x), 10, p)
        assert np.allclose(floors[name][1].astype(float), floor), name
        assert troughs.get(name, np.empty((1, 0)))[0].tolist() == at.tolist(), name
        assert raw.get(name, np.empty((1, 0)))[0].tolist() == k.raw_peaks(np.abs(x), floor, 10, p).tolist(), name


def test_decimation_before_the_filter(spark):
    x = np.random.default_rng(5).normal(size=9000)
    rows = spark.createDataFrame(pd.DataFrame({"recording_id": "r", "idx": np.arange(len(x)), "amp": x}))
    got, rate = sig.band_passed(rows, 4000)
    want = k.envelope_of(x, 4000)
    assert rate == want[1] and abs(by_id(got, "filtered")["r"][0] - want[2]).max() < 1e-9


def test_one_recording_in_many_tasks(spark):
    """A long recording is not in one task, and many short ones are not either."""
    one = spark.range(200_000).select(F.lit("r").alias("recording_id"), F.col("id").alias("idx"), F.sin("id").alias("amp"))
    many = spark.range(4000).select((F.col("id") % 500).cast("string").alias("recording_id"), (F.col("id") / 500).cast("bigint").alias("idx"), F.sin("id").alias("amp"))
    for rows in (one, many):
        out = blocks.centred_quantile(rows, "amp", "q", 0.5, 5)
        assert out.select(F.spark_partition_id()).distinct().count() == 4


@pytest.mark.parametrize("odd", [[], [(None, 0, 1.0), (None, 1, 2.0), (None, 2, 0.0), ("a", 0, 5.0), ("a", 1, 7.0), ("a", 2, 5.0)]])
def test_no_rows_and_null_ids(spark, odd):
    rows = spark.createDataFrame(odd, "recording_id string, idx bigint, amp double")
    assert peaks.find_peaks(rows, "amp", prominence=0.1, distance=2).count() == (2 if odd else 0)
    assert blocks.centred_quantile(rows, "amp", "q", 0.5, 3).count() == len(odd) and blocks.band_pass(rows.withColumn("hz", F.lit(600)), "amp", "hz").count() == 0


def test_pieces(spark):
    rows = spark.createDataFrame([(i,) for i in (-11, -1, 0, 4, 9, 10, 19, 25, None)], "at bigint")
    got = {(r["at"], r["piece"], r["own"]) for r in rolling.in_pieces(rows, "at", 10, 2, 1).collect()}
    assert got == {(-11, -2, True), (-11, -1, False), (-1, -1, True), (-1, 0, False), (0, 0, True), (0, -1, False), (4, 0, True), (9, 0, True), (9, 1, False), (10, 1, True), (10, 0, False), (19, 1, True), (19, 2, False), (25, 2, True)}


def test_following_frames_are_carried(spark):
    """A frame that ends at the partition's end is computed anew for each row; none is left, and long recordings end soon."""
    n = 300_000
    rows = spark.range(n).select(F.lit("r").alias("recording_id"), F.col("id").alias("idx"), (F.col("id") * 1000).alias("t_us"), F.when(F.col("id") % 7 == 0, 1.0 * F.col("id")).alias("smoothed_bpm"))
    left, right = rows.select("recording_id", "t_us"), rows.filter("smoothed_bpm is not null").selectExpr("recording_id", "t_us + 3 as t_us", "smoothed_bpm")
    tables = [
        rows.withColumn("x", rolling.fill_backward("smoothed_bpm")), rows.withColumn("x", rolling.interpolate_gaps("smoothed_bpm", "idx")), metrics.slope_partners(rows.na.fill(1.0)),
        align.asof_nearest(left, right, "t_us", "smoothed_bpm", "v", 500), align.interpolate_at(left, right, "t_us", "smoothed_bpm", "v"), align.inside_gaps(left, right, "t_us"),
        align.first_following(rows.withColumn("w", F.col("smoothed_bpm").isNotNull()), "w", "t_us"),
    ]
    for df in tables:
        assert "unboundedfollowing" not in df._jdf.queryExecution().analyzed().toString().lower()
        df.write.format("noop").mode("overwrite").save()
    filled = tables[0].filter("idx in (0, 1, 7, 299997, 299999)").orderBy("idx").collect()
    assert [r["x"] for r in filled] == [0.0, 7.0, 7.0, 299999.0, 299999.0]
