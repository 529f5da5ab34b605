import numpy as np
import pytest
from pcg import heart
from pyspark.sql import functions as F

from pcgspark.operators import align, classify, metrics
from pcgspark.operators import labels as lab
from pcgspark.operators import signal as sig
from pcgspark.plans import analysis


@pytest.fixture(scope="module")
def result(spark):
    steady = np.arange(0.5, 40, 60 / 72)
    ramp = [0.5]
    while ramp[-1] < 150:
        ramp.append(ramp[-1] + 60 / np.interp(ramp[-1], [0, 20, 75, 140, 150], [105, 80, 140, 85, 100]))
    rows = [
        ("steady", 4000, heart(steady).tolist()),
        ("ramp", 4000, heart(ramp, s2_after=0.22).tolist()),
        ("gap", 4000, heart(steady, drop=(20,)).tolist()),
        ("noise", 4000, np.random.default_rng(3).normal(size=8000).tolist()),
        ("low", 250, [0.0] * 1000),
        ("tiny", 4000, [0.0] * 4000),
        ("none", None, None),
    ]
    recordings = spark.createDataFrame(rows, "recording_id string, sample_rate int, samples array<double>")
    return analysis.analyse(recordings)


def test_steady_rate_is_found(result):
    got = {r["recording_id"]: r for r in result.summary.collect()}
    assert set(got) == {"steady", "ramp", "gap", "noise", "low", "tiny", "none"}
    assert got["steady"]["status"] == "ok" and got["steady"]["avg_bpm"] == pytest.approx(72, abs=1)
    assert got["ramp"]["max_bpm"] == pytest.approx(140, abs=8) and got["ramp"]["peak_exertion"]["slope"] > 0.3
    assert got["ramp"]["peak_recovery"]["slope"] < 0 and got["ramp"]["hrr_bpm"] > 20
    assert "sample rate" in got["low"]["status"] and got["tiny"]["avg_bpm"] is None and got["none"]["status"] != "ok"


def test_beats_lie_on_the_sounds(result):
    steady = np.arange(0.5, 40, 60 / 72)
    got = np.array([r["t_sec"] for r in result.beats.filter("recording_id = 'steady'").orderBy("t_us").collect()])
    near = np.abs(steady[:, None] - got[None]).min(1)
    assert (near < 0.08).mean() > 0.95


def test_inclines_and_reports(result):
    up = result.inclines.filter("recording_id = 'ramp'").collect()
    assert up and up[0]["change_bpm"] >= 15
    texts = {r["recording_id"]: r["value"] for r in analysis.report(result).collect()}
    assert "| Average BPM | 7" in texts["steady"] and "## Exertion periods" in texts["ramp"] and "n/a" in texts["tiny"]
    logs = {r["recording_id"]: r["value"] for r in analysis.debug_log(result).collect()}
    assert "S1 (Paired)" in logs["steady"] and "Trough" in logs["steady"]
    tables = analysis.traces(result, 50)
    assert tables["markers"].filter("bucket = 'S1'").count() > 40 and tables["samples"].count() > 0
    assert tables["axis"].count() >= 1 and tables["extremes"].count() > 0 and tables["slopes"].count() > 0


def test_native_conflict_fold(spark):
    rows = [("a", t, a) for t, a in ((0, 1.0), (1_000_000, 1.0), (1_200_000, 2.0), (2_000_000, 1.0), (3_000_000, 1.0), (3_100_000, 1.0))]
    got = classify.drop_conflicts(spark.createDataFrame([*rows, ("b", 5, 1.0)], "recording_id string, t_us bigint, amp double"))
    assert sorted((r[0], r[1]) for r in got.select("recording_id", "t_us").collect()) == [("a", 0), ("a", 1_200_000), ("a", 2_000_000), ("a", 3_000_000), ("b", 5)]


def test_greedy_pairs_against_two_pointers(spark):
    rng = np.random.default_rng(5)
    rows, expected = [], []
    for rid in range(30):
        a, b = np.sort(rng.choice(60, 12, False)) / 2, np.sort(rng.choice(60, 10, False)) / 2
        rows += [(str(rid), float(t), 1.0, "S1") for t in a] + [(str(rid), float(t), 1.0, "S2") for t in b]
        j = 0
        for t in a:
            while j < len(b) and b[j] <= t:
                j += 1
            if j < len(b):
                expected.append((str(rid), float(t), float(b[j])))
                j += 1
    labels = spark.createDataFrame(rows, "recording_id string, t_sec double, bpm double, peak_type string")
    assert sorted((r[0], r[1], r[2]) for r in lab.pairs(labels).collect()) == sorted(expected)


def test_label_editing(spark):
    schema = "recording_id string, t_sec double, bpm double, peak_type string"
    labels = spark.createDataFrame([("a", 1.0, 60.0, "S1")], schema)
    series = spark.createDataFrame([("a", 0.5, 61.0), ("a", 2.0004, 62.00049)], "recording_id string, t_sec double, bpm double")
    click = spark.createDataFrame([("a", -3.0, "S2"), ("a", 9.0, "S1")], "recording_id string, t_sec double, peak_type string")
    more = lab.add_label(labels, click, series)
    assert sorted(map(tuple, more.collect())) == [("a", 0.5, 61.0, "S2"), ("a", 1.0, 60.0, "S1"), ("a", 2.0, 62.0, "S1")]
    assert lab.remove_labels(more, labels).count() == 2


def test_nearest_prefers_the_earlier(spark):
    left = spark.createDataFrame([("a", 5)], "recording_id string, t bigint")
    right = spark.createDataFrame([("a", 3, 1.0), ("a", 7, 2.0)], "recording_id string, t bigint, v double")
    assert align.asof_nearest(left, right, "t", "v", "n", 2).first()["n"] == 1.0
    assert align.asof_nearest(left, right, "t", "v", "n", 1).first()["n"] is None


def test_guards(spark):
    one = spark.range(1)
    assert one.select(sig.checked_rate(F.lit(400))).first()[0] == 400
    with pytest.raises(Exception, match="pass band"):
        one.select(sig.checked_rate(F.col("id") + 300)).collect()
    silent = spark.createDataFrame([("a", 0, 0.0)], "recording_id string, idx bigint, amp double")
    assert silent.select(sig.peak_normalised("amp")).first()[0] == 0
    assert metrics.hrv_windows(spark.createDataFrame([("a", 0, 0.0)], "recording_id string, t_us bigint, t_sec double")).count() == 0


def test_table_function(spark):
    from pcgspark.operators.peaks import register_find_peaks

    register_find_peaks(spark)
    got = spark.sql("select * from find_peaks(array(0D, 3D, 0D, 5D, 0D), 1D, 1D, 1)").collect()
    assert [(r[0], r[1]) for r in got] == [(1, 3.0), (3, 5.0)]
