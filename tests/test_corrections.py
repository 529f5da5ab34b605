"""Native corrections against the tracker's own, on rhythms with gaps and crowds."""

import numpy as np
import pytest

from pcgspark.operators import classify, corrections
from pcgspark.params import DEFAULTS

SCHEMA = "recording_id string, sample_rate int, status string, raw_peaks array<bigint>, env array<double>, floor array<double>"


def recording(seed):
    """Pairs at a steady rate, of which some are quiet (so that they count as noise) or have loud neighbours."""
    rng = np.random.default_rng(seed)
    beats = np.cumsum(rng.normal(80, 3, 40)).astype(int)
    places = {}
    for b in beats:
        if rng.random() < 0.85:
            quiet = rng.random() < 0.25
            places[int(b)] = 0.6 if quiet else rng.uniform(0.9, 1.1)
            places[int(b) + int(rng.integers(24, 36))] = 1.4 if quiet else rng.uniform(0.5, 0.8)
        if rng.random() < 0.25:
            places[int(b) + int(rng.integers(8, 70))] = rng.uniform(0.2, 1.3)
    at = sorted(places)
    env = np.zeros(at[-1] + 1)
    env[at] = [places[i] for i in at]
    return (f"r{seed}", 100, "ok", at, env.tolist(), [0.05] * len(env))


def rows_of(df):
    return sorted((r["recording_id"], r["sample_idx"], r["peak_type"] or "", r["is_final_beat"], tuple((x["tag"], x["note"], len(x["steps"])) for x in r["reasons"])) for r in df.collect())


@pytest.mark.parametrize("p", [DEFAULTS, DEFAULTS.but(rr_correction_long_interval_pct=1.2, rr_correction_threshold_pct=0.9, penalty_waiver_strength_ratio=1.0)])
def test_corrections_against_the_tracker(spark, p):
    prepared = spark.createDataFrame([recording(i) for i in range(25)], SCHEMA)
    want = rows_of(classify.peaks_of(classify.analyse(prepared, p=p)))
    plain = classify.peaks_of(classify.analyse(prepared, p=p.but(enable_correction_pass=False)))
    assert rows_of(corrections.correct(plain, p)) == want
    assert rows_of(plain) != want and rows_of(corrections.correct(plain, p.but(enable_correction_pass=False))) == rows_of(plain)


def test_few_or_no_peaks(spark):
    one = (recording(1)[0], 100, "ok", [5, 90], [0.0] * 5 + [1.0] + [0.0] * 84 + [1.0], [0.1] * 91)
    few = classify.peaks_of(classify.analyse(spark.createDataFrame([one], SCHEMA)))
    assert rows_of(corrections.correct(few)) == rows_of(few) and len(rows_of(few)) == 2
    assert corrections.correct(few.limit(0)).count() == 0


def fold(beats, usual, p, margin):
    """Removals from the first beat to the last, by their definition."""
    gone, out = False, set()
    for j in range(len(beats) - 1):
        (i, t, a), (k, u, b) = beats[j], beats[j + 1]
        if not (margin <= j <= len(beats) - 2 - margin and u - t < usual * p.rr_correction_threshold_pct):
            gone = False
        elif gone:
            gone = False
        else:
            out.add(i if b > a else k)
            gone = not b > a
    return out


def test_removals_against_a_fold(spark):
    rng = np.random.default_rng(5)
    rows, want = [], set()
    for r in range(40):
        t = np.cumsum(rng.choice([0.2, 0.9], 60, p=[0.7, 0.3]))
        beats = [(3 * i, float(t[i]), float(rng.integers(1, 4))) for i in range(60)]
        want |= {(f"r{r}", i) for i in fold(beats, 1.0, DEFAULTS, 3)}
        rows += [(f"r{r}", i, x, a, True, False, 1.0) for i, x, a in beats]
        rows += [(f"r{r}", i + 1, x + 0.05, 9.0, False, False, 1.0) for i, x, _ in beats if rng.random() < 0.5]
    peaks = spark.createDataFrame(rows, "recording_id string, sample_idx bigint, t_sec double, amp double, __beat boolean, __made boolean, __usual double")
    got = {(r["recording_id"], r["sample_idx"]) for r in corrections._thinned(peaks, DEFAULTS, 3).filter("__made and not __beat").collect()}
    assert got == want and len(want) > 100


def test_a_round_sorts_once_and_tasks_stay_small(spark, monkeypatch):
    peaks = classify.peaks_of(classify.analyse(spark.createDataFrame([recording(i) for i in range(12)], SCHEMA)))
    rows = peaks.withColumnRenamed("peak_type", "kind").withColumn("__beat", peaks["is_final_beat"])
    plan = corrections._thinned(corrections._filled(rows, DEFAULTS, 3), DEFAULTS, 3)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    assert sum(" Sort [" in x for x in lines) == 1 and sum("mapInPandas" in x or "MapInPandas" in x for x in lines) == 1 and "Join" not in plan
    want = rows_of(corrections.correct(peaks))
    monkeypatch.setattr(corrections, "TASK_ROWS", 50)
    many = corrections.correct(peaks)
    assert many.rdd.getNumPartitions() >= peaks.count() // 50 > 4
    assert rows_of(many) == want
