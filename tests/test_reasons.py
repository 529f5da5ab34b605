"""Reason texts and their lists; the kick-start; the debug file."""

import numpy as np
import pytest
from pcg import heart
from pyspark.sql import functions as F

from pcgspark import schema
from pcgspark.functions import kernels, reasons, tracker
from pcgspark.operators import signal as sig
from pcgspark.params import DEFAULTS, ORIGINAL, PAIRED_BECAUSE, REJECTED_BECAUSE, VALID_BECAUSE
from pcgspark.sources import sinks, wav


def lines(spark, column, steps):
    return spark.createDataFrame([(steps,)], "x array<struct<kind:string,by:double,of:double,against:double>>").select(column(F.col("x")).alias("l")).first()["l"]


def test_pairing_lines_carry_the_confidence(spark):
    steps = [("base", 0.8, 0.2, None), ("stability", 0.9, 0.46, None), ("penalty", 0.25, 2.0, 1.5), ("interval", 0.75, 0.4, 0.3), ("score", 0.0, None, 0.5)]
    assert lines(spark, reasons.pairing_lines, steps) == [
        "- S1-S2 pairing decision:",
        "    - Base Conf (Blended Model 20% High): 0.80",
        "    - Stability Pre-Adjust: x0.90 (Pairing Ratio: 46%) -> 0.720",
        "    - PENALIZED by 0.25 (S2 Str. Ratio 2.0x > Expected 1.5x) -> 0.470",
        "    - Interval PENALTY by 0.75 (Interval 0.400s > Max 0.300s) -> 0.000",
        "    - Final Score: 0.00 vs Threshold 0.50 -> Not Paired",
    ]
    boosted = lines(spark, reasons.pairing_lines, [("base", 0.4, 1.0, None), ("boost", 0.125, 3.04, None), ("score", 0.525, None, 0.5)])
    assert boosted[2:] == ["    - BOOSTED by 0.13 (S1 Str. Ratio 3.0x > S2)", "    - Final Score: 0.53 vs Threshold 0.50 -> Paired"]
    for nothing in (None, []):
        assert lines(spark, reasons.pairing_lines, nothing) == ["- S1-S2 pairing decision:", "    - No details available."]


def test_lone_lines(spark):
    fits = [("rhythm", 0.8, 0.7, 0.75), ("amplitude", 0.87, 0.81, None)]
    assert lines(spark, reasons.lone_lines, [*fits, ("lone", 0.8245, None, 0.5), ("weights", 0.65, 0.35, None)]) == [
        "- Lone S1 decision:",
        "\t- Rhythm Fit=0.80 (Interval 0.700s vs Expected 0.750s)",
        "\t- Amplitude Fit=0.87 (Strength Ratio 0.81x)",
        "\t- Weighted Calculation:",
        "\t\t- Rhythm: 0.80 × 0.65 = 0.520",
        "\t\t- Amplitude: 0.87 × 0.35 = 0.305",
        "\t\t- Final: 0.520 + 0.305 = 0.825",
        "- Final Score: Confidence 0.825 >= 0.50 -> Validated",
    ]
    low = lines(spark, reasons.lone_lines, [("rhythm", 0.0, 0.1, 0.75), ("amplitude", 0.3, 0.3, None), ("lone", 0.104, None, 0.5)])
    assert low[-1] == "- Final Score: Confidence 0.100 < 0.50 -> Rejected" and len(low) == 4
    for steps, other in (([("first", None, None, None)], "First beat"), ([("soon", 300.0, None, None)], "Rejected Lone S1: Forward check failed (Implies 300 BPM)"), ([], "")):
        assert lines(spark, reasons.lone_lines, steps) == ["- Lone S1 decision:", f"\t- {other}"]


def test_records(spark):
    kind, parts = reasons.split_record("x")
    df = spark.createDataFrame([("Noise§A§b§C§d",), ("Noise",), ("Noise§A",)], "x string").select(kind.alias("k"), parts.alias("p"))
    assert [(r["k"], [tuple(x) for x in r["p"]]) for r in df.collect()] == [("Noise", [("A", "b"), ("C", "d")]), ("Noise", []), ("Noise", [("A", None)])]


def test_the_tracker_gives_steps_that_become_lines(spark):
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.choice([0.3, 0.5, 0.2, 0.8], 120))
    peaks = tracker.peaks_of(np.round(times * 100).astype(int), times, rng.uniform(0.3, 1, 120), np.full(120, 0.1))
    _, verdicts, _ = tracker.track(peaks)
    rows = [(x,) for v in verdicts.values() for x in [*v.reasons, (ORIGINAL, "Noise", [])]]
    assert {PAIRED_BECAUSE, VALID_BECAUSE, REJECTED_BECAUSE} <= {x[0] for (x,) in rows}
    got = spark.createDataFrame(rows, f"r {schema.REASON}").select("r.tag", reasons.reason_lines(F.col("r")).alias("l")).collect()
    assert all(r["l"] and None not in r["l"] and "null" not in " ".join(r["l"]) for r in got)
    assert any("->" in " ".join(r["l"]) for r in got) and any("Weighted" in " ".join(r["l"]) for r in got)
    assert {tuple(r["l"]) for r in got if r["tag"] == ORIGINAL} == {("- Original Classification:", "    - Noise")}


def test_kickstart():
    """Three of the last four beats lone with noise after them, and few pairs: the ratio is overridden, if asked for."""
    for asked in (False, True):
        t = tracker.Tracker(DEFAULTS.but(kickstart=asked))
        t.beats = 30
        t.paired.extend([0] * 20)
        t.lone.extend([2, 2, 1, 2])
        assert t.pairing_ratio() == (DEFAULTS.kickstart_override_ratio if asked else 0)
        t.lone.append(0)
        assert t.pairing_ratio() == 0


def test_the_debug_file_holds_the_filtered_signal(spark):
    x = heart(np.arange(0.5, 5, 0.8))
    recordings = spark.createDataFrame([("a", 4000, x.tolist()), ("b", 200, [0.0] * 50)], "recording_id string, sample_rate int, samples array<double>")
    got = {r["recording_id"]: r["content"] for r in sinks.debug_wav(sig.prepare(recordings)).collect()}
    rate, pcm = wav.decode(bytes(got["a"]))
    want = kernels.envelope_of(x, 4000)[2]
    assert set(got) == {"a"} and rate == 4000 // 12 and len(pcm) == len(want) and pcm.min() < 0
    assert np.abs(pcm / 32767 - want / np.abs(want).max()).max() < 1e-4
    assert sinks.debug_wav(sig.prepare(recordings, DEFAULTS.but(save_filtered_wav=False))).count() == 0


def test_conflicting_label_times(spark):
    from pcgspark.operators import labels as lab

    rows = [("a", 1.0, 60.0, "S1"), ("a", 1.0, 61.0, "S1"), ("a", 2.0, 60.0, "S2"), ("a", 3.0, 60.0, "S2")]
    found = lab.range_average(lab.pairs(spark.createDataFrame(rows, "recording_id string, t_sec double, bpm double, peak_type string")), 0, 9).first()
    assert found["n_pairs"] == 2 and [(p["S1_BPM"], p["S2_Time"]) for p in found["pairs"]] == [(60.0, 2.0), (61.0, 3.0)]
    assert found["avg_delta_t"] == pytest.approx(1.5)
