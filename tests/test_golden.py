"""The metric layer on the beats of a real recording, with the values known for it."""

import numpy as np
import pytest

from pcgspark.operators import metrics

RATE = 302
# The sample number of the first beat, the samples between beats, and smoothed rates (seconds: beats a minute).
FIRST = 9
GAPS = """
185 184 141 129 180 182 178 177 185 190 200 197 184 178 168 182 177 179 185 171 172 171 182 185 187 189 190 194 177 178
175 177 181 174 174 176 173 167 167 160 168 171 168 152 181 155 178 158 151 162 149 153 146 139 141 152 142 143 141 133
149 137 138 140 135 137 138 133 135 137 132 135 133 137 139 129 138 136 133 134 134 135 137 138 135 137 137 130 135 135
134 131 127 136 131 129 125 138 125 141 140 131 131 135 148 138 153 157 163 101 174 170 170 176 193 228 222 220 208 190
188 202 200 206 198 190 192 187 183 177 171 169 93 71 166 165 182 188 174 173 167 160 155 140 169 152 153 149 151 144
148 143 141 135 145 138 137 138 75 130 133 119 138 126 123 125 126 124 76 102 119 119 117 117 113 115 116 116 117 117
119 125 126 129 133 130 130 129 130 130
"""
RATES = {0.642: 113.213, 12.361: 101.47, 24.099: 108.444, 34.245: 129.034, 43.219: 134.179, 52.079: 134.93, 63.325: 89.928, 74.762: 108.903, 79.798: 124.839}


@pytest.fixture(scope="module")
def beats(spark):
    at = np.concatenate(([FIRST], FIRST + np.cumsum([int(x) for x in GAPS.split()])))
    return spark.createDataFrame([("golden", int(round(i / RATE * 1e6)), i / RATE) for i in at.tolist()], "recording_id string, t_us bigint, t_sec double")


def test_smoothed_rates(beats):
    got = {round(r["t_us"] / 1e6, 3): r["smoothed_bpm"] for r in metrics.rate_series(beats).collect()}
    assert all(got[t] == pytest.approx(v, abs=0.00051) for t, v in RATES.items())
    assert round(max(got.values()), 1) == 163.3


def test_steepest_rise(beats):
    r = metrics.peak_exertion(metrics.rate_series(beats)).first()
    assert (round(r["slope"], 2), round(r["start_sec"], 1), round(r["end_sec"], 1), round(r["duration_sec"], 1), round(r["start_bpm"], 1), round(r["end_bpm"], 1)) == (3.35, 65.3, 85.4, 20.1, 92.3, 159.6)


def test_periods(beats):
    points = metrics.turning_points(metrics.rate_series(beats))
    shown = lambda df: [(round(r["start_sec"], 1), round(r["end_sec"], 1), round(r["duration_sec"], 1), round(r["change_bpm"], 1)) for r in df.orderBy("start_sec").collect()]
    assert shown(metrics.major_changes(points, True)) == [(5.8, 49.0, 43.2, 40.7), (73.6, 85.4, 11.8, 52.6)]
    assert shown(metrics.major_changes(points, False)) == [(49.0, 62.1, 13.1, -50.6)]


def test_variability_against_plain_windows(beats):
    t = np.array([r["t_us"] for r in beats.orderBy("t_us").collect()]) / 1e6
    rr, want = np.diff(t), []
    for i in range(0, len(rr) - 39, 5):
        w = rr[i : i + 40]
        want.append((i // 5, np.sqrt((np.diff(w) ** 2).mean()) * 1000 / w.mean(), w.std() * 1000, 60 / w.mean(), (t[i] + t[i + 40]) / 2))
    got = [(r["window_no"], r["rmssdc"], r["sdnn"], r["bpm"], r["t_mid"]) for r in metrics.hrv_windows(beats).orderBy("window_no").collect()]
    assert np.allclose(got, want)
