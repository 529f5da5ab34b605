"""What the classifier works out and hands over at once."""

import random

import numpy as np
import pandas as pd

from pcgspark.functions import tracker
from pcgspark.operators import classify
from pcgspark.params import DEFAULTS, DEVIATION_KNOTS, LOW_RATE_CURVE


def recordings(n, peaks=60):
    r = random.Random(3)
    rows = [(str(i), 100, "ok", None, np.cumsum([r.randint(20, 60) for _ in range(peaks)]), np.array([r.expovariate(0.02) for _ in range(peaks)]), np.full(peaks, 3.0)) for i in range(n)]
    return pd.DataFrame(rows, columns=["recording_id", "sample_rate", "status", "start_bpm_hint", "raw_peaks", "env", "floor"])


def test_results_leave_a_worker_in_slices():
    frames = list(classify._analysed([recordings(400)], DEFAULTS, classify.PARTS))
    assert sum(map(len, frames)) == 400 and max(sum(map(len, f["peaks"])) for f in frames) <= classify.SLICE + 60


def test_parts():
    rows = recordings(5)
    whole, belief, start = (pd.concat(classify._analysed([rows], DEFAULTS, parts)) for parts in (classify.PARTS, ("belief",), ()))
    slim = pd.concat(classify._analysed([rows], DEFAULTS, ("peaks",)))
    for c in ("start_bpm", "peak_bpm_time_sec", "recovery_end_sec"):
        assert whole[c].tolist() == belief[c].tolist() == start[c].tolist() == slim[c].tolist()
    assert whole["belief"].tolist() == belief["belief"].tolist() and not any(map(len, start["belief"])) and not any(map(len, belief["peaks"]))
    assert [[{**x, "reasons": []} for x in row] for row in whole["peaks"]] == slim["peaks"].tolist() and any(x["reasons"] for x in whole["peaks"].iloc[0])


def test_interp_is_that_of_numpy():
    r = random.Random(4)
    for x in [*DEVIATION_KNOTS, -1.0, 9.0, *[r.random() * 1.2 for _ in range(2000)]]:
        assert tracker.interp(x, DEVIATION_KNOTS, LOW_RATE_CURVE) == np.interp(x, DEVIATION_KNOTS, LOW_RATE_CURVE)
    assert np.isnan(tracker.interp(float("nan"), DEVIATION_KNOTS, LOW_RATE_CURVE))
