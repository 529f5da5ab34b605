import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pcgspark.functions import tracker as t
from pcgspark.params import DEFAULTS, LONE_S1_LAST, NOISE, S1_PAIRED, S2_PAIRED


def peaks(times, env, floor=0.1, rate=100):
    times = np.asarray(times, float)
    return t.peaks_of(np.round(times * rate).astype(int), times, np.asarray(env, float), np.full(len(times), floor))


def test_steady_pairs():
    s1 = np.arange(0, 30, 0.8)
    times = np.sort(np.concatenate((s1, s1 + 0.3)))
    env = np.where(np.isin(times, s1), 1.0, 0.8)
    beats, verdicts, history = t.track(peaks(times, env))
    assert np.allclose([b.t for b in beats], s1)
    kinds = [v.kind for v in verdicts.values()]
    assert kinds.count(S1_PAIRED) == len(s1) and kinds.count(S2_PAIRED) == len(s1)
    assert abs(history[-1][1] - 75) < 5


def test_few_peaks_give_nothing():
    assert t.track(peaks([1.0], [1.0])) == ([], {}, [])
    start, recovery, beats, verdicts, history = t.analyse(peaks([], []))
    assert (start, recovery, beats, verdicts, history) == (80.0, None, [], {}, [])


def test_last_peak_is_a_beat():
    beats, verdicts, _ = t.track(peaks([0, 0.3, 0.8], [1, 0.8, 1]))
    assert list(verdicts.values())[-1].kind == LONE_S1_LAST and beats[-1].t == 0.8


def test_unknown_deviation_is_confident():
    tr = t.Tracker()
    a, b = peaks([0, 0.3], [1, 0.8])
    assert np.isnan(a.dev) and tr.pair_confidence(a, b)[0] == 1.0


def test_belief_moves_by_its_limit():
    tr = t.Tracker(bpm=80)
    tr.before, tr.last = peaks([0, 0.5], [1, 1])
    tr._believe()
    assert tr.bpm == 80 + min(1.5, 0.05 * (120 - 80))


def loop(beats, p=DEFAULTS):
    if len(beats) < 5:
        return beats
    limit = np.median(np.diff([b.t for b in beats])) * p.rr_correction_threshold_pct
    kept = [beats[0]]
    for b in beats[1:]:
        if b.t - kept[-1].t < limit:
            if b.env > kept[-1].env:
                kept[-1] = b
        else:
            kept.append(b)
    return kept


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 5)), min_size=1, max_size=30))
def test_conflicts_against_the_loop(items):
    times = np.cumsum([g / 10 for g, _ in items])
    beats = peaks(times, [a for _, a in items])
    assert t.drop_conflicts(beats) == loop(beats)


def test_gap_is_filled_and_surplus_removed():
    s1 = [0.8 * i for i in range(20)]
    every = sorted(s1 + [x + 0.3 for x in s1])
    ps = peaks(every, [1.0 if i % 2 == 0 else 0.8 for i in range(len(every))])
    verdicts = {p.idx: t.Verdict(p.idx, S1_PAIRED if i % 2 == 0 else S2_PAIRED) for i, p in enumerate(ps)}
    for p in ps[20:22]:
        verdicts[p.idx].kind = NOISE
    beats = [p for i, p in enumerate(ps) if i % 2 == 0 and i != 20]
    fixed, made = t.fix_discontinuities(beats, ps, verdicts)
    assert made == 1 and ps[20] in fixed and verdicts[ps[20].idx].kind.startswith("S1 (Paired - Corrected")
    extra = peaks([8.05], [0.3])[0]
    fixed, made = t.fix_discontinuities(sorted([*fixed, extra], key=lambda b: b.t), sorted([*ps, extra], key=lambda b: b.t), verdicts)
    assert made == 1 and extra not in fixed
