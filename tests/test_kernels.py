import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pcgspark.functions import kernels as k


def gain(b, a, hz, rate):
    z = np.exp(2j * np.pi * hz / rate)
    return abs(np.polyval(b, z) / np.polyval(a, z))


def test_band_edges_have_half_power():
    b, a = k.bandpass(1000)
    assert gain(b, a, 20, 1000) == pytest.approx(2**-0.5, abs=1e-9)
    assert gain(b, a, 150, 1000) == pytest.approx(2**-0.5, abs=1e-9)
    assert gain(b, a, 60, 1000) == pytest.approx(1, abs=0.02)
    assert gain(b, a, 0.001, 1000) < 1e-6


def test_rate_too_low():
    with pytest.raises(ValueError):
        k.bandpass(300)


def test_filter_keeps_phase():
    rate, t = 1000, np.arange(4000) / 1000
    x = np.sin(2 * np.pi * 60 * t)
    y = k.filtfilt(*k.bandpass(rate), x)
    inner = slice(1000, 3000)
    assert np.corrcoef(x[inner], y[inner])[0, 1] > 0.9999
    assert y[inner].std() / x[inner].std() == pytest.approx(gain(*k.bandpass(rate), 60, rate) ** 2, rel=1e-3)


def test_constant_input_is_removed_without_a_transient():
    y = k.filtfilt(*k.bandpass(1000), np.full(500, 3.0))
    assert abs(y).max() < 1e-9


def test_local_maxima():
    assert k.local_maxima(np.array([0, 1, 0, 2, 2, 2, 0, 3])).tolist() == [1, 4]
    assert k.local_maxima(np.array([2, 2, 1])).tolist() == []
    assert k.local_maxima(np.array([])).tolist() == []


def brute_prominence(x, p):
    sides = []
    for step in (-1, 1):
        i, low = p, x[p]
        while 0 <= i < len(x) and x[i] <= x[p]:
            low = min(low, x[i])
            i += step
        sides.append(low)
    return x[p] - max(sides)


def brute_distance(peaks, heights, d):
    keep = np.ones(len(peaks), bool)
    for j in np.argsort(heights, kind="stable")[::-1]:
        if keep[j]:
            for i in range(len(peaks)):
                if i != j and abs(peaks[i] - peaks[j]) < d:
                    keep[i] = False
    return keep


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.integers(1, 9))
def test_peaks_against_brute_force(values, d):
    x = np.array(values, float)
    p = k.local_maxima(x)
    assert np.allclose(k.prominences(x, p), [brute_prominence(x, i) for i in p])
    assert (k.far_apart(p, x[p], d) == brute_distance(p, x[p], d)).all()


def test_find_peaks_height_by_sample():
    x = np.array([0, 3, 0, 5, 0, 4, 0], float)
    assert k.find_peaks(x, height=np.array([0, 4, 0, 4, 0, 4, 0.0])).tolist() == [3, 5]
    assert k.find_peaks(x, distance=3).tolist() == [3]
    assert k.find_peaks(x, prominence=4.5).tolist() == [3]


def test_noise_floor_falls_back():
    env = np.abs(np.random.default_rng(0).normal(size=50)) + 5
    floor, troughs = k.noise_floor(env[:6], 100)
    assert (floor == np.quantile(env[:6], 0.2)).all()
    assert k.noise_floor(np.empty(0), 100)[0].size == 0


def test_envelope_rate():
    env, rate, passed = k.envelope_of(np.random.default_rng(0).normal(size=44100), 44100)
    assert rate == 302 and len(env) == len(passed) == -(-44100 // 146)


def test_centred_mean_matches_rows():
    x = np.arange(10.0)
    assert np.allclose(k.centred_mean(x, 4), [x[max(0, i - 2) : i + 2].mean() for i in range(10)])
    assert pd.Series(x).rolling(3, center=True, min_periods=1).mean().tolist() == k.centred_mean(x, 3).tolist()
