"""Synthetic heart sounds with known beats."""

import numpy as np


def heart(beats, rate=4000, seconds=None, s2_after=0.3, s2_gain=0.7, noise=0.01, seed=1, drop=()):
    """Bursts of 50 Hz (S1) and 70 Hz (S2, s2_after later) over noise; ``drop``: numbers of beats left out."""
    rng = np.random.default_rng(seed)
    n = int((seconds or beats[-1] + 1) * rate)
    x = rng.normal(0, noise, n)
    t = np.arange(n) / rate
    for k, b in enumerate(beats):
        if k in drop:
            continue
        for at, hz, gain in ((b, 50, 1.0), (b + s2_after, 70, s2_gain)):
            lo, hi = int((at - 0.06) * rate), int((at + 0.06) * rate)
            lo, hi = max(lo, 0), min(hi, n)
            x[lo:hi] += gain * np.exp(-(((t[lo:hi] - at) / 0.02) ** 2)) * np.sin(2 * np.pi * hz * (t[lo:hi] - at))
    return x
