"""NumPy kernels for what has no closed relational form: zero-phase filtering, peak selection, rolling quantiles."""

from __future__ import annotations

import numpy as np
import pandas as pd

from pcgspark.params import DEFAULTS, Params

LOW_HZ, HIGH_HZ = 20.0, 150.0


def bandpass(rate: float, low: float = LOW_HZ, high: float = HIGH_HZ, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital Butterworth band pass, by the bilinear transform of the analog prototype."""
    if high >= rate / 2:
        raise ValueError(f"the band's upper end of {high} Hz needs a sample rate over {2 * high} Hz, not {rate}")
    warped = 4 * np.tan(np.pi * np.array([low, high]) / rate)  # at a rate of 2
    width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
    k = np.arange(1, order + 1)
    prototype = np.exp(1j * np.pi * (2 * k + order - 1) / (2 * order)) * width / 2
    shift = np.sqrt(prototype**2 - centre**2)
    poles = np.concatenate((prototype + shift, prototype - shift))
    gain = width**order
    z_poles = (4 + poles) / (4 - poles)
    z_zeros = np.concatenate((np.ones(order), -np.ones(order)))  # zeros at 0 and at infinity
    gain = gain * np.real(4.0**order / np.prod(4 - poles))
    return np.real(gain * np.poly(z_zeros)), np.real(np.poly(z_poles))


STRIDE = 64  # samples of a stretch, of which many are filtered side by side


def transition(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(M, B) of the filter's state, which a sample x takes from z to M z + B x; the output is b0 x + z0."""
    m = np.eye(len(a) - 1, k=1)
    m[:, 0] -= a[1:]
    return m, b[1:] - a[1:] * b[0]


def filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Output and last state of the transposed direct form II, from a state.

    A stretch of samples is an affine map of the state. Stretches are filtered side by side from a state of zero, their maps
    are applied one after another, and what a stretch's true state adds to its output comes from a table of powers."""
    m, gain = transition(b, a)
    n = len(x) // STRIDE
    y, z = np.empty(len(x)), np.asarray(state, float)
    if n:
        side, own, seen = x[: n * STRIDE].reshape(n, STRIDE), np.zeros((n, len(gain))), np.empty((STRIDE, len(gain)))
        out, power = np.empty_like(side), np.eye(len(gain))
        for t in range(STRIDE):
            out[:, t] = b[0] * side[:, t] + own[:, 0]
            own = own @ m.T + np.outer(side[:, t], gain)
            seen[t], power = power[0], m @ power
        states = np.empty((n, len(gain)))
        for k in range(n):
            states[k], z = z, power @ z + own[k]
        y[: n * STRIDE] = (out + states @ seen.T).ravel()
    for i in range(n * STRIDE, len(x)):
        y[i], z = b[0] * x[i] + z[0], m @ z + gain * x[i]
    return y, z


def lfilter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    return filtered(b, a, np.asarray(x, float), state)[0]


def steady_state(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state that a constant input of 1 settles to."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[np.arange(1, n), np.arange(n - 1)] = 1
    return np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward, with an odd extension of three times the filter's length at either end."""
    b, a = b / a[0], a / a[0]
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        raise ValueError(f"a signal of {len(x)} samples is too short to filter")
    wide = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    zi = steady_state(b, a)
    once = lfilter(b, a, wide, zi * wide[0])
    twice = lfilter(b, a, once[::-1], zi * once[-1])[::-1]
    return twice[pad:-pad]


def centred_mean(x: np.ndarray, width: int) -> np.ndarray:
    return pd.Series(x).rolling(max(1, width), min_periods=1, center=True).mean().to_numpy()


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Indices of strict local maxima; a plateau counts once, at its middle rounded down; never an end."""
    if len(x) < 3:
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    ends = np.append(starts[1:], len(x)) - 1
    level = x[starts]
    inner = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1
    return (starts[inner] + ends[inner]) // 2


def far_apart(peaks: np.ndarray, heights: np.ndarray, distance: int) -> np.ndarray:
    """Mask of peaks kept when higher ones drop their neighbours closer than ``distance``; of equals the later goes first."""
    keep = np.ones(len(peaks), bool)
    for j in np.argsort(heights, kind="stable")[::-1]:
        if keep[j]:
            lo, hi = np.searchsorted(peaks, (peaks[j] - distance, peaks[j] + distance), side="right")
            hi = np.searchsorted(peaks, peaks[j] + distance, side="left")
            mine = np.arange(lo, hi)
            keep[mine[mine != j]] = False
    return keep


def _reach(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each sample the least value to the left and to the right before a strictly higher sample, by a stack."""

    def left(v: list[float]) -> list[float]:
        stack: list[tuple[float, float]] = []
        out = []
        for value in v:
            low = value
            while stack and stack[-1][0] <= value:
                low = min(low, stack.pop()[1])
            out.append(low)
            stack.append((value, low))
        return out

    return np.array(left(x.tolist())), np.array(left(x[::-1].tolist()))[::-1]


def prominences(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    if not len(peaks):
        return np.empty(0)
    before, after = _reach(x)
    return x[peaks] - np.maximum(before[peaks], after[peaks])


def find_peaks(x: np.ndarray, height: np.ndarray | float | None = None, prominence: float | None = None, distance: int | None = None) -> np.ndarray:
    """Local maxima filtered by height (a number or one for each sample), then distance, then prominence."""
    x = np.asarray(x, float)
    peaks = local_maxima(x)
    if height is not None:
        level = np.asarray(height, float)
        peaks = peaks[x[peaks] >= (level[peaks] if level.ndim else level)]
    if distance is not None and distance > 1:
        peaks = peaks[far_apart(peaks, x[peaks], int(distance))]
    if prominence is not None:
        peaks = peaks[prominences(x, peaks) >= prominence]
    return peaks


def decimation(rate: int, p: Params = DEFAULTS) -> int:
    """The factor, lowered where it would leave too few samples for the pass band."""
    return min(p.downsample_factor, max(1, int(rate / 300 - 1)))


def envelope_of(samples: np.ndarray, rate: int, p: Params = DEFAULTS, filter_first: bool = False) -> tuple[np.ndarray, int, np.ndarray]:
    """The decimated, band-passed, rectified and smoothed signal, its rate, and the signal before it is rectified."""
    k = decimation(rate, p)
    if filter_first:
        samples = filtfilt(*bandpass(rate), np.asarray(samples, float))[::k]
    new_rate = rate // k
    if not filter_first:
        samples = filtfilt(*bandpass(new_rate), np.asarray(samples, float)[::k])
    return centred_mean(np.abs(samples), new_rate // 10), new_rate, samples


def _floor_through(troughs: np.ndarray, env: np.ndarray, width: int, q: float) -> np.ndarray:
    line = pd.Series(env[troughs], index=troughs).reindex(np.arange(len(env))).interpolate()
    return line.rolling(width, min_periods=min(3, width), center=True).quantile(q).bfill().ffill().to_numpy()


def noise_floor(env: np.ndarray, rate: int, p: Params = DEFAULTS) -> tuple[np.ndarray, np.ndarray]:
    """Floor for each sample and the accepted troughs: a draft through all troughs judges them, the rest make the floor."""
    env = np.asarray(env, float)
    if not len(env):
        return env, np.empty(0, np.int64)
    troughs = find_peaks(-env, prominence=np.quantile(env, p.trough_prominence_quantile), distance=max(1, int(p.min_peak_distance_sec * rate)))
    if len(troughs) < 5:
        return np.full(len(env), np.quantile(env, p.noise_floor_quantile)), troughs
    width = max(1, int(p.noise_window_sec * rate))
    floor = _floor_through(troughs, env, width, p.noise_floor_quantile)
    with np.errstate(invalid="ignore"):
        kept = troughs[env[troughs] <= p.trough_rejection_multiplier * floor[troughs]]
    if len(kept) > 2:
        floor = _floor_through(kept, env, width, p.noise_floor_quantile)
    if np.isnan(floor).all():
        floor = np.full(len(env), np.quantile(env, 0.1))
    return floor, kept


def raw_peaks(env: np.ndarray, floor: np.ndarray, rate: int, p: Params = DEFAULTS) -> np.ndarray:
    if not len(env):
        return np.empty(0, np.int64)
    return find_peaks(env, height=floor, prominence=np.quantile(env, p.peak_prominence_quantile), distance=max(1, int(p.min_peak_distance_sec * rate)))
