"""Beat tracking: a fold over raw peaks, one peak of look-ahead. The same step serves batches and streams."""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

from pcgspark.params import (
    AMPLITUDE_KNOTS,
    AMPLITUDE_SCORES,
    DEFAULTS,
    DEVIATION_KNOTS,
    HIGH_RATE_CURVE,
    LONE_S1,
    LONE_S1_CASCADE,
    LONE_S1_LAST,
    LOW_RATE_CURVE,
    NOISE,
    ORIGINAL,
    PAIRED_BECAUSE,
    REJECTED_BECAUSE,
    RHYTHM_KNOTS,
    RHYTHM_SCORES,
    S1_FROM_GAP,
    S1_PAIRED,
    S2_FROM_GAP,
    S2_PAIRED,
    UNPAIRED_BECAUSE,
    VALID_BECAUSE,
    Params,
)

TINY = 1e-9
#: A step of a decision: its kind and up to three numbers (see ``reasons``).
Step = tuple[str, float | None, float | None, float | None]


def step_of(kind: str, by: float | None = None, of: float | None = None, against: float | None = None) -> Step:
    return (kind, *[None if x is None else float(x) for x in (by, of, against)])


def interp(x: float, xs: tuple[float, ...], ys: tuple[float, ...]) -> float:
    """``numpy.interp`` of one number, without the cost of arrays."""
    if x != x:
        return x
    if x <= xs[0] or x >= xs[-1]:
        return ys[0] if x <= xs[0] else ys[-1]
    j = bisect_right(xs, x) - 1
    return ys[j] if xs[j] == x else (ys[j + 1] - ys[j]) / (xs[j + 1] - xs[j]) * (x - xs[j]) + ys[j]


def unit(x: float) -> float:
    """Cut to 0..1."""
    return min(1.0, max(0.0, x))


@dataclass
class Peak:
    """A raw peak: sample number, seconds, envelope, noise floor, and the smoothed deviation known at its time."""

    idx: int
    t: float
    env: float
    floor: float
    dev: float

    @property
    def strength(self) -> float:
        return max(0.0, self.env - self.floor)


@dataclass
class Verdict:
    idx: int
    kind: str
    reasons: list[tuple[str, str | None, list[Step]]] = field(default_factory=list)  # tag, note, steps
    confidence: float | None = None


@dataclass
class Tracker:
    """State of the fold. ``step`` consumes one peak, or two where they pair."""

    params: Params = DEFAULTS
    bpm: float = 80.0
    recovery: tuple[float, float] | None = None
    beats: int = 0
    last: Peak | None = None
    before: Peak | None = None
    paired: deque = field(default_factory=deque)  # of the latest beats, whether they are paired
    rejections: int = 0
    lone: deque = field(default_factory=lambda: deque(maxlen=4))  # of the latest beats: 0 paired, 1 lone, 2 lone and noise after it
    just_beaten: bool = False  # whether the latest verdict was on a lone beat

    def pairing_ratio(self) -> float:
        p = self.params
        n = p.stability_history_window
        ratio = 0.5 if self.beats < n else sum(self.paired) / n
        return p.kickstart_override_ratio if p.kickstart and ratio < p.kickstart_check_threshold and self.stuck() else ratio

    def stuck(self) -> bool:
        """Whether of the last four beats three or more are lone ones with noise right after them."""
        return len(self.lone) == self.lone.maxlen and sum(x == 2 for x in self.lone) >= 3

    def pair_confidence(self, a: Peak, b: Peak) -> tuple[float, list[Step]]:
        p = self.params
        rate = unit((self.bpm - p.contractility_bpm_low) / (p.contractility_bpm_high - p.contractility_bpm_low))
        low, high = (interp(a.dev, DEVIATION_KNOTS, c) for c in (LOW_RATE_CURVE, HIGH_RATE_CURVE))
        conf = low + (high - low) * rate
        said = [step_of("base", conf, rate)]
        if self.beats >= 5:
            paired = self.pairing_ratio()
            factor = interp(paired, (0, 1), (p.stability_confidence_floor, p.stability_confidence_ceiling))
            conf *= factor
            said.append(step_of("stability", factor, paired))
        recovering = self.recovery is not None and self.recovery[0] < a.t < self.recovery[1]
        expected = interp(max(self.bpm, p.contractility_bpm_low) if recovering else self.bpm, (p.contractility_bpm_low, p.contractility_bpm_high), (p.s2_s1_ratio_low_bpm, p.s2_s1_ratio_high_bpm))
        ratio = b.strength / (a.strength + TINY)
        if ratio > expected:
            cut = p.penalty_amount_min + unit((ratio / expected - 1) / 2) * (p.penalty_amount_max - p.penalty_amount_min)
            conf -= cut
            said.append(step_of("penalty", cut, ratio, expected))
        elif a.strength > b.strength * p.s1_s2_boost_ratio:
            share = unit((a.strength / (b.strength + TINY) - p.s1_s2_boost_ratio) / (p.s1_s2_full_boost_ratio - p.s1_s2_boost_ratio))
            gain = p.boost_amount_min + share * (p.boost_amount_max - p.boost_amount_min)
            conf += gain
            said.append(step_of("boost", gain, a.strength / (b.strength + TINY)))
        conf = 1.0 if conf != conf else float(min(1.0, max(0.0, conf)))  # an unknown deviation leaves nothing to doubt
        longest = min(p.s1_s2_interval_cap_sec, 60.0 / self.bpm * p.s1_s2_interval_rr_fraction)
        gap = b.t - a.t
        start, full = longest * p.interval_penalty_start_factor, longest * p.interval_penalty_full_factor
        if p.enable_interval_penalty and gap > longest and gap > start:
            cut = float(unit((gap - start) / (full - start + TINY))) * p.interval_max_penalty
            conf = max(0.0, conf - cut)
            said.append(step_of("interval", cut, gap, longest))
        said.append(step_of("score", conf, None, p.pairing_confidence_threshold))
        return conf, said

    def lone_verdict(self, peak: Peak, following: Peak | None) -> tuple[bool, bool, float | None, list[Step]]:
        """(valid, rejected by confidence, confidence, steps)."""
        p = self.params
        if self.last is None:
            return True, False, None, [step_of("first")]
        expected = 60.0 / self.bpm
        rhythm = interp(abs(peak.t - self.last.t - expected) / expected, RHYTHM_KNOTS, RHYTHM_SCORES)
        amplitude = interp(peak.strength / (self.last.strength + TINY), AMPLITUDE_KNOTS, AMPLITUDE_SCORES)
        conf = float(rhythm * p.lone_s1_rhythm_weight + amplitude * p.lone_s1_amplitude_weight)
        least = p.lone_s1_confidence_threshold
        said = [step_of("rhythm", rhythm, peak.t - self.last.t, expected), step_of("amplitude", amplitude, peak.strength / (self.last.strength + TINY)), step_of("lone", conf, None, least)]
        if conf < least:
            return False, True, conf, said
        if following is not None and following.t - peak.t < expected * p.lone_s1_forward_check_pct and not peak.env > following.env * p.lone_s1_forward_amplitude_ratio:
            gap = following.t - peak.t
            return False, False, conf, [step_of("soon", 60.0 / gap if gap > 0 else float("inf"))]
        return True, False, conf, [*said, step_of("weights", p.lone_s1_rhythm_weight, p.lone_s1_amplitude_weight)]

    def _beat(self, peak: Peak, paired: bool) -> None:
        self.before, self.last = self.last, peak
        self.beats += 1
        self.paired.append(paired)
        self.lone.append(0 if paired else 1)
        self.just_beaten = not paired
        if len(self.paired) > self.params.stability_history_window:
            self.paired.popleft()

    def _believe(self) -> None:
        """After every decision, so each noise peak applies the last interval again."""
        if self.before is not None and (rr := self.last.t - self.before.t) > 0:
            p = self.params
            change = self.bpm * p.belief_inertia + 60.0 / rr * (1 - p.belief_inertia) - self.bpm
            limit = p.belief_speed_limit * rr
            self.bpm = float(min(p.max_bpm, max(p.min_bpm, self.bpm + min(limit, max(-limit, change)))))

    def step(self, peak: Peak, following: Peak | None) -> list[Verdict]:
        """Verdicts on the peak and, if they pair, on the one after it."""
        if following is None:
            self._beat(peak, False)
            out = [Verdict(peak.idx, LONE_S1_LAST)]
        else:
            conf, why = self.pair_confidence(peak, following)
            if conf >= self.params.pairing_confidence_threshold:
                self._beat(peak, True)
                self.rejections = 0
                out = [Verdict(x.idx, kind, [(PAIRED_BECAUSE, None, why)], conf) for x, kind in ((peak, S1_PAIRED), (following, S2_PAIRED))]
            else:
                out = [self._lone(peak, following, why)]
        self._believe()
        return out

    def _lone(self, peak: Peak, following: Peak, why: list[Step]) -> Verdict:
        valid, by_confidence, conf, steps = self.lone_verdict(peak, following)
        reasons = [(UNPAIRED_BECAUSE, None, why), (VALID_BECAUSE if valid else REJECTED_BECAUSE, None, steps)]
        self.rejections = self.rejections + 1 if by_confidence and not valid else 0
        kind = LONE_S1 if valid else NOISE
        if not valid and self.rejections >= self.params.cascade_reset_trigger_count:
            kind, self.rejections = LONE_S1_CASCADE, 0
        if kind != NOISE:
            self._beat(peak, False)
        else:
            if self.just_beaten:
                self.lone[-1] = 2
            self.just_beaten = False
        return Verdict(peak.idx, kind, reasons, conf)


def peaks_of(idx: np.ndarray, t: np.ndarray, env: np.ndarray, floor: np.ndarray, p: Params = DEFAULTS) -> list[Peak]:
    """Peaks with the smoothed deviation at or before their time (the one of the pair before; none for the first)."""
    strengths = np.maximum(0.0, env - floor)
    dev = np.abs(np.diff(strengths)) / (np.maximum(strengths[:-1], strengths[1:]) + TINY)
    smooth = pd.Series(dev).rolling(max(5, int(len(dev) * p.deviation_smoothing_factor)), min_periods=1, center=True).mean().to_numpy()
    at = np.searchsorted((t[:-1] + t[1:]) / 2, t, side="right") - 1
    known = np.where(at >= 0, smooth[np.maximum(at, 0)], np.nan) if len(dev) else np.full(len(t), np.nan)
    return [Peak(int(i), float(s), float(e), float(f), float(d)) for i, s, e, f, d in zip(idx, t, env, floor, known, strict=True)]


def track(peaks: list[Peak], p: Params = DEFAULTS, start_bpm: float | None = None, recovery: tuple[float, float] | None = None):
    """(beats, verdict by sample number, belief history)."""
    tracker = Tracker(p, float(start_bpm or 80.0), recovery)
    verdicts: dict[int, Verdict] = {}
    history: list[tuple[float, float]] = []
    beats: list[Peak] = []
    at = 0
    while len(peaks) >= 2 and at < len(peaks):
        was = tracker.beats
        made = tracker.step(peaks[at], peaks[at + 1] if at + 1 < len(peaks) else None)
        verdicts.update((v.idx, v) for v in made)
        if tracker.beats > was:
            beats.append(tracker.last)
        if tracker.last is not None:
            history.append((tracker.last.t, tracker.bpm))
        at += len(made)
    return beats, verdicts, history


def smoothed_rate(t: np.ndarray, p: Params = DEFAULTS) -> tuple[np.ndarray, np.ndarray]:
    """(time, smoothed rate) of beats 2..n: mean over (t - w/2, t + w/2]."""
    gaps = np.diff(t)
    ok = gaps > 1e-6
    at, inst = t[1:][ok], 60.0 / gaps[ok]
    micros, half = np.round(at * 1e6).astype(np.int64), int(p.output_smoothing_window_sec * 1e6) // 2
    sums = np.concatenate(([0.0], np.cumsum(inst)))
    lo, hi = np.searchsorted(micros, micros - half, "right"), np.searchsorted(micros, micros + half, "right")
    return at, (sums[hi] - sums[lo]) / np.maximum(hi - lo, 1)


def preliminary(peaks: list[Peak], p: Params = DEFAULTS, hint: float | None = None) -> tuple[float, tuple[float, float] | None]:
    """Starting rate and recovery phase from a pass with a high threshold."""
    beats, _, _ = track(peaks, p.but(pairing_confidence_threshold=p.preliminary_confidence_threshold), hint)
    t = np.array([b.t for b in beats])
    estimate = 60.0 / np.median(np.diff(t)) if len(t) >= 10 and np.median(np.diff(t)) > 0 else None
    at, bpm = smoothed_rate(t, p) if len(t) >= 2 else (np.empty(0), np.empty(0))
    bpm = np.round(bpm, 9)  # means of equal frames are equal, and the first counts
    recovery = (float(at[bpm.argmax()]), float(at[bpm.argmax()] + p.recovery_phase_duration_sec)) if len(at) >= 2 else None
    return float(hint or estimate or 80.0), recovery


def drop_conflicts(beats: list[Peak], p: Params = DEFAULTS) -> list[Peak]:
    """Of two beats closer than a share of the median interval the stronger stays (of equals the earlier)."""
    if len(beats) < 5:
        return beats
    least = float(np.median(np.diff([b.t for b in beats]))) * p.rr_correction_threshold_pct
    kept: list[Peak] = []
    for b in beats:
        if not kept or b.t - kept[-1].t >= least:
            kept.append(b)
        elif b.env > kept[-1].env:
            kept[-1] = b
    return kept


def fix_discontinuities(beats: list[Peak], peaks: list[Peak], verdicts: dict[int, Verdict], p: Params = DEFAULTS, margin: int = 3) -> tuple[list[Peak], int]:
    """One round: missed beats in long gaps, surplus beats in short ones. Changes ``verdicts``; returns the corrections."""
    if len(beats) < 2 * margin:
        return beats, 0
    rr = np.diff([b.t for b in beats])
    q1, q3 = np.percentile(rr, (25, 75))
    spread = 1.5 * (q3 - q1)
    stable = rr[(rr > q1 - spread) & (rr < q3 + spread)]
    if not len(stable):
        return beats, 0
    usual, made = float(np.median(stable)), 0
    noise = {v.idx for v in verdicts.values() if "Noise" in v.kind}  # as labelled before this round
    order = {x.idx: k for k, x in enumerate(peaks)}
    added: list[Peak] = []
    for a, b in zip(beats[margin : len(beats) - 1 - margin], beats[margin + 1 : len(beats) - margin], strict=True):
        if b.t - a.t <= usual * p.rr_correction_long_interval_pct:
            continue
        inside = peaks[order[a.idx] + 1 : order[b.idx]]
        for first, second in zip(inside[:-1], inside[1:], strict=True):
            strong = first.strength > p.penalty_waiver_strength_ratio * first.floor
            plausible = second.env / (first.env + TINY) < p.penalty_waiver_max_s2_s1_ratio
            if first.idx in noise and second.idx in noise and strong and plausible:
                for x, kind in ((first, S1_FROM_GAP), (second, S2_FROM_GAP)):
                    verdicts[x.idx] = Verdict(x.idx, kind, [(ORIGINAL, verdicts[x.idx].kind, []), *verdicts[x.idx].reasons], verdicts[x.idx].confidence)
                added.append(first)
                made += 1
                break
    merged = sorted({b.idx: b for b in [*beats, *added]}.values(), key=lambda b: b.idx)
    gone: set[int] = set()
    for a, b in zip(merged[margin : len(merged) - 1 - margin], merged[margin + 1 : len(merged) - margin], strict=True):
        if a.idx not in gone and b.idx not in gone and b.t - a.t < usual * p.rr_correction_threshold_pct:
            gone.add(a.idx if b.env > a.env else b.idx)
            made += 1
    return [b for b in merged if b.idx not in gone], made


def analyse(peaks: list[Peak], p: Params = DEFAULTS, hint: float | None = None, rounds: int = 5, parts: tuple[str, ...] = ("peaks", "belief")):
    """(start rate, recovery, final beats, verdicts, belief history) of a recording; without ``peaks`` no corrections, without
    any of ``parts`` only the first pass."""
    start, recovery = preliminary(peaks, p, hint)
    if not parts:
        return start, recovery, [], {}, []
    beats, verdicts, history = track(peaks, p, start, recovery)
    if "peaks" not in parts:
        return start, recovery, beats, verdicts, history
    beats = drop_conflicts(beats, p)
    for _ in range(rounds if p.enable_correction_pass else 0):
        beats, made = fix_discontinuities(beats, peaks, verdicts, p)
        if not made:
            break
    return start, recovery, beats, verdicts, history
