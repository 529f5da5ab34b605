"""Scalar building blocks as Catalyst columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pcgspark.params import AMPLITUDE_KNOTS, AMPLITUDE_SCORES, DEFAULTS, DEVIATION_KNOTS, HIGH_RATE_CURVE, LOW_RATE_CURVE, RHYTHM_KNOTS, RHYTHM_SCORES, Params

ColumnOr = Column | str | float | int
TINY = 1e-9


def col(x: ColumnOr) -> Column:
    """A name is a column; a number is a literal."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def clip(x: ColumnOr, low: ColumnOr, high: ColumnOr) -> Column:
    return F.greatest(col(low), F.least(col(high), col(x)))


def lerp(a: ColumnOr, b: ColumnOr, share: ColumnOr) -> Column:
    return col(a) + (col(b) - col(a)) * col(share)


def interp(x: ColumnOr, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear map, constant beyond the ends; null stays null."""
    x = col(x)
    out = F.when(x.isNull(), None).when(x <= float(xs[0]), float(ys[0]))
    for x0, x1, y0, y1 in zip(xs[:-1], xs[1:], ys[:-1], ys[1:], strict=True):
        out = out.when(x < float(x1), float(y0) + (x - float(x0)) * ((float(y1) - float(y0)) / (float(x1) - float(x0))))
    return out.otherwise(float(ys[-1]))


def seconds(idx: ColumnOr, rate: ColumnOr) -> Column:
    return col(idx) / col(rate)


def strength(env: ColumnOr, floor: ColumnOr) -> Column:
    return F.greatest(F.lit(0.0), col(env) - col(floor))


def deviation(a: ColumnOr, b: ColumnOr) -> Column:
    """Relative change between two neighbouring strengths."""
    return F.abs(col(b) - col(a)) / (F.greatest(col(a), col(b)) + TINY)


def safe_decimation(rate: ColumnOr, factor: ColumnOr, least_rate: float = 300.0) -> Column:
    """The factor, lowered where it would leave too few samples for the pass band."""
    return F.least(col(factor), F.greatest(F.lit(1.0), F.floor(col(rate) / least_rate - 1))).cast("int")


def sound_trough(env: ColumnOr, floor: ColumnOr, p: Params = DEFAULTS) -> Column:
    """Whether a trough lies near a draft of the floor; not where that is unknown."""
    return F.coalesce(col(env) <= col(floor) * p.trough_rejection_multiplier, F.lit(False))


def rate_blend(bpm: ColumnOr, p: Params = DEFAULTS) -> Column:
    return clip((col(bpm) - p.contractility_bpm_low) / (p.contractility_bpm_high - p.contractility_bpm_low), 0, 1)


def blended_confidence(dev: ColumnOr, bpm: ColumnOr, p: Params = DEFAULTS) -> Column:
    """Confidence of a pair from the deviation of strengths; interpolation is linear in the curve, so curves blend."""
    return lerp(interp(dev, DEVIATION_KNOTS, LOW_RATE_CURVE), interp(dev, DEVIATION_KNOTS, HIGH_RATE_CURVE), rate_blend(bpm, p))


def stability_factor(ratio: ColumnOr, beats: ColumnOr, p: Params = DEFAULTS) -> Column:
    return F.when(col(beats) >= 5, interp(ratio, (0, 1), (p.stability_confidence_floor, p.stability_confidence_ceiling))).otherwise(1.0)


def in_recovery(t: ColumnOr, peak_t: ColumnOr, end_t: ColumnOr) -> Column:
    return F.coalesce((col(t) > col(peak_t)) & (col(t) < col(end_t)), F.lit(False))


def expected_ratio(bpm: ColumnOr, recovery: Column, p: Params = DEFAULTS) -> Column:
    """How strong S2 may be against S1."""
    rate = F.when(recovery, F.greatest(col(bpm), F.lit(p.contractility_bpm_low))).otherwise(col(bpm))
    return interp(rate, (p.contractility_bpm_low, p.contractility_bpm_high), (p.s2_s1_ratio_low_bpm, p.s2_s1_ratio_high_bpm))


def adjusted_confidence(conf: ColumnOr, s1: ColumnOr, s2: ColumnOr, expected: ColumnOr, factor: ColumnOr = 1.0, p: Params = DEFAULTS) -> Column:
    """Stability factor, then a penalty for a loud S2 or else a boost for a strong S1, clamped to 0..1."""
    conf, s1, s2, expected = col(conf) * col(factor), col(s1), col(s2), col(expected)
    ratio, inverse = s2 / (s1 + TINY), s1 / (s2 + TINY)
    penalty = lerp(p.penalty_amount_min, p.penalty_amount_max, clip((ratio / expected - 1) / 2, 0, 1))
    boost = lerp(p.boost_amount_min, p.boost_amount_max, clip((inverse - p.s1_s2_boost_ratio) / (p.s1_s2_full_boost_ratio - p.s1_s2_boost_ratio), 0, 1))
    change = F.when(ratio > expected, -penalty).when(s1 > s2 * p.s1_s2_boost_ratio, boost).otherwise(0.0)
    return clip(conf + change, 0, 1)


def max_pair_interval(bpm: ColumnOr, p: Params = DEFAULTS) -> Column:
    return F.least(F.lit(p.s1_s2_interval_cap_sec), F.lit(60.0) / col(bpm) * p.s1_s2_interval_rr_fraction)


def interval_penalised(conf: ColumnOr, interval: ColumnOr, longest: ColumnOr, p: Params = DEFAULTS) -> Column:
    start, full = col(longest) * p.interval_penalty_start_factor, col(longest) * p.interval_penalty_full_factor
    share = clip((col(interval) - start) / (full - start + TINY), 0, 1)
    hit = (col(interval) > col(longest)) & (col(interval) > start)
    return F.when(hit, F.greatest(F.lit(0.0), col(conf) - share * p.interval_max_penalty)).otherwise(col(conf))


def rhythm_fit(rr: ColumnOr, bpm: ColumnOr) -> Column:
    expected = F.lit(60.0) / col(bpm)
    return interp(F.abs(col(rr) - expected) / expected, RHYTHM_KNOTS, RHYTHM_SCORES)


def amplitude_fit(current: ColumnOr, last: ColumnOr) -> Column:
    return interp(col(current) / (col(last) + TINY), AMPLITUDE_KNOTS, AMPLITUDE_SCORES)


def lone_confidence(rr: ColumnOr, bpm: ColumnOr, current: ColumnOr, last: ColumnOr, p: Params = DEFAULTS) -> Column:
    return rhythm_fit(rr, bpm) * p.lone_s1_rhythm_weight + amplitude_fit(current, last) * p.lone_s1_amplitude_weight


def passes_forward_check(gap: ColumnOr, bpm: ColumnOr, env: ColumnOr, next_env: ColumnOr, p: Params = DEFAULTS) -> Column:
    """False if the next peak comes too soon, unless this one towers over it; true where there is no next peak."""
    soon = col(gap) < F.lit(60.0) / col(bpm) * p.lone_s1_forward_check_pct
    return ~F.coalesce(soon & ~(col(env) > col(next_env) * p.lone_s1_forward_amplitude_ratio), F.lit(False))


def belief_step(bpm: Column, rr: Column, p: Params = DEFAULTS) -> Column:
    """One update of the believed rate: inertia, a limit on the speed of change, and the allowed range."""
    target = bpm * p.belief_inertia + (F.lit(60.0) / rr) * (1 - p.belief_inertia)
    limit = rr * p.belief_speed_limit
    return clip(bpm + F.greatest(-limit, F.least(limit, target - bpm)), p.min_bpm, p.max_bpm)


def belief_fold(rrs: ColumnOr, start: ColumnOr = 80.0, p: Params = DEFAULTS) -> Column:
    """The believed rate after an array of intervals."""
    return F.aggregate(col(rrs), col(start).cast("double"), lambda b, rr: F.when(rr > 0, belief_step(b, rr, p)).otherwise(b))


def is_s1(label: ColumnOr) -> Column:
    return F.trim(col(label)).startswith("S1") | F.trim(col(label)).startswith("Lone S1")


def is_s2(label: ColumnOr) -> Column:
    return F.trim(col(label)).startswith("S2")


def clock(t: ColumnOr) -> Column:
    """MM:SS of seconds; minutes run on past the hour."""
    whole = F.floor(col(t)).cast("bigint")
    return F.format_string("%02d:%02d", F.expr("0L") + (whole / 60).cast("bigint"), whole % 60)


def sane(x: ColumnOr) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(col(x)) | (F.abs(col(x)) == float("inf")), 0.0).otherwise(col(x))


def product_error(a: Column, b: Column) -> Column:
    """What the rounded product of two doubles lacks, exactly (both are split into halves whose products are exact)."""
    halves = lambda x: (134217729.0 * x - (134217729.0 * x - x), x - (134217729.0 * x - (134217729.0 * x - x)))
    (ah, al), (bh, bl) = halves(a), halves(b)
    return ((ah * bh - a * b) + ah * bl + al * bh) + al * bl


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once."""
    p, e = a * b, product_error(a, b)
    s = p + c
    lost = (p - (s - (s - p))) + (c - (s - p))
    return s + (lost + e)


def to_places(x: ColumnOr, places: int) -> Column:
    """The double next to ``x`` rounded to ``places`` by its exact binary value, halves to even, as Python and C print it.
    Java's formatter rounds the halves of the shortest decimal up."""
    x = col(x).cast("double")
    y, scale = F.abs(x) * float(10**places), F.lit(float(10**places))
    whole = F.floor(y).cast("double")
    error = product_error(F.abs(x), scale)
    up = (y - whole > 0.5) | ((y - whole == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    near = (whole + up.cast("double")) / scale * F.when(x < 0, -1.0).otherwise(1.0)
    return F.when(y < 1e15, near).otherwise(x)


def printf(pattern: str, *columns: ColumnOr) -> Column:
    """``format_string`` whose fixed numbers are rounded by ``to_places``."""
    specs = re.findall(r"%[-+ 0#]*\d*(?:\.(\d+))?([a-zA-Z])", pattern.replace("%%", ""))
    return F.format_string(pattern, *[to_places(c, int(n or 6)) if kind == "f" else c for (n, kind), c in zip(specs, columns, strict=True)])


def null_if_nan(x: ColumnOr) -> Column:
    return F.when(F.isnan(col(x)), None).otherwise(col(x))
