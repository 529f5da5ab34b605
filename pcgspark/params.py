"""Analysis parameters."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Names and defaults of the parameters, and the knots of the confidence curves.


@dataclass(frozen=True)
class Params:
    # preprocessing
    downsample_factor: int = 300
    save_filtered_wav: bool = True
    # features
    min_peak_distance_sec: float = 0.05
    peak_prominence_quantile: float = 0.1
    trough_prominence_quantile: float = 0.1
    # noise floor
    noise_floor_quantile: float = 0.20
    noise_window_sec: float = 10
    trough_rejection_multiplier: float = 4.0
    # pairing
    pairing_confidence_threshold: float = 0.50
    preliminary_confidence_threshold: float = 0.75
    s1_s2_interval_cap_sec: float = 0.4
    s1_s2_interval_rr_fraction: float = 0.7
    deviation_smoothing_factor: float = 0.05
    stability_history_window: int = 20
    stability_confidence_floor: float = 0.60
    stability_confidence_ceiling: float = 1.25
    s1_s2_boost_ratio: float = 1.2
    s1_s2_full_boost_ratio: float = 4.0
    boost_amount_min: float = 0.10
    boost_amount_max: float = 0.35
    penalty_amount_min: float = 0.10
    penalty_amount_max: float = 0.30
    s2_s1_ratio_low_bpm: float = 1.5
    s2_s1_ratio_high_bpm: float = 1.1
    contractility_bpm_low: float = 120.0
    contractility_bpm_high: float = 140.0
    recovery_phase_duration_sec: float = 120
    enable_interval_penalty: bool = True
    interval_penalty_start_factor: float = 1.0
    interval_penalty_full_factor: float = 1.4
    interval_max_penalty: float = 0.75
    kickstart: bool = False
    kickstart_check_threshold: float = 0.3
    kickstart_override_ratio: float = 0.60
    # rhythm
    min_bpm: float = 40
    max_bpm: float = 240
    belief_inertia: float = 0.95
    belief_speed_limit: float = 3.0
    lone_s1_forward_check_pct: float = 0.50
    lone_s1_forward_amplitude_ratio: float = 1.7
    lone_s1_confidence_threshold: float = 0.50
    lone_s1_rhythm_weight: float = 0.65
    lone_s1_amplitude_weight: float = 0.35
    cascade_reset_trigger_count: int = 3
    # correction
    enable_correction_pass: bool = True
    rr_correction_threshold_pct: float = 0.40
    rr_correction_long_interval_pct: float = 1.70
    penalty_waiver_strength_ratio: float = 4.0
    penalty_waiver_max_s2_s1_ratio: float = 2.5
    # output
    output_smoothing_window_sec: float = 5
    hrv_window_size_beats: int = 40
    hrv_step_size_beats: int = 5
    plot_amplitude_scale_factor: float = 250.0
    plot_downsample_factor: int = 1

    def but(self, **changes) -> Params:
        return replace(self, **changes)


DEFAULTS = Params()

DEVIATION_KNOTS = (0.0, 0.25, 0.40, 0.80, 1.0)
LOW_RATE_CURVE = (0.9, 0.9, 0.7, 0.1, 0.1)
HIGH_RATE_CURVE = (0.1, 0.5, 0.75, 0.65, 0.0)
RHYTHM_KNOTS, RHYTHM_SCORES = (0.0, 0.15, 0.30, 0.50), (1.0, 0.8, 0.4, 0.0)
AMPLITUDE_KNOTS, AMPLITUDE_SCORES = (0.0, 0.4, 0.7, 1.0), (0.0, 0.4, 0.8, 1.0)

PEAK_TYPES = (
    "S1 (Paired)",
    "S2 (Paired)",
    "Lone S1",
    "Lone S1 (Corrected by Cascade Reset)",
    "Lone S1 (Last Peak)",
    "Noise/Rejected",
    "S1 (Paired - Corrected from Gap)",
    "S2 (Paired - Corrected from Gap)",
    "S2 (Paired - Corrected from Conflict)",
)
S1_PAIRED, S2_PAIRED, LONE_S1, LONE_S1_CASCADE, LONE_S1_LAST, NOISE_REJECTED, S1_FROM_GAP, S2_FROM_GAP, S2_FROM_CONFLICT = PEAK_TYPES
NOISE = "Noise"

# Tags of a peak's reasons, and the lines in which a report shows the numbers behind them.
PAIRED_BECAUSE, UNPAIRED_BECAUSE, VALID_BECAUSE, REJECTED_BECAUSE, ORIGINAL = (
    "PAIRING_SUCCESS_REASON",
    "PAIRING_FAIL_REASON",
    "LONE_S1_VALIDATE_REASON",
    "LONE_S1_REJECT_REASON",
    "ORIGINAL_REASON",
)
FIRST_BEAT = "First beat"
BASE_TEXT = "Base Conf (Blended Model %.0f%% High): %.2f"
STABILITY_TEXT = "Stability Pre-Adjust: x%.2f (Pairing Ratio: %.0f%%)"
PENALTY_TEXT = "PENALIZED by %.2f (S2 Str. Ratio %.1fx > Expected %.1fx)"
BOOST_TEXT = "BOOSTED by %.2f (S1 Str. Ratio %.1fx > S2)"
INTERVAL_TEXT = "Interval PENALTY by %.2f (Interval %.3fs > Max %.3fs)"
SCORE_TEXT = "Final Score: %.2f vs Threshold %.2f -> %s"
TOO_SOON_TEXT = "Rejected Lone S1: Forward check failed (Implies %.0f BPM)"
RHYTHM_TEXT = "\t- Rhythm Fit=%.2f (Interval %.3fs vs Expected %.3fs)"
AMPLITUDE_TEXT = "\t- Amplitude Fit=%.2f (Strength Ratio %.2fx)"
PAIRING_TITLE, PAIRING_ABSENT, LONE_TITLE = "- S1-S2 pairing decision:", "    - No details available.", "- Lone S1 decision:"
ORIGINAL_TITLE = "- Original Classification:"
WEIGHTED_TITLE, WEIGHTED_ROWS = "\t- Weighted Calculation:", ("\t\t- Rhythm: %.2f × %.2f = %.3f", "\t\t- Amplitude: %.2f × %.2f = %.3f", "\t\t- Final: %.3f + %.3f = %.3f")
# Separators before the rest of a label; the first in this order that occurs counts.
SEPARATORS = (". Pairing Justification: ", ". Rejection: ", ". Original: ", ". ")
UNKNOWN_PEAK = "Unknown Peak"
FINAL_ROW = "- Final Score: Confidence %.3f %s %.2f -> %s"
