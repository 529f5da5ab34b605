"""Schemas of the tables."""

RECORDINGS = "recording_id string, path string, sample_rate int, samples array<double>"
SAMPLES = "recording_id string, sample_rate int, sample_idx bigint, amp double"
SETTINGS = "start_bpm_hint double"
BPM_CSV = "`Time (s)` double, `Average BPM` double"
LABELS_CSV = "`Time (s)` double, `Average BPM` double, `Peak Type` string"
LABELS = "recording_id string, t_sec double, bpm double, peak_type string"
ENVELOPES = "recording_id string, sample_rate int, n_samples bigint, env array<double>, floor array<double>, troughs array<bigint>, raw_peaks array<bigint>, status string, filtered array<double>"
REASON = "struct<tag:string,note:string,steps:array<struct<kind:string,by:double,of:double,against:double>>>"
PEAK = f"struct<sample_idx:bigint,t_sec:double,amp:double,floor:double,peak_type:string,reasons:array<{REASON}>,confidence:double,is_final_beat:boolean>"
BELIEF = "struct<step_no:int,t_sec:double,bpm:double>"
ANALYSES = f"recording_id string, sample_rate int, status string, peaks array<{PEAK}>, belief array<{BELIEF}>, start_bpm double, peak_bpm_time_sec double, recovery_end_sec double"
