"""The runnable jobs as registered queries: each runs twice into one new folder, whose output is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from pcgspark.plans import registry  # noqa: F401 (registers the SQL that is used here)
from pcgspark.plans.catalogue import ORACLE, out, query
from pcgspark.plans.files import _folder

_PARTS = {"a": "analysis_summary", "h": "hrv_summary", "y": "hrr_10s", "e": "peak_exertion", "f": "peak_recovery"}
_VALUES = {
    **{c: f"a.{c}" for c in ("n_points", "avg_bpm", "min_bpm", "max_bpm")}, **{c: f"h.{c}" for c in ("n_windows", "avg_rmssdc", "avg_sdnn")}, "hrr_bpm": "y.hrr_bpm",
    **{f"exertion_{c}": f"e.{c}" for c in ("start_sec", "duration_sec", "slope")}, **{f"recovery_{c}": f"f.{c}" for c in ("start_sec", "duration_sec", "slope")},
}


@query(
    ", st as (select user_id as recording_id, strftime(min(ts), '%Y-%m-%d') as start_day, count(*) as n_beats from events group by 1)\nselect recording_id, n_beats, case when n_beats >= 20 then 'ok' else 'too few beats' end as status, start_day, "
    + ", ".join(f"case when n_beats >= 20 then {x} end as {c}" for c, x in _VALUES.items())
    + " from st "
    + " ".join(f"left join ({ORACLE[q]}) {name} using (recording_id)" for name, q in _PARTS.items())
)
def job1_rate_report(spark, sf):
    from jobs import rate_report
    from jobs.common import config_of

    path = _folder(spark)
    for _ in range(2):
        rate_report.run(spark, f"{sf}/events.parquet", f"{path}/report", config_of("rate_report"))
    got = rate_report.result(spark, f"{path}/report")
    rounded = {c: c for c, kind in got.dtypes if kind == "double"}
    return out(got, *[c for c in got.columns if c not in rounded], **rounded)


@query(
    """, l as (select doc_id, source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_words from documents where doc_id is not null),
b as (select *, avg(n_words) over (partition by source order by doc_id range between 99 preceding and 100 following) as baseline,
      max(n_words) over (partition by source order by doc_id range between 50 preceding and 1 preceding) as earlier,
      max(n_words) over (partition by source order by doc_id range between 1 following and 50 following) as later from l)
select doc_id, source, lang, n_words, round(baseline, 6) as baseline, n_words > 0 and n_words >= 4.0 * baseline and coalesce(earlier < n_words, true) and coalesce(later <= n_words, true) as is_peak,
  doc_id // 100000 as block from b"""
)
def job2_text_peaks(spark, sf):
    from jobs import text_peaks
    from jobs.common import config_of

    path = _folder(spark)
    for _ in range(2):
        text_peaks.run(spark, f"{sf}/documents.parquet", f"{path}/watch", f"{path}/checkpoint", config_of("text_peaks"))
    got = text_peaks.result(spark, f"{path}/watch")
    return out(got, *[c for c in got.columns if c != "baseline"], baseline=F.col("baseline"))
