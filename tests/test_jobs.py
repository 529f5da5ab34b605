"""The runnable jobs on copies: against plain versions, over growing input, run again, from the command line."""

import datetime as dt
import json
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import rate_report, text_peaks
from jobs.common import config_of

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = {"block": 40, "window": 20, "ratio": 2.0, "distance": 5, "files_per_batch": 64}


def plain_peaks(rows, c):
    """rows: (doc_id, source, lang, n_words), one for each doc_id."""
    out = set()
    for i, source, lang, n in rows:
        near = [(j, m) for j, s, _, m in rows if s == source]
        frame = [m for j, m in near if i - c["window"] // 2 < j <= i + c["window"] // 2]
        baseline = sum(frame) / len(frame)
        around = [(j, m) for j, m in near if 0 < abs(j - i) <= c["distance"]]
        alone = all(m < n if j < i else m <= n for j, m in around)
        out.add((i, source, lang, n, round(baseline, 6), alone and n > 0 and n >= c["ratio"] * baseline, i // c["block"]))
    return out


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rows_of(spark, out):
    return sorted((r["doc_id"], r["source"], r["lang"], r["n_words"], round(r["baseline"], 6), r["is_peak"], r["block"]) for r in text_peaks.result(spark, out).collect())


def text_of(n):
    return " ".join(["w"] * n)


@pytest.fixture
def growing():
    """Documents of three sources, one of which has most rows, with some loud ones near the edges of blocks."""
    loud = {39, 40, 79, 81, 120, 125, 199}
    return [(i, text_of(90 if i in loud else 3 + i * 7 % 5), "en", "hot" if i % 5 else None if i % 10 else "b", None) for i in range(-45, 230)]


def write(spark, rows, path):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(path)


def test_growing_input(spark, growing, tmp_path):
    """Three runs over growing input give what one run over all gives, and read only what is new."""
    docs, out, mark = (f"file://{tmp_path}/{x}" for x in ("documents", "out", "mark"))
    taken = 0
    for part in (growing[::2], growing[1::2][:60], growing[1::2][60:]):
        write(spark, part, docs)
        assert text_peaks.run(spark, docs, out, mark, SMALL)["documents read"] == len(part)
        taken += len(part)
    want = sorted(plain_peaks([(i, s, lang, words(t)) for i, t, lang, s, _ in growing], SMALL), key=str)
    got = rows_of(spark, out)
    assert sorted(got, key=str) == want and any(r[5] for r in got) and taken == len(growing)
    stored = {p.name for p in (tmp_path / "out/rows").glob("block=*")}
    assert "block=-2" in stored and "block=5" in stored
    assert text_peaks.run(spark, docs, out, mark, SMALL)["documents read"] == 0 and rows_of(spark, out) == got
    whole = f"file://{tmp_path}/whole"
    text_peaks.run(spark, docs, whole, f"{mark}2", SMALL | {"files_per_batch": 1})
    assert rows_of(spark, whole) == got


def test_a_batch_again(spark, growing, tmp_path):
    """A batch that is run again after a failure leaves the same rows."""
    out = f"file://{tmp_path}/out"
    batches = [spark.createDataFrame(growing[:100], DOCS), spark.createDataFrame(growing[100:], DOCS)]
    for number in (0, 1, 1):
        text_peaks._take(batches[number], number, out, SMALL)
        got = rows_of(spark, out)
    assert {r[:4] for r in got} == {(i, s, lang, words(t)) for i, t, lang, s, _ in growing} and len(got) == len(growing)


def test_odd_documents(spark, tmp_path):
    docs, out, mark = (f"file://{tmp_path}/{x}" for x in ("documents", "out", "mark"))
    long = text_of(50_000)
    write(spark, [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", "a", 5), (4, long, "en", "a", 9), (4, long, "en", "a", 9), (None, "x", "en", "a", 1), (5, "  x", "de", "a", 3), (10**15, "far", None, "a", 3)], docs)
    text_peaks.run(spark, docs, out, mark, SMALL)
    got = {r[0]: r for r in rows_of(spark, out)}
    assert {i: r[3] for i, r in got.items()} == {1: 0, 2: 0, 3: 0, 4: 50_000, 5: 2, 10**15: 1} and [i for i, r in got.items() if r[5]] == [4]
    write(spark, [(4, "now short", "fr", "b", 9)], docs)
    text_peaks.run(spark, docs, out, mark, SMALL)
    assert {r[0]: r[1:4] for r in rows_of(spark, out)}[4] == ("b", "fr", 2)
    with pytest.raises(ValueError):
        text_peaks.run(spark, docs, out, mark, SMALL | {"window": 500})


def test_no_documents(spark, tmp_path):
    docs, out, mark = (f"file://{tmp_path}/{x}" for x in ("documents", "out", "mark"))
    write(spark, [], docs)
    assert text_peaks.run(spark, docs, out, mark, SMALL)["documents read"] == 0


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def test_rate_report(spark, tmp_path):
    at = dt.datetime(2024, 3, 1)
    regular = [(i, at + dt.timedelta(minutes=1000 * i), 1, "x", 1.0, None) for i in range(60)]
    short = [(100 + i, at + dt.timedelta(days=40, minutes=i), 2, "x", 1.0, None) for i in range(3)]
    odd = [(200, None, 1, "x", 1.0, None), (201, at, None, "x", 1.0, None), (202, at, 1, "x", None, None)]
    events, out = f"file://{tmp_path}/events", f"file://{tmp_path}/report"
    spark.createDataFrame(regular + short + odd, EVENTS).write.parquet(events)
    config = config_of("rate_report")
    for _ in range(2):
        assert rate_report.run(spark, events, out, config) == {"events read": 66, "rows written": 2}
        got = {r["recording_id"]: r for r in rate_report.result(spark, out).collect()}
    assert (got[1]["status"], got[1]["n_beats"], got[1]["start_day"], round(got[1]["avg_bpm"], 6)) == ("ok", 60, "2024-03-01", 60.0)
    assert (got[2]["status"], got[2]["n_beats"], got[2]["avg_bpm"]) == ("too few beats", 3, None)
    assert sorted(p.name for p in (tmp_path / "report").glob("start_day=*")) == ["start_day=2024-03-01", "start_day=2024-04-10"]
    spark.createDataFrame(regular, EVENTS).write.mode("overwrite").parquet(events)
    rate_report.run(spark, events, out, config)
    assert rate_report.result(spark, out).count() == 1
    spark.createDataFrame([], EVENTS).write.mode("overwrite").parquet(events)
    rate_report.run(spark, events, out, config)
    assert rate_report.result(spark, out).count() == 0


def test_command_line(spark, tmp_path):
    mine = tmp_path / "mine.json"
    mine.write_text(json.dumps({"least_beats": 10_000}))
    command = [sys.executable, str(ROOT / "jobs/rate_report.py"), "--events", f"{SF}/events.parquet", "--out", f"{tmp_path}/report", "--config", str(mine)]
    done = subprocess.run(command, capture_output=True, text=True, timeout=300, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"})
    assert done.returncode == 0 and "events read: 1000" in done.stderr and "rows written: " in done.stderr
    assert {r["status"] for r in rate_report.result(spark, f"{tmp_path}/report").collect()} == {"too few beats"}
    mine.write_text('{"no_such_entry": 1}')
    with pytest.raises(ValueError):
        config_of("rate_report", str(mine))
