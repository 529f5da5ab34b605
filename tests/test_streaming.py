"""The tracker over streams, with typed state: against one fold, started again, closed when idle."""

import numpy as np
import pytest

from pcgspark.params import DEFAULTS
from pcgspark.streaming import tracking

SCHEMA = "recording_id string, sample_idx bigint, t_sec double, amp double, floor double"


@pytest.fixture
def rocks(spark):
    spark.conf.set(tracking.PROVIDER, tracking.ROCKS)
    yield spark
    spark.conf.unset(tracking.PROVIDER)


def recordings():
    """A steady rate in pairs, and a rhythm in which all kinds of verdicts occur."""
    s1 = np.arange(0, 16, 0.8)
    steady = [("a", int(t * 100), float(t), 1.0 if t in s1 else 0.8, 0.1) for t in np.sort(np.concatenate((s1, s1 + 0.3)))]
    rng = np.random.default_rng(4)
    times = np.cumsum(rng.choice([0.3, 0.5, 0.2, 0.8], 60))
    return steady, [("b", int(round(t * 100)), float(t), float(e), 0.1) for t, e in zip(times, rng.uniform(0.3, 1, 60), strict=True)]


def folded(rows, last=False):
    live = tracking.Live(DEFAULTS)
    out = [v for _, *peak in rows for v in live.push(*peak)]
    return [(rows[0][0], *v) for v in out + (live.finish() if last else [])]


def run(spark, folder, mark, out, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = tracking.track_stream(stream, **options).writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def verdicts(spark, out):
    return sorted(tuple(r) for r in spark.read.schema(tracking.VERDICTS).parquet(out).collect())


def test_started_again_in_the_middle_of_a_pair(rocks, tmp_path):
    spark, (a, b) = rocks, recordings()
    folder, mark, out = (f"{tmp_path}/{x}" for x in ("in", "mark", "out"))
    for part in ((0, 7), (7, 8), (8, 60)):  # the 7th and 8th peak of the steady one are a pair
        rows = a[slice(*part)] + b[slice(*part)]
        spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        run(spark, folder, mark, out)
    want = sorted(folded(a) + folded(b))
    got = verdicts(spark, out)
    assert [x[:4] for x in got] == [x[:4] for x in want] and np.allclose([x[5] for x in got], [x[5] for x in want])
    assert len({x[3] for x in want}) >= 4
    state = {r["key"]["recording_id"]: r["value"] for r in spark.read.format("statestore").option("stateVarName", "tracker").load(mark).collect()}
    assert set(state) == {"a", "b"} and state["a"]["pending_idx"] == a[-1][1] and state["b"]["bpm"] == pytest.approx(folded(b)[-1][5])
    assert isinstance(state["a"]["paired"], list) and state["a"]["beats"] == len([x for x in folded(a) if x[3].startswith(("S1", "Lone"))])


def test_state_as_columns():
    _, rows = recordings()
    one, many = tracking.Live(), tracking.Live()
    for _, *peak in rows:
        want = one.push(*peak)
        many = tracking.Live.of(many.state(), DEFAULTS)
        assert many.push(*peak) == want
    assert many.finish() == one.finish() != []


def test_late_peaks_are_dropped():
    live = tracking.Live()
    assert live.push(10, 1.0, 1.0, 0.1) == [] and live.push(5, 0.5, 1.0, 0.1) == [] and live.push(10, 1.0, 2.0, 0.1) == []
    assert [v[0] for v in live.push(40, 1.3, 0.8, 0.1)] == [10, 40]


def test_idle_recordings_are_closed(rocks, tmp_path):
    """A timer settles the pending peak and drops the state. With timers a query has batches without new rows, so it runs
    until it is stopped."""
    import time

    spark, (a, _) = rocks, recordings()
    folder, mark, out = (f"{tmp_path}/{x}" for x in ("in", "mark", "out"))
    spark.createDataFrame(a[:7], SCHEMA).coalesce(1).write.parquet(folder)
    stream = tracking.track_stream(spark.readStream.schema(SCHEMA).parquet(folder), idle_ms=500)
    query = stream.writeStream.format("parquet").option("checkpointLocation", mark).option("path", out).outputMode("append").trigger(processingTime="1 second").start()
    want = [x[:4] for x in sorted(folded(a[:7], last=True))]
    try:
        for _ in range(60):
            time.sleep(1)
            if query.lastProgress and len(got := [x[:4] for x in verdicts(spark, out)]) >= len(want):
                break
    finally:
        query.stop()
    assert got == want
    assert spark.read.format("statestore").option("stateVarName", "tracker").load(mark).count() == 0


def test_the_store_must_be_named(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    with pytest.raises(ValueError, match="RocksDB"):
        tracking.track_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"))


def test_recordings_are_analysed_once(spark, tmp_path):
    from pcg import heart

    from pcgspark.plans import analysis
    from pcgspark.sources import wav
    from pcgspark.streaming import discovery

    folder, mark, out = (tmp_path / x for x in ("in", "mark", "out"))
    (folder / "deep").mkdir(parents=True)
    sounds = {"a": heart(np.arange(0.5, 14, 0.8)), "b": heart(np.arange(0.5, 14, 0.7)), "c": heart(np.arange(0.5, 14, 0.6))}

    def put(name, at=None):
        (folder / (at or f"{name}.wav")).write_bytes(wav.encode(4000, sounds[name]))

    paths = f"file://{folder}", f"file://{out}", f"file://{mark}"
    put("a")
    (folder / "broken.WAV").write_bytes(b"no sound")
    (folder / "notes.txt").write_text("x")
    assert discovery.analyse_new(spark, *paths) == 2
    put("b", "deep/b.wav")
    put("c")
    assert discovery.analyse_new(spark, *paths, files_per_batch=1) == 2
    assert discovery.analyse_new(spark, *paths) == 0
    got = {r["recording_id"]: r for r in discovery.latest(spark, paths[1]).collect()}
    whole = analysis.analyse(wav.read_recordings(spark, paths[0]))
    want = {r["recording_id"]: r for r in whole.summary.collect()}
    assert set(got) == {"a", "b", "c", "broken"} and got["broken"]["status"] != "ok"
    assert all(got[n].asDict(True) == want[n].asDict(True) for n in want)
    rates = sorted((r["recording_id"], r["t_sec"], r["smoothed_bpm"]) for r in discovery.latest(spark, paths[1], "rates").collect())
    assert rates == sorted((r["recording_id"], r["t_sec"], r["smoothed_bpm"]) for r in whole.series.collect())
    batch = spark.createDataFrame([("c", "c.wav", wav.encode(4000, sounds["a"]))], "recording_id string, path string, content binary")
    for _ in range(2):  # a later batch replaces a recording's rows, and may be run again
        discovery._take(batch, 9, paths[1], None, DEFAULTS)
    again = {r["recording_id"]: r["avg_bpm"] for r in discovery.latest(spark, paths[1]).collect()}
    assert again["c"] == got["a"]["avg_bpm"] and again["b"] == got["b"]["avg_bpm"] and len(again) == 4
    whole.release()
