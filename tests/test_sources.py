import dataclasses
import os
import struct

import numpy as np
import pytest

from pyspark.sql import functions as F

from pcgspark.functions import kernels
from pcgspark.operators import labels as lab
from pcgspark.operators import signal as sig
from pcgspark.sources import named, sinks, tables, wav


def riff(rate, channels, bits, data, kind=1):
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits, b"data", len(data))
    return head + data


def test_encodings():
    assert wav.decode(riff(100, 1, 16, np.array([1, -2], "<i2").tobytes()))[1].tolist() == [1, -2]
    assert wav.decode(riff(100, 2, 8, bytes([10, 20, 30, 50])))[1].tolist() == [15, 40]
    assert wav.decode(riff(100, 1, 24, (-3).to_bytes(3, "little", signed=True)))[1].tolist() == [-3]
    assert wav.decode(riff(100, 1, 32, np.array([0.5], "<f4").tobytes(), 3))[1].tolist() == [0.5]
    with pytest.raises(ValueError):
        wav.decode(b"no wave")


def test_silence_is_written():
    rate, x = wav.decode(wav.encode(300, np.zeros(5)))
    assert rate == 300 and x.tolist() == [0] * 5
    assert wav.decode(wav.encode(300, [1.0, -2.0]))[1].tolist() == [16383, -32767]


def test_samples_of_long_files(spark, tmp_path):
    """More tasks than files; files and frames that filters rule out are not read."""
    rng = np.random.default_rng(2)
    (tmp_path / "in").mkdir()
    (tmp_path / "a.wav").write_bytes(wav.encode(4000, rng.normal(size=10_000)))
    (tmp_path / "in" / "b.WAV").write_bytes(riff(100, 2, 24, bytes(range(96)) + b"x"))
    (tmp_path / "c.wav").write_bytes(b"broken")
    rows = wav.read_samples(spark, str(tmp_path), 3000)
    assert rows.rdd.getNumPartitions() == 5
    got = {n: [r["amp"] for r in sorted(rows.filter(F.col("recording_id") == n).collect(), key=lambda r: r["idx"])] for n in "ab"}
    for n, path in (("a", tmp_path / "a.wav"), ("b", tmp_path / "in" / "b.WAV")):
        assert got[n] == wav.decode(path.read_bytes())[1].tolist() and len(got[n]) == {"a": 10_000, "b": 16}[n]
    (tmp_path / "gone.wav").symlink_to(tmp_path / "nowhere.wav")  # opening it fails
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = wav.read_samples(spark, str(tmp_path), 3000).filter("recording_id in ('a', 'b') and idx >= 2990 and idx < 3010 and idx <= 3008 and idx > 2989 and amp is not null")
        assert part.count() == 19 and part.rdd.getNumPartitions() == 1
        assert wav.read_samples(spark, str(tmp_path)).filter("recording_id = 'b' and idx = 3").count() == 1
        assert wav.read_samples(spark, str(tmp_path)).filter("recording_id = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    passed, rate = sig.band_passed(wav.read_samples(spark, str(tmp_path / "a.wav"), 700), 4000)
    want = kernels.envelope_of(wav.decode((tmp_path / "a.wav").read_bytes())[1], 4000)[2]
    assert rate == 333 and np.allclose([r["filtered"] for r in passed.orderBy("idx").collect()], want)
    with pytest.raises(ValueError):
        wav._SampleReader({"path": "x", "stretch": "0"})


def test_reading_folders(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.wav").write_bytes(wav.encode(400, [1.0, 2.0]))
    (tmp_path / "in" / "b.WAV").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("x")
    rows = {r["recording_id"]: r for r in wav.read_recordings(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"} and rows["a"]["sample_rate"] == 400 and rows["b"]["samples"] is None
    wav.register(spark)
    (tmp_path / "in" / "b.WAV").unlink()
    got = spark.read.format("pcg_wav").load(str(tmp_path)).collect()
    assert [r["recording_id"] for r in got] == ["a"] and len(got[0]["samples"]) == 2


def test_discovery(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.wav", "b.MP3", "in/c.Flac", "d.txt", "e"):
        (tmp_path / name).write_bytes(b"xy")
    got = tables.list_recordings(spark, str(tmp_path)).collect()
    assert sorted((r["recording_id"], r["length"]) for r in got) == [("a", 2), ("b", 2), ("c", 2)]


def test_fallback(spark):
    done = spark.createDataFrame([("a_filtered_debug", 1)], "recording_id string, v int")
    plain = spark.createDataFrame([("a", 2), ("b", 3)], "recording_id string, v int")
    assert sorted(map(tuple, wav.with_fallback(done, plain).collect())) == [("a", 1), ("b", 3)]


def test_label_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("x", 1.0, 70.0, "S1"), ("x", 1.25, 70.0, "S2"), ("y", 2.0, 60.0, "S1")], "recording_id string, t_sec double, bpm double, peak_type string")
    texts = {r["recording_id"]: r["value"] for r in sinks.label_text(rows, lab.pairs(rows)).collect()}
    assert texts["x"].startswith("# Peak Labels\n") and "1.0,1.25,0.25,70.0" in texts["x"] and not texts["y"].startswith("#")
    for name, text in texts.items():
        (tmp_path / f"{name}_labels.csv").write_text(text)
    (tmp_path / "z_labels.csv").write_text("garbage\n")
    back = tables.read_labels(spark, str(tmp_path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_settings_and_rates(spark, tmp_path):
    (tmp_path / "a_Analysis_Settings.json").write_text('{\n    "start_bpm_hint": 95.0\n}')
    (tmp_path / "b_Analysis_Settings.json").write_text("{broken")
    got = {r["recording_id"]: r["start_bpm_hint"] for r in tables.read_settings(spark, str(tmp_path)).collect()}
    assert got == {"a": 95.0, "b": None}
    (tmp_path / "a_bpm_plot.csv").write_text("Time (s),Average BPM\n1.000,70.5\n")
    assert [tuple(r) for r in tables.read_rates(spark, str(tmp_path)).collect()] == [("a", 1.0, 70.5)]
    assert [r[0] for r in tables.processed_recordings(spark, str(tmp_path)).collect()] == ["a"]


def test_rate_files(spark, tmp_path):
    s = spark.createDataFrame([("a", 2.0, 71.23456), ("a", 1.0, 70.0), ("a", 3.0, None)], "recording_id string, t_sec double, smoothed_bpm double")
    sinks.write_rates(s, str(tmp_path / "out"))
    text = next((tmp_path / "out" / "recording_id=a").glob("*.csv")).read_text().split("\n")
    assert text[:3] == ["Time (s),Average BPM", "1.000,70.000", "2.000,71.235"]


def test_files_with_names(spark, tmp_path):
    """Rates, labels and signals as plain files, which the readers find by their names."""
    series = spark.createDataFrame([("a", 1.0, 60.0), ("a", 0.5, 61.5), ("b", 2.0, 70.25), ("b", 3.0, None)], "recording_id string, t_sec double, smoothed_bpm double")
    marks = spark.createDataFrame([("a", 1.0, 60.0, "S1"), ("a", 1.3, 60.0, "S2"), ("b", 2.0, 70.0, "S1")], "recording_id string, t_sec double, bpm double, peak_type string")
    x = np.sin(np.arange(4000) / 20)
    prepared = sig.prepare(spark.createDataFrame([("a", 4000, np.tile(x, 3).tolist())], "recording_id string, sample_rate int, samples array<double>"))
    folder = str(tmp_path / "out")
    for _ in range(2):
        named.write_files(named.rate_files(series), folder)
        named.write_files(named.text_files(sinks.label_text(marks, lab.pairs(marks)), "_labels.csv"), folder)
        named.write_files(named.debug_files(prepared), folder)
    names = ["a_bpm_plot.csv", "a_filtered_debug.wav", "a_labels.csv", "b_bpm_plot.csv", "b_labels.csv"]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == names
    assert (tmp_path / "out/a_bpm_plot.csv").read_text() == "Time (s),Average BPM\n0.500,61.500\n1.000,60.000\n"
    assert sorted(map(tuple, tables.read_rates(spark, folder).collect())) == [("a", 0.5, 61.5), ("a", 1.0, 60.0), ("b", 2.0, 70.25)]
    assert sorted(map(tuple, tables.read_labels(spark, folder).collect())) == sorted(map(tuple, marks.collect()))
    assert wav.decode((tmp_path / "out/a_filtered_debug.wav").read_bytes())[0] == 333
    assert {r["recording_id"] for r in tables.processed_recordings(spark, folder).collect()} == {"a", "b"}
    named.write_files(named.rate_files(series.filter("recording_id = 'a'")), folder, overwrite=True)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a_bpm_plot.csv"]


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = spark.createDataFrame([("good.txt", b"x"), ("bad/name.txt", b"y"), ("other.txt", None)], named.SCHEMA).repartition(3)
    with pytest.raises(Exception, match="not a file's name"):
        named.write_files(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    named.write_files(rows.filter("name not like '%/%'"), str(tmp_path / "out"))
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "out").iterdir()) == [("good.txt", b"x"), ("other.txt", b"")]
    named.write_files(rows.limit(0), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


@pytest.mark.parametrize("query, suffix", [("settings_files", "_Analysis_Settings.json"), ("label_files", "_labels.csv"), ("rate_files", "_bpm_plot.csv")])
def test_a_file_for_each_recording(spark, tmp_path, query, suffix):
    """The queries write one file with the recording's name, and no folder, for each recording; rows without an id stay so."""
    from pcgspark.plans import files, registry

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("user_id", F.expr("nullif(user_id, 3)"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    base = named.local_path(files._folder(spark)).rsplit("/", 1)[0]
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    got = registry.queries()[query](spark, str(tmp_path)).toPandas()
    (made,) = set(os.listdir(base)) - before
    ids = {r[0] for r in events.select(F.coalesce(F.col("user_id").cast("string"), F.lit("no-recording"))).distinct().collect()}
    assert set(os.listdir(f"{base}/{made}")) == {i + suffix for i in ids} and "no-recording" in ids
    assert set(got["recording_id"].fillna("no-recording")) == ids


def test_local_paths():
    assert [named.local_path(x) for x in ("/a/b", "file:///a/b", "file:/a/b", "s3a://b/c", "a/b:c")] == ["/a/b", "/a/b", "/a/b", None, "a/b:c"]


def test_settings_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 61.5), ("b", None)], "recording_id string, start_bpm_hint double")
    named.write_files(named.settings_files(rows), str(tmp_path / "out"))
    assert (tmp_path / "out/b_Analysis_Settings.json").read_text() == '{"start_bpm_hint":null}'
    assert sorted(map(tuple, tables.read_settings(spark, str(tmp_path / "out")).collect())) == [("a", 61.5), ("b", None)]


def test_tasks_send_no_names():
    assert [f.name for f in dataclasses.fields(named._Written)] == ["folder"]
