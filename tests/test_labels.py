"""Replay of label logs against a plain version."""

import random

import pytest

from pcgspark.operators import labels as lab

LOG = "recording_id string, seq bigint, action string, t_sec double, bpm double, peak_type string"


def plain(events, depth):
    kept, stack = [], []
    for action, label in events:
        if action == "add":
            kept.append(label)
            stack = [*stack, label][-depth:]
        elif action == "clear":
            kept, stack = [], []
        elif action == "undo" and kept and stack:
            last = stack.pop()
            kept = [x for x in kept if x != last]
    return kept


@pytest.mark.parametrize("depth", [1, 3, lab.UNDO_DEPTH])
def test_replay(spark, depth):
    rng = random.Random(depth)
    logs = {}
    for i in range(40):
        weights = rng.choice([(8, 3, 1, 1), (3, 3, 0, 1), (9, 1, 0, 0), (2, 9, 1, 0)])
        logs[f"r{i}"] = [(rng.choices(["add", "undo", "clear", "save"], weights)[0], (float(rng.randrange(4)), rng.choice([60.0, None]), rng.choice(["S1", "S2"]))) for _ in range(rng.randrange(1, 60))]
    rows = [(r, i, action, *label) for r, events in logs.items() for i, (action, label) in enumerate(events)]
    rng.shuffle(rows)
    got = {}
    for r in lab.replay(spark.createDataFrame(rows, LOG), depth=depth).collect():
        got.setdefault(r["recording_id"], []).append((r["t_sec"], r["bpm"], r["peak_type"]))
    for r, events in logs.items():
        assert sorted(got.get(r, []), key=str) == sorted(plain(events, depth), key=str), r


def test_replay_of_nothing(spark):
    assert lab.replay(spark.createDataFrame([], LOG)).count() == 0
    assert lab.replay(spark.createDataFrame([("a", 0, "undo", None, None, None), ("a", 1, "save", None, None, None)], LOG)).count() == 0
