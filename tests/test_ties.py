"""Values that stand just at a limit are judged as the SQL judges them; halves are printed as C and Python print them."""

import math
import random
import struct

import duckdb
import pandas as pd
import pytest

from pcgspark.functions import exprs as X
from pcgspark.operators import rolling
from pcgspark.plans import analysis, registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def written(folder, rows):
    """A folder with an event table of (seconds, user, kind, value)."""
    con = duckdb.connect()
    con.register("r", pd.DataFrame([(i, *r) for i, r in enumerate(rows)], columns=["event_id", "s", "user_id", "event_type", "value"]))
    con.execute(f"copy (select event_id, timestamp '2024-01-01' + to_microseconds(cast(round(s * 1e6) as bigint)) as ts, user_id, event_type, value, '' as props from r) to '{folder}/events.parquet'")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return con


def same(spark, folder, con, name):
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, str(folder)).toPandas()[list(want.columns)]
    key = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_values_at_a_quantile(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for user in range(400):  # the value four times the quantile is put in where it is a number of two places
        v = sorted(round(r.expovariate(1 / 50), 2) for _ in range(71))
        at = 71 * 0.2
        limit = round(4 * (v[14] * (15 - at) + v[15] * (at - 14)), 2)
        rows += [(i * 60, user, "view", x) for i, x in enumerate([*v, limit])]
    same(spark, tmp_path, written(tmp_path, rows), "trough_sanity")


#: Hundredths; each holds a trough whose prominence is just the quantile that it must reach.
AT_THE_LIMIT = [
    "54 32 166 5 62 164 168 38 20 120 20 180 128 40 22 22 88 15 53 85 88 66 200 19 59 4 29 199 191 139 84 168 190 118 78 170 130 43 99 70 158 153 94 113 76 43 176 109 70 23 115 33 127 195 144 63 107 172 21 115 136 86 34 110 112 150 143 75 181 57 42 158",
    "184 138 57 142 105 14 14 144 10 31 178 100 58 13 48 155 111 129 15 121 120 178 53 148 35 105 45 86 136 136 73 175 92 168 84 28 70 142 178 28 49 65 34 111 128 78 74 88 128 120 181 33 181 31 71 177 63 101 200 122 114 110 44 150 126 132 155 136 33 53 192 161",
]


@pytest.mark.parametrize("name", ["noise_floor", "raw_extrema"])
def test_troughs_at_the_limit(spark, tmp_path, name):
    rows = [(i * 60, user, "view", int(x) / 100) for user, text in enumerate(AT_THE_LIMIT) for i, x in enumerate(text.split())]
    same(spark, tmp_path, written(tmp_path, rows), name)


def test_labels_and_values_at_one_time(spark, tmp_path):
    rows = [(0, 7, "click", 9.0), (60, 7, "view", 2.0), (60.01, 7, "view", 1.0), (120, 7, "click", 3.0), (120.01, 7, "click", 4.0), (180, 7, "view", 20.0), (180.02, 7, "view", 10.0)]
    same(spark, tmp_path, written(tmp_path, rows), "interpolate_at_labels")


def test_quantiles_round_once(spark):
    r = random.Random(7)
    values = [(str(g), round(r.expovariate(0.02), 2)) for g in range(40) for _ in range(r.randint(1, 90))]
    got = {x["recording_id"]: x["q"] for x in rolling.quantiles(spark.createDataFrame(values, "recording_id string, x double"), "x", q=0.2).collect()}
    for g in got:
        v = sorted(x for k, x in values if k == g)
        at = (len(v) - 1) * 0.2
        low = math.floor(at)
        assert got[g] == math.fma(v[low], 1 - (at - low), v[min(low + 1, len(v) - 1)] * (at - low))


def test_halves_are_printed_to_even(spark):
    r = random.Random(8)
    values = [0.25, 0.35, 0.15, 106.25, 106.75, -0.25, -0.04, 0.0, 1e300, 43.25, 0.05, 2.675, 1.005, *[r.randint(0, 4000) / 16 for _ in range(200)], *[struct.unpack("d", struct.pack("q", r.getrandbits(62)))[0] for _ in range(5)]]
    values = [v for v in values if v == v and abs(v) < 1e14]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.printf("%.1f %.2f%% %+.2f %s", "v", "v", "v", X.F.lit("x")).alias("s")).collect()
    for x in rows:
        assert x["s"] == "%.1f %.2f%% %+.2f x" % (x["v"], x["v"], x["v"])


def test_report_of_halves(spark):
    beats = spark.createDataFrame([("a", i, t, int(t * 1e6)) for i, t in enumerate([0.0, 0.96, 3.46, 5.86])], "recording_id string, sample_idx bigint, t_sec double, t_us bigint")
    rated = analysis.metrics.rate_series(beats)
    line = rated.filter("t_us = 960000").select(X.printf("| %.2f | %.1f |", "t_sec", "smoothed_bpm").alias("l"), "smoothed_bpm").first()
    assert (line["l"], line["smoothed_bpm"]) == ("| 0.96 | 43.2 |", 43.25)
