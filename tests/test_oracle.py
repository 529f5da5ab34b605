"""Every registered query against its DuckDB counterpart on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from pcgspark.plans import registry

SF = "/root/testdata/sf0.001"
EMPTY = {"hrr_60s", "major_inclines", "major_declines"}  # the recordings are shorter than these look for
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda x: None if x is None or x != x else round(float(x), 5) if isinstance(x, float) or hasattr(x, "dtype") else x)
    return df.astype(object).where(df.notna(), None).sort_values(list(df.columns), key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "orders", "pages", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) or name in EMPTY
    want = duck.execute(SQL[name]).df()
    a, b = tidy(got), tidy(want)
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        for x, y in zip(a[c], b[c], strict=True):
            assert x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(float(x) - float(y)) < 2e-5 * max(1, abs(float(y)))), c


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
