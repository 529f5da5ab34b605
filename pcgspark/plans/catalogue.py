"""Where queries over the event table and their DuckDB counterparts are registered. Doubles are rounded to six places in both.

Many exact results end in a 5 at the seventh place, which the engines round either way; a nudge of ``NUDGE`` before
rounding decides these alike.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pcgspark.plans.adapter import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
NUDGE = "1.23e-9"


def query(sql: str | None = None, recursive: bool = False):
    """Registers a query under its function's name, with the SQL that follows the common tables."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = SQL + re.sub(rf"(?<!{NUDGE}), 6\)", f" + {NUDGE}, 6)", sql)
            ORACLE[f.__name__] = text.replace("with ", "with recursive ", 1) if recursive else text
        return f

    return add


def r(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + float(NUDGE), 6)


def out(df: DataFrame, *keep: str, **rounded: Column | str) -> DataFrame:
    return df.select(*keep, *[r(c).alias(k) for k, c in rounded.items()])
