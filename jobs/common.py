"""What the jobs share: their command line, their config and their log."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def config_of(name: str, path: str | None = None) -> dict:
    """The job's config file, which lies beside its code, and over it the entries of another one. Unknown entries raise."""
    own = json.loads(Path(__file__).with_name(f"{name}.json").read_text())
    given = json.loads(Path(path).read_text()) if path else {}
    if odd := set(given) - set(own):
        raise ValueError(f"unknown entries in {path}: {', '.join(sorted(odd))}")
    return own | given


class Counted:
    """Counts the rows of tables as they are read or written, without a pass of its own."""

    def __init__(self) -> None:
        self.seen: dict[str, Observation] = {}

    def __call__(self, what: str, df: DataFrame) -> DataFrame:
        self.seen[what] = Observation()
        return df.observe(self.seen[what], F.count(F.lit(1)).alias("rows"))

    def told(self, **more) -> dict:
        """The counts of tables that an action has gone through; logs them."""
        counts = {what: _rows(o) for what, o in self.seen.items()} | more
        for what, n in counts.items():
            log.info("%s: %s", what, n)
        return counts


def _rows(seen: Observation) -> int:
    """Where Spark finds at run time that a table is empty, it drops the count with the table, and there is no row of it."""
    try:
        return seen.get["rows"]
    except Py4JJavaError:
        return 0


def main(name: str, paths: dict[str, str], run: Callable[..., dict], argv: list[str] | None = None) -> None:
    """Runs a job from the command line in a session of its own. ``paths``: names of path arguments and what they are."""
    parser = argparse.ArgumentParser(prog=f"jobs/{name}.py", description=run.__doc__)
    parser.add_argument("--config", help="JSON file with entries that replace those of the job's own config file")
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = config_of(name, given.pop("config"))
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **given, config=config)
    finally:
        spark.stop()
