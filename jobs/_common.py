"""What the jobs share: columns by expressions, logs and the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def columns(rows: DataFrame, named: dict[str, str]) -> DataFrame:
    """The columns that the configuration makes of a table's own, each a SQL expression."""
    return rows.select(*(F.expr(e).alias(c) for c, e in named.items()))


def command(name: str, about: str, paths: dict[str, str], run: Callable[..., Any], config: str, arguments: list[str] | None = None) -> Any:
    """Parse plain paths and a configuration file, make a session, run, stop it."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=about)
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    parser.add_argument("--config", default=config, help="JSON file")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    with open(given.config) as f:
        settings = json.load(f)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, **{p: getattr(given, p) for p in paths}, config=settings)
    finally:
        spark.stop()
