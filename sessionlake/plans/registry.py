"""Registered queries and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bridge import SINCE, UNTIL, oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Views:
    """A query's views, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(sql: str | None = None, **values: object) -> Callable:
    """Registers a function of Views under its name; ``sql`` is its oracle, with SINCE, UNTIL and ``values`` filled in."""

    def register(f: Callable[[Views], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql is not None:
            text = sql
            for k, v in {"SINCE": SINCE, "UNTIL": UNTIL, **values}.items():
                text = text.replace(f"${k}", str(v))
            ORACLES[f.__name__] = oracle(text)
        return f

    return register
