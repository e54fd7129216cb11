"""Registry of named queries and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.session import prepare
from tidewatch.sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The supplied tables and the frames derived from them, for one query."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return A.read_table(self.spark, self.sf_dir, name)

    def txn(self) -> DataFrame:
        return A.events_to_txn(self.raw("events"))

    def lines(self) -> DataFrame:
        return A.lines_to_txn(self.raw("lineitem"), self.raw("orders"))

    def scores(self) -> DataFrame:
        return A.score_stream(self.lines())

    def decisions(self) -> DataFrame:
        return A.decisions(self.txn())

    def episodes(self) -> DataFrame:
        return A.episodes(self.decisions())

    def repair_log(self) -> DataFrame:
        return A.repair_log(self.txn())


def query(name: str, sql: str | None = None):
    """Register `fn(tables)` under `name`, with its SQL when SQL can say it."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(prepare(spark), sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap
