"""The query catalogue: a Spark callable per operator and, where SQL can say it, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register the decorated callable, with the oracle SQL when there is one."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def us(name: str, alias: str | None = None):
    """An instant as integer microseconds, so both engines compare the same number."""
    return F.unix_micros(name).alias(alias or name)


def joined(name: str, alias: str | None = None):
    """An array as one comma-joined string, in its own order."""
    return F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(alias or name)
