"""Typing, validation and quarantine of canonical rows."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import parse_event_time
from ..schemas import TABLE_COLUMNS, TABLE_SCHEMAS, SchemaError, Telemetry

EARLIEST = "2000-01-01 00:00:00"
AHEAD = timedelta(days=1)


def coerce(df: DataFrame, event_type: str) -> DataFrame:
    """Declared columns only: UTC instants, nullable integers, strings that are never null."""
    out = []
    for field in TABLE_SCHEMAS[event_type].fields:
        kind = field.dataType.typeName()
        if field.name not in df.columns:
            default = F.lit("") if kind == "string" else F.lit(None)
            out.append(default.cast(field.dataType).alias(field.name))
            continue
        c, have = F.col(field.name), df.schema[field.name].dataType.typeName()
        if kind == "string":
            value = F.coalesce(c.cast("string"), F.lit(""))
        elif kind == "timestamp":
            value = parse_event_time(c) if have == "string" else c.cast("timestamp")
        else:
            # "4820.0" is how a reader without nullable integers wrote 4820.
            value = F.coalesce(c.try_cast("long"), c.try_cast("double").cast("long"))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)


def validate(df: DataFrame, event_type: str) -> None:
    """Raise on missing or extra columns, foreign event types or repeated ids."""
    have, want = set(df.columns), set(TABLE_COLUMNS[event_type])
    if want - have:
        raise SchemaError(f"{event_type}: missing columns {sorted(want - have)}")
    if have - want:
        raise SchemaError(f"{event_type}: unexpected columns {sorted(have - want)}")
    foreign = df.where(F.col("event_type") != event_type).select("event_type").limit(1).collect()
    if foreign:
        raise SchemaError(f"{event_type}: foreign event_type {foreign[0].event_type!r}")
    twice = repeated_ids(df).limit(1).collect()
    if twice:
        raise SchemaError(f"{event_type}: duplicate event_id {twice[0].event_id!r}")


def repeated_ids(df: DataFrame) -> DataFrame:
    return df.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def global_id_conflicts(tel: Telemetry) -> DataFrame:
    """Event ids that occur more than once across all tables."""
    ids = reduce(DataFrame.unionByName, [
        df.select("event_id", F.lit(name).alias("table")) for name, df in tel.tables().items()])
    return ids.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("table")).alias("tables")
    ).where(F.col("n") > 1)


def assert_global_ids(tel: Telemetry) -> None:
    found = global_id_conflicts(tel).limit(1).collect()
    if found:
        raise SchemaError(f"event_id {found[0].event_id!r} occurs in {found[0].tables}")


def quarantine_reason(load_time: datetime | str) -> Column:
    """Why a row's instant is impossible, or null."""
    latest = F.lit(str(load_time)).cast("timestamp") + F.expr(f"INTERVAL {int(AHEAD.total_seconds())} SECONDS")
    return (
        F.when(F.col("timestamp").isNull(), "unparseable timestamp")
        .when(F.col("timestamp") < F.lit(EARLIEST).cast("timestamp"), "timestamp before 2000")
        .when(F.col("timestamp") > latest, "timestamp in the future"))


@dataclass(frozen=True)
class Normalised:
    """Kept rows and the issues of the refused ones."""

    rows: DataFrame
    issues: DataFrame


def quarantine(df: DataFrame, load_time: datetime | str) -> Normalised:
    """Split off rows with impossible instants; nothing is repaired, one issue per row."""
    marked = df.withColumn("_reason", quarantine_reason(load_time))
    return Normalised(
        marked.where(F.col("_reason").isNull()).drop("_reason"),
        marked.where(F.col("_reason").isNotNull()).select(
            "event_type", "source_ref", F.col("_reason").alias("reason")))


def normalise_full(df: DataFrame, event_type: str, load_time: datetime | str, check: bool = True) -> Normalised:
    """Typing, validation and quarantine as one funnel."""
    typed = coerce(df, event_type)
    if check:
        validate(typed, event_type)
    return quarantine(typed, load_time)


def time_outliers(tel: Telemetry, distance: timedelta = timedelta(days=30)) -> DataFrame:
    """Rows further than ``distance`` from their table's median instant; report only.

    The median over a whole table is taken exactly from the hour it falls in.
    """
    from ..operators.timing import exact_median

    us = int(distance.total_seconds() * 1_000_000)
    parts = []
    for name, df in tel.tables().items():
        stamped = df.where(F.col("timestamp").isNotNull()).select(
            F.lit(name).alias("table"), F.unix_micros("timestamp").alias("us"))
        middle = exact_median(stamped, ["table"], "us", "median_us")
        parts.append(stamped.join(middle, "table").groupBy("table", "median_us").agg(
            F.count_if(F.abs(F.col("us") - F.col("median_us")) > us).alias("outliers"),
            F.count(F.lit(1)).alias("rows")))
    return reduce(DataFrame.unionByName, parts)


def mint_event_id(prefix: str, source_ref: Column) -> Column:
    """A stable id from where the record came from (N26): no global order is needed."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(source_ref, 256), 1, 32))
