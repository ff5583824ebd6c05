"""Canonical tables: reading, writing, widening, merging, the unified view."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import event_summary
from ..schemas import TABLE_COLUMNS, TABLE_STEMS, UNIFIED_COLUMNS, Telemetry, empty_table
from ..vocab import CONTROL, EVENT_TYPES
from .normalise import assert_global_ids, coerce


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _parquet(spark: SparkSession, target: str) -> DataFrame | None:
    """A stored table with the columns of all its files; None if it was written without a single row."""
    try:
        return spark.read.option("mergeSchema", True).parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None


def read_canonical(spark: SparkSession, path: str, fmt: str = "csv") -> Telemetry:
    """Four typed tables from ``path``; a missing control table is empty, any other an error."""
    tables = {}
    for name in EVENT_TYPES:
        stem = f"{path}/{TABLE_STEMS[name]}"
        target = next((p for p in (f"{stem}.{fmt}", stem) if _exists(spark, p)), None)
        if target is None:
            if name != CONTROL:
                raise FileNotFoundError(f"{stem}.{fmt}")
            tables[name] = empty_table(spark, name)
            continue
        if fmt == "csv":
            # Read as text columns; coerce() owns how they become typed.
            raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(target)
        else:
            raw = _parquet(spark, target)
        tables[name] = empty_table(spark, name) if raw is None else coerce(raw, name)
    return Telemetry(*(tables[n] for n in EVENT_TYPES))


#: Rows of a stored file at most; a CSV file is one task when it is read again.
FILE_ROWS = 5_000_000


def write_canonical(tel: Telemetry, path: str, fmt: str = "parquet", file_rows: int = FILE_ROWS) -> None:
    """One folder per table, clustered by day, device and time; CSV carries UTC ISO text instants.

    Rows are dealt by ranges of (day, device, instant), so a hot day or host spreads over many
    files, a file spans few of either and its minima and maxima prune, and a day has only the files
    of the ranges that touch it.  Parquet is partitioned by ``event_date``.  No file has more than
    ``file_rows`` rows.
    """
    for name, df in tel.tables().items():
        target = f"{path}/{TABLE_STEMS[name]}"
        order = ["event_date", "device", "timestamp", "event_id"]
        placed = df.withColumn("event_date", F.to_date("timestamp")).repartitionByRange(*order).sortWithinPartitions(*order)
        if fmt == "parquet":
            placed.write.mode("overwrite").option("maxRecordsPerFile", file_rows).partitionBy("event_date").parquet(target)
        else:
            text = placed.drop("event_date").withColumn(
                "timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
            text.write.mode("overwrite").option("maxRecordsPerFile", file_rows).option("header", True).option("escape", '"').csv(target)


def read_canonical_parquet(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, devices: list[str] | None = None,
) -> tuple[Telemetry, dict[str, list[str]]]:
    """Stored Parquet widened to the current columns, and which columns were added.

    ``start`` and ``end`` (inclusive instants) and ``devices`` read a slice: other days are not
    listed, files of other hosts are skipped by their minima and maxima.  Rows without an instant
    belong to no slice in time.  Tables written without dates are read all the same.
    """
    tables, added = {}, {}
    for name in EVENT_TYPES:
        target = f"{path}/{TABLE_STEMS[name]}"
        if not _exists(spark, target):
            tables[name] = empty_table(spark, name)
            continue
        raw = _parquet(spark, target)
        if raw is None:
            tables[name] = empty_table(spark, name)
            continue
        added[name] = [c for c in TABLE_COLUMNS[name] if c not in raw.columns]
        for limit, sign in ((start, ">="), (end, "<=")):
            if limit is not None:
                instant = F.lit(limit).cast("timestamp")
                if "event_date" in raw.columns:
                    day, at = F.col("event_date"), F.to_date(instant)
                    raw = raw.where(day >= at if sign == ">=" else day <= at)
                at = F.col("timestamp")
                raw = raw.where(at >= instant if sign == ">=" else at <= instant)
        if devices is not None:
            raw = raw.where(F.col("device").isin(*devices))
        tables[name] = coerce(raw, name)
    return Telemetry(*(tables[n] for n in EVENT_TYPES)), {k: v for k, v in added.items() if v}


def merge_telemetry(parts: list[Telemetry], check: bool = True) -> Telemetry:
    """Concatenate sets; an event id may then occur once across all tables."""
    merged = Telemetry(*(
        reduce(DataFrame.unionByName, [p.table(n) for p in parts]) for n in EVENT_TYPES))
    if check:
        assert_global_ids(merged)
    return merged


def unified(tel: Telemetry) -> DataFrame:
    """All tables as core columns plus a one-line summary; sort by ``timestamp`` to read it."""
    return reduce(DataFrame.unionByName, [
        df.withColumn("summary", event_summary(name)).select(*UNIFIED_COLUMNS)
        for name, df in tel.tables().items()])


def without(tel: Telemetry, ids: DataFrame) -> Telemetry:
    """The telemetry minus the rows whose ``event_id`` is listed."""
    return tel.map(lambda _, df: df.join(ids.select("event_id"), "event_id", "left_anti").select(*df.columns))
