"""Control-plane behaviour statistics (A19-A25, A44): windows per actor, their distribution, costs of thresholds."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.control import with_control_classes
from ..functions.identity import identity_scheme
from ..operators.sliding import trailing_measure

WINDOWS = (timedelta(minutes=10), timedelta(minutes=60))
# Statistic -> candidate thresholds (fixed values).
THRESHOLDS = {
    "read_services": (5, 10, 20),
    "denied_calls": (10, 25, 50, 100),
    "failed_identity_authority_changes": (3, 5, 10),
    "identity_delete_revoke_changes": (1, 3, 5),
}


def _statistics():
    """Statistic -> (row condition, the column counted distinct, or none to count rows)."""
    read = F.col("verb_class") == "read"
    denied = F.col("decision") == V.DENIED
    return {
        "read_services": (read, "service"),
        "read_resource_types": (read, "resource_type"),
        "denied_calls": (denied, None),
        "denied_resource_types": (denied, "resource_type"),
        "failed_identity_authority_changes": (F.col("changes_authority") & (F.col("decision") == V.FAILED), None),
        "identity_delete_revoke_changes": (F.col("changes_authority") & F.col("verb_class").isin("delete", "revoke"), None),
    }


def _classified(controls: DataFrame) -> DataFrame:
    return with_control_classes(controls.withColumn("actor", F.coalesce("actor", F.lit(""))))


def window_values(controls: DataFrame, windows=WINDOWS) -> DataFrame:
    """``minutes, statistic, actor, timestamp, value``: the window ending at each qualifying row."""
    rows, parts = _classified(controls), []
    for kind in (True, False):  # statistics of distinct values, and of rows
        chosen = {n: x for n, x in _statistics().items() if bool(x[1]) == kind}
        marks = F.array_compact(F.array(*[
            F.when(where, F.struct(F.lit(n).alias("statistic"), (F.col(counted) if counted else F.lit("")).alias("counted")))
            for n, (where, counted) in chosen.items()]))
        marked = rows.select("actor", "timestamp", F.inline(marks))
        for window in windows:
            measured = trailing_measure(
                marked, ["statistic", "actor"], "timestamp", window, "counted" if kind else None, out="value")
            parts.append(measured.select(
                F.lit(int(window.total_seconds() // 60)).alias("minutes"), "statistic", "actor", "timestamp", "value"))
    return reduce(DataFrame.unionByName, parts)


def actor_statistics(controls: DataFrame, windows=WINDOWS) -> DataFrame:
    """``actor, minutes, statistic, best, total``: window maxima per actor, zero where none."""
    rows = _classified(controls)
    best = window_values(controls, windows).groupBy("actor", "minutes", "statistic").agg(F.max("value").alias("best"))
    totals = rows.groupBy("actor").agg(*[
        (F.countDistinct(F.when(where, F.col(counted))) if counted else F.count_if(where)).alias(name)
        for name, (where, counted) in _statistics().items()])
    cells = F.explode(F.array(*[
        F.struct(F.lit(int(w.total_seconds() // 60)).alias("minutes"), F.lit(n).alias("statistic"), F.col(n).alias("total"))
        for w in windows for n in _statistics()]))
    every = totals.select("actor", cells.alias("c")).select("actor", "c.*")
    return every.join(best, ["actor", "minutes", "statistic"], "left").fillna(0, ["best"])


def actor_profile(controls: DataFrame) -> DataFrame:
    """Rows, span, active days and decisions per actor."""
    decided = lambda d: F.count_if(F.col("decision") == d).alias(d)
    # Per day first, so the distinct days of a busy actor are counted on few rows.
    daily = controls.groupBy(F.coalesce("actor", F.lit("")).alias("actor"), F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"),
        decided(V.ALLOWED), decided(V.DENIED), decided(V.FAILED))
    return daily.groupBy("actor").agg(
        F.sum("n").alias("rows"), F.min("lo").alias("first"), F.max("hi").alias("last"), F.count("day").alias("days_active"),
        *[F.sum(d).alias(d) for d in (V.ALLOWED, V.DENIED, V.FAILED)])


def distributions(actors: DataFrame) -> DataFrame:
    """p50, p90, p99 and maximum over actors, linear interpolation."""
    return actors.groupBy("minutes", "statistic").agg(
        F.count(F.lit(1)).alias("actors"), *[F.percentile("best", p).alias(f"p{int(p * 100)}") for p in (0.5, 0.9, 0.99)],
        F.max("best").cast("double").alias("max"))


def threshold_grid(controls: DataFrame, windows=WINDOWS, thresholds=THRESHOLDS) -> DataFrame:
    """``minutes, statistic, threshold, actors, actor_days`` of every candidate."""
    daily = window_values(controls, windows).groupBy("minutes", "statistic", "actor", F.to_date("timestamp").alias("day")).agg(
        F.max("value").alias("value"))
    candidates = F.create_map(*[
        x for name, values in thresholds.items() for x in (F.lit(name), F.array(*[F.lit(v) for v in values]))])
    reached = daily.where(F.col("statistic").isin(*thresholds)).withColumn(
        "threshold", F.explode(F.filter(candidates[F.col("statistic")], lambda t: F.col("value") >= t)))
    counted = reached.groupBy("minutes", "statistic", "threshold").agg(
        F.countDistinct("actor").alias("actors"), F.count(F.lit(1)).alias("actor_days"))
    every = controls.sparkSession.createDataFrame(
        [(int(w.total_seconds() // 60), n, t) for w in windows for n, ts in thresholds.items() for t in ts],
        "minutes int, statistic string, threshold int")
    return every.join(counted, ["minutes", "statistic", "threshold"], "left").fillna(0, ["actors", "actor_days"])


def top_actors(actors: DataFrame, top: int = 10) -> DataFrame:
    """The highest actors per statistic, ties by name."""
    rank = F.row_number().over(Window.partitionBy("minutes", "statistic").orderBy(F.col("best").desc(), "actor"))
    return actors.withColumn("rank", rank).where(F.col("rank") <= top)


def control_shape(controls: DataFrame, top: int = 25) -> DataFrame:
    """``measure, value, n``: decisions, verb classes, top verbs and resource types, fill."""
    rows = _classified(controls)
    count = lambda name, c: rows.groupBy(F.lit(name).alias("measure"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    best = lambda name, c: count(name, c).orderBy(F.col("n").desc(), "value").limit(top)
    columns = ("target_actor", "role_ref", "resource_name", "actor_groups", "source_ip")
    fill = rows.agg(*[F.count_if(F.col(c) != "").alias(c) for c in columns])
    filled = fill.select(F.explode(F.array(*[F.struct(F.lit(c).alias("value"), F.col(c).alias("n")) for c in columns])).alias("c")).select(
        F.lit("filled").alias("measure"), "c.value", "c.n")
    return reduce(DataFrame.unionByName, [
        count("decision", "decision"), count("verb_class", "verb_class"), best("verb", "verb"),
        best("resource_type", "resource_type"), filled])


def identity_population(rows: DataFrame, column: str = "process_guid") -> DataFrame:
    """``source, scheme, rows``: how a table names process instances."""
    return rows.groupBy("source", identity_scheme(F.col(column)).alias("scheme")).agg(F.count(F.lit(1)).alias("rows"))


def findings_per_actor(findings: DataFrame) -> DataFrame:
    """``rule_id, actor, findings, days``."""
    actor = F.coalesce(F.nullif(F.col("actor"), F.lit("")), F.col("user"))
    return findings.groupBy("rule_id", actor.alias("actor")).agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct(F.to_date("first_seen")).alias("days"))
