"""Behaviours: what was observed, before any rule decides what it means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import commands as C
from ..operators.timing import connection_patterns
from ..schemas import Telemetry
from .environment import public_connections

# Behaviour types (fixed values).
CONTACT, RELATIONSHIP = "interpreter_external_contact", "periodic_outbound_relationship"
RECOVERY, TOOLING = "recovery_mechanism_disabled", "security_tool_configuration_modified"


def recovery_behaviours(processes: DataFrame) -> DataFrame:
    """Rows that destroy or merely enumerate recovery mechanisms."""
    line = F.col("command_line")
    return (
        processes.where(C.any_of(line, V.RECOVERY_PROCEDURES + V.RECOVERY_ENUMERATION))
        .withColumn("procedures", C.matching_names(line, V.RECOVERY_PROCEDURES))
        .withColumn("enumeration", C.matching_names(line, V.RECOVERY_ENUMERATION))
        .withColumn("descriptions", C.descriptions_of(F.col("procedures"), V.RECOVERY_PROCEDURES))
        .withColumn("is_destructive", F.size("procedures") > 0))


def security_tool_behaviours(processes: DataFrame) -> DataFrame:
    """Rows that disable, stop or reconfigure a security product."""
    line = F.col("command_line")
    return (
        processes.where(C.any_of(line, V.SECURITY_TOOL_PROCEDURES))
        .withColumn("procedures", C.matching_names(line, V.SECURITY_TOOL_PROCEDURES))
        .withColumn("descriptions", C.descriptions_of(F.col("procedures"), V.SECURITY_TOOL_PROCEDURES)))


def _row_behaviours(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select(
        F.concat(F.lit(kind + ":"), F.col("event_id")).alias("behaviour_id"), F.lit(kind).alias("type"),
        F.col("timestamp").alias("start_time"), F.col("timestamp").alias("end_time"), "device", "user",
        F.col("process_name").alias("process"), F.lit("").alias("destination"), "procedures",
        F.lit(1).cast("long").alias("events"))


def outbound_relationships(network: DataFrame) -> DataFrame:
    """One behaviour per (host, image, public address), and one more for interpreters.

    Timing stays beside it in ``connection_patterns``; it is attached whether or not it
    looks regular, so "irregular" and "not measured" stay apart.
    """
    keys = ["device", "process_name", "remote_ip"]
    seen = public_connections(network).groupBy(*keys).agg(
        F.min("event_id").alias("_id"), F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"), F.count(F.lit(1)).alias("events"),
        F.min_by("user", F.struct("timestamp", "event_id")).alias("user"))
    interpreter = F.lower("process_name").isin(*V.SCRIPT_INTERPRETERS)
    kinds = F.array_compact(F.array(F.lit(RELATIONSHIP), F.when(interpreter, F.lit(CONTACT))))
    return seen.withColumn("type", F.explode(kinds)).select(
        F.concat_ws(":", "type", "_id").alias("behaviour_id"), "type", "start_time", "end_time",
        "device", "user", F.col("process_name").alias("process"), F.col("remote_ip").alias("destination"),
        F.array().cast("array<string>").alias("procedures"), "events")


def relationship_timing(network: DataFrame) -> DataFrame:
    """Timing of every outbound relationship."""
    return connection_patterns(public_connections(network), ["device", "process_name", "remote_ip"], "timestamp")


def extract_behaviours(tel: Telemetry) -> DataFrame:
    """All behaviours of one telemetry set; order by ``start_time, type`` to read them."""
    return (
        outbound_relationships(tel.network)
        .unionByName(_row_behaviours(recovery_behaviours(tel.processes), RECOVERY))
        .unionByName(_row_behaviours(security_tool_behaviours(tel.processes), TOOLING)))
