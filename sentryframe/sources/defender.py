"""Defender advanced-hunting exports: CSV or JSON, one table per file."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import start_identity
from ..functions.time import parse_event_time
from ..schemas import Telemetry, empty_table
from ..vocab import CONTROL, LOGON, NETWORK, PROCESS
from .files import WRONG_SHAPE, Ingest, issue_rows, number_copies
from .normalise import coerce, mint_event_id, quarantine

# Export column -> canonical column (fixed values).
RENAMES = {
    PROCESS: {
        "Timestamp": "timestamp", "DeviceName": "device", "AccountName": "user", "FileName": "process_name",
        "ProcessId": "process_id", "ProcessCommandLine": "command_line", "InitiatingProcessFileName": "parent_process_name",
        "InitiatingProcessId": "parent_process_id", "FolderPath": "file_path", "SHA256": "sha256",
        "ProcessVersionInfoCompanyName": "signer",
    },
    NETWORK: {
        "Timestamp": "timestamp", "DeviceName": "device", "InitiatingProcessAccountName": "user",
        "InitiatingProcessFileName": "process_name", "InitiatingProcessId": "process_id", "RemoteIP": "remote_ip",
        "RemotePort": "remote_port", "Protocol": "protocol", "RemoteUrl": "remote_url",
    },
    LOGON: {
        "Timestamp": "timestamp", "DeviceName": "device", "AccountName": "user", "FailureReason": "failure_reason",
        "RemoteDeviceName": "source_device", "RemoteIP": "source_ip",
    },
}
REQUIRED = {
    PROCESS: ("Timestamp", "DeviceName", "FileName"),
    NETWORK: ("Timestamp", "DeviceName", "RemoteIP"),
    LOGON: ("Timestamp", "DeviceName", "AccountName", "LogonType", "ActionType"),
}
LOGON_TYPES = {
    "interactive": 2, "network": 3, "batch": 4, "service": 5, "remote interactive (rdp)": 10,
    "remoteinteractive": 10, "remote interactive": 10, "rdp": 10,
}
LOGON_ACTIONS = {"logonsuccess": "success", "logonfailed": "failure", "logonfailure": "failure"}
_OWN = ("DeviceName", "ProcessId", "ProcessCreationTime")
_INITIATING = ("DeviceName", "InitiatingProcessId", "InitiatingProcessCreationTime")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """One export file as text columns; the header (or the JSON keys) names them."""
    if path.lower().endswith(".csv"):
        return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    whole = bool(first) and first[0].value.lstrip("﻿ ").startswith("[")
    return spark.read.option("multiLine", whole).option("primitivesAsString", True).json(path)


def _lookup(text: Column, table: dict) -> Column:
    key, out = F.lower(F.trim(F.coalesce(text, F.lit("")))), F.lit(None)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def defender_rows(raw: DataFrame, event_type: str, file_name: str) -> tuple[DataFrame, dict[str, str]]:
    """Canonical rows with a ``reason``, and the columns the export does not offer."""
    have = set(raw.columns)
    text = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("")) if n in have else F.lit("")
    absent = {
        canonical: source for source, canonical in RENAMES[event_type].items()
        if source not in have and source not in REQUIRED[event_type]}

    def instance(column: str, parts: tuple[str, str, str]) -> Column:
        missing = [p for p in parts if p not in have]
        if missing:
            absent[column] = ", ".join(missing)
            return F.lit("")
        return start_identity(F.col(parts[0]), F.col(parts[1]).try_cast("long"), parse_event_time(F.col(parts[2])))

    ref = F.concat(F.lit("ReportId="), text("ReportId"), F.lit(f";File={file_name}"))
    values = {canonical: text(source) for source, canonical in RENAMES[event_type].items()}
    values |= {
        "timestamp": parse_event_time(text("Timestamp")), "event_type": F.lit(event_type),
        "source": F.lit("defender_export"), "source_ref": ref}
    reason = F.when(F.col("timestamp").isNull(), "unparseable timestamp")
    if event_type == PROCESS:
        values |= {
            "signature_status": F.lit("unknown"), "process_guid": instance("process_guid", _OWN),
            "parent_process_guid": instance("parent_process_guid", _INITIATING)}
    elif event_type == NETWORK:
        values |= {
            "direction": F.when(F.lower(text("ActionType")).contains("inbound"), "inbound").otherwise("outbound"),
            "process_guid": instance("process_guid", _INITIATING)}
    else:
        values |= {"logon_type": _lookup(text("LogonType"), LOGON_TYPES), "action": _lookup(text("ActionType"), LOGON_ACTIONS)}
        reason = reason.when(F.col("logon_type").isNull(), "unrecognised LogonType value").when(
            F.col("action").isNull(), "unrecognised ActionType value")
    # Identical export rows are told apart by a number among their equals.
    raw = number_copies(raw.withColumn("file", F.lit(file_name)), F.to_json(F.struct("*")))
    place = F.concat_ws("#", ref, F.col("record_key"), F.col("copy").cast("string"))
    rows = raw.select(mint_event_id(f"defender-{event_type}", place).alias("event_id"), *[v.alias(n) for n, v in values.items()])
    return rows.withColumn("reason", reason), absent


def read_defender_export(spark: SparkSession, files: dict[str, list[str]], load_time: datetime | str) -> Ingest:
    """``files`` lists candidate paths per table; every one whose header fits is read.

    A file name is only a hint: the header decides, and the others are refused with a reason.
    """
    tables = {CONTROL: empty_table(spark, CONTROL)}
    admissions, issues, gaps = [], [], []
    for event_type in (PROCESS, NETWORK, LOGON):
        tables[event_type] = empty_table(spark, event_type)
        for path in files.get(event_type, []):
            name = path.rsplit("/", 1)[-1]
            raw = read_export(spark, path)
            missing = [c for c in REQUIRED[event_type] if c not in raw.columns]
            verdict = raw.agg(F.count(F.lit(1)).alias("records")).select(
                F.lit(name).alias("file"), F.lit(not missing).alias("admitted"),
                F.lit(f"recognised as a Defender {event_type} export" if not missing
                      else f"{WRONG_SHAPE}: header carries no {', '.join(missing)}").alias("reason"),
                F.lit("a Defender advanced-hunting export").alias("shape"), "records")
            admissions.append(verdict)
            if missing:
                continue
            rows, absent = defender_rows(raw, event_type, name)
            issues.append(issue_rows(rows.where(F.col("reason").isNotNull()), event_type, F.col("reason"), F.col("source_ref")))
            good = quarantine(coerce(rows.where(F.col("reason").isNull()), event_type), load_time)
            issues.append(issue_rows(good.issues, event_type, F.col("reason"), F.col("source_ref")))
            tables[event_type] = tables[event_type].unionByName(good.rows)
            for canonical, source in sorted(absent.items()):
                gaps.append(good.rows.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
                    F.lit(f"{event_type}.{canonical}").alias("column"),
                    F.lit(f"export carries no {source} column").alias("reason"), "n"))

    def union(parts, schema):
        out = spark.createDataFrame([], schema)
        for p in parts:
            out = out.unionByName(p)
        return out

    return Ingest(
        Telemetry(tables[PROCESS], tables[NETWORK], tables[LOGON], tables[CONTROL]),
        union(issues, "event_type string, field string, reason string, reference string"),
        union(admissions, "file string, admitted boolean, reason string, shape string, records long"),
        gaps=union(gaps, "column string, reason string, n long"))
