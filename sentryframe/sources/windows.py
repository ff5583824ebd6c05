"""Windows event exports: Winlogbeat ECS and flat Elastic documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import start_identity, sysmon_identity
from ..functions.time import parse_event_time
from ..schemas import Telemetry, empty_table
from ..vocab import CONTROL, LOGON, NETWORK, PROCESS
from .files import (
    Ingest, admit, issue_rows, keep_admitted, number_copies, read_deflated_lines, read_lines, settle, with_parsed,
)
from .normalise import coerce, mint_event_id, quarantine

SYSMON_CHANNEL, SECURITY_CHANNEL = "Microsoft-Windows-Sysmon/Operational", "Security"
# NTSTATUS -> failure reason (fixed values).
FAILURE_REASONS = {
    "0xc000006a": "bad_password", "0xc0000064": "unknown_user", "0xc0000234": "account_locked",
    "0xc0000072": "account_disabled", "0xc000006f": "outside_logon_hours",
    "0xc0000070": "workstation_restriction", "0xc0000193": "account_expired",
    "0xc0000071": "password_expired", "0xc000015b": "logon_type_not_granted",
}


def _first(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def _no_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(F.nullif(c, F.lit("-")), F.lit("")), F.lit(""))


def _basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(F.coalesce(path, F.lit("")), "/", "\\"), r"\\"), -1)


def _failure(code: Column) -> Column:
    out = code
    for status, reason in FAILURE_REASONS.items():
        out = F.when(code == status, reason).otherwise(out)
    return out


def _assemble(spark, lines_bad, parsed, rows, admissions, unmapped, load_time) -> Ingest:
    """Split typed rows by reason, quarantine each table, collect the issues."""
    tables, issues = {}, lines_bad
    for name, df in rows.items():
        refused = issue_rows(df.where(F.col("reason").isNotNull()), name, F.col("reason"), F.col("source_ref"))
        good = quarantine(coerce(df.where(F.col("reason").isNull()), name), load_time)
        tables[name] = good.rows
        issues = issues.unionByName(refused).unionByName(
            issue_rows(good.issues, name, F.col("reason"), F.col("source_ref")))
    telemetry = Telemetry(tables[PROCESS], tables[NETWORK], tables[LOGON], empty_table(spark, CONTROL))
    return Ingest(telemetry, issues, admissions, unmapped=unmapped)


# ---------------------------------------------------------------- Winlogbeat

ECS = (
    "`@timestamp` STRING, host STRUCT<name: STRING>, agent STRUCT<hostname: STRING>, user STRUCT<name: STRING>, "
    "event STRUCT<code: STRING>, hash STRUCT<sha256: STRING>, "
    "process STRUCT<name: STRING, pid: STRING, executable: STRING, command_line: STRING, entity_id: STRING, "
    "hash: STRUCT<sha256: STRING>, parent: STRUCT<name: STRING, pid: STRING, entity_id: STRING>>, "
    "destination STRUCT<ip: STRING, port: STRING>, network STRUCT<direction: STRING, transport: STRING>, "
    "winlog STRUCT<channel: STRING, event_id: STRING, record_id: STRING, computer_name: STRING, event_data: MAP<STRING, STRING>>"
)


def parse_ecs(lines: DataFrame) -> DataFrame:
    return with_parsed(lines, "line", ECS).select(
        "*", F.col("`@timestamp`").alias("stamp_text"), _first(F.col("winlog.channel")).alias("channel"),
        F.coalesce("winlog.event_id", "event.code").try_cast("int").alias("code"))


def looks_like_ecs() -> Column:
    return (F.col("winlog").isNotNull() | F.col("event.code").isNotNull()) & (
        F.coalesce("stamp_text", F.lit("")) != "")


def winlogbeat_rows(parsed: DataFrame) -> dict[str, DataFrame]:
    """Sysmon 1 and 3 and Security 4624 and 4625 as canonical rows with a ``reason``."""
    data = lambda key: F.col("winlog.event_data")[key]
    short = lambda c: F.substring_index(c, ".", 1)
    host = short(_first(F.col("host.name"), F.col("agent.hostname"), F.col("winlog.computer_name")))
    ref = F.concat(
        F.lit("host="), _first(F.col("host.name")), F.lit(";channel="), F.col("channel"), F.lit(";record_id="),
        _first(F.col("winlog.record_id")), F.lit(";File="), F.col("file"))
    stamp = parse_event_time(F.col("stamp_text"))

    def rows(where, name, user, **columns):
        place = F.concat_ws("#", ref, F.col("record_key"), F.col("copy").cast("string"))
        core = {
            "event_id": mint_event_id(f"wlb-{name}", place), "timestamp": stamp, "event_type": F.lit(name),
            "device": host, "user": user, "source": F.lit("winlogbeat"), "source_ref": ref}
        return settle(parsed.where(where), {**core, **columns})

    sysmon = F.col("channel") == SYSMON_CHANNEL
    image = _first(F.col("process.name"), _basename(F.col("process.executable")))
    pid = F.col("process.pid").try_cast("long")
    own = sysmon_identity(_first(F.col("process.entity_id"), data("ProcessGuid")))
    process = rows(
        sysmon & (F.col("code") == 1), PROCESS, _first(F.col("user.name")), process_name=image, process_id=pid,
        command_line=_first(F.col("process.command_line")), parent_process_name=_first(F.col("process.parent.name")),
        parent_process_id=F.col("process.parent.pid").try_cast("long"), file_path=_first(F.col("process.executable")),
        sha256=F.lower(_first(F.col("process.hash.sha256"), F.col("hash.sha256"))), signer=_no_dash(data("Company")),
        signature_status=F.lit("unknown"),
        process_guid=F.when(own != "", own).otherwise(start_identity(host, pid, stamp)),
        parent_process_guid=sysmon_identity(_first(F.col("process.parent.entity_id"), data("ParentProcessGuid"))))
    direction = F.lower(_first(F.col("network.direction")))
    initiated = F.lower(_first(data("Initiated")))
    network = rows(
        sysmon & (F.col("code") == 3), NETWORK, _first(F.col("user.name")), process_name=_first(F.col("process.name")),
        process_id=pid, process_guid=own, remote_ip=_first(F.col("destination.ip"), data("DestinationIp")),
        remote_port=_first(F.col("destination.port"), data("DestinationPort")).try_cast("long"),
        protocol=F.lower(_first(F.col("network.transport"), data("Protocol"))),
        direction=F.when(direction.isin("outbound", "inbound"), direction).when(initiated == "true", "outbound")
        .when(initiated == "false", "inbound").otherwise(""), remote_url=F.lit(""))
    code = F.lower(_first(_no_dash(data("SubStatus")), _no_dash(data("Status"))))
    success = F.col("code") == 4624
    logon = rows(
        (F.col("channel") == SECURITY_CHANNEL) & F.col("code").isin(4624, 4625), LOGON, _no_dash(data("TargetUserName")),
        logon_type=data("LogonType").try_cast("long"), source_ip=_no_dash(data("IpAddress")),
        source_device=_no_dash(data("WorkstationName")), action=F.when(success, "success").otherwise("failure"),
        failure_reason=F.when(success, "").otherwise(_failure(code)))
    bad_time = F.when(F.col("timestamp").isNull(), "unparseable timestamp")
    return {
        PROCESS: process.withColumn("reason", bad_time.when(F.col("process_name") == "", "image missing")),
        NETWORK: network.withColumn("reason", bad_time.when(F.col("remote_ip") == "", "destination missing")),
        LOGON: logon.withColumn("reason", bad_time.when(F.col("user") == "", "account missing")),
    }


def ingest_winlogbeat(lines: DataFrame, load_time: datetime | str) -> Ingest:
    parsed = number_copies(parse_ecs(lines), F.col("line"))
    admissions = admit(parsed, looks_like_ecs(), F.col("shape"), "Winlogbeat ECS Windows events")
    kept = keep_admitted(parsed, admissions)
    bad = issue_rows(kept.where(F.col("shape").isNull()), PROCESS, F.lit("line is not valid JSON"), F.col("file"))
    good = kept.where(F.col("shape").isNotNull())
    routed = ((F.col("channel") == SYSMON_CHANNEL) & F.col("code").isin(1, 3)) | (
        (F.col("channel") == SECURITY_CHANNEL) & F.col("code").isin(4624, 4625))
    label = F.concat(
        F.when(F.col("channel") == "", "<no channel>").otherwise(F.col("channel")), F.lit(":"),
        F.coalesce(F.col("code").cast("string"), F.lit("?")))
    unmapped = good.where(~F.coalesce(routed, F.lit(False))).groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return _assemble(lines.sparkSession, bad, parsed, winlogbeat_rows(good), admissions, unmapped, load_time)


def read_winlogbeat(spark: SparkSession, path: str, load_time: datetime | str, deflated: bool = False) -> Ingest:
    """ECS records one per line, plain or bz2; ``deflated`` for bz2 wrapped in raw deflate."""
    glob = "*.{jsonl,json,ndjson,jsonl.bz2,json.bz2,ndjson.bz2}"
    lines = read_deflated_lines(spark, path) if deflated else read_lines(spark, path, glob)
    return ingest_winlogbeat(lines, load_time)


# ---------------------------------------------------------------- Elastic

_FLAT = (
    "event_id", "event_original_time", "@timestamp", "event_recorded_time", "host_name", "user_name", "user_account",
    "TargetUserName", "SubjectUserName", "process_name", "process_path", "process_id", "CommandLine", "process_parent_name",
    "process_parent_id", "hash_sha256", "Company", "process_guid", "process_parent_guid", "dst_ip_addr", "dst_port",
    "network_initiated", "network_protocol", "logon_type", "IpAddress", "src_ip_addr", "WorkstationName", "SubStatus",
    "Status", "_channel", "_doc_id",
)
ROUTING = {("sysmon", "1"): PROCESS, ("sysmon", "3"): NETWORK, ("security", "4624"): LOGON, ("security", "4625"): LOGON}


def parse_elastic(lines: DataFrame) -> DataFrame:
    """One flat record per line; ``_source`` is unwrapped, the channel comes from ``_index``."""
    inner = ", ".join(f"`{f}`: STRING" for f in _FLAT)
    outer = ", ".join(f"`{f}` STRING" for f in _FLAT)
    parsed = with_parsed(lines, "line", f"_index STRING, _id STRING, _source STRUCT<{inner}>, {outer}")
    wrapped = F.col("_source").isNotNull()
    plain = lambda c: F.coalesce(F.when(F.trim(c).isin("-", "null"), "").otherwise(F.trim(c)), F.lit(""))
    fields = {f: plain(F.when(wrapped, F.col(f"_source.`{f}`")).otherwise(F.col(f"`{f}`"))) for f in _FLAT}
    index = F.regexp_extract(F.coalesce("_index", F.lit("")), r"^(?:.*winevent-)?(.*?)(?:-[^-]*)?$", 1)
    fields["_channel"] = F.when(wrapped & (fields["_channel"] == ""), index).otherwise(fields["_channel"])
    fields["_doc_id"] = F.when(wrapped & (fields["_doc_id"] == ""), F.coalesce("_id", F.lit(""))).otherwise(fields["_doc_id"])
    return parsed.select(
        "file", "block", "seq", "line", "shape",
        *[c.alias(f.replace("@", "at_")) for f, c in fields.items()]).withColumn("_channel", F.lower("_channel"))


def looks_like_elastic() -> Column:
    return (F.col("event_id") != "") & (
        F.concat("_channel", "event_original_time", "at_timestamp", "event_recorded_time") != "")


def elastic_rows(parsed: DataFrame) -> dict[str, DataFrame]:
    """The same routing on flat keys, hosts, accounts and images lower-cased."""
    c = F.col
    tail = lambda x: F.lower(F.element_at(F.split(x, r"\\"), -1))
    short = lambda x: F.lower(F.substring_index(x, ".", 1))
    stamp = F.coalesce(*[parse_event_time(F.nullif(c(n), F.lit(""))) for n in ("event_original_time", "at_timestamp", "event_recorded_time")])
    account = tail(_first(c("user_name"), c("user_account"), c("TargetUserName"), c("SubjectUserName")))
    ref = F.concat(c("file"), F.lit(":"), F.when(c("_doc_id") != "", c("_doc_id")).otherwise(F.col("record_key")))
    device = short(c("host_name"))

    def rows(name, user, **columns):
        keys = [k for k, v in ROUTING.items() if v == name]
        where = F.lit(False)
        for channel, code in keys:
            where = where | ((c("_channel") == channel) & (c("event_id") == code))
        core = {
            "event_id": ref, "timestamp": stamp, "event_type": F.lit(name), "device": device, "user": user,
            "source": F.lit("elastic_winevent"), "source_ref": ref}
        return settle(parsed.where(where), {**core, **columns})

    pid = c("process_id").try_cast("long")
    own = sysmon_identity(c("process_guid"))
    process = rows(
        PROCESS, account, process_name=_first(F.lower("process_name"), F.lower(_basename(c("process_path")))), process_id=pid,
        command_line=c("CommandLine"), parent_process_name=F.lower("process_parent_name"),
        parent_process_id=c("process_parent_id").try_cast("long"), file_path=c("process_path"), sha256=F.lower("hash_sha256"),
        signer=c("Company"), signature_status=F.lit("unknown"),
        process_guid=F.when(own != "", own).otherwise(start_identity(device, pid, stamp)),
        parent_process_guid=sysmon_identity(c("process_parent_guid")))
    initiated = F.lower("network_initiated")
    network = rows(
        NETWORK, account, process_name=F.lower("process_name"), process_id=pid, process_guid=own, remote_ip=c("dst_ip_addr"),
        remote_port=c("dst_port").try_cast("long"), protocol=F.lower("network_protocol"),
        direction=F.when(initiated == "true", "outbound").when(initiated == "false", "inbound").otherwise(""), remote_url=F.lit(""))
    sub = F.lower(_first(c("SubStatus"), c("Status")))
    status = F.when(sub.isin("0x0", ""), F.lower("Status")).otherwise(sub)
    success = c("event_id") == "4624"
    logon = rows(
        LOGON, tail(c("TargetUserName")), logon_type=c("logon_type").try_cast("long"), source_ip=_first(c("IpAddress"), c("src_ip_addr")),
        source_device=short(c("WorkstationName")), action=F.when(success, "success").otherwise("failure"),
        failure_reason=F.when(success, "").otherwise(_failure(status)))
    bad = F.when(c("timestamp").isNull(), "no readable time").when(c("device") == "", "host missing")
    return {
        PROCESS: process.withColumn("reason", bad.when(c("process_name") == "", "image missing")),
        NETWORK: network.withColumn("reason", bad.when(c("remote_ip") == "", "destination missing")),
        LOGON: logon.withColumn("reason", bad.when(c("user") == "", "account missing")),
    }


def ingest_elastic(lines: DataFrame, load_time: datetime | str) -> Ingest:
    parsed = number_copies(parse_elastic(lines), F.col("line"))
    admissions = admit(parsed, looks_like_elastic(), F.col("shape"), "Elastic-exported Windows events")
    kept = keep_admitted(parsed, admissions)
    bad = issue_rows(kept.where(F.col("shape").isNull()), PROCESS, F.lit("line is not valid JSON"), F.col("file"))
    good = kept.where(F.col("shape").isNotNull())
    routed = F.lit(False)
    for channel, code in ROUTING:
        routed = routed | ((F.col("_channel") == channel) & (F.col("event_id") == code))
    unmapped = good.where(~routed).groupBy(F.concat_ws("/", "_channel", "event_id").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return _assemble(lines.sparkSession, bad, parsed, elastic_rows(good), admissions, unmapped, load_time)


def read_elastic_winevent(spark: SparkSession, path: str, load_time: datetime | str) -> Ingest:
    return ingest_elastic(read_lines(spark, path, "*.{jsonl,json}"), load_time)
