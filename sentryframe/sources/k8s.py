"""Kubernetes audit logs: RBAC binding creations and pod execs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.control import classify_decision
from ..functions.time import parse_event_time
from ..schemas import Telemetry, empty_table
from ..vocab import CONTROL, FAILED, LOGON, NETWORK, PROCESS, RBAC_BINDING_RESOURCES
from .files import Ingest, admit, documents, issue_rows, keep_admitted, number_copies, read_lines, with_parsed
from .normalise import coerce, mint_event_id, quarantine

FINAL_STAGE = "ResponseComplete"
EXEC_VERBS = ("create", "connect", "get")
API_GROUP = "audit.k8s.io/"
EVENT = (
    "kind STRING, apiVersion STRING, auditID STRING, stage STRING, verb STRING, "
    "user STRUCT<username: STRING, groups: ARRAY<STRING>>, sourceIPs ARRAY<STRING>, "
    "objectRef STRUCT<resource: STRING, subresource: STRING, namespace: STRING, name: STRING>, "
    "requestObject STRUCT<subjects: ARRAY<STRUCT<kind: STRING, name: STRING, namespace: STRING>>, "
    "roleRef: STRUCT<name: STRING>>, responseStatus STRUCT<code: STRING>, "
    "stageTimestamp STRING, requestReceivedTimestamp STRING"
)


def raw_events(lines: DataFrame) -> DataFrame:
    """``file, shape, record``; text that does not parse keeps a null shape.

    What parses to an object with an ``items`` array is a list of events; anything else that
    parses is one event; each line that does not is one issue.
    """
    listed = F.when(F.try_variant_get("value", "$.kind", "string").endswith("List") | F.try_variant_get("value", "$.auditID", "string").isNull(),
                    F.try_variant_get("value", "$.items", "array<variant>"))
    units = documents(lines, "items").select("file", "line", "value", F.inline(F.array(F.struct(listed.alias("_items")))))
    is_list = F.col("_items").isNotNull()
    shape = F.when(is_list, "a top-level 'items' array").when(F.col("value").isNotNull(), "one JSON Event per line")
    records = F.when(is_list, F.transform("_items", lambda i: F.to_json(i))).otherwise(F.array("line"))
    return units.select("file", shape.alias("shape"), F.explode(records).alias("record"))


def parse_events(raw: DataFrame) -> DataFrame:
    return with_parsed(raw, "record", EVENT)


def looks_like_audit() -> Column:
    return (F.col("kind") == "Event") & F.startswith(F.coalesce("apiVersion", F.lit("")), F.lit(API_GROUP))


def rbac_subjects(subjects: Column, binding_namespace: Column) -> Column:
    """Subjects sorted and comma-joined; service accounts get their full name."""
    def name(s):
        space = F.coalesce(F.nullif(s["namespace"], F.lit("")), F.nullif(binding_namespace, F.lit("")))
        account = (s["kind"] == "ServiceAccount") & ~F.startswith(s["name"], F.lit("system:serviceaccount:"))
        return F.when(F.coalesce(account, F.lit(False)) & space.isNotNull(),
                      F.concat(F.lit("system:serviceaccount:"), space, F.lit(":"), s["name"])).otherwise(s["name"])

    named = F.filter(F.coalesce(subjects, F.array()), lambda s: F.coalesce(s["name"], F.lit("")) != "")
    return F.array_join(F.array_sort(F.transform(named, name)), ",")


def k8s_controls(events: DataFrame, cluster: str) -> DataFrame:
    """Final-stage RBAC grants and pod execs as control rows; others carry a ``reason``."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    resource, sub, verb = text("objectRef.resource"), text("objectRef.subresource"), text("verb")
    grant = resource.isin(*RBAC_BINDING_RESOURCES) & (sub == "") & (verb == "create")
    shell = (resource == "pods") & (sub == "exec") & verb.isin(*EXEC_VERBS)
    code = F.col("responseStatus.code").try_cast("int")
    target = F.when(grant, rbac_subjects(F.col("requestObject.subjects"), text("objectRef.namespace"))).otherwise("")
    final = events.where(F.col("stage").isNull() | (F.col("stage") == FINAL_STAGE))
    reference = F.concat(F.lit("auditID="), F.coalesce("auditID", F.lit("?")), F.lit(";File="), F.col("file"))
    place = F.concat_ws("#", reference, F.col("record_key"), F.col("copy").cast("string"))
    rows = final.select(
        mint_event_id("k8s-control", place).alias("event_id"),
        parse_event_time(F.coalesce(F.nullif(F.col("stageTimestamp"), F.lit("")), F.col("requestReceivedTimestamp"))).alias("timestamp"),
        F.lit(CONTROL).alias("event_type"), F.lit(f"k8s:{cluster}").alias("device"),
        F.lit("k8s_audit").alias("source"), reference.alias("source_ref"), text("user.username").alias("actor"),
        F.array_join(F.filter(F.coalesce("user.groups", F.array().cast("array<string>")), lambda g: g != ""), ",").alias("actor_groups"),
        F.when(shell, "exec").otherwise(verb).alias("verb"),
        F.when(shell, "pods/exec").otherwise(resource).alias("resource_type"),
        text("objectRef.name").alias("resource_name"), text("objectRef.namespace").alias("resource_namespace"),
        target.alias("target_actor"), F.when(grant, text("requestObject.roleRef.name")).otherwise("").alias("role_ref"),
        F.when(code.isNull(), FAILED).otherwise(classify_decision(F.lit(""), code)).alias("decision"),
        F.coalesce(F.get("sourceIPs", F.lit(0)), F.lit("")).alias("source_ip"), (grant | shell).alias("_mapped"))
    rows = rows.withColumn("user", F.coalesce(F.nullif(F.col("target_actor"), F.lit("")), F.col("actor")))
    return rows.withColumn(
        "reason",
        F.when(~F.col("_mapped"), F.concat(F.col("verb"), F.lit(" on "), F.col("resource_type"), F.lit(" is not mapped")))
        .when(F.col("timestamp").isNull(), "unparseable timestamp").when(F.col("actor") == "", "no usable principal name"))


def read_k8s_audit(spark: SparkSession, path: str, load_time: datetime | str, cluster: str = "default") -> Ingest:
    """``*.json``, ``*.jsonl`` and ``*.log`` under ``path``."""
    return ingest_k8s(read_lines(spark, path, "*.{json,jsonl,log}"), load_time, cluster)


def staged_events(lines: DataFrame) -> DataFrame:
    """Typed events, written once, with what makes each of them itself."""
    return number_copies(parse_events(raw_events(lines)), F.col("record"))


def ingest_k8s(lines: DataFrame, load_time: datetime | str, cluster: str = "default") -> Ingest:
    spark, events = lines.sparkSession, staged_events(lines)
    admissions = admit(events, looks_like_audit(), F.col("shape"), "Kubernetes audit")
    kept = keep_admitted(events, admissions)
    bad = issue_rows(kept.where(F.col("shape").isNull()), CONTROL, F.lit("line is not valid JSON"), F.col("file"))
    rows = k8s_controls(kept.where(F.col("shape").isNotNull()), cluster)
    refused = issue_rows(rows.where(F.col("reason").isNotNull()), CONTROL, F.col("reason"), F.col("source_ref"), "objectRef")
    good = quarantine(coerce(rows.where(F.col("reason").isNull()), CONTROL), load_time)
    late = issue_rows(good.issues, CONTROL, F.col("reason"), F.col("source_ref"))
    tables = Telemetry(empty_table(spark, PROCESS), empty_table(spark, NETWORK), empty_table(spark, LOGON), good.rows)
    return Ingest(tables, bad.unionByName(refused).unionByName(late), admissions)
