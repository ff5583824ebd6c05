"""Queries over vendor records.  The records are built from ``events``, one per row, as text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import cloudtrail as N
from ..functions import control, identity
from ..functions import time as tm
from ..operators.lineage_cut import shared_folder
from ..plans import evaluate
from ..sources import canonical, cloudtrail, defender, files, k8s, normalise, windows
from . import projection as P
from .registry import query, us

LOAD = "2024-01-20 00:00:00"
LOAD_US = 1705708800000000
_EV = P.with_tables().rstrip(",\n")
# API names by k % 12: (service, name, verb, family).
_CALLS = [
    ("iam.amazonaws.com", "AttachUserPolicy", "attach", "user-policy"),
    ("iam.amazonaws.com", "CreateAccessKey", "create", "access-key"),
    ("ec2.amazonaws.com", "DescribeInstances", "describe", "instance"),
    ("s3.amazonaws.com", "ListBuckets", "list", "bucket"),
    ("lambda.amazonaws.com", "GetFunction20150331v2", "get", "function"),
    ("rds.amazonaws.com", "DescribeDBClusters", "describe", "db-cluster"),
    ("ec2.amazonaws.com", "DeleteFlowLogs", "delete", "flow-log"),
    ("kms.amazonaws.com", "ListAliases", "list", "alias"),
    ("iam.amazonaws.com", "DetachRolePolicy", "detach", "role-policy"),
    ("dynamodb.amazonaws.com", "Scan", "scan", ""),
    ("ec2.amazonaws.com", "DescribeVpcEndpointServices", "describe", "vpc-endpoint-service"),
    ("", "listThings", "listthings", ""),
]
_ERRORS = ("", "", "Client.UnauthorizedOperation", "AccessDeniedException", "Throttling", "NoSuchEntity")


def _when(index, values):
    return P._pick(values, index)


def _stamp():
    return F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _lines(df: DataFrame, line) -> DataFrame:
    return df.select(
        F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string"), F.lit(".json")).alias("file"),
        F.lit(0).cast("long").alias("block"), F.col("event_id").alias("seq"), line.alias("line"))


def _cloudtrail_lines(spark, sf) -> DataFrame:
    """Console logins where k % 13 is 0, management calls elsewhere; some without a caller."""
    ev = P.events(spark, sf)
    k = F.col("k")
    login = k % 13 == 0
    caller = F.when(k % 11 == 0, F.struct(F.lit("").alias("userName"))).otherwise(
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("userName")))
    params = F.when(k % 9 != 0, F.struct(
        F.concat(F.lit("t"), (k % 7).cast("string")).alias("userName"), F.concat(F.lit("arn:p"), (k % 3).cast("string")).alias("policyArn"),
        k.alias("count")))
    record = F.to_json(F.struct(
        F.lit("1.08").alias("eventVersion"), _stamp().alias("eventTime"),
        F.when(login, "signin.amazonaws.com").otherwise(_when(k % 12, [c[0] for c in _CALLS])).alias("eventSource"),
        F.when(login, "ConsoleLogin").otherwise(_when(k % 12, [c[1] for c in _CALLS])).alias("eventName"),
        F.lit("eu-1").alias("awsRegion"), F.concat(F.lit("10.0.0."), (F.col("user_id") % 200).cast("string")).alias("sourceIPAddress"),
        caller.alias("userIdentity"), F.when(~login, params).alias("requestParameters"),
        F.when(login, F.struct(F.when(k % 2 == 0, "Success").otherwise("Failure").alias("ConsoleLogin"))).alias("responseElements"),
        F.when(~login, F.nullif(_when(k % 6, _ERRORS), F.lit(""))).alias("errorCode"),
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("eventID"), F.lit("123").alias("recipientAccountId")))
    return _lines(ev, record)


_CT = _EV + f""", ct AS (SELECT *, {P._case([c[0].removesuffix('.amazonaws.com') or 'unknown' for c in _CALLS], 'k % 12')} AS service, {P._case([c[2] for c in _CALLS], 'k % 12')} AS verb,
    {P._case([c[3] for c in _CALLS], 'k % 12')} AS family, {P._case(_ERRORS, 'k % 6')} AS code FROM ev WHERE k % 13 <> 0),
  rows AS (SELECT *, service || CASE WHEN family = '' THEN '' ELSE ':' || family END AS resource_type, 'u' || user_id AS actor,
    service = 'iam' AS moves, CASE WHEN k % 9 = 0 THEN '' ELSE 't' || (k % 7) END AS pu, CASE WHEN k % 9 = 0 THEN '' ELSE 'arn:p' || (k % 3) END AS pp,
    CASE WHEN code IN ('Client.UnauthorizedOperation', 'AccessDeniedException') THEN 'denied' WHEN code <> '' THEN 'failed' ELSE 'allowed' END AS decision FROM ct WHERE k % 11 <> 0),
  full_rows AS (SELECT *, CASE WHEN moves THEN CASE WHEN pu = '' AND family = 'access-key' THEN actor ELSE pu END ELSE '' END AS target_actor,
    CASE WHEN moves THEN pp ELSE '' END AS role_ref FROM rows)"""


# The fields of the records above.
_SHAPE = ('{"eventVersion": "", "eventTime": "", "eventSource": "", "eventName": "", "awsRegion": "", "sourceIPAddress": "", '
          '"userIdentity": {"userName": ""}, "requestParameters": {"userName": "", "policyArn": "", "count": 1}, '
          '"responseElements": {"ConsoleLogin": ""}, "errorCode": "", "eventID": "", "recipientAccountId": ""}')


def _cloudtrail(spark, sf):
    return cloudtrail._ingest(_cloudtrail_lines(spark, sf), LOAD)


_CONTROLS = _CT + f"""
  SELECT 'eventID=e' || n || ';File=f' || (n % 5) || '.json' AS source_ref, us AS "timestamp", actor, verb, resource_type, target_actor, role_ref, decision,
    CASE WHEN pu <> '' THEN pu WHEN target_actor <> '' THEN target_actor ELSE role_ref END AS resource_name FROM full_rows WHERE us <= {LOAD_US} + 86400000000"""


@query("s03_n13_cloudtrail_controls", _CONTROLS)
def s03(spark, sf):
    return _control_rows(_cloudtrail(spark, sf))


@query("s03_spread_documents", _CONTROLS)
def s03_spread(spark, sf):
    """The same records as five documents, each printed over many lines in splits of a thousand records."""
    lines = _cloudtrail_lines(spark, sf)
    pretty = F.split(F.to_json(F.from_json("line", F.schema_of_json(_SHAPE)), {"pretty": "true"}), "\n")
    first = lines.groupBy("file").agg(F.min("seq").alias("first"))
    dealt = lines.join(F.broadcast(first), "file").repartition("file", F.floor(F.col("seq") / 1000))  # five files
    parts = dealt.select(
        "file", "seq", F.posexplode(F.concat(
            F.when(F.col("seq") == F.col("first"), F.array(F.lit('{"Records" : ['))).otherwise(F.array(F.lit(","))), pretty)).alias("at", "line"))
    ends = first.select("file", F.lit(2**40).alias("seq"), F.lit(0).alias("at"), F.lit("]}").alias("line"))
    spread = parts.unionByName(ends).select(
        "file", F.floor(F.col("seq") / 1000).cast("long").alias("block"), (F.col("seq") * 1000 + F.col("at")).alias("seq"),
        F.trim("line").alias("line")).where("line <> ''")
    path = shared_folder(spark, "spread")  # printed once, however often the lines are read
    spread.write.parquet(path)
    return _control_rows(cloudtrail._ingest(spark.read.parquet(path), LOAD))


def _control_rows(ingest):
    out = ingest.tables.controls
    return out.select("source_ref", us("timestamp"), "actor", "verb", "resource_type", "target_actor", "role_ref", "decision", "resource_name")


@query("n12_cloudtrail_logons", _EV + f"""
  SELECT 'eventID=e' || n || ';File=f' || (n % 5) || '.json' AS source_ref, 'u' || user_id AS "user", CASE WHEN k % 2 = 0 THEN 'success' ELSE 'failure' END AS action,
    'aws:123/eu-1' AS device FROM ev WHERE k % 13 = 0 AND k % 11 <> 0 AND us <= {LOAD_US} + 86400000000""")
def n12(spark, sf):
    return _cloudtrail(spark, sf).tables.logons.select("source_ref", "user", "action", "device")


@query("n24_source_ledger", _CT + f""",
  g AS (SELECT *, moves AND verb IN ('attach', 'detach') AS guaranteed FROM full_rows),
  late AS (SELECT count(*) AS n FROM ev WHERE k % 11 <> 0 AND us > {LOAD_US} + 86400000000)
  SELECT 'files_admitted' AS measure, 'recognised as CloudTrail' AS class, 5 AS n UNION ALL SELECT 'records_read', '', count(*) FROM ev
  UNION ALL SELECT 'issues', 'no usable principal name', count(*) FROM ev WHERE k % 11 = 0
  UNION ALL SELECT 'issues', 'timestamp in the future', n FROM late UNION ALL SELECT 'issues', 'no verb could be read from the event name', count(*) FROM full_rows WHERE verb = 'listthings'
  UNION ALL SELECT 'rows', 'control', count(*) FROM full_rows WHERE us <= {LOAD_US} + 86400000000
  UNION ALL SELECT 'rows', 'logon', count(*) FROM ev WHERE k % 13 = 0 AND k % 11 <> 0 AND us <= {LOAD_US} + 86400000000
  UNION ALL SELECT 'field_gaps', 'request carried no parameters (decision=' || decision || ')', count(*) FROM g WHERE guaranteed AND target_actor = '' GROUP BY ALL
  UNION ALL SELECT 'field_gaps', 'request carried no parameters (decision=' || decision || ')', count(*) FROM g WHERE guaranteed AND role_ref = '' GROUP BY ALL
  UNION ALL SELECT 'field_gaps', 'not guaranteed on this action', count(*) FROM g WHERE NOT guaranteed AND moves AND target_actor = '' HAVING count(*) > 0""")
def n24(spark, sf):
    return files.source_ledger(_cloudtrail(spark, sf))


@query("n26_event_ids", _CT + f"""
  SELECT count(*) AS n_rows, count(*) AS n_ids, count(*) AS n_same FROM full_rows WHERE us <= {LOAD_US} + 86400000000""")
def n26(spark, sf):
    """The same records from files split and ordered in another way get the same ids."""
    lines = _cloudtrail_lines(spark, sf)
    moved = lines.withColumns({"block": F.col("seq") % 7 * (1 << 33), "seq": -F.col("seq")}).repartition(5, "line")
    ids, other = (cloudtrail._ingest(x, LOAD).tables.controls.select("event_id") for x in (lines, moved))
    again = other.select(F.col("event_id").alias("o"))
    return ids.join(again, F.col("event_id") == F.col("o"), "left").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("event_id").alias("n_ids"), F.count("o").alias("n_same"))


@query("n25_field_gaps", _CT + """,
  g AS (SELECT *, moves AND verb IN ('attach', 'detach') AS guaranteed FROM full_rows)
  SELECT 'control.target_actor' AS "column", 'request carried no parameters (decision=' || decision || ')' AS reason, count(*) AS n FROM g WHERE guaranteed AND target_actor = '' GROUP BY ALL
  UNION ALL SELECT 'control.role_ref', 'request carried no parameters (decision=' || decision || ')', count(*) FROM g WHERE guaranteed AND role_ref = '' GROUP BY ALL
  UNION ALL SELECT 'control.target_actor', 'not guaranteed on this action', count(*) FROM g WHERE NOT guaranteed AND moves AND target_actor = '' HAVING count(*) > 0""")
def n25(spark, sf):
    return _cloudtrail(spark, sf).gaps


@query("n08_api_names", _EV + f""", c AS (SELECT k % 12 AS i FROM ev)
  SELECT i, {P._case([c[2] for c in _CALLS], 'i')} AS verb, {P._case([c[3] for c in _CALLS], 'i')} AS family, count(*) AS n FROM c GROUP BY ALL""")
def n08(spark, sf):
    name = _when(F.col("i"), [c[1] for c in _CALLS])
    rows = P.events(spark, sf).select((F.col("k") % 12).alias("i"))
    return rows.groupBy("i", N.verb_of(name).alias("verb"), N.family_of(name).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("n09_principals", _EV + """
  SELECT CASE k % 4 WHEN 0 THEN 'u' || user_id WHEN 1 THEN 's' || user_id WHEN 2 THEN 'i' || user_id ELSE 'svc' END AS principal, count(*) AS n FROM ev GROUP BY 1""")
def n09(spark, sf):
    who = F.col("user_id").cast("string")
    k = F.col("k")
    record = F.to_json(F.struct(
        F.when(k % 4 == 0, F.concat(F.lit("u"), who)).alias("userName"),
        F.when(k % 4 == 1, F.concat(F.lit("arn:aws:sts::1:assumed-role/r/s"), who)).alias("arn"),
        F.when(k % 4 == 2, F.struct(F.struct(F.concat(F.lit("i"), who).alias("userName")).alias("sessionIssuer"))).alias("sessionContext"),
        F.lit("svc").alias("invokedBy")))
    return P.events(spark, sf).select(N.principal(F.parse_json(record)).alias("principal")).groupBy("principal").agg(F.count(F.lit(1)).alias("n"))


@query("n10_decisions", _EV + """, c AS (SELECT CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'AccessDenied' WHEN 2 THEN 'Client.UnauthorizedOperation' WHEN 3 THEN 'Throttling' ELSE '' END AS code,
    CASE WHEN k % 6 IN (0, 1) THEN NULL WHEN k % 6 = 4 THEN 403 WHEN k % 6 = 5 THEN 101 ELSE 409 END AS status FROM ev)
  SELECT code, status, CASE WHEN code IN ('AccessDenied', 'Client.UnauthorizedOperation') OR coalesce(status, 0) IN (401, 403) THEN 'denied' WHEN code <> '' THEN 'failed'
    WHEN status IS NULL OR status = 101 THEN 'allowed' ELSE 'failed' END AS decision, count(*) AS n FROM c GROUP BY ALL""")
def n10(spark, sf):
    k = F.col("k") % 6
    code = _when(k, ["", "AccessDenied", "Client.UnauthorizedOperation", "Throttling", "", ""])
    status = F.when(k.isin(0, 1), F.lit(None)).when(k == 4, 403).when(k == 5, 101).otherwise(409).cast("int")
    rows = P.events(spark, sf).select(code.alias("code"), status.alias("status"))
    return rows.groupBy("code", "status", control.classify_decision(F.col("code"), F.col("status")).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


_ALL_VERBS = [v for verbs in V.VERBS_BY_CLASS.values() for v in verbs]
_VERB_OF = [c for c, verbs in V.VERBS_BY_CLASS.items() for _ in verbs]


@query("n21_n23_verb_classes", _EV + f""", c AS (SELECT {P._case(_ALL_VERBS, f"n % {len(_ALL_VERBS)}")} AS verb, {P._case(_VERB_OF, f"n % {len(_ALL_VERBS)}")} AS cls,
    CASE k % 3 WHEN 0 THEN 'IAM:user-policy' WHEN 1 THEN 'rolebindings' ELSE 's3:bucket' END AS r FROM ev)
  SELECT verb, r, cls AS verb_class, lower(split_part(r, ':', 1)) AS service, r <> 's3:bucket' AND cls IN ('grant', 'revoke', 'create', 'delete', 'modify') AS changes_authority,
    cls = 'grant' OR (verb = 'create' AND r = 'rolebindings') AS is_grant, r <> 's3:bucket' AND (cls IN ('grant', 'revoke') OR (verb = 'create' AND r = 'rolebindings')) AS is_identity_grant, count(*) AS n FROM c GROUP BY ALL""")
def n21(spark, sf):
    rows = P.events(spark, sf).select(
        P._pick(_ALL_VERBS, F.col("event_id") % len(_ALL_VERBS)).alias("verb"), P._pick(["IAM:user-policy", "rolebindings", "s3:bucket"], F.col("k") % 3).alias("r"))
    v, r = F.col("verb"), F.col("r")
    return rows.groupBy("verb", "r").agg(F.count(F.lit(1)).alias("n")).select(
        "verb", "r", control.verb_class(v).alias("verb_class"), control.service_of(r).alias("service"), control.changes_authority(v, r).alias("changes_authority"),
        control.is_grant(v, r).alias("is_grant"), control.is_identity_grant(v, r).alias("is_identity_grant"), "n")


@query("n01_event_times", _EV + """
  SELECT n, CASE WHEN k % 5 = 4 THEN NULL WHEN k % 5 = 3 THEN us // 1000000 * 1000000 WHEN k % 5 = 1 THEN us - 7200000000 ELSE us END AS at FROM ev""")
def n01(spark, sf):
    k = F.col("k") % 5
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (F.when(k == 0, F.concat(plain, F.lit("Z"))).when(k == 1, F.concat(plain, F.lit("+02:00")))
            .when(k == 2, F.concat(plain, F.lit("123Z"))).when(k == 3, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("2024-13-45T00:00:00Z"))
    return P.events(spark, sf).select(F.col("event_id").alias("n"), F.unix_micros(tm.parse_event_time(text)).alias("at"))


@query("n03_repeated_ids", "WITH l AS (SELECT l_orderkey || '-' || l_linenumber AS event_id FROM lineitem) SELECT event_id, count(*) AS n FROM l GROUP BY 1 HAVING count(*) > 1")
def n03(spark, sf):
    ids = P.table(spark, sf, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("event_id"))
    return normalise.repeated_ids(ids)


@query("n04_global_ids", P.with_tables("logon") + " SELECT event_id, 2 AS n, 'logon,network' AS tables FROM logon WHERE action = 'failure'")
def n04(spark, sf):
    tel = P.telemetry(spark, sf)
    clash = tel.network.unionByName(tel.logons.where("action = 'failure'").select("event_id", "timestamp"), allowMissingColumns=True)
    found = normalise.global_id_conflicts(tel.with_table("network", clash))
    return found.select("event_id", "n", F.array_join("tables", ",").alias("tables"))


@query("n05_quarantine", P.with_tables("logon") + f"""
  SELECT 'timestamp in the future' AS reason, count(*) AS n FROM logon WHERE us > {LOAD_US} + 86400000000
  UNION ALL SELECT 'kept', count(*) FROM logon WHERE us <= {LOAD_US} + 86400000000""")
def n05(spark, sf):
    out = normalise.quarantine(P.logons(P.events(spark, sf)), LOAD)
    kept = out.rows.agg(F.lit("kept").alias("reason"), F.count(F.lit(1)).alias("n"))
    return out.issues.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).unionByName(kept)


@query("n07_time_outliers", P.with_tables("logon", "control", "network", "process") + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) FILTER (abs(us - (SELECT median(us) FROM {t})) > 864000000000) AS outliers, count(*) AS rows FROM {t}"
    for t in ("logon", "control", "network", "process")))
def n07(spark, sf):
    from datetime import timedelta

    return normalise.time_outliers(P.telemetry(spark, sf), timedelta(days=10)).select("table", "outliers", "rows")


@query("n20_instance_identity", _EV + """
  SELECT n, CASE WHEN k % 3 = 0 THEN 'sysmon:ab-' || n ELSE '' END AS sysmon, CASE WHEN k % 4 = 0 THEN '' ELSE
    'start:h' || (user_id % 20) || '|' || (n % 500) || '|' || strftime(make_timestamp(us // 1000 * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END AS start FROM ev""")
def n20(spark, sf):
    k = F.col("k")
    guid = F.when(k % 3 == 0, F.concat(F.lit("{AB-"), F.col("event_id").cast("string"), F.lit("}"))).when(k % 3 == 1, "-").otherwise("")
    device = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("H"), (F.col("user_id") % 20).cast("string")))
    return P.events(spark, sf).select(
        F.col("event_id").alias("n"), identity.sysmon_identity(guid).alias("sysmon"),
        identity.start_identity(device, F.col("event_id") % 500, F.col("ts")).alias("start"))


def _k8s_lines(spark, sf) -> DataFrame:
    k = F.col("k")
    grant = F.struct(
        F.array(F.struct(F.lit("ServiceAccount").alias("kind"), F.concat(F.lit("sa"), (k % 4).cast("string")).alias("name")),
                F.struct(F.lit("User").alias("kind"), F.concat(F.lit("u"), (k % 5).cast("string")).alias("name"))).alias("subjects"),
        F.struct(F.lit("admin").alias("name")).alias("roleRef"))
    record = F.to_json(F.struct(
        F.lit("Event").alias("kind"), F.lit("audit.k8s.io/v1").alias("apiVersion"), F.concat(F.lit("a"), F.col("event_id").cast("string")).alias("auditID"),
        F.when(k % 10 == 0, "RequestReceived").otherwise("ResponseComplete").alias("stage"), F.when(k % 3 == 2, "get").otherwise("create").alias("verb"),
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"), F.array(F.lit("g1"), F.lit("g2")).alias("groups")).alias("user"),
        F.struct(F.when(k % 3 == 0, "rolebindings").otherwise("pods").alias("resource"), F.when(k % 3 == 1, "exec").alias("subresource"), F.lit("ns").alias("namespace")).alias("objectRef"),
        F.when(k % 3 == 0, grant).alias("requestObject"), F.struct(F.when(k % 2 == 0, 201).otherwise(403).alias("code")).alias("responseStatus"), _stamp().alias("stageTimestamp")))
    return _lines(P.events(spark, sf), F.when(F.col("event_id") % 50 == 49, "{broken").otherwise(record))


@query("s05_n15_k8s_controls", _EV + """
  SELECT 'auditID=a' || n || ';File=f' || (n % 5) || '.json' AS source_ref, 'u' || user_id AS actor, 'g1,g2' AS actor_groups, CASE WHEN k % 3 = 0 THEN 'create' ELSE 'exec' END AS verb,
    CASE WHEN k % 3 = 0 THEN 'rolebindings' ELSE 'pods/exec' END AS resource_type,
    CASE WHEN k % 3 = 0 THEN 'system:serviceaccount:ns:sa' || (k % 4) || ',u' || (k % 5) ELSE '' END AS target_actor, CASE WHEN k % 3 = 0 THEN 'admin' ELSE '' END AS role_ref,
    CASE WHEN k % 2 = 0 THEN 'allowed' ELSE 'denied' END AS decision FROM ev WHERE k % 10 <> 0 AND k % 3 <> 2 AND n % 50 <> 49""")
def s05(spark, sf):
    events = k8s.staged_events(_k8s_lines(spark, sf))
    rows = k8s.k8s_controls(events.where("shape IS NOT NULL"), "c").where("reason IS NULL")
    return rows.select("source_ref", "actor", "actor_groups", "verb", "resource_type", "target_actor", "role_ref", "decision")


def _ecs_lines(spark, sf) -> DataFrame:
    k = F.col("k")
    kind = k % 5
    channel = F.when(kind < 2, windows.SYSMON_CHANNEL).when(kind < 4, "Security").otherwise("System")
    code = F.when(kind == 0, 1).when(kind == 1, 3).when(kind == 2, 4624).when(kind == 3, 4625).otherwise(7)
    data = F.struct(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("TargetUserName"), (k % 12).cast("string").alias("LogonType"),
        F.when(k % 2 == 0, "-").otherwise("10.0.0.1").alias("IpAddress"), F.lit("0xC000006A").alias("SubStatus"), F.when(k % 2 == 0, "true").otherwise("false").alias("Initiated"))
    record = F.to_json(F.struct(
        _stamp().alias("@timestamp"), F.struct(F.concat(F.lit("H"), (F.col("user_id") % 20).cast("string"), F.lit(".corp")).alias("name")).alias("host"),
        F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name")).alias("user"),
        F.struct(F.lit("C:\\a\\x.exe").alias("executable"), (F.col("event_id") % 500).alias("pid"),
                 F.concat(F.lit("{AB-"), F.col("event_id").cast("string"), F.lit("}")).alias("entity_id")).alias("process"),
        F.struct(F.when(k % 7 != 0, "8.8.8.8").alias("ip"), F.lit(443).alias("port")).alias("destination"),
        F.struct(channel.alias("channel"), code.alias("event_id"), F.col("event_id").alias("record_id"), data.alias("event_data")).alias("winlog")))
    return _lines(P.events(spark, sf), record)


_HOST = "'H' || (user_id % 20)"


@query("s06_n17_winlogbeat", _EV + f"""
  SELECT 'process' AS event_type, us AS "timestamp", {_HOST} AS device, 'u' || user_id AS "user", 'x.exe|sysmon:ab-' || n AS detail FROM ev WHERE k % 5 = 0
  UNION ALL SELECT 'network', us, {_HOST}, 'u' || user_id, '8.8.8.8|' || CASE WHEN k % 2 = 0 THEN 'outbound' ELSE 'inbound' END FROM ev WHERE k % 5 = 1 AND k % 7 <> 0
  UNION ALL SELECT 'logon', us, {_HOST}, 'u' || user_id, CASE WHEN k % 5 = 2 THEN 'success||' ELSE 'failure|bad_password|' END || (k % 12) FROM ev WHERE k % 5 IN (2, 3)""")
def s06(spark, sf):
    got = windows.ingest_winlogbeat(_ecs_lines(spark, sf), "2030-01-01").tables
    cols = lambda df, *d: df.select("event_type", us("timestamp"), "device", "user", F.concat_ws("|", *[F.col(c).cast("string") for c in d]).alias("detail"))
    return cols(got.processes, "process_name", "process_guid").unionByName(cols(got.network, "remote_ip", "direction")).unionByName(
        cols(got.logons, "action", "failure_reason", "logon_type"))


@query("s12_slice_source", _EV + """, c AS (SELECT CASE WHEN k % 5 < 2 THEN 'Microsoft-Windows-Sysmon/Operational' WHEN k % 5 < 4 THEN 'Security' ELSE 'System' END AS channel,
    CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4624 WHEN 3 THEN 4625 ELSE 7 END AS code FROM ev)
  SELECT channel, code, count(*) AS seen, count(*) FILTER (code IN (1, 4625)) AS kept FROM c GROUP BY channel, code""")
def s12(spark, sf):
    parsed = windows.parse_ecs(_ecs_lines(spark, sf))
    return files.slice_source(parsed, "channel", "code", [(windows.SYSMON_CHANNEL, "1"), ("Security", "4625")])[1]


@query("s10_s11_admissions", _EV + """, f AS (SELECT 'f' || (n % 5) || '.json' AS file, n, n % 5 = 2 AS odd FROM ev)
  SELECT file, NOT bool_or(odd) AS admitted, count(*) AS records FROM f GROUP BY file""")
def s10(spark, sf):
    lines = _ecs_lines(spark, sf).withColumn("line", F.when(F.col("file") == "f2.json", '{"other": 1}').otherwise(F.col("line")))
    parsed = windows.parse_ecs(lines)
    return files.admit(parsed, windows.looks_like_ecs(), F.col("shape"), "Winlogbeat").select("file", "admitted", "records")


def _elastic_lines(spark, sf) -> DataFrame:
    k = F.col("k")
    kind = k % 4
    index = F.when(kind < 2, "logs-endpoint-winevent-sysmon-2024").otherwise("logs-endpoint-winevent-security-2024")
    body = F.struct(
        F.when(kind == 0, 1).when(kind == 1, 3).when(kind == 2, 4624).otherwise(4625).alias("event_id"), _stamp().alias("event_original_time"),
        F.concat(F.lit("H"), (F.col("user_id") % 20).cast("string"), F.lit(".Corp")).alias("host_name"), F.concat(F.lit("CORP\\U"), F.col("user_id").cast("string")).alias("user_name"),
        F.concat(F.lit("CORP\\T"), F.col("user_id").cast("string")).alias("TargetUserName"), F.lit("C:/Tools/X.EXE").alias("process_path"),
        F.concat(F.lit("AB-"), F.col("event_id").cast("string")).alias("process_guid"), F.when(k % 7 == 0, "-").otherwise("8.8.8.8").alias("dst_ip_addr"),
        F.lit("0xC0000064").alias("Status"), F.lit("0x0").alias("SubStatus"))
    return _lines(P.events(spark, sf), F.to_json(F.struct(index.alias("_index"), F.concat(F.lit("d"), F.col("event_id").cast("string")).alias("_id"), body.alias("_source"))))


@query("s07_n18_elastic", _EV + """
  SELECT 'f' || (n % 5) || '.json:d' || n AS event_id, 'process' AS event_type, us AS "timestamp", 'h' || (user_id % 20) AS device, 'u' || user_id AS "user", 'x.exe|sysmon:ab-' || n AS detail FROM ev WHERE k % 4 = 0
  UNION ALL SELECT 'f' || (n % 5) || '.json:d' || n, 'network', us, 'h' || (user_id % 20), 'u' || user_id, '8.8.8.8|' FROM ev WHERE k % 4 = 1 AND k % 7 <> 0
  UNION ALL SELECT 'f' || (n % 5) || '.json:d' || n, 'logon', us, 'h' || (user_id % 20), 't' || user_id, CASE WHEN k % 4 = 2 THEN 'success|' ELSE 'failure|unknown_user' END FROM ev WHERE k % 4 > 1""")
def s07(spark, sf):
    got = windows.ingest_elastic(_elastic_lines(spark, sf), "2030-01-01").tables
    cols = lambda df, *d: df.select("event_id", "event_type", us("timestamp"), "device", "user", F.concat_ws("|", *d).alias("detail"))
    return cols(got.processes, "process_name", "process_guid").unionByName(cols(got.network, "remote_ip", "direction")).unionByName(cols(got.logons, "action", "failure_reason"))


@query("s08_n19_defender_logons", _EV + """
  SELECT us AS "timestamp", 'H' || (user_id % 20) AS device, CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN 3 END AS logon_type, CASE WHEN k % 2 = 0 THEN 'success' ELSE 'failure' END AS action,
    CASE WHEN k % 3 = 2 THEN 'unrecognised LogonType value' END AS reason FROM ev""")
def s08(spark, sf):
    k = F.col("k")
    raw = P.events(spark, sf).select(
        _stamp().alias("Timestamp"), F.concat(F.lit("H"), (F.col("user_id") % 20).cast("string")).alias("DeviceName"), F.lit("a").alias("AccountName"),
        F.when(k % 3 == 0, "RemoteInteractive").when(k % 3 == 1, " Network").otherwise("Odd").alias("LogonType"),
        F.when(k % 2 == 0, "LogonSuccess").otherwise("LogonFailed").alias("ActionType"), F.col("event_id").alias("ReportId"))
    rows, _ = defender.defender_rows(raw, "logon", "x.csv")
    return rows.select(us("timestamp"), "device", "logon_type", "action", "reason")


@query("s14_label_refs", _EV + """, r AS (SELECT 'user=u' || user_id || ';k=' || k AS ref, min(us) AS us FROM ev WHERE kind = 'error' GROUP BY 1)
  SELECT ref, us // 86400000000 AS day FROM r""")
def s14(spark, sf):
    raw = P.events(spark, sf).where("event_type = 'error'").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"), "k", "ts")
    return evaluate.build_label_refs(raw, ["user", "k"], "ts").select("ref", F.datediff("day", F.lit("1970-01-01")).alias("day"))


@query("s16_merge_telemetry", P.with_tables("logon", "control", "rbac", "network", "process") + " SELECT 'control' AS \"table\", (SELECT count(*) FROM control) + (SELECT count(*) FROM rbac) AS rows"
       + "".join(f" UNION ALL SELECT '{t}', count(*) FROM {t}" for t in ("logon", "network", "process")))
def s16(spark, sf):
    from ..schemas import empty_telemetry
    from ..sources.canonical import merge_telemetry

    ev = P.events(spark, sf)
    merged = merge_telemetry([P.telemetry(spark, sf), empty_telemetry(spark).with_table("control", P.rbac_controls(ev))])
    one = lambda df, n: df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows"))
    return reduce(DataFrame.unionByName, [one(df, name) for name, df in merged.tables().items()])


_DETAILS = {
    "process": ("command_line", "process_id", "parent_process_name"), "network": ("remote_ip", "remote_port", "process_name"),
    "logon": ("action", "source_ip", "logon_type"), "control": ("verb", "resource_type", "decision"),
}
_STORED = P.with_tables("logon", "control", "network", "process") + " " + " UNION ALL ".join(
    f"""SELECT event_id, '{t}' AS "table", us AS "timestamp", device, concat_ws('|', {", ".join(f"{c}::VARCHAR" for c in cs)}) AS detail FROM {t}""" for t, cs in _DETAILS.items())


def _stored(tel):
    return reduce(DataFrame.unionByName, [df.select(
        "event_id", F.lit(name).alias("table"), us("timestamp"), "device",
        F.concat_ws("|", *(F.col(c).cast("string") for c in _DETAILS[name])).alias("detail")) for name, df in tel.tables().items()])


@query("s01_s02_csv_round_trip", _STORED)
def s01(spark, sf):
    """All tables, written as CSV and read again."""
    folder = shared_folder(spark, "canonical-csv")
    canonical.write_canonical(P.telemetry(spark, sf), folder, "csv")
    return _stored(canonical.read_canonical(spark, folder, "csv"))


@query("s09_stored_parquet", _STORED)
def s09(spark, sf):
    """All tables, written without columns of today's layout and widened when they are read again."""
    folder = shared_folder(spark, "canonical-parquet")
    older = P.telemetry(spark, sf).map(lambda _, df: df.drop("sha256", "signer", "remote_url", "failure_reason", "role_ref"))
    canonical.write_canonical(older, folder)
    return _stored(canonical.read_canonical_parquet(spark, folder)[0])


@query("s15_verdict_log", _EV + """,
  v AS (SELECT 'F' || user_id AS finding_id, CASE k % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' ELSE 'benign_true_positive' END AS verdict, us, n FROM ev)
  SELECT finding_id, arg_max(verdict, (us, n)) AS verdict, arg_max(n, (us, n))::VARCHAR AS note, count(*) AS records FROM v GROUP BY 1""")
def s15(spark, sf):
    """A verdict for every event, appended in two goes with broken lines between; the newest of each finding."""
    ev = P.events(spark, sf)
    text = lambda c: c.cast("string")
    verdicts = ev.select(
        F.concat(F.lit("F"), text(F.col("user_id"))).alias("finding_id"), F.lit("R").alias("rule_id"),
        F.when(F.col("k") % 3 == 0, "true_positive").when(F.col("k") % 3 == 1, "false_positive").otherwise("benign_true_positive").alias("verdict"),
        F.lit("a").alias("analyst"), text(F.col("event_id")).alias("note"), F.lit("needs_review").alias("system_disposition"),
        F.concat(_stamp(), F.lit("#"), F.lpad(text(F.col("event_id")), 19, "0")).alias("recorded_at"), "event_type")
    log = shared_folder(spark, "verdicts")
    evaluate.append_verdicts(verdicts.where("event_type <> 'purchase'").drop("event_type"), log)
    ev.where("k % 10 = 0").select(F.concat(F.lit('{"finding_id": "F'), text(F.col("user_id"))).alias("value")).write.mode("append").text(log)
    evaluate.append_verdicts(verdicts.where("event_type = 'purchase'").drop("event_type"), log)
    read = evaluate.read_verdicts(spark, log)
    counts = read.groupBy("finding_id").agg(F.count(F.lit(1)).alias("records"))
    return evaluate.latest_verdict(read).join(counts, "finding_id").select("finding_id", "verdict", "note", "records")


@query("n06_normalise_full", P.with_tables("logon") + f""",
  r AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'unparseable timestamp' WHEN k % 19 = 0 THEN 'timestamp before 2000' WHEN us > {LOAD_US} + 86400000000 THEN 'timestamp in the future' END AS reason FROM logon JOIN (SELECT n, k FROM ev) ON event_id = 'l' || n)
  SELECT source_ref, coalesce(reason, 'kept') AS outcome, CASE WHEN reason IS NULL THEN us END AS "timestamp", CASE WHEN reason IS NULL THEN 3 END AS logon_type, CASE WHEN reason IS NULL THEN '' END AS failure_reason FROM r""")
def n06(spark, sf):
    """Logon rows as text, some with impossible instants, through the whole funnel."""
    ev = P.events(spark, sf).select(F.concat(F.lit("l"), F.col("event_id").cast("string")).alias("event_id"), "k")
    stamp = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = P.telemetry(spark, sf).logons.join(ev, "event_id").withColumns({
        "timestamp": F.when(F.col("k") % 17 == 0, "yesterday").when(F.col("k") % 19 == 0, "1999-12-31T23:59:59Z").otherwise(stamp),
        "logon_type": F.lit("3.0"), "failure_reason": F.lit(None).cast("string")})
    found = normalise.normalise_full(rows, V.LOGON, LOAD)
    nothing = F.lit(None)
    return found.rows.select("source_ref", F.lit("kept").alias("outcome"), us("timestamp"), "logon_type", "failure_reason").unionByName(
        found.issues.select("source_ref", F.col("reason").alias("outcome"), nothing.cast("long").alias("timestamp"),
                            nothing.cast("long").alias("logon_type"), nothing.cast("string").alias("failure_reason")))


@query("n11_messages_without_code", _CT + f"""
  SELECT 'eventID=e' || n || ';File=f' || (n % 5) || '.json' AS source_ref, CASE WHEN code = '' AND k % 4 = 1 THEN 'failed' ELSE decision END AS decision
  FROM full_rows WHERE us <= {LOAD_US} + 86400000000""")
def n11(spark, sf):
    """Records with an error message, with and without an error code."""
    said = F.get_json_object("line", "$.eventID").substr(2, 20).cast("long").alias("event_id")
    lines = _cloudtrail_lines(spark, sf).withColumn("event_id", said).join(P.events(spark, sf).select("event_id", "k"), "event_id")
    line = F.when(F.col("k") % 4 == 1, F.regexp_replace("line", r"^\{", '{"errorMessage":"refused",')).otherwise(F.col("line"))
    return cloudtrail._ingest(lines.select("file", "block", "seq", line.alias("line")), LOAD).tables.controls.select("source_ref", "decision")


@query("s17_split_by_delivery", _EV + """
  SELECT CASE WHEN k % 9 = 0 THEN 'unreadable' WHEN us // 60000000 * 60000000 < 1704067200000000 + 864000000000 THEN 'dev' ELSE 'holdout' END AS part, count(*) AS n FROM ev GROUP BY 1""")
def s17(spark, sf):
    key = F.concat(F.lit("1_CloudTrail_eu-1_"), F.date_format("ts", "yyyyMMdd'T'HHmm"), F.when(F.col("k") % 9 == 0, "").otherwise("Z"), F.lit("_x.json.gz"))
    paths = P.events(spark, sf).select(key.alias("path"))
    return files.split_by_delivery_time(paths, "2024-01-01", 10).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("a19_raw_identity_pass", _CT + """
  SELECT code AS error_code, count(*) AS n FROM full_rows WHERE code <> '' GROUP BY 1""")
def a19(spark, sf):
    records = cloudtrail.parse_records(cloudtrail.raw_records(_cloudtrail_lines(spark, sf)))
    return cloudtrail.raw_identity_pass(records)["error_codes"]


@query("a19_decision_cross_tab", _CT + """
  SELECT CASE WHEN code <> '' THEN 'denied' ELSE 'allowed' END AS two_valued, decision, count(*) AS n FROM full_rows GROUP BY ALL""")
def a19_cross(spark, sf):
    records = cloudtrail.parse_records(cloudtrail.raw_records(_cloudtrail_lines(spark, sf)))
    return cloudtrail.raw_identity_pass(records)["decision_cross_tab"]


