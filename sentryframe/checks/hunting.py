"""Queries over sequence operators, joins and detections, with their SQL twins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import asof, episodes, sliding, timing
from ..plans import rules
from ..plans.hunt import run_hunt, triage_order
from ..plans.rules import REGISTRY, HuntConfig
from . import projection as P
from .registry import ORACLES, joined, query, us

H = 3_600_000_000  # an hour in microseconds

# Thresholds that give results on the driver tables (the rules' own give none there).
CONFIG = HuntConfig(
    bruteforce_min_failures=3, bruteforce_window=timedelta(hours=48),
    bruteforce_success_window=timedelta(hours=24), privilege_escalation_window=timedelta(days=7),
    cloud_discovery_min_services=3, cloud_discovery_window=timedelta(hours=72),
    cloud_denial_min_count=3, cloud_denial_window=timedelta(hours=48),
    cloud_identity_change_window=timedelta(hours=60), cloud_identity_failed_min_count=2,
    discovery_window=timedelta(days=10),
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def inlist(values) -> str:
    return "(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + ")"


def any_match(expr: str, table) -> str:
    return "(" + " OR ".join(f"regexp_matches({expr}, {lit(e[1])})" for e in table) + ")"


def names_matching(expr: str, table) -> str:
    """SQL text: names of matching patterns in table order, as a list."""
    cases = ", ".join(f"CASE WHEN regexp_matches({expr}, {lit(e[1])}) THEN {lit(e[0])} END" for e in table)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def episode_ctes(source: str, keys: str, minimum: int, span: int) -> str:
    """The sweep as defined: stand on an event, take its window or step to the next one.

    ``source`` is a relation with the key columns, ``us`` and ``event_id``; the result is
    ``member`` (its rows with the ``start_us`` they belong to).
    """
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    pre = lambda p: ", ".join(f"{p}.{k.strip()}" for k in keys.split(","))
    return f"""seq AS (SELECT {keys}, us, event_id,
    row_number() OVER (PARTITION BY {keys} ORDER BY us, event_id) AS i,
    count(*) OVER (PARTITION BY {keys} ORDER BY us RANGE BETWEEN CURRENT ROW AND {span} FOLLOWING) AS c
    FROM {source}),
  sweep AS (SELECT {keys}, i, us, c FROM seq WHERE i = 1
    UNION ALL SELECT {pre('b')}, b.i, b.us, b.c FROM sweep a JOIN seq b ON {on}
      AND b.i = CASE WHEN a.c >= {minimum} THEN a.i + a.c ELSE a.i + 1 END),
  ep AS (SELECT {keys}, us AS start_us FROM sweep WHERE c >= {minimum}),
  member AS (SELECT b.*, a.start_us FROM ep a JOIN {source} b ON {on}
    AND b.us BETWEEN a.start_us AND a.start_us + {span})"""


# ------------------------------------------------------------------ W: sequences


@query("w01_episodes_3_in_48h", P.with_tables("logon", recursive=True) + """,
  fail AS (SELECT "user", us, event_id FROM logon WHERE action = 'failure'),
  """ + episode_ctes("fail", '"user"', 3, 48 * H) + """
  SELECT "user", start_us, max(us) AS end_us, count(*) AS n FROM member GROUP BY "user", start_us""")
def w01(spark, sf):
    fail = P.logons(P.events(spark, sf)).where("action = 'failure'")
    return episodes.episodes(fail, ["user"], "timestamp", 3, timedelta(hours=48))


@query("w01_episodes_5_in_72h_bucketed", P.with_tables("logon", recursive=True) + """,
  fail AS (SELECT "user", us, event_id FROM logon WHERE action = 'failure'),
  """ + episode_ctes("fail", '"user"', 5, 72 * H) + """
  SELECT "user", start_us, max(us) AS end_us, count(*) AS n FROM member GROUP BY "user", start_us""")
def w01_hot(spark, sf):
    """The path taken by keys with very many qualifying instants, forced for every key."""
    fail = P.logons(P.events(spark, sf)).where("action = 'failure'")
    return episodes.episodes(fail, ["user"], "timestamp", 5, timedelta(hours=72))


@query("w01_episodes_all_actions_1h", P.with_tables("control", recursive=True) + """,
  src AS (SELECT device, us, event_id FROM control),
  """ + episode_ctes("src", "device", 4, H) + """
  SELECT device, start_us, max(us) AS end_us, count(*) AS n FROM member GROUP BY device, start_us""")
def w01_device(spark, sf):
    return episodes.episodes(P.controls(P.events(spark, sf)), ["device"], "timestamp", 4, timedelta(hours=1))


@query("w02_sliding_max_denials", P.with_tables("control") + f""",
  d AS (SELECT actor, count(*) OVER (PARTITION BY actor ORDER BY us
    RANGE BETWEEN {48 * H} PRECEDING AND CURRENT ROW) AS c FROM control WHERE decision = 'denied')
  SELECT actor, max(c) AS max_in_window FROM d GROUP BY actor""")
def w02_count(spark, sf):
    denied = P.controls(P.events(spark, sf)).where("decision = 'denied'")
    return sliding.sliding_max(denied, ["actor"], "timestamp", timedelta(hours=48))


@query("w02_sliding_max_distinct_types", P.with_tables("control") + f""",
  r AS (SELECT actor, us, resource_type FROM control WHERE verb IN ('get', 'list', 'describe')),
  w AS (SELECT a.actor, a.us, count(DISTINCT b.resource_type) AS c FROM r a JOIN r b
    ON a.actor = b.actor AND b.us BETWEEN a.us - {72 * H} AND a.us GROUP BY a.actor, a.us)
  SELECT actor, max(c) AS max_in_window FROM w GROUP BY actor""")
def w02_distinct(spark, sf):
    reads = P.controls(P.events(spark, sf)).where("verb IN ('get', 'list', 'describe')")
    return sliding.sliding_max(reads, ["actor"], "timestamp", timedelta(hours=72), "resource_type")


@query("w03_first_per_type", P.with_tables("control") + """,
  f AS (SELECT actor, resource_type, event_id, us, row_number() OVER
    (PARTITION BY actor, resource_type ORDER BY us, event_id) AS r FROM control),
  g AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY us, event_id) AS q FROM f WHERE r = 1)
  SELECT actor, resource_type, event_id, us AS "timestamp" FROM g WHERE q <= 3""")
def w03(spark, sf):
    rows = P.controls(P.events(spark, sf)).select("actor", "resource_type", "timestamp", "event_id")
    kept = rules.first_per(rows, ["actor"], "resource_type", limit=3)
    return kept.select("actor", "resource_type", "event_id", us("timestamp"))


@query("w04_inter_arrival", P.with_tables("network") + """,
  g AS (SELECT device, process_name, remote_ip, us - lag(us) OVER
    (PARTITION BY device, process_name, remote_ip ORDER BY us) AS gap_us FROM network)
  SELECT device, process_name, remote_ip, gap_us, count(*) AS n FROM g WHERE gap_us IS NOT NULL
  GROUP BY ALL""")
def w04(spark, sf):
    keys = ["device", "process_name", "remote_ip"]
    gaps = timing.inter_arrival(P.network(P.events(spark, sf)), keys, "timestamp")
    return gaps.groupBy(*keys, "gap_us").agg(F.count(F.lit(1)).alias("n"))


@query("w05_span_distinct", P.with_tables("process") + """
  SELECT device, parent_process_id, max(us) - min(us) AS span_us, count(DISTINCT lower(process_name)) AS images
  FROM process GROUP BY device, parent_process_id""")
def w05(spark, sf):
    return P.processes(P.events(spark, sf)).groupBy("device", "parent_process_id").agg(
        (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))).alias("span_us"),
        F.countDistinct(F.lower("process_name")).alias("images"))


@query("a09_connection_patterns", P.with_tables("network") + f""",
  pub AS (SELECT * FROM network WHERE {P.PUBLIC_IP_SQL}),
  g AS (SELECT device, process_name, remote_ip, us - lag(us) OVER
    (PARTITION BY device, process_name, remote_ip ORDER BY us) AS gap FROM pub),
  m AS (SELECT device, process_name, remote_ip, median(gap) AS med, count(gap) AS c FROM g GROUP BY ALL),
  d AS (SELECT g.device, g.process_name, g.remote_ip, median(abs(gap - med)) AS mad
    FROM g JOIN m USING (device, process_name, remote_ip) WHERE gap IS NOT NULL GROUP BY ALL),
  n AS (SELECT device, process_name, remote_ip, count(*) AS connection_count FROM pub GROUP BY ALL)
  SELECT device, process_name, remote_ip, connection_count,
    CASE WHEN connection_count > 3 THEN round(med / 1e6, 3) END AS median_interval,
    CASE WHEN connection_count > 3 THEN round(mad / 1e6, 3) END AS interval_mad,
    coalesce(connection_count > 3 AND mad / med < 0.15 AND med > 5e6, false) AS is_regular
  FROM n JOIN m USING (device, process_name, remote_ip) LEFT JOIN d USING (device, process_name, remote_ip)""")
def a09(spark, sf):
    from ..functions.network import is_public_ip

    public = P.network(P.events(spark, sf)).where(is_public_ip(F.col("remote_ip")))
    found = timing.connection_patterns(public, ["device", "process_name", "remote_ip"], "timestamp")
    return found.select(
        "device", "process_name", "remote_ip", "connection_count",
        F.round("median_interval", 3).alias("median_interval"),
        F.round("interval_mad", 3).alias("interval_mad"), "is_regular")


# ------------------------------------------------------------------ J: as-of joins


@query("j01_first_use_after_grant", P.with_tables("control") + f""",
  g AS (SELECT * FROM control WHERE verb IN ('attach', 'put') AND resource_type = 'iam:user-policy'),
  u AS (SELECT * FROM control WHERE verb = 'create' AND resource_type = 'iam:access-key')
  SELECT g.event_id AS grant_id, arg_min(u.event_id, (u.us, u.event_id)) AS use_id, min(u.us) - g.us AS lag_us
  FROM g JOIN u ON u.actor = g.target_actor AND u.us BETWEEN g.us AND g.us + {168 * H}
  GROUP BY g.event_id, g.us""")
def j01(spark, sf):
    control = P.controls(P.events(spark, sf))
    grants = control.where("verb IN ('attach', 'put') AND resource_type = 'iam:user-policy'")
    uses = control.where("verb = 'create' AND resource_type = 'iam:access-key'")
    chains = rules.grant_then_use(grants, uses, timedelta(days=7), ["device"])
    return chains.select(
        F.col("event_id").alias("grant_id"), F.col("use_event_id").alias("use_id"),
        (F.unix_micros("use_timestamp") - F.unix_micros("timestamp")).alias("lag_us"))


@query("j02_follow_up_success", P.with_tables("logon") + f""",
  f AS (SELECT * FROM logon WHERE action = 'failure'), s AS (SELECT * FROM logon WHERE action = 'success')
  SELECT f.event_id, arg_min(s.event_id, (s.us, s.event_id)) AS success_id
  FROM f LEFT JOIN s ON s.device = f.device AND s."user" = f."user" AND s.source_ip = f.source_ip
    AND s.us BETWEEN f.us AND f.us + {24 * H} GROUP BY f.event_id""")
def j02(spark, sf):
    logons = P.logons(P.events(spark, sf))
    found = asof.first_after(
        logons.where("action = 'failure'"), logons.where("action = 'success'"),
        ["device", "user", "source_ip"], left_ts="timestamp", right_ts="timestamp",
        window=timedelta(hours=24), right_columns=[], right_id="event_id", how="left")
    return found.select("event_id", F.col("next_event_id").alias("success_id"))


_FOREIGN = """,
  own AS (SELECT DISTINCT device, "user" FROM logon WHERE action = 'success' AND logon_type IN (2, 7, 11)),
  rem AS (SELECT * FROM logon WHERE action = 'success' AND logon_type IN (3, 10) AND source_device <> ''),
  fp AS (SELECT DISTINCT source_device, "user" FROM rem r WHERE source_device IN (SELECT device FROM own)
    AND NOT EXISTS (SELECT 1 FROM own o WHERE o.device = r.source_device AND o."user" = r."user"))"""


@query("j03_foreign_pairs", P.with_tables("logon") + _FOREIGN + ' SELECT source_device, "user" FROM fp')
def j03(spark, sf):
    return rules.foreign_pairs(P.logons(P.events(spark, sf)), V.OWNERSHIP_LOGON_TYPES, V.REMOTE_LOGON_TYPES)


# ------------------------------------------------------------------ D: detections


def _out(spark, sf, rule_id, *extra, rbac=False):
    out = REGISTRY[rule_id].run(P.telemetry(spark, sf, rbac=rbac), CONFIG)
    return out.findings.select(
        "finding_id", "severity", "device", "user", us("first_seen"), us("last_seen"),
        "evidence_count", *extra)


def _row_sql(rule_id: str, severity: str, where: str, *extra: str, user: str = '"user"', source="process") -> str:
    more = "".join(", " + e for e in extra)
    return P.with_tables(source) + f"""
  SELECT '{rule_id}:' || event_id AS finding_id, {severity} AS severity, device, {user} AS "user",
    us AS first_seen, us AS last_seen, 1 AS evidence_count{more} FROM {source} WHERE {where}"""


_PARENT, _IMAGE, _CMD = "lower(parent_process_name)", "lower(process_name)", "lower(command_line)"


@query("d01_office_spawns_interpreter", _row_sql(
    "ATH-001", "'high'",
    f"{_PARENT} IN {inlist(V.OFFICE_APPLICATIONS)} AND {_IMAGE} IN {inlist(V.SCRIPT_INTERPRETERS)}",
    "process_name AS child_process"))
def d01(spark, sf):
    return _out(spark, sf, "ATH-001", "child_process")


_DOWNLOADED = "(" + " OR ".join(f"contains(lower(decoded), {lit(i)})" for i in V.DOWNLOAD_INDICATORS) + ")"
_FLAG_SQL = r"(?:^|\s)[-/](?i:e|en|enc|enco|encod|encode|encoded|encodedc|encodedco|encodedcom|encodedcomm|encodedcomma|encodedcomman|encodedcommand)[\s:]+([A-Za-z0-9+/=]{20,})"


@query("d02_encoded_powershell", P.with_tables("process") + rf""",
  b AS (SELECT *, regexp_extract(command_line, {lit(_FLAG_SQL)}, 1) AS blob FROM process
    WHERE {_IMAGE} IN ('powershell.exe', 'pwsh.exe')),
  x AS (SELECT *, decode(unhex(regexp_replace(hex(from_base64(blob)), '(..)00', '\1', 'g'))) AS decoded
    FROM b WHERE blob <> '')
  SELECT 'ATH-002:' || event_id AS finding_id, CASE WHEN {_DOWNLOADED} THEN 'high'
    WHEN {any_match(_CMD, V.EVASION_FLAGS)} THEN 'medium' ELSE 'low' END AS severity, device, "user",
    us AS first_seen, us AS last_seen, 1 AS evidence_count, decoded AS decoded_command,
    array_to_string({names_matching(_CMD, V.EVASION_FLAGS)}, ',') AS evasion_flags FROM x""")
def d02(spark, sf):
    return _out(spark, sf, "ATH-002", "decoded_command", joined("evasion_flags"))


@query("d03_interpreter_egress", P.with_tables("network") + f""",
  h AS (SELECT * FROM network WHERE {_IMAGE} IN {inlist(V.SCRIPT_INTERPRETERS)}
    AND direction = 'outbound' AND {P.PUBLIC_IP_SQL})
  SELECT 'ATH-003:' || arg_min(event_id, (us, event_id)) AS finding_id,
    CASE WHEN bool_or(remote_port = 80) THEN 'high' ELSE 'medium' END AS severity, device,
    arg_min("user", (us, event_id)) AS "user", min(us) AS first_seen, max(us) AS last_seen,
    count(*) AS evidence_count, remote_ip, process_id,
    array_to_string(list_sort(list(DISTINCT remote_port)), ',') AS ports,
    CASE WHEN count(DISTINCT nullif(process_guid, '')) = 1 THEN max(process_guid) ELSE '' END AS process_guid,
    bool_or(remote_url <> '') AS has_url
  FROM h GROUP BY device, process_id, process_name, remote_ip""")
def d03(spark, sf):
    return _out(spark, sf, "ATH-003", "remote_ip", "process_id", joined("ports"), "process_guid", "has_url")


_ARGS = """CASE WHEN path <> '' AND starts_with(cmd, path) THEN trim(substr(cmd, length(path) + 1))
    WHEN img <> '' AND contains(cmd, img) THEN trim(substr(cmd, strpos(cmd, img) + length(img)))
    ELSE trim(regexp_replace(cmd, '^\\S+\\s*', '')) END"""
_LSASS_OTHER = [p for p in V.LSASS_PATTERNS if p != V.LSASS_ARGUMENT_PATTERN]
_LSASS_CASES = ", ".join(
    f"CASE WHEN regexp_matches({'args' if p == V.LSASS_ARGUMENT_PATTERN else 'cmd'}, {lit(p[1])}) THEN {lit(p[0])} END"
    for p in V.LSASS_PATTERNS)


@query("d04_lsass_access", P.with_tables("process") + f""",
  t AS (SELECT *, lower(trim(command_line)) AS cmd, lower(file_path) AS path, {_IMAGE} AS img FROM process),
  a AS (SELECT *, {_ARGS} AS args FROM t),
  m AS (SELECT *, list_filter([{_LSASS_CASES}], lambda x: x IS NOT NULL) AS found FROM a)
  SELECT 'ATH-004:' || event_id AS finding_id, 'critical' AS severity, device, "user", us AS first_seen,
    us AS last_seen, 1 AS evidence_count, array_to_string(found, ',') AS indicators FROM m WHERE len(found) > 0""")
def d04(spark, sf):
    return _out(spark, sf, "ATH-004", joined("indicators"))


_KEY3 = 'device, "user", source_ip'
_BRUTE = P.with_tables("logon", recursive=True) + """,
  fail AS (SELECT device, "user", source_ip, us, event_id, source_device FROM logon WHERE action = 'failure'),
  """ + episode_ctes("fail", _KEY3, 3, 48 * H) + f""",
  b AS (SELECT {_KEY3}, start_us, max(us) AS end_us, count(*) AS n, arg_min(event_id, (us, event_id)) AS first_id,
    arg_min(source_device, (us, event_id)) AS sdev FROM member GROUP BY {_KEY3}, start_us),
  w AS (SELECT b.first_id, min(s.us) AS won FROM b JOIN logon s ON s.action = 'success' AND s.device = b.device
    AND s."user" = b."user" AND s.source_ip = b.source_ip AND s.us BETWEEN b.start_us AND b.end_us + {24 * H}
    GROUP BY b.first_id)"""


@query("d05_brute_force", _BRUTE + """
  SELECT 'ATH-005:' || first_id AS finding_id, CASE WHEN won IS NULL THEN 'medium' ELSE 'critical' END AS severity,
    device, "user", start_us AS first_seen, greatest(end_us, coalesce(won, end_us)) AS last_seen,
    n + CASE WHEN won IS NULL THEN 0 ELSE 1 END AS evidence_count, n AS failure_count, sdev AS source_device,
    won AS success_time FROM b LEFT JOIN w USING (first_id)""")
def d05(spark, sf):
    return _out(spark, sf, "ATH-005", "failure_count", "source_device", us("success_time"))


@query("d05_evidence", _BRUTE + """
  SELECT 'ATH-005:' || b.first_id AS finding_id, m.event_id, m.us AS "timestamp" FROM member m JOIN b
    ON m.device = b.device AND m."user" = b."user" AND m.source_ip = b.source_ip AND m.start_us = b.start_us
  UNION ALL SELECT 'ATH-005:' || b.first_id, s.event_id, s.us FROM b JOIN w USING (first_id) JOIN logon s
    ON s.us = w.won AND s.action = 'success' AND s.device = b.device AND s."user" = b."user" AND s.source_ip = b.source_ip""")
def d05_evidence(spark, sf):
    out = REGISTRY["ATH-005"].run(P.telemetry(spark, sf), CONFIG)
    return out.evidence.select("finding_id", "event_id", us("timestamp"))


@query("d06_foreign_host_logon", P.with_tables("logon") + _FOREIGN + """
  SELECT 'ATH-006:' || arg_min(event_id, (us, event_id)) AS finding_id, 'high' AS severity,
    CASE WHEN count(DISTINCT device) = 1 THEN min(device) ELSE source_device END AS device, "user",
    min(us) AS first_seen, max(us) AS last_seen, count(*) AS evidence_count, source_device,
    array_to_string(list_sort(list(DISTINCT device)), ',') AS target_devices,
    array_to_string(list_sort(list(DISTINCT logon_type)), ',') AS logon_types
  FROM rem JOIN fp USING (source_device, "user") GROUP BY source_device, "user" """)
def d06(spark, sf):
    return _out(spark, sf, "ATH-006", "source_device", joined("target_devices"), joined("logon_types"))


@query("d07_remote_service_execution", _row_sql(
    "ATH-007", f"CASE WHEN regexp_matches(command_line, {lit(V.ADMIN_SHARE_REDIRECT)}) THEN 'high' ELSE 'medium' END",
    f"{_PARENT} = 'services.exe' AND {_IMAGE} IN {inlist(V.SERVICE_SHELLS)}"))
def d07(spark, sf):
    return _out(spark, sf, "ATH-007")


_STAGED, _BULK = (f"regexp_matches(command_line, {lit(p)})" for p in (V.STAGING_PATHS, V.BULK_SOURCE))


@query("d08_archive_staging", _row_sql(
    "ATH-008", f"CASE WHEN {_STAGED} AND {_BULK} THEN 'high' ELSE 'medium' END",
    f"regexp_matches(command_line, {lit(V.ARCHIVE_TOOLS)}) AND ({_STAGED} OR {_BULK})",
    f"{_BULK} AS bulk_source", f"{_STAGED} AS staging_destination"))
def d08(spark, sf):
    return _out(spark, sf, "ATH-008", "bulk_source", "staging_destination")


@query("d09_macro_attachment", _row_sql(
    "ATH-009", "'medium'",
    f"{_PARENT} = 'outlook.exe' AND {_IMAGE} IN {inlist(V.MAIL_OPENED_OFFICE_APPLICATIONS)} "
    f"AND regexp_matches({_CMD}, '[.](docm|dotm|xlsm|xlsb|pptm|ppsm)')"))
def d09(spark, sf):
    return _out(spark, sf, "ATH-009")


@query("d10_discovery_sequence", P.with_tables("process") + f""",
  g AS (SELECT device, parent_process_id, arg_min(event_id, (us, event_id)) AS first_id, min(us) AS lo, max(us) AS hi,
    arg_min("user", (us, event_id)) AS u, count(*) AS n, list_sort(list(DISTINCT {_IMAGE})) AS b
    FROM process WHERE {_IMAGE} IN {inlist(V.DISCOVERY_BINARIES)} GROUP BY device, parent_process_id)
  SELECT 'ATH-010:' || first_id AS finding_id, 'medium' AS severity, device, u AS "user", lo AS first_seen,
    hi AS last_seen, n AS evidence_count, array_to_string(b, ',') AS matched_binaries, parent_process_id
  FROM g WHERE len(b) >= 2 AND hi - lo <= {240 * H}""")
def d10(spark, sf):
    return _out(spark, sf, "ATH-010", joined("matched_binaries"), "parent_process_id")


def _procedures_sql(rule_id, table, at):
    return P.with_tables("process") + f""",
  p AS (SELECT *, unnest({names_matching(_CMD, table)}) AS proc FROM process),
  g AS (SELECT device, "user", arg_min(event_id, (us, event_id)) AS first_id, min(us) AS lo, max(us) AS hi,
    count(DISTINCT event_id) AS n, list_sort(list(DISTINCT proc)) AS ps FROM p GROUP BY device, "user")
  SELECT '{rule_id}:' || first_id AS finding_id, CASE WHEN len(ps) >= {at} THEN 'critical' ELSE 'high' END AS severity,
    device, "user", lo AS first_seen, hi AS last_seen, n AS evidence_count, array_to_string(ps, ',') AS procedures FROM g"""


@query("d11_recovery_inhibition", _procedures_sql("ATH-011", V.RECOVERY_PROCEDURES, 2))
def d11(spark, sf):
    return _out(spark, sf, "ATH-011", joined("procedures"))


@query("d12_security_tool_tampering", _procedures_sql("ATH-012", V.SECURITY_TOOL_PROCEDURES, 3))
def d12(spark, sf):
    return _out(spark, sf, "ATH-012", joined("procedures"))


def _chain_sql(rule_id, severity, source, grant, use, hours):
    return P.with_tables(source) + f""",
  g AS (SELECT * FROM {source} WHERE {grant}), u AS (SELECT * FROM {source} WHERE {use}),
  c AS (SELECT g.event_id, g.us, g.target_actor, min(u.us) AS used, arg_min(u.device, (u.us, u.event_id)) AS device
    FROM g JOIN u ON u.actor = g.target_actor AND u.us BETWEEN g.us AND g.us + {hours * H}
    GROUP BY g.event_id, g.us, g.target_actor)
  SELECT '{rule_id}:' || event_id AS finding_id, '{severity}' AS severity, device, target_actor AS "user",
    us AS first_seen, used AS last_seen, 2 AS evidence_count, (used - us) // 1000000 AS lag_seconds FROM c"""


@query("d13_iam_escalation_chain", _chain_sql(
    "AWS-001", "high", "control", "verb IN ('attach', 'put') AND resource_type = 'iam:user-policy'",
    "verb = 'create' AND resource_type = 'iam:access-key'", 168))
def d13(spark, sf):
    return _out(spark, sf, "AWS-001", "lag_seconds")


@query("d14_audit_log_disabled", _row_sql(
    "AWS-002", "'critical'", "resource_type LIKE 'cloudtrail:%' AND verb IN ('stop', 'delete')", "verb",
    user="actor", source="control"))
def d14(spark, sf):
    return _out(spark, sf, "AWS-002", "verb")


def _burst_ctes(rule_id, where, minimum, span, keep="true"):
    """``g``: the episodes that are findings; ``cited``: every event of each."""
    return P.with_tables("control", recursive=True) + f""",
    src AS (SELECT *, split_part(resource_type, ':', 1) AS service FROM control WHERE {where}),
    {episode_ctes("src", "actor", minimum, span)},
    g AS (SELECT actor, start_us, '{rule_id}:' || arg_min(event_id, (us, event_id)) AS finding_id,
      arg_min(device, (us, event_id)) AS device, count(*) AS n, count_if(decision = 'denied') AS denied,
      count(DISTINCT service) AS services, count(DISTINCT resource_type) AS kinds, min(us) AS lo, max(us) AS hi
      FROM member GROUP BY actor, start_us HAVING {keep})"""


def _burst_sql(rule_id, where, minimum, span, severity, keep="true", extra=""):
    return _burst_ctes(rule_id, where, minimum, span, keep) + f"""
    SELECT finding_id, {severity} AS severity, device, actor AS "user", lo AS first_seen, hi AS last_seen,
      n AS evidence_count, n AS call_count, kinds AS distinct_resource_types{extra} FROM g"""


def _burst_evidence(name, rule_id, *args):
    """Every event that a burst rule cites."""
    sql = _burst_ctes(rule_id, *args) + """
    SELECT finding_id, event_id, us AS "timestamp", verb FROM member JOIN g USING (actor, start_us)"""

    def fn(spark, sf):
        out = REGISTRY[rule_id].run(P.telemetry(spark, sf), CONFIG)
        verbs = P.controls(P.events(spark, sf)).select("event_id", "verb")
        return out.evidence.join(verbs, "event_id").select("finding_id", "event_id", us("timestamp"), "verb")

    query(name, sql)(fn)


_READS = "verb IN ('get', 'list', 'describe')"


@query("d15_service_discovery_burst", _burst_sql(
    "AWS-003", _READS, 3, 72 * H, "CASE WHEN denied / n > 0.5 THEN 'high' ELSE 'medium' END",
    "count(DISTINCT service) >= 3", ", services AS distinct_services, denied AS denied_count"))
def d15(spark, sf):
    return _out(spark, sf, "AWS-003", "call_count", "distinct_resource_types", "distinct_services", "denied_count")


@query("d16_denial_burst", _burst_sql(
    "AWS-004", "decision = 'denied'", 3, 48 * H, "CASE WHEN kinds >= 5 THEN 'high' ELSE 'medium' END"))
def d16(spark, sf):
    return _out(spark, sf, "AWS-004", "call_count", "distinct_resource_types")


_IDENTITY = "resource_type LIKE 'iam:%'"


@query("d17_authority_removed", _burst_sql(
    "AWS-005", f"{_IDENTITY} AND verb IN ('delete', 'detach') AND decision = 'allowed'", 1, 60 * H, "'medium'"))
def d17(spark, sf):
    return _out(spark, sf, "AWS-005", "call_count", "distinct_resource_types")


_CHANGES = f"{_IDENTITY} AND verb IN ('attach', 'detach', 'create', 'delete', 'update')"


@query("d18_rejected_changes", _burst_sql(
    "AWS-006", f"{_CHANGES} AND decision = 'failed'", 2, 60 * H, "'medium'"))
def d18(spark, sf):
    return _out(spark, sf, "AWS-006", "call_count", "distinct_resource_types")


_burst_evidence("d15_burst_evidence", "AWS-003", _READS, 3, 72 * H, "count(DISTINCT service) >= 3")
_burst_evidence("d16_burst_evidence", "AWS-004", "decision = 'denied'", 3, 48 * H)
_burst_evidence("d17_burst_evidence", "AWS-005", f"{_IDENTITY} AND verb IN ('delete', 'detach') AND decision = 'allowed'", 1, 60 * H)
_burst_evidence("d18_burst_evidence", "AWS-006", f"{_CHANGES} AND decision = 'failed'", 2, 60 * H)

_PRIVILEGED = ("verb = 'create' AND resource_type IN ('rolebindings', 'clusterrolebindings') "
               "AND role_ref IN ('cluster-admin', 'admin') AND target_actor NOT IN ('', 'system:masters')")


@query("d19_rbac_escalation", _row_sql(
    "K8S-001", "'high'", f"{_PRIVILEGED} AND NOT contains(actor_groups, 'system:masters')", "role_ref",
    user="target_actor", source="rbac"))
def d19(spark, sf):
    return _out(spark, sf, "K8S-001", "role_ref", rbac=True)


@query("d20_exec_after_grant", _chain_sql(
    "K8S-002", "critical", "rbac", _PRIVILEGED, "verb = 'exec' AND resource_type = 'pods/exec'", 168))
def d20(spark, sf):
    return _out(spark, sf, "K8S-002", "lag_seconds", rbac=True)


@query("d21_wide_rejection_episodes", P.with_tables("control", recursive=True) + f""",
  src AS (SELECT actor, us, event_id FROM control WHERE {_CHANGES} AND decision IN ('failed', 'denied')),
  {episode_ctes("src", "actor", 2, 60 * H)}
  SELECT actor, start_us, max(us) AS end_us, count(*) AS n FROM member GROUP BY actor, start_us""")
def d21(spark, sf):
    return rules.wide_rejection_episodes(P.controls(P.events(spark, sf)), 2, timedelta(hours=60))


@query("d22_control_classes", P.with_tables("control") + """
  SELECT verb, resource_type, CASE WHEN verb IN ('get', 'list', 'describe') THEN 'read' WHEN verb = 'attach' THEN 'grant'
    WHEN verb = 'detach' THEN 'revoke' WHEN verb = 'update' THEN 'modify' ELSE verb END AS verb_class,
    split_part(resource_type, ':', 1) AS service, resource_type LIKE 'iam:%' AS identity_service,
    resource_type LIKE 'iam:%' AND verb NOT IN ('get', 'list', 'describe') AS changes_authority, count(*) AS n
  FROM control GROUP BY ALL""")
def d22(spark, sf):
    from ..functions.control import with_control_classes

    return with_control_classes(P.controls(P.events(spark, sf))).groupBy(
        "verb", "resource_type", "verb_class", "service", "identity_service", "changes_authority"
    ).agg(F.count(F.lit(1)).alias("n"))


def endpoint_hunt(spark, sf, **kwargs):
    """Every rule over all four tables, RBAC rows included."""
    return run_hunt(P.telemetry(spark, sf, rbac=True), config=CONFIG, **kwargs)


#: The query that states each rule alone.
_BY_RULE = {
    "ATH-001": "d01_office_spawns_interpreter", "ATH-002": "d02_encoded_powershell", "ATH-003": "d03_interpreter_egress",
    "ATH-004": "d04_lsass_access", "ATH-005": "d05_brute_force", "ATH-006": "d06_foreign_host_logon",
    "ATH-007": "d07_remote_service_execution", "ATH-008": "d08_archive_staging", "ATH-009": "d09_macro_attachment",
    "ATH-010": "d10_discovery_sequence", "ATH-011": "d11_recovery_inhibition", "ATH-012": "d12_security_tool_tampering",
    "AWS-001": "d13_iam_escalation_chain", "AWS-002": "d14_audit_log_disabled", "AWS-003": "d15_service_discovery_burst",
    "AWS-004": "d16_denial_burst", "AWS-005": "d17_authority_removed", "AWS-006": "d18_rejected_changes",
    "K8S-001": "d19_rbac_escalation", "K8S-002": "d20_exec_after_grant",
}


def _all_rules_sql() -> str:
    parts = [
        f"SELECT '{rule}' AS rule_id, severity, count(*) AS findings, sum(evidence_count)::BIGINT AS evidence FROM ({ORACLES[name]}) GROUP BY severity"
        for rule, name in _BY_RULE.items()]
    return " UNION ALL ".join(parts)


@query("d23_run_hunt_counts", _all_rules_sql())
def d23(spark, sf):
    found = endpoint_hunt(spark, sf).findings
    return found.groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("evidence_count").alias("evidence"))


@query("d23_one_pass_hunt", _all_rules_sql())
def d23_one_pass(spark, sf):
    found = endpoint_hunt(spark, sf, one_pass=True).findings
    return found.groupBy("rule_id", "severity").agg(
        F.count(F.lit(1)).alias("findings"), F.sum("evidence_count").alias("evidence"))


_SINGLE_ROW_HUNT = P.with_tables("process", "control") + f""",
  f AS (SELECT 'ATH-001' AS rule_id, event_id, us, 3 AS severity_rank FROM process WHERE {_PARENT} IN {inlist(V.OFFICE_APPLICATIONS)}
      AND {_IMAGE} IN {inlist(V.SCRIPT_INTERPRETERS)}
    UNION ALL SELECT 'ATH-007', event_id, us, CASE WHEN regexp_matches(command_line, {lit(V.ADMIN_SHARE_REDIRECT)}) THEN 3 ELSE 2 END
      FROM process WHERE {_PARENT} = 'services.exe' AND {_IMAGE} IN {inlist(V.SERVICE_SHELLS)}
    UNION ALL SELECT 'AWS-002', event_id, us, 4 FROM control WHERE resource_type LIKE 'cloudtrail:%' AND verb IN ('stop', 'delete'))
  SELECT rule_id || ':' || event_id AS finding_id, severity_rank, us AS first_seen FROM f WHERE severity_rank >= 3"""


@query("d23_run_hunt_selected", _SINGLE_ROW_HUNT)
def d23_selected(spark, sf):
    result = run_hunt(P.telemetry(spark, sf), ["ATH-001", "ATH-007", "AWS-002"], CONFIG, min_severity="high")
    return triage_order(result.findings).select("finding_id", "severity_rank", us("first_seen"))


@query("a50_follow_up_lag", _BRUTE + """
  SELECT 'ATH-005:' || first_id AS finding_id, trunc((won - end_us) / 1e6)::BIGINT AS lag_seconds, won < end_us AS negative
  FROM b JOIN w USING (first_id)""")
def a50(spark, sf):
    out = REGISTRY["ATH-005"].run(P.telemetry(spark, sf), CONFIG)
    from ..plans.evaluate import follow_up_lag

    return follow_up_lag(out.findings).select("finding_id", "lag_seconds", "negative")
