"""Queries over the environment, coverage, triage, techniques and cases."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import text as T
from ..functions.network import is_public_ip
from ..plans import correlate, coverage, environment, hubs, hunt, techniques, triage
from ..plans.rules import REGISTRY
from . import projection as P
from .hunting import (CONFIG, H, _CMD, _IMAGE, _PARENT, any_match, inlist, lit, names_matching)
from .registry import ORACLES, joined, query, us

_PUB = f"pub AS (SELECT * FROM network WHERE {P.PUBLIC_IP_SQL})"


@query("p01_public_ip", P.with_tables("network") + f"""
  SELECT remote_ip, {P.PUBLIC_IP_SQL} AS is_public, count(*) AS n FROM network GROUP BY ALL""")
def p01(spark, sf):
    return P.network(P.events(spark, sf)).groupBy(
        "remote_ip", is_public_ip(F.col("remote_ip")).alias("is_public")).agg(F.count(F.lit(1)).alias("n"))


@query("p08_p09_event_summaries", P.with_tables("logon", "control", "network", "process") + """
  SELECT event_id, action || ' logon [' || CASE logon_type WHEN 2 THEN 'Interactive (console)'
      WHEN 3 THEN 'Network (SMB / share access)' WHEN 10 THEN 'RemoteInteractive (RDP)' WHEN 7 THEN 'Unlock'
      ELSE 'Service' END || '] from ' || source_ip || CASE WHEN failure_reason = '' THEN '' ELSE ' reason=' || failure_reason END AS summary FROM logon
  UNION ALL SELECT event_id, actor || ' ' || verb || ' ' || resource_type || CASE WHEN resource_name = '' THEN '' ELSE ' (' || resource_name || ')' END
      || ' -> ' || target_actor || ' [' || decision || ']' FROM control
  UNION ALL SELECT event_id, process_name || ' -> ' || remote_ip || ':' || remote_port || ' (' || direction || ')' FROM network
  UNION ALL SELECT event_id, parent_process_name || ' -> ' || process_name || ' | ' || substr(command_line, 1, 160) FROM process""")
def summaries(spark, sf):
    from ..sources.canonical import unified

    return unified(P.telemetry(spark, sf)).select("event_id", "summary")


@query("p10_slice", P.with_tables("logon", "control", "network", "process") + " " + " UNION ALL ".join(f"""
  SELECT event_id, '{t}' AS "table" FROM {t} WHERE us BETWEEN 1704067200000000 + {24 * H} AND 1704067200000000 + {96 * H}
    AND device IN ('H1', 'H2', 'H3')""" for t in ("logon", "control", "network", "process")))
def p10(spark, sf):
    from ..plans.retrieve import slice_telemetry

    part = slice_telemetry(P.telemetry(spark, sf), "2024-01-02 00:00:00", "2024-01-05 00:00:00", ["H1", "H2", "H3"])
    return reduce(DataFrame.unionByName, [df.select("event_id", F.lit(name).alias("table")) for name, df in part.tables().items()])


@query("p14_calibration_documents", f"""
  SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN contains(lower(text), {lit(w)}) THEN {lit(w)} END" for w in T.CERTAINTY_WORDS)}],
    lambda x: x IS NOT NULL), ',') AS issues FROM documents""")
def p14(spark, sf):
    docs = P.table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(
        T.calibration_issues(F.col("text"), F.lit("inference")), ",").alias("issues"))


@query("p14_calibration_conversations", f"""
  SELECT conv_id, turn, array_to_string(list_filter([{", ".join(f"CASE WHEN contains(lower(text), {lit(w)}) THEN {lit(w)} END" for w in T.HEDGE_WORDS)}],
    lambda x: x IS NOT NULL), ',') AS issues FROM conversations WHERE role = 'assistant'""")
def p14_turns(spark, sf):
    turns = P.table(spark, sf, "conversations").where("role = 'assistant'")
    return turns.select("conv_id", "turn", F.array_join(
        T.calibration_issues(F.col("text"), F.lit("fact")), ",").alias("issues"))


# ------------------------------------------------------------------ A01-A08, A13


@query("a01_table_counts", P.with_tables("logon", "control", "network", "process") + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, min(us) AS first, max(us) AS last FROM {t}"
    for t in ("process", "network", "logon", "control")))
def a01(spark, sf):
    return environment.table_counts(P.telemetry(spark, sf)).select("table", "rows", us("first"), us("last"))


@query("a01_top_images", P.with_tables("process") + """
  SELECT process_name, count(*) AS executions FROM process GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def a01_images(spark, sf):
    return environment.top_images(P.telemetry(spark, sf))


@query("a01_logon_outcomes", P.with_tables("logon") + """
  SELECT device, action, count(*) AS logons FROM logon GROUP BY ALL""")
def a01_logons(spark, sf):
    return environment.logon_outcomes(P.telemetry(spark, sf))


@query("a02_a04_destination_profiles", P.with_tables("network") + f""", {_PUB},
  b AS (SELECT min(us) AS lo, max(us) AS hi FROM pub)
  SELECT remote_ip, count(DISTINCT device) AS hosts, count(DISTINCT "user") AS users,
    count(DISTINCT lower(process_name)) AS images, count(*) AS connections,
    count(DISTINCT CASE WHEN us >= hi - (hi - lo) / 4.0 THEN device END) AS recent_hosts,
    count(DISTINCT CASE WHEN us >= hi - (hi - lo) / 4.0 THEN device END) >= 2 AND
      count(DISTINCT CASE WHEN us >= hi - (hi - lo) / 4.0 THEN device END) > count(DISTINCT device) * 0.75 AS is_emerging,
    max(us) - min(us) >= (any_value(hi) - any_value(lo)) * 0.5 AS is_established
  FROM pub, b GROUP BY remote_ip""")
def a02(spark, sf):
    return environment.destination_profiles(P.network(P.events(spark, sf))).select(
        "remote_ip", "hosts", "users", "images", "connections", "recent_hosts", "is_emerging", "is_established")


@query("a03_process_profiles", P.with_tables("process") + """,
  c AS (SELECT lower(parent_process_name) AS image, count(*) AS spawned FROM process WHERE parent_process_name <> '' GROUP BY 1)
  SELECT lower(process_name) AS image, count(DISTINCT device) AS hosts, count(*) AS executions,
    count(DISTINCT nullif(signer, '')) AS signers, count(DISTINCT sha256) AS hashes,
    array_to_string(list_sort(list(DISTINCT signature_status)), ',') AS signature_states,
    coalesce(any_value(spawned), 0) AS spawned_children
  FROM process LEFT JOIN c ON c.image = lower(process_name) GROUP BY 1""")
def a03(spark, sf):
    return environment.process_profiles(P.processes(P.events(spark, sf))).select(
        "image", "hosts", "executions", "signers", "hashes", joined("signature_states"), "spawned_children")


_HOSTS = P.with_tables("logon", "network", "process") + f""",
  d AS (SELECT device FROM process UNION SELECT device FROM network UNION SELECT device FROM logon),
  iu AS (SELECT DISTINCT device, "user" FROM logon WHERE action = 'success' AND logon_type IN (2, 7, 10, 11)),
  rs AS (SELECT DISTINCT device, source_device FROM logon WHERE action = 'success' AND logon_type IN (3, 10) AND source_device NOT IN ('', device)),
  ip AS (SELECT DISTINCT device, remote_ip, {P.PUBLIC_IP_SQL} AS ext FROM network WHERE remote_ip <> ''),
  hosts AS (SELECT device, (SELECT count(*) FROM process p WHERE p.device = d.device) AS process_count,
    (SELECT count(*) FROM network p WHERE p.device = d.device) AS network_count,
    (SELECT count(*) FROM logon p WHERE p.device = d.device) AS logon_count,
    (SELECT count(*) FROM iu p WHERE p.device = d.device) AS interactive_users,
    (SELECT count(*) FROM rs p WHERE p.device = d.device) AS remote_sources,
    (SELECT count(*) FROM ip p WHERE p.device = d.device AND ext) AS external_destinations,
    (SELECT count(*) FROM ip p WHERE p.device = d.device AND NOT ext) AS internal_peers FROM d)"""
_ROLE = """CASE WHEN remote_sources > 0 AND interactive_users = 0 THEN 'server' WHEN interactive_users > 0 THEN 'workstation' ELSE 'unknown' END"""


@query("a05_host_inventory", _HOSTS + f" SELECT *, {_ROLE} AS role FROM hosts")
def a05(spark, sf):
    return environment.host_inventory(P.telemetry(spark, sf)).select(
        "device", "process_count", "network_count", "logon_count", "interactive_users", "remote_sources",
        "external_destinations", "internal_peers", "role")


@query("a06_a07_identity_inventory", _HOSTS + f""",
  u AS (SELECT "user" FROM logon UNION SELECT "user" FROM process),
  l AS (SELECT "user", count(*) FILTER (action = 'success') AS successes, count(*) FILTER (action <> 'success') AS failures,
    count(DISTINCT device) AS hosts_authenticated, count(*) FILTER (logon_type IN (2, 7, 10, 11)) AS i, count(*) FILTER (logon_type = 5) AS s FROM logon GROUP BY 1),
  p AS (SELECT "user", count(DISTINCT device) AS hosts_run_on, count(*) FILTER (regexp_matches(command_line, {lit(V.ADMIN_SHARE_REFERENCE)})) AS admin_share_hits FROM process GROUP BY 1),
  c AS (SELECT "user", count(*) AS n FROM iu JOIN hosts USING (device) WHERE {_ROLE} = 'server' GROUP BY 1),
  m AS (SELECT median(hosts_authenticated) AS med FROM l)
  SELECT "user", coalesce(successes, 0) AS successes, coalesce(failures, 0) AS failures, coalesce(hosts_authenticated, 0) AS hosts_authenticated,
    coalesce(hosts_run_on, 0) AS hosts_run_on, coalesce(admin_share_hits, 0) AS admin_share_hits,
    CASE WHEN s > 0 AND i = 0 THEN 'service' WHEN i > 0 THEN 'interactive' ELSE 'unknown' END AS kind,
    array_to_string(list_filter([CASE WHEN admin_share_hits > 0 THEN 'admin_share' END, CASE WHEN c.n > 0 THEN 'server_console' END,
      CASE WHEN hosts_authenticated > greatest(2 * med, med + 1) THEN 'distinctive_reach' END], lambda x: x IS NOT NULL), ',') AS privilege_signals
  FROM u LEFT JOIN l USING ("user") LEFT JOIN p USING ("user") LEFT JOIN c USING ("user"), m""")
def a06(spark, sf):
    return environment.identity_inventory(P.telemetry(spark, sf)).select(
        "user", "successes", "failures", "hosts_authenticated", "hosts_run_on", "admin_share_hits", "kind",
        joined("privilege_signals"))


@query("a08_security_products", P.with_tables("process") + """
  SELECT lower(process_name) AS image, CASE lower(process_name) WHEN 'msmpeng.exe' THEN 'Microsoft Defender Antivirus'
      ELSE 'Microsoft Configuration Manager (patch management)' END AS product,
    count(DISTINCT nullif(signer, '')) = 1 AND min(signature_status) = 'valid' AND max(signature_status) = 'valid' AS recognised
  FROM process WHERE lower(process_name) IN ('msmpeng.exe', 'ccmexec.exe') GROUP BY 1""")
def a08(spark, sf):
    return environment.security_products(P.processes(P.events(spark, sf)))


def _behaviour_sql(found: str, extra: str, shown: str, where: str) -> str:
    return P.with_tables("process") + f""",
  m AS (SELECT event_id, device, "user", {found} AS found{extra} FROM process)
  SELECT event_id, device, "user", array_to_string(found, ',') AS procedures{shown} FROM m WHERE {where}"""


@query("a10_recovery_behaviours", _behaviour_sql(
    names_matching(_CMD, V.RECOVERY_PROCEDURES), f", {names_matching(_CMD, V.RECOVERY_ENUMERATION)} AS enum",
    ", array_to_string(enum, ',') AS enumeration", "len(found) + len(enum) > 0"))
def a10(spark, sf):
    from ..plans.behaviours import recovery_behaviours

    return recovery_behaviours(P.processes(P.events(spark, sf))).select(
        "event_id", "device", "user", joined("procedures"), joined("enumeration"))


@query("a11_security_tool_behaviours", _behaviour_sql(
    names_matching(_CMD, V.SECURITY_TOOL_PROCEDURES), "", "", "len(found) > 0"))
def a11(spark, sf):
    from ..plans.behaviours import security_tool_behaviours

    return security_tool_behaviours(P.processes(P.events(spark, sf))).select(
        "event_id", "device", "user", joined("procedures"))


@query("a12_behaviours", P.with_tables("process", "network") + f""", {_PUB},
  r AS (SELECT device, process_name, remote_ip, min(us) AS us FROM pub GROUP BY ALL),
  x AS (SELECT 'periodic_outbound_relationship' AS type, us FROM r
    UNION ALL SELECT 'interpreter_external_contact', us FROM r WHERE {_IMAGE} IN {inlist(V.SCRIPT_INTERPRETERS)}
    UNION ALL SELECT 'recovery_mechanism_disabled', us FROM process WHERE {any_match(_CMD, V.RECOVERY_PROCEDURES)} OR {any_match(_CMD, V.RECOVERY_ENUMERATION)}
    UNION ALL SELECT 'security_tool_configuration_modified', us FROM process WHERE {any_match(_CMD, V.SECURITY_TOOL_PROCEDURES)})
  SELECT type, count(*) AS n, min(us) AS first, max(us) AS last FROM x GROUP BY type""")
def a12(spark, sf):
    from ..plans.behaviours import extract_behaviours

    return extract_behaviours(P.telemetry(spark, sf)).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("start_time")).alias("first"),
        F.unix_micros(F.max("start_time")).alias("last"))


@query("a13_platforms", P.with_tables("control", "process", "rbac") + """
  SELECT 'windows' AS platform, 'system images' AS basis FROM process HAVING count(*) FILTER (lower(process_name) = 'svchost.exe') > 0
  UNION ALL SELECT 'aws', 'management rows' FROM control HAVING count(*) > 0
  UNION ALL SELECT 'kubernetes', 'audit rows' FROM rbac HAVING count(*) > 0""")
def a13(spark, sf):
    return environment.platforms(P.telemetry(spark, sf, rbac=True))


# ------------------------------------------------------------------ A14-A18


def _population_sql():
    from ..schemas import TABLE_COLUMNS, TABLE_SCHEMAS

    grant = """(resource_type LIKE 'iam:%' AND verb IN ('attach', 'detach') AND decision = 'allowed')"""
    masks = {("control", "target_actor"): grant, ("control", "role_ref"): grant,
             ("logon", "failure_reason"): "action = 'failure'", ("logon", "source_device"): "logon_type IN (3, 10)",
             ("logon", "source_ip"): "logon_type IN (3, 10)"}
    rows = []
    for t, columns in TABLE_COLUMNS.items():
        for c in columns:
            name = {"timestamp": "us", "user": '"user"'}.get(c, c)
            text = TABLE_SCHEMAS[t][c].dataType.typeName() == "string"
            filled = f"{name} <> ''" if text else f"{name} IS NOT NULL"
            mask = masks.get((t, c), "true")
            rows.append(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({filled}) AS populated, "
                        f"count(*) FILTER ({mask}) AS applicable_rows, count(*) FILTER ({mask} AND {filled}) AS applicable_populated FROM {t}")
    return P.with_tables("logon", "control", "network", "process") + " " + " UNION ALL ".join(rows)


@query("a14_a15_field_population", _population_sql())
def a14(spark, sf):
    found = coverage.field_population(P.telemetry(spark, sf))
    return found.where(~F.col("column").contains(":"))


@query("a16_channel_availability", P.with_tables("logon", "control", "network", "process") + """,
  c(channel, populated, rows, t) AS (
    SELECT 'process_execution', count(*) FILTER (process_name <> ''), count(*), 0.5 FROM process
    UNION ALL SELECT 'process_command_line', count(*) FILTER (command_line <> ''), count(*), 0.5 FROM process
    UNION ALL SELECT 'process_lineage', count(*) FILTER (parent_process_name <> ''), count(*), 0.5 FROM process
    UNION ALL SELECT 'network_flow', count(*) FILTER (remote_ip <> ''), count(*), 0.5 FROM network
    UNION ALL SELECT 'network_inbound', count(*) FILTER (direction = 'inbound'), count(*), 0.01 FROM network
    UNION ALL SELECT 'network_url', count(*) FILTER (remote_url <> ''), count(*), 0.5 FROM network
    UNION ALL SELECT 'authentication', count(*) FILTER (action <> ''), count(*), 0.5 FROM logon
    UNION ALL SELECT 'auth_source_attribution', count(*) FILTER (source_ip <> ''), count(*), 0.5 FROM logon
    UNION ALL SELECT 'cloud_control_plane', count(*) FILTER (source = 'cloudtrail'), count(*), 0.01 FROM logon
    UNION ALL SELECT 'cloud_management_activity', count(*) FILTER (source = 'cloudtrail_mgmt'), count(*), 0.01 FROM control
    UNION ALL SELECT 'container_audit', count(*) FILTER (source = 'k8s_audit'), count(*), 0.01 FROM control)
  SELECT channel, CASE WHEN populated = 0 THEN 'absent_in_data' WHEN populated / rows < t THEN 'partial' ELSE 'available' END AS state, populated, rows FROM c
  UNION ALL SELECT unnest(['handle_access', 'dns_query', 'auth_factor', 'file_events', 'registry', 'script_block', 'email']), 'absent_by_schema', 0, 0""")
def a16(spark, sf):
    return coverage.channel_availability(coverage.field_population(P.telemetry(spark, sf)))


@query("a17_rule_verdicts", P.with_tables("network") + """,
  u AS (SELECT count(*) FILTER (remote_url <> '') / count(*) AS url FROM network)
  SELECT r AS rule_id, CASE WHEN r IN ('K8S-001', 'K8S-002') THEN 'unsupported' WHEN r = 'ATH-003' AND url < 0.5 THEN 'degraded' ELSE 'supported' END AS support,
    CASE WHEN r IN ('K8S-001', 'K8S-002') THEN 'unusable' WHEN r = 'ATH-003' AND url < 0.5 THEN 'degraded' ELSE 'usable' END AS verdict
  FROM u, (SELECT unnest(['ATH-001', 'ATH-002', 'ATH-003', 'ATH-004', 'ATH-005', 'ATH-006', 'ATH-007', 'ATH-008', 'ATH-009', 'ATH-010', 'ATH-011',
    'ATH-012', 'AWS-001', 'AWS-002', 'AWS-003', 'AWS-004', 'AWS-005', 'AWS-006', 'K8S-001', 'K8S-002']) AS r)""")
def a17(spark, sf):
    found = coverage.rule_verdicts(coverage.field_population(P.telemetry(spark, sf)))
    return found.select("rule_id", "support", "verdict")


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)


def _coverage_sql() -> str:
    """The watch list and the mappings are fixed values; what they come to is stated here."""
    watch = [(t, c) for t, channels in coverage.WATCHLIST for c in channels]
    covers = sorted({(m.technique_id, m.rule_id) for m in techniques.MAPPINGS})
    return f"""
  WITH watch(technique_id, channel) AS ({_values(watch)}), covers(technique_id, rule_id) AS ({_values(covers)}),
  seen AS (SELECT technique_id, list_sort(list(DISTINCT channel) FILTER (state IN ('absent_in_data', 'absent_by_schema'))) AS missing
    FROM watch JOIN ({ORACLES['a16_channel_availability']}) USING (channel) GROUP BY 1),
  ruled AS (SELECT technique_id, list_sort(list(DISTINCT rule_id)) AS rules, bool_or(coalesce(verdict IN ('usable', 'degraded'), false)) AS credited
    FROM covers LEFT JOIN ({ORACLES['a17_rule_verdicts']}) USING (rule_id) GROUP BY 1)
  SELECT technique_id, CASE WHEN len(missing) > 0 THEN 'unobservable' WHEN rules IS NULL THEN 'observable_undetected'
    WHEN credited THEN 'detectable' ELSE 'unverifiable' END AS state, array_to_string(coalesce(rules, []), ',') AS covering_rules,
    array_to_string(coalesce(missing, []), ',') AS missing_channels FROM seen LEFT JOIN ruled USING (technique_id)"""


@query("a18_technique_coverage", _coverage_sql())
def a18(spark, sf):
    found = coverage.technique_coverage(coverage.field_population(P.telemetry(spark, sf)))
    return found.select("technique_id", "state", joined("covering_rules"), joined("missing_channels"))


@query("j18_channel_violations", P.with_tables("control") + """
  SELECT 'ATH-001' AS rule_id, event_id, 'control' AS event_type, 'channel not declared' AS reason FROM control WHERE resource_type LIKE 'cloudtrail:%' AND verb IN ('stop', 'delete')
  UNION ALL SELECT 'AWS-002', 'gone' || event_id, '', 'no such row' FROM control WHERE resource_type LIKE 'cloudtrail:%' AND verb IN ('stop', 'delete')""")
def j18(spark, sf):
    """Rules that cite their own rows, one that cites another's channel, and rows that do not exist."""
    tel = P.telemetry(spark, sf, rbac=True)
    cited = hunt.run_hunt(tel, ["ATH-001", "ATH-003", "ATH-007", "ATH-011", "AWS-002", "K8S-001"], CONFIG).evidence
    trail = cited.where("rule_id = 'AWS-002'")
    foreign = trail.withColumn("rule_id", F.lit("ATH-001"))
    gone = trail.withColumn("event_id", F.concat(F.lit("gone"), "event_id"))
    return coverage.channel_violations(cited.unionByName(foreign).unionByName(gone), tel)


# ------------------------------------------------------------------ T, M


_EGRESS = P.with_tables("network") + f""",
  h AS (SELECT * FROM network WHERE {_IMAGE} IN {inlist(V.SCRIPT_INTERPRETERS)} AND direction = 'outbound' AND {P.PUBLIC_IP_SQL}),
  f AS (SELECT 'ATH-003:' || arg_min(event_id, (us, event_id)) AS finding_id, count(*) AS n, bool_or(remote_port = 80) AS clear,
    list_sort(list(DISTINCT remote_port)) AS ports, bool_or(remote_url <> '') AS url, lower(process_name) AS img FROM h GROUP BY device, process_id, process_name, remote_ip)"""
_CONFLICTS = """SELECT lower(process_name) AS image FROM process GROUP BY 1
  HAVING count(DISTINCT nullif(signer, '')) > 1 OR (count(DISTINCT nullif(signer, '')) > 0 AND bool_or(signature_status <> 'valid'))"""
_EGRESS_FULL = _EGRESS.replace(P.with_tables("network"), P.with_tables("network", "process"), 1)


@query("t01_t06_triage_dispositions")
def t05(spark, sf):
    tel = P.telemetry(spark, sf)
    found = hunt.run_hunt(tel, ["ATH-001", "ATH-002", "ATH-003", "ATH-007"], CONFIG)
    out = triage.assess_findings(found.findings, tel)
    return out.select("finding_id", "disposition", "score", joined("vetoes"), joined("disqualifiers"),
                      F.array_join(F.transform("benign_signals", lambda s: s["name"]), ",").alias("benign_signals"))


_PRODUCT, _OFFICE = sorted(V.SECURITY_PRODUCTS)[0], sorted(V.OFFICE_APPLICATIONS)[0]


@query("t05_dispositions", P.with_tables() .rstrip(",\n") + f""",
  c AS (SELECT 'f' || n AS finding_id, k % 4 = 0 AND k % 3 <> 0 AS known, k % 4 = 1 AS office, (k % 20) / 20 AS ph, k % 9 AS pc, k % 23 = 0 OR k % 29 = 0 AS odd,
      (k * 7 % 20) / 20 AS dh, k % 5 AS di, k % 2 = 0 AS est, k % 6 = 0 AS regular, k % 5 = 0 AS evades, k % 5 > 1 AS quiet, k % 7 = 0 AS loads, k % 3 = 1 AS tls,
      k % 11 = 0 AS clear, k % 13 <> 0 AND k % 8 >= 5 AS often, k % 4 + 1 > 2 AS high FROM ev),
  s AS (SELECT *, known OR (ph >= 0.5 AND pc >= 5) OR (dh >= 0.5 AND di >= 3 AND est) AS affirmed,
      list_filter([CASE WHEN known THEN 'known_management_tool' END, CASE WHEN NOT known AND ph >= 0.5 AND pc >= 5 THEN 'established_tooling' END,
        CASE WHEN dh >= 0.5 AND di >= 3 AND est THEN 'ubiquitous_destination' END, CASE WHEN quiet THEN 'no_evasion_indicators' END,
        CASE WHEN NOT loads THEN 'no_download_indicators' END, CASE WHEN tls AND NOT clear THEN 'encrypted_standard_port' END], lambda x: x IS NOT NULL) AS good,
      list_filter([CASE WHEN evades THEN 'evasion_flags_present' END, CASE WHEN loads THEN 'download_indicators_present' END,
        CASE WHEN office THEN 'office_application_parent' END, CASE WHEN clear THEN 'cleartext_external_retrieval' END,
        CASE WHEN often THEN 'sustained_interpreter_contact' END, CASE WHEN odd THEN 'process_identity_conflict' END,
        CASE WHEN high THEN 'graded_high_by_detection' END], lambda x: x IS NOT NULL) AS bad FROM c),
  w AS (SELECT *, CASE WHEN known THEN 3 ELSE 0 END + CASE WHEN NOT known AND ph >= 0.5 AND pc >= 5 THEN 2 ELSE 0 END
      + CASE WHEN dh >= 0.5 AND di >= 3 AND est THEN 3 ELSE 0 END + CASE WHEN quiet THEN 2 ELSE 0 END + CASE WHEN NOT loads THEN 2 ELSE 0 END
      + CASE WHEN tls AND NOT clear THEN 1 ELSE 0 END AS score FROM s)
  SELECT finding_id, array_to_string(good, ',') AS benign_signals, array_to_string(bad, ',') AS vetoes,
    CASE WHEN regular THEN 'suspiciously_regular_contact' ELSE '' END AS disqualifiers, score,
    CASE WHEN len(bad) > 0 THEN 'likely_malicious' WHEN regular THEN 'needs_review' WHEN score >= 4 AND affirmed THEN 'likely_benign' ELSE 'needs_review' END AS disposition
  FROM w""")
def t05_dispositions(spark, sf):
    """Every signal, veto and disqualifier in all their combinations, from facts made of ``k``."""
    k, none = F.col("k"), F.array().cast("array<string>")
    context = P.events(spark, sf).select(
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("finding_id"), F.lit("R").alias("rule_id"),
        F.when(k % 4 == 0, _PRODUCT).when(k % 4 == 1, _OFFICE).when(k % 4 == 2, "tool.exe").alias("_parent"), (k % 3 != 0).alias("parent_signed"),
        (k % 20).alias("parent_hosts"), (k % 9).alias("parent_children"), (k % 23 == 0).alias("parent_conflict"), (k % 29 == 0).alias("own_conflict"),
        (k * 7 % 20).alias("destination_hosts"), (k % 5).alias("destination_images"), (k % 2 == 0).alias("destination_established"), (k % 6 == 0).alias("is_regular"),
        F.when(k % 5 == 0, F.array(F.lit("hidden"))).when(k % 5 > 1, none).alias("evasion_flags"),
        F.when(k % 7 == 0, F.array(F.lit("http"))).otherwise(none).alias("download_indicators"),
        F.when(k % 3 == 1, F.array(F.lit(443).cast("long"))).when(k % 3 == 2, F.array(F.lit(80).cast("long"), F.lit(443).cast("long"))).alias("ports"),
        (k % 11 == 0).alias("cleartext_http"), F.when(k % 13 != 0, k % 8).alias("connection_count"), (k % 4 + 1).alias("severity_rank"), F.lit(20).alias("_hosts"))
    out = triage.dispose(context)
    return out.select("finding_id", "disposition", "score", joined("vetoes"), joined("disqualifiers"),
                      F.array_join(F.transform("benign_signals", lambda s: s["name"]), ",").alias("benign_signals"))


@query("t02_egress_vetoes", _EGRESS_FULL + f"""
  SELECT finding_id, array_to_string(list_filter([CASE WHEN clear THEN 'cleartext_external_retrieval' END,
    CASE WHEN n >= 5 THEN 'sustained_interpreter_contact' END, CASE WHEN img IN ({_CONFLICTS}) THEN 'process_identity_conflict' END,
    CASE WHEN clear THEN 'graded_high_by_detection' END], lambda x: x IS NOT NULL), ',') AS vetoes FROM f""")
def t02(spark, sf):
    tel = P.telemetry(spark, sf)
    out = triage.assess_findings(REGISTRY["ATH-003"].run(tel, CONFIG).findings, tel)
    return out.select("finding_id", joined("vetoes"))


@query("t04_identity_conflicts", P.with_tables("process") + """
  SELECT lower(process_name) AS image, count(DISTINCT nullif(signer, '')) AS signers FROM process GROUP BY 1
  HAVING count(DISTINCT nullif(signer, '')) > 1 OR (count(DISTINCT nullif(signer, '')) > 0 AND bool_or(signature_status <> 'valid'))""")
def t04(spark, sf):
    profiles = environment.process_profiles(P.processes(P.events(spark, sf)))
    return environment.identity_conflicts(profiles).select("image", "signers")


@query("t06_triage_summary", _EGRESS + """,
  d AS (SELECT CASE WHEN clear OR n >= 5 THEN 'likely_malicious' ELSE 'other' END AS disposition FROM f)
  SELECT disposition, count(*) AS findings FROM d WHERE disposition = 'likely_malicious' GROUP BY 1""")
def t06(spark, sf):
    tel = P.telemetry(spark, sf)
    found = REGISTRY["ATH-003"].run(tel, CONFIG).findings.withColumn("process_name", F.lit(None).cast("string"))
    summary = triage.triage_summary(triage.assess_findings(found, tel))
    return summary.where("disposition = 'likely_malicious'")


@query("m01_egress_techniques", _EGRESS + """
  SELECT finding_id, 'T1071.001' AS technique_id, 'medium' AS confidence FROM f WHERE len(list_intersect(ports, [80, 443, 8080, 8443])) > 0
  UNION ALL SELECT finding_id, 'T1105', 'medium' FROM f WHERE clear OR url""")
def m01(spark, sf):
    found = REGISTRY["ATH-003"].run(P.telemetry(spark, sf), CONFIG).findings
    return techniques.map_techniques(found).select("finding_id", "technique_id", "confidence")


@query("m01_office_techniques", P.with_tables("process") + f""",
  f AS (SELECT 'ATH-001:' || event_id AS finding_id, {_IMAGE} AS img FROM process WHERE {_PARENT} IN {inlist(V.OFFICE_APPLICATIONS)} AND {_IMAGE} IN {inlist(V.SCRIPT_INTERPRETERS)})
  SELECT finding_id, 'T1204.002' AS technique_id, 'medium' AS confidence FROM f
  UNION ALL SELECT finding_id, 'T1059.001', 'high' FROM f WHERE img IN ('powershell.exe', 'pwsh.exe')
  UNION ALL SELECT finding_id, 'T1059.003', 'high' FROM f WHERE img = 'cmd.exe'""")
def m01_office(spark, sf):
    found = REGISTRY["ATH-001"].run(P.telemetry(spark, sf), CONFIG).findings
    return techniques.map_techniques(found).select("finding_id", "technique_id", "confidence")


@query("m02_unknown_techniques", P.with_tables("network") + """
  SELECT DISTINCT 'T9' || (remote_port % 7) AS technique_id FROM network WHERE remote_port IS NOT NULL""")
def m02(spark, sf):
    """Techniques of real findings are known; made-up ids beside them are not."""
    tel = P.telemetry(spark, sf)
    found = techniques.map_techniques(hunt.run_hunt(tel, ["ATH-001", "ATH-003", "ATH-011"], CONFIG).findings)
    made = tel.network.where("remote_port IS NOT NULL").select(
        F.concat(F.lit("T9"), (F.col("remote_port") % 7).cast("string")).alias("technique_id"))
    return techniques.unknown_techniques(found.select("technique_id").unionByName(made))


@query("m03_tactics_by_rule", P.with_tables("process") + f"""
  SELECT 'ATH-011' AS rule_id, 'T1490' AS techniques, 'Impact' AS tactics FROM process HAVING bool_or({any_match(_CMD, V.RECOVERY_PROCEDURES)})
  UNION ALL SELECT 'ATH-012', 'T1685', 'Defense Impairment' FROM process HAVING bool_or({any_match(_CMD, V.SECURITY_TOOL_PROCEDURES)})""")
def m03(spark, sf):
    found = hunt.run_hunt(P.telemetry(spark, sf), ["ATH-011", "ATH-012"], CONFIG).findings
    out = techniques.tactics_covered(techniques.map_techniques(found), ["rule_id"])
    return out.select("rule_id", joined("techniques"), joined("tactics"))


# ------------------------------------------------------------------ C

_LINK_RULES = ["ATH-001", "ATH-007", "AWS-002"]
# Findings of three single-row rules; the wide gap makes their sparse rows meet.
_LINK_CONFIG = correlate.CorrelationConfig(
    max_gap=timedelta(hours=12), tight_window=timedelta(hours=2), auth_exec_window=timedelta(hours=12),
    cross_domain_window=timedelta(hours=12), sibling_window=timedelta(hours=12),
    max_session_span=timedelta(days=40), max_session_fan_out=1000)
_NODES = P.with_tables("process", "control", recursive=True) + f""",
  nodes AS (SELECT 'ATH-001:' || event_id AS id, 'ATH-001' AS rule, device, "user" AS u, us, 3 AS sev, 'endpoint' AS fam, "user" AS p1, CAST(NULL AS VARCHAR) AS p2,
      process_guid AS g, process_id AS pid, parent_process_guid AS pg, parent_process_id AS ppid FROM process WHERE {_PARENT} IN {inlist(V.OFFICE_APPLICATIONS)} AND {_IMAGE} IN {inlist(V.SCRIPT_INTERPRETERS)}
    UNION ALL SELECT 'ATH-007:' || event_id, 'ATH-007', device, "user", us, CASE WHEN regexp_matches(command_line, {lit(V.ADMIN_SHARE_REDIRECT)}) THEN 3 ELSE 2 END, 'endpoint', "user", NULL,
      process_guid, process_id, parent_process_guid, parent_process_id FROM process WHERE {_PARENT} = 'services.exe' AND {_IMAGE} IN {inlist(V.SERVICE_SHELLS)}
    UNION ALL SELECT 'AWS-002:' || event_id, 'AWS-002', device, actor, us, 4, 'control_plane', actor, target_actor, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)
      FROM control WHERE resource_type LIKE 'cloudtrail:%' AND verb IN ('stop', 'delete')),
  pairs AS (SELECT a.*, b.*, b.us - a.us AS gap,
      (a.g <> '' AND b.g <> '' AND a.g = b.g) OR (NOT (a.g <> '' AND b.g <> '') AND a.device = b.device AND a.pid = b.pid) AS same_process,
      (a.g <> '' AND b.pg <> '' AND a.g = b.pg) OR (NOT (a.g <> '' AND b.pg <> '') AND a.device = b.device AND a.pid = b.ppid)
        OR (b.g <> '' AND a.pg <> '' AND b.g = a.pg) OR (NOT (b.g <> '' AND a.pg <> '') AND a.device = b.device AND b.pid = a.ppid) AS lineage,
      (a.pg <> '' AND b.pg <> '' AND a.pg = b.pg) OR (NOT (a.pg <> '' AND b.pg <> '') AND a.device = b.device AND a.ppid = b.ppid) AS sibling,
      a.fam <> b.fam AND (a.p1 = b.p1 OR coalesce(a.p1 = b.p2, false) OR coalesce(a.p2 = b.p1, false)) AS principal
    FROM nodes a JOIN nodes b ON (a.us, a.rule, a.id) < (b.us, b.rule, b.id) AND b.us - a.us <= {12 * H}),
  scored AS (SELECT id AS left_id, id_1 AS right_id, CASE WHEN same_process THEN 3 ELSE 0 END + CASE WHEN lineage THEN 3 ELSE 0 END
      + CASE WHEN sibling THEN 2 ELSE 0 END + CASE WHEN principal THEN 3 ELSE 0 END
      + CASE WHEN device = device_1 THEN 2 ELSE 0 END + CASE WHEN u = u_1 THEN 2 ELSE 0 END + CASE WHEN gap <= {2 * H} THEN 2 ELSE 1 END AS score
    FROM pairs WHERE coalesce(same_process, false) OR coalesce(lineage, false) OR coalesce(sibling, false) OR coalesce(principal, false)),
  links AS (SELECT * FROM scored WHERE score >= 5)"""
_GROUPS = """,
  both_ways AS (SELECT left_id AS x, right_id AS y FROM links UNION SELECT right_id, left_id FROM links),
  reach(x, y) AS (SELECT id, id FROM nodes UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
  comp AS (SELECT x AS id, min(y) AS component FROM reach GROUP BY x)"""


def _linked(spark, sf):
    tel = P.telemetry(spark, sf)
    found = hunt.run_hunt(tel, _LINK_RULES, CONFIG)
    return found, correlate.link_findings(found.findings, found.evidence, tel, _LINK_CONFIG)


@query("c05_c07_links", _NODES + " SELECT left_id, right_id, score FROM links")
def c07(spark, sf):
    return _linked(spark, sf)[1].select("left_id", "right_id", "score")


@query("c08_components", _NODES + _GROUPS + " SELECT id AS finding_id, component FROM comp")
def c08(spark, sf):
    from ..operators.components import connected_components

    found, links = _linked(spark, sf)
    return connected_components(found.findings, links, "finding_id", "left_id", "right_id")


@query("c08_spanning_components", _NODES + _GROUPS + " SELECT id AS finding_id, component FROM comp")
def c08_spanning(spark, sf):
    from ..operators.components import connected_components

    tel = P.telemetry(spark, sf)
    found = hunt.run_hunt(tel, _LINK_RULES, CONFIG)
    links = hubs.spanning_links(found.findings, found.evidence, tel, _LINK_CONFIG)
    return connected_components(found.findings, links, "finding_id", "left_id", "right_id")


@query("c09_c11_cases", _NODES + _GROUPS + """,
  g AS (SELECT component, min((us, rule, id)) AS first, count(*) AS n, max(sev) AS sev FROM nodes JOIN comp USING (id) GROUP BY 1),
  k AS (SELECT component, row_number() OVER (ORDER BY first) AS i FROM g WHERE n >= 2 OR sev >= 3)
  SELECT 'CASE-' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS case_id, id AS finding_id FROM k JOIN comp USING (component)""")
def c09(spark, sf):
    found, links = _linked(spark, sf)
    return correlate.group_cases(found.findings, links, config=_LINK_CONFIG)


_CASES = _NODES + _GROUPS + f""",
  g AS (SELECT component, min((us, rule, id)) AS first, count(*) AS n, max(sev) AS sev FROM nodes JOIN comp USING (id) GROUP BY 1),
  k AS (SELECT component, row_number() OVER (ORDER BY first) AS i FROM g WHERE n >= 2 OR sev >= 3),
  img AS (SELECT event_id, {_IMAGE} AS image, regexp_matches(command_line, {lit(V.ADMIN_SHARE_REDIRECT)}) AS redirect FROM process),
  mem AS (SELECT 'CASE-' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS case_id, nodes.*,
    list_sort(list_filter(CASE rule
      WHEN 'ATH-001' THEN ['T1204.002', CASE WHEN image IN ('powershell.exe', 'pwsh.exe') THEN 'T1059.001' END, CASE WHEN image = 'cmd.exe' THEN 'T1059.003' END]
      WHEN 'ATH-007' THEN ['T1569.002', CASE WHEN redirect THEN 'T1021.002' END] ELSE ['T1685'] END, lambda t: t IS NOT NULL)) AS techniques
    FROM k JOIN comp USING (component) JOIN nodes USING (id) LEFT JOIN img ON event_id = split_part(id, ':', 2))"""
_GRADES = "['low', 'medium', 'high', 'critical']"
_PRIMARY = _values([(t, tactics[0], str(techniques.TACTIC_ORDER.index(tactics[0])).zfill(2)) for t, (_, tactics, _) in techniques.TECHNIQUES.items()])


@query("c10_c13_case_attributes", _CASES + f""",
  prim(t, tactic, pos) AS ({_PRIMARY}),
  tac AS (SELECT case_id, string_agg(tactic, ',' ORDER BY pos) AS tactics, string_agg(tactic, ' -> ' ORDER BY pos) AS told, count(*) AS breadth
    FROM (SELECT DISTINCT case_id, tactic, pos FROM (SELECT case_id, unnest(techniques) AS t FROM mem) JOIN prim USING (t)) GROUP BY 1),
  inside AS (SELECT case_id, count(*) AS n FROM links JOIN mem ON left_id = id GROUP BY 1),
  basic AS (SELECT case_id, min(us) AS start_time, count(*) AS findings, list_sort(list(DISTINCT device)) AS hosts, list_sort(list(DISTINCT u)) AS people,
    string_agg(DISTINCT rule, ',' ORDER BY rule) AS rule_ids, {_GRADES}[max(sev)] AS severity, count(DISTINCT split_part(id, ':', 2)) AS events FROM mem GROUP BY 1),
  full_rows AS (SELECT *, coalesce(n, 0) AS strength, CASE WHEN findings = 1 THEN 'low' WHEN breadth >= 4 AND coalesce(n, 0) >= 3 THEN 'high'
    WHEN breadth >= 2 AND coalesce(n, 0) >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM basic LEFT JOIN tac USING (case_id) LEFT JOIN inside USING (case_id))
  SELECT case_id, start_time, findings, array_to_string(hosts, ',') AS devices, array_to_string(people, ',') AS users, rule_ids, severity, tactics, confidence, events,
    CASE WHEN findings = 1 THEN case_id || ': one ' || severity || ' finding, raised on its own severity'
      ELSE case_id || ': ' || findings || ' findings on ' || array_to_string(hosts, ', ') || ' by ' || array_to_string(people, ', ') END
    || '; tactics ' || told || CASE WHEN strength > 0 THEN '; ' || strength || ' of ' || strength || ' links structural' ELSE '' END
    || '; grouping confidence ' || confidence || ', ' || events || ' events' AS explanation FROM full_rows""")
def c10(spark, sf):
    found, links = _linked(spark, sf)
    members = correlate.group_cases(found.findings, links, config=_LINK_CONFIG)
    out = correlate.case_attributes(members, found.findings, links, found.evidence)
    return out.select("case_id", us("start_time"), "findings", joined("devices"), joined("users"),
                      joined("rule_ids"), "severity", joined("tactics"), "confidence", "events",
                      correlate.explain_case().alias("explanation"))


@query("c12_case_timeline", _CASES + f"""
  SELECT case_id, us AS "timestamp", id AS finding_id, rule AS rule_id, {_GRADES}[sev] AS severity, array_to_string(techniques, ',') AS techniques FROM mem""")
def c12(spark, sf):
    found, links = _linked(spark, sf)
    members = correlate.group_cases(found.findings, links, config=_LINK_CONFIG)
    return correlate.case_timeline(members, found.findings).select(
        "case_id", us("timestamp"), "finding_id", "rule_id", "severity", joined("techniques"))


@query("c14_correlation_stats", _NODES + """
  SELECT signal, count(*) AS links FROM (SELECT unnest([CASE WHEN same_process THEN 'same_process' END, CASE WHEN lineage THEN 'process_lineage' END,
    CASE WHEN sibling THEN 'sibling_lineage' END, CASE WHEN principal THEN 'shared_principal' END, CASE WHEN device = device_1 THEN 'same_device' END,
    CASE WHEN u = u_1 THEN 'same_user' END, CASE WHEN gap <= 7200000000 THEN 'temporal_close' ELSE 'temporal_near' END]) AS signal
    FROM pairs JOIN links ON left_id = id AND right_id = id_1) WHERE signal IS NOT NULL GROUP BY 1""")
def c14(spark, sf):
    return correlate.correlation_stats(_linked(spark, sf)[1]).select("signal", "links")


@query("c01_c02_session_parents", P.with_tables("process") + """
  SELECT device, parent_process_id AS pid, count(DISTINCT CASE WHEN process_guid <> '' THEN process_guid ELSE 'pid' || process_id END) AS fan_out,
    max(us) - min(us) AS span_us FROM process WHERE parent_process_guid = '' GROUP BY ALL""")
def c01(spark, sf):
    from ..functions.identity import instance_tag

    rows = P.processes(P.events(spark, sf)).where("parent_process_guid = ''")
    child = instance_tag(F.col("process_guid"), F.col("device"), F.col("process_id"))
    return rows.groupBy("device", F.col("parent_process_id").alias("pid")).agg(
        F.countDistinct(child).alias("fan_out"),
        (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))).alias("span_us"))


@query("c04_principals", P.with_tables("control") + """
  SELECT DISTINCT 'AWS-002:' || event_id AS finding_id, unnest([actor, target_actor]) AS principal FROM control
  WHERE resource_type LIKE 'cloudtrail:%' AND verb IN ('stop', 'delete')""")
def c04(spark, sf):
    return correlate.principals(REGISTRY["AWS-002"].run(P.telemetry(spark, sf), CONFIG).evidence)


@query("j15_candidate_pairs", P.with_tables("process") + f""",
  f AS (SELECT event_id AS id, device, us FROM process WHERE {any_match(_CMD, V.RECOVERY_PROCEDURES)})
  SELECT least(a.id, b.id) AS left_id, greatest(a.id, b.id) AS right_id, abs(a.us - b.us) AS gap_us
  FROM f a JOIN f b ON a.id < b.id AND a.device = b.device AND abs(a.us - b.us) <= {6 * H}""")
def j15(spark, sf):
    from ..functions.commands import any_of

    rows = P.processes(P.events(spark, sf)).where(any_of(F.col("command_line"), V.RECOVERY_PROCEDURES))
    nodes = rows.select("device", F.col("event_id").alias("finding_id"),
                        F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_seen"))
    return correlate.candidate_pairs(nodes, ["device"], timedelta(hours=6))


