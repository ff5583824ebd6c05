"""Queries over statistics, retrieval, scoring and comparison."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import instances, lifetimes
from ..plans import correlate, evaluate, hunt, retrieve, statistics, techniques, triage
from ..plans.rules import REGISTRY
from . import projection as P
from .hunting import CONFIG, H, _CMD, _FOREIGN, _IMAGE, _PARENT, inlist, lit
from .measuring import _EGRESS, _GROUPS, _LINK_CONFIG, _NODES, _linked
from .registry import joined, query, us
from .. import vocab as V

_CLASSES = """c AS (SELECT *, split_part(resource_type, ':', 1) AS service, verb IN ('get', 'list', 'describe') AS is_read,
    resource_type LIKE 'iam:%' AND verb NOT IN ('get', 'list', 'describe') AS moves FROM control)"""
# Windows that give values above one on the driver tables.
WINDOWS = (timedelta(hours=24), timedelta(hours=96))
_STAT_ROWS = {
    "read_services": ("is_read", "service"), "read_resource_types": ("is_read", "resource_type"),
    "denied_calls": ("decision = 'denied'", None), "denied_resource_types": ("decision = 'denied'", "resource_type"),
    "failed_identity_authority_changes": ("moves AND decision = 'failed'", None),
    "identity_delete_revoke_changes": ("moves AND verb IN ('delete', 'detach')", None),
}


def _values_sql() -> str:
    parts = []
    for window in WINDOWS:
        span, minutes = int(window.total_seconds()) * 1_000_000, int(window.total_seconds() // 60)
        for name, (where, column) in _STAT_ROWS.items():
            measure = f"count(DISTINCT b.{column})" if column else "count(*)"
            parts.append(f"""SELECT {minutes} AS minutes, '{name}' AS statistic, a.actor, a.us, {measure} AS value
      FROM (SELECT * FROM c WHERE {where}) a JOIN (SELECT * FROM c WHERE {where}) b
      ON a.actor = b.actor AND b.us BETWEEN a.us - {span} AND a.us GROUP BY a.actor, a.event_id, a.us""")
    return f"{_CLASSES}, v AS ({' UNION ALL '.join(parts)})"


def _stat_names() -> str:
    return "[" + ", ".join(lit(n) for n in _STAT_ROWS) + "]"


_ACTORS = f"""{_values_sql()},
  best AS (SELECT actor, minutes, statistic, max(value) AS best FROM v GROUP BY ALL),
  grid AS (SELECT actor, unnest([1440, 5760]) AS minutes FROM (SELECT DISTINCT actor FROM control)),
  cells AS (SELECT actor, minutes, unnest({_stat_names()}) AS statistic FROM grid),
  actors AS (SELECT cells.*, coalesce(best, 0) AS best FROM cells LEFT JOIN best USING (actor, minutes, statistic))"""


@query("a21_actor_statistics", P.with_tables("control") + f", {_ACTORS} SELECT actor, minutes, statistic, best FROM actors")
def a21(spark, sf):
    return statistics.actor_statistics(P.controls(P.events(spark, sf)), WINDOWS).select("actor", "minutes", "statistic", "best")


@query("a21_actor_profile", P.with_tables("control") + """
  SELECT actor, count(*) AS rows, min(us) AS first, max(us) AS last, count(DISTINCT us // 86400000000) AS days_active,
    count(*) FILTER (decision = 'allowed') AS allowed, count(*) FILTER (decision = 'denied') AS denied,
    count(*) FILTER (decision = 'failed') AS failed FROM control GROUP BY actor""")
def a21_profile(spark, sf):
    out = statistics.actor_profile(P.controls(P.events(spark, sf)))
    return out.select("actor", "rows", us("first"), us("last"), "days_active", "allowed", "denied", "failed")


@query("a22_distributions", P.with_tables("control") + f""", {_ACTORS}
  SELECT minutes, statistic, count(*) AS actors, round(quantile_cont(best, 0.5), 6) AS p50, round(quantile_cont(best, 0.9), 6) AS p90,
    round(quantile_cont(best, 0.99), 6) AS p99, max(best) AS max FROM actors GROUP BY minutes, statistic""")
def a22(spark, sf):
    out = statistics.distributions(statistics.actor_statistics(P.controls(P.events(spark, sf)), WINDOWS))
    return out.select("minutes", "statistic", "actors", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")], "max")


_GRID = {"read_services": (2, 3), "denied_calls": (2, 3, 4), "identity_delete_revoke_changes": (1, 2)}


@query("a23_threshold_grid", P.with_tables("control") + f""", {_values_sql()},
  t AS (SELECT m AS minutes, s AS statistic, n AS threshold FROM (SELECT unnest([1440, 5760]) AS m),
    (VALUES {", ".join(f"('{s}', {n})" for s, ns in _GRID.items() for n in ns)}) x(s, n))
  SELECT minutes, statistic, threshold, count(DISTINCT actor) AS actors, count(DISTINCT CASE WHEN actor IS NOT NULL THEN (actor, us // 86400000000) END) AS actor_days
  FROM t LEFT JOIN v USING (minutes, statistic) WHERE coalesce(value, 0) >= threshold GROUP BY ALL
  UNION ALL SELECT minutes, statistic, threshold, 0, 0 FROM t WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.minutes = t.minutes AND v.statistic = t.statistic AND value >= threshold)""")
def a23(spark, sf):
    return statistics.threshold_grid(P.controls(P.events(spark, sf)), WINDOWS, _GRID)


@query("a24_top_actors", P.with_tables("control") + f""", {_ACTORS}
  SELECT * FROM (SELECT actor, minutes, statistic, best, row_number() OVER (PARTITION BY minutes, statistic ORDER BY best DESC, actor) AS rank FROM actors) WHERE rank <= 10""")
def a24(spark, sf):
    actors = statistics.actor_statistics(P.controls(P.events(spark, sf)), WINDOWS)
    return statistics.top_actors(actors).select("actor", "minutes", "statistic", "best", "rank")


@query("a20_control_shape", P.with_tables("control") + """,
  n AS (SELECT *, CASE WHEN verb IN ('get', 'list', 'describe') THEN 'read' WHEN verb = 'attach' THEN 'grant' WHEN verb = 'detach' THEN 'revoke'
    WHEN verb = 'update' THEN 'modify' ELSE verb END AS cls FROM control)
  SELECT 'decision' AS measure, decision AS value, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT 'verb_class', cls, count(*) FROM n GROUP BY ALL
  UNION ALL SELECT 'verb', verb, count(*) FROM n GROUP BY ALL UNION ALL SELECT 'resource_type', resource_type, count(*) FROM n GROUP BY ALL
  UNION ALL SELECT 'filled', unnest(['target_actor', 'role_ref', 'resource_name', 'actor_groups', 'source_ip']), unnest([count(*) FILTER (target_actor <> ''),
    count(*) FILTER (role_ref <> ''), count(*) FILTER (resource_name <> ''), count(*) FILTER (actor_groups <> ''), count(*) FILTER (source_ip <> '')]) FROM n""")
def a20(spark, sf):
    return statistics.control_shape(P.controls(P.events(spark, sf)))


@query("a25_identity_population", P.with_tables("process") + """
  SELECT source, CASE WHEN process_guid = '' THEN '' ELSE 'sysmon' END AS scheme, count(*) AS rows FROM process GROUP BY ALL""")
def a25(spark, sf):
    return statistics.identity_population(P.processes(P.events(spark, sf)))


@query("a26_auth_history", P.with_tables("logon") + """
  SELECT "user", count(*) AS total, count(*) FILTER (action <> 'success') AS failures, count(DISTINCT source_ip) AS source_ips,
    count(DISTINCT source_device) AS source_devices, count(DISTINCT device) AS targets,
    array_to_string(list_sort(list(DISTINCT logon_type)), ',') AS logon_types, min(us) AS first_seen FROM logon GROUP BY "user" """)
def a26(spark, sf):
    out = retrieve.auth_history(P.logons(P.events(spark, sf)))
    return out.select("user", "total", "failures", "source_ips", "source_devices", "targets", joined("logon_types"), us("first_seen"))


@query("a27_host_network_activity", P.with_tables("network") + """,
  c AS (SELECT device, remote_ip, process_name, count(*) AS connections, count(DISTINCT nullif(process_guid, '')) AS instances FROM network GROUP BY ALL)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY connections DESC, remote_ip, process_name) AS rank FROM c) WHERE rank <= 15""")
def a27(spark, sf):
    return retrieve.host_network_activity(P.network(P.events(spark, sf))).drop("pids")


@query("a28_beacon_report", P.with_tables("network") + """,
  g AS (SELECT device, remote_ip, us - lag(us) OVER (PARTITION BY device, remote_ip ORDER BY us) AS gap FROM network),
  m AS (SELECT device, remote_ip, median(gap) AS med, count(gap) AS n FROM g GROUP BY ALL),
  d AS (SELECT device, remote_ip, median(abs(gap - med)) AS mad FROM g JOIN m USING (device, remote_ip) WHERE gap IS NOT NULL GROUP BY ALL)
  SELECT device, remote_ip, n + 1 AS connection_count, CASE WHEN n < 3 OR med = 0 THEN 'too few' WHEN mad / med < 0.15 AND med > 5e6 THEN 'regular' ELSE 'irregular' END AS verdict
  FROM m LEFT JOIN d USING (device, remote_ip)""")
def a28(spark, sf):
    out = retrieve.beacon_report(P.network(P.events(spark, sf)))
    return out.select("device", "remote_ip", "connection_count", "verdict")


def _counted(keys, columns):
    return " UNION ALL ".join(
        f"SELECT {keys}, '{c}' AS attribute, CASE WHEN {c} = '' THEN '?' ELSE {c} END AS value, count(*) AS n FROM control GROUP BY ALL" for c in columns)


@query("a29_actor_history", P.with_tables("control") + " " + _counted("actor", ("verb", "resource_type", "decision", "source_ip")))
def a29(spark, sf):
    return retrieve.actor_history(P.controls(P.events(spark, sf)))


@query("a30_resource_history", P.with_tables("control") + " " + _counted("resource_type, resource_name, resource_namespace", ("actor", "verb", "decision")))
def a30(spark, sf):
    return retrieve.resource_history(P.controls(P.events(spark, sf)))


def _span_sql(keys):
    return P.with_tables("control") + f" SELECT {keys}, count(*) AS rows, min(us) AS first_seen, max(us) AS last_seen, (max(us) - min(us)) / 1e6 AS span_seconds FROM control GROUP BY {keys}"


@query("a29_actor_span", _span_sql("actor"))
def a29_span(spark, sf):
    out = retrieve.history_span(P.controls(P.events(spark, sf)), ["actor"])
    return out.select("actor", "rows", us("first_seen"), us("last_seen"), "span_seconds")


@query("a30_resource_span", _span_sql("resource_type, resource_name, resource_namespace"))
def a30_span(spark, sf):
    keys = ["resource_type", "resource_name", "resource_namespace"]
    return retrieve.history_span(P.controls(P.events(spark, sf)), keys).select(*keys, "rows", us("first_seen"), us("last_seen"), "span_seconds")


@query("a31_identity_grants", P.with_tables("rbac") + """,
  g AS (SELECT target_actor AS identity, event_id, us FROM rbac WHERE verb = 'create' AND resource_type IN ('rolebindings', 'clusterrolebindings') AND target_actor <> ''),
  f AS (SELECT identity, min(us) AS first FROM g GROUP BY 1)
  SELECT identity, 'grant' AS kind, event_id FROM g UNION ALL
  SELECT actor, 'use', event_id FROM rbac LEFT JOIN f ON actor = identity WHERE resource_type = 'pods/exec' AND (first IS NULL OR us >= first)""")
def a31(spark, sf):
    return retrieve.identity_grants(P.rbac_controls(P.events(spark, sf))).select("identity", "kind", "event_id")


# ------------------------------------------------------------------ J04-J22


_JOINED = """(a.g <> '' AND b.g <> '' AND a.g = b.g) OR (NOT (a.g <> '' AND b.g <> '') AND a.device = b.device AND a.pid = b.pid)"""


@query("j04_j05_network_to_process", P.with_tables("network", "process") + f""",
  a AS (SELECT event_id, process_guid AS g, device, process_id AS pid FROM network), b AS (SELECT event_id, process_guid AS g, device, process_id AS pid FROM process)
  SELECT a.event_id AS net_event_id, b.event_id AS proc_event_id, NOT (a.g <> '' AND b.g <> '' AND a.g = b.g) AS inferred FROM a JOIN b ON {_JOINED}""")
def j05(spark, sf):
    ev = P.events(spark, sf)
    return instances.network_to_process(P.network(ev), P.processes(ev))


_PARENT_CTES = """,
  byid AS (SELECT process_guid AS g, arg_min(event_id, (us, event_id)) AS pe FROM process WHERE process_guid <> '' GROUP BY 1),
  slot AS (SELECT device, process_id AS pid, count(DISTINCT process_guid) AS held, arg_min(event_id, (us, event_id)) AS pe FROM process GROUP BY ALL),
  par AS (SELECT p.event_id, CASE WHEN p.parent_process_guid <> '' THEN byid.pe WHEN held = 1 THEN slot.pe END AS parent_event_id,
    CASE WHEN p.parent_process_guid <> '' THEN CASE WHEN byid.pe IS NULL THEN 'gap' ELSE 'identity' END
      WHEN held IS NULL THEN 'gap' WHEN held = 1 THEN 'inferred' ELSE 'ambiguous' END AS status
    FROM process p LEFT JOIN byid ON p.parent_process_guid <> '' AND byid.g = p.parent_process_guid
      LEFT JOIN slot ON slot.device = p.device AND slot.pid = p.parent_process_id)"""


@query("j06_resolve_parent", P.with_tables("process") + _PARENT_CTES + " SELECT * FROM par")
def j06(spark, sf):
    procs = P.processes(P.events(spark, sf))
    return instances.resolve_parent(procs, procs).select("event_id", "parent_event_id", "status")


@query("j07_ancestry", P.with_tables("process", recursive=True) + _PARENT_CTES + f""",
  walk AS (SELECT event_id AS seed_id, 0 AS hop, event_id, [event_id] AS path FROM process WHERE {_IMAGE} = 'whoami.exe'
    UNION ALL SELECT seed_id, hop + 1, parent_event_id, list_append(path, parent_event_id) FROM walk JOIN par USING (event_id)
      WHERE hop < 3 AND parent_event_id IS NOT NULL AND NOT list_contains(path, parent_event_id))
  SELECT seed_id, hop, event_id FROM walk WHERE hop > 0""")
def j07(spark, sf):
    procs = P.processes(P.events(spark, sf))
    return instances.ancestry(procs.where("lower(process_name) = 'whoami.exe'"), procs).select("seed_id", "hop", "event_id")


@query("j08_children", P.with_tables("process") + f""",
  a AS (SELECT event_id, process_guid AS g, device, process_id AS pid FROM process WHERE {_PARENT} IN {inlist(V.OFFICE_APPLICATIONS)}),
  b AS (SELECT event_id, parent_process_guid AS g, device, parent_process_id AS pid FROM process)
  SELECT a.event_id AS seed_id, b.event_id, NOT (a.g <> '' AND b.g <> '' AND a.g = b.g) AS inferred FROM a JOIN b ON {_JOINED}""")
def j08(spark, sf):
    procs = P.processes(P.events(spark, sf))
    return instances.children(procs.where(F.lower("parent_process_name").isin(*V.OFFICE_APPLICATIONS)), procs)


# Who held the slot: its latest start at or before the row (for a child, before it).
_HELD = """coalesce(NOT (a.g <> '' AND b.g <> ''), true)"""


@query("j05_network_to_holder", P.with_tables("network", "process") + f""",
  a AS (SELECT event_id, us, process_guid AS g, device, process_id AS pid FROM network), b AS (SELECT event_id, us, process_guid AS g, device, process_id AS pid FROM process),
  st AS (SELECT device, pid, us, max(event_id) AS event_id FROM b GROUP BY ALL)
  SELECT a.event_id AS net_event_id, b.event_id AS proc_event_id, false AS inferred FROM a JOIN b ON a.g <> '' AND a.g = b.g
  UNION ALL SELECT a.event_id, st.event_id, true FROM a ASOF JOIN st ON a.device = st.device AND a.pid = st.pid AND a.us >= st.us
    JOIN b ON b.event_id = st.event_id WHERE {_HELD}""")
def j05_holder(spark, sf):
    ev = P.events(spark, sf)
    return lifetimes.network_to_holder(P.network(ev), P.processes(ev))


@query("j08_held_children", P.with_tables("process") + f""",
  s AS (SELECT event_id FROM process WHERE {_PARENT} IN {inlist(V.OFFICE_APPLICATIONS)}),
  a AS (SELECT event_id, us, parent_process_guid AS g, device, parent_process_id AS pid FROM process), b AS (SELECT event_id, us, process_guid AS g, device, process_id AS pid FROM process),
  st AS (SELECT device, pid, us, max(event_id) AS event_id FROM b GROUP BY ALL),
  j AS (SELECT b.event_id AS seed_id, a.event_id, false AS inferred FROM a JOIN b ON a.g <> '' AND a.g = b.g
    UNION ALL SELECT st.event_id, a.event_id, true FROM a ASOF JOIN st ON a.device = st.device AND a.pid = st.pid AND a.us > st.us
      JOIN b ON b.event_id = st.event_id WHERE {_HELD})
  SELECT * FROM j WHERE seed_id IN (SELECT event_id FROM s)""")
def j08_held(spark, sf):
    procs = P.processes(P.events(spark, sf))
    return lifetimes.held_children(procs.where(F.lower("parent_process_name").isin(*V.OFFICE_APPLICATIONS)), procs)


@query("j09_slot_candidates", P.with_tables("network", "process") + """
  SELECT device, process_id, process_guid AS identity, arg_min(event_id, (us, event_id)) AS event_id, count(*) AS rows FROM process
  WHERE (device, process_id) IN (SELECT (device, process_id) FROM network) GROUP BY ALL""")
def j09(spark, sf):
    ev = P.events(spark, sf)
    out = instances.slot_candidates(P.processes(ev), P.network(ev).select("device", "process_id"))
    return out.select("device", "process_id", "identity", "event_id", "rows")


@query("j10_seed_ancestry", P.with_tables("process", "network") + _PARENT_CTES + f""",
  seed AS (SELECT * FROM process WHERE {_IMAGE} = 'whoami.exe'),
  rec AS (SELECT event_id, process_guid AS g FROM process WHERE process_guid <> '' UNION ALL SELECT event_id, process_guid FROM network WHERE process_guid <> '')
  SELECT s.event_id, r.event_id AS parent_event_id, 'identity' AS by FROM seed s JOIN rec r ON s.parent_process_guid <> '' AND s.parent_process_guid = r.g WHERE s.event_id <> r.event_id
  UNION ALL SELECT s.event_id, parent_event_id, 'pid' FROM seed s JOIN par USING (event_id) WHERE status = 'inferred' AND parent_event_id <> s.event_id""")
def j10(spark, sf):
    tel = P.telemetry(spark, sf)
    return retrieve.seed_ancestry(tel.processes.where("lower(process_name) = 'whoami.exe'"), tel)


@query("j10_benign_guard", P.with_tables("process", "network") + _PARENT_CTES + f""",
  seed AS (SELECT *, device AS case_id FROM process WHERE {_IMAGE} = 'whoami.exe'),
  rec AS (SELECT event_id, process_guid AS g FROM process WHERE process_guid <> '' UNION ALL SELECT event_id, process_guid FROM network WHERE process_guid <> ''),
  anc AS (SELECT s.case_id, s.event_id, r.event_id AS pe FROM seed s JOIN rec r ON s.parent_process_guid <> '' AND s.parent_process_guid = r.g WHERE s.event_id <> r.event_id
    UNION ALL SELECT s.case_id, s.event_id, parent_event_id FROM seed s JOIN par USING (event_id) WHERE status = 'inferred' AND parent_event_id <> s.event_id),
  shown AS (SELECT device AS case_id, event_id FROM process WHERE process_id < 250),
  ok AS (SELECT s.case_id, s.event_id, bool_or(h.event_id IS NOT NULL) AS ok FROM seed s LEFT JOIN anc a USING (case_id, event_id) LEFT JOIN shown h ON h.case_id = s.case_id AND h.event_id = a.pe GROUP BY ALL)
  SELECT case_id, NOT bool_and(ok) AS withheld FROM ok GROUP BY 1""")
def j10_guard(spark, sf):
    tel = P.telemetry(spark, sf)
    seeds = tel.processes.where("lower(process_name) = 'whoami.exe'").select(F.col("device").alias("case_id"), "event_id")
    shown = tel.processes.where("process_id < 250").select(F.col("device").alias("case_id"), "event_id")
    return retrieve.benign_guard(seeds, shown, tel)


@query("j11_resolve_refs", P.with_tables("logon", "control", "network", "process") + """,
  r AS (SELECT event_id, source_ref FROM logon UNION ALL SELECT event_id, source_ref FROM control UNION ALL SELECT event_id, source_ref FROM network UNION ALL SELECT event_id, source_ref FROM process),
  a AS (SELECT DISTINCT 'kind=' || kind || ';event=' || (n * 3) AS ref, 'event=' || (n * 3) || ';kind=' || kind AS want FROM ev WHERE kind <> 'view'),
  m AS (SELECT ref, count(event_id) AS matches, min(event_id) AS id FROM a LEFT JOIN r ON source_ref = want GROUP BY ref)
  SELECT ref, CASE WHEN matches = 0 THEN 'unresolved' WHEN matches = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN matches = 1 THEN id ELSE '' END AS event_id, matches FROM m""")
def j11(spark, sf):
    ev = P.events(spark, sf)
    refs = ev.where("event_type <> 'view'").select(
        F.concat(F.lit("kind="), F.col("event_type"), F.lit(";event="), (F.col("event_id") * 3).cast("string")).alias("ref"))
    return retrieve.resolve_refs(refs, P.telemetry(spark, sf))


@query("j12_verify_assertions", P.with_tables("logon", "process", "control") + """
  SELECT 'auth_outcome' AS kind, event_id, '' AS other_event_id, 'failure' AS expected, CASE WHEN action = 'failure' THEN 'supported' ELSE 'contradicted' END AS status FROM logon
  UNION ALL SELECT 'control_action', event_id, '', 'list s3:bucket', CASE WHEN verb = 'list' AND resource_type = 's3:bucket' THEN 'supported' ELSE 'contradicted' END FROM control
  UNION ALL SELECT 'parent_child', a.event_id, b.event_id, '', CASE WHEN a.event_id = b.event_id THEN 'contradicted' WHEN a.device <> b.device THEN 'contradicted'
      WHEN a.process_guid = '' OR b.parent_process_guid = '' THEN 'unverifiable' WHEN a.process_guid <> b.parent_process_guid THEN 'contradicted'
      WHEN a.process_id <> b.parent_process_id THEN 'contradicted' WHEN a.process_guid = b.process_guid THEN 'contradicted' WHEN a.us > b.us THEN 'contradicted' ELSE 'supported' END
    FROM process b JOIN process a ON b.parent_process_guid <> '' AND a.event_id = 'p' || substr(b.parent_process_guid, 9)
  UNION ALL SELECT 'before', event_id, 'missing' || event_id, '', 'unverifiable' FROM logon""")
def j12(spark, sf):
    tel = P.telemetry(spark, sf)
    row = lambda df, kind, other, expected: df.select(
        F.lit(kind).alias("kind"), F.col("event_id"), other.alias("other_event_id"), F.lit(expected).alias("expected"))
    child = tel.processes.where("parent_process_guid <> ''").select(
        F.concat(F.lit("p"), F.substring("parent_process_guid", 9, 30)).alias("event_id"), F.col("event_id").alias("_other"))
    child = child.join(tel.processes.select("event_id"), "event_id", "left_semi")
    asked = row(tel.logons, "auth_outcome", F.lit(""), "failure").unionByName(
        row(tel.controls, "control_action", F.lit(""), "list s3:bucket")).unionByName(
        row(child, "parent_child", F.col("_other"), "")).unionByName(
        row(tel.logons, "before", F.concat(F.lit("missing"), F.col("event_id")), ""))
    return retrieve.verify_assertions(asked, tel).drop("reason")


@query("j13_verify_citations", P.with_tables("logon") + """,
  c AS (SELECT event_id, logon_type, action, CASE WHEN logon_type = 2 THEN 'hypothesis' WHEN logon_type = 3 THEN 'inference' ELSE 'fact' END AS t FROM logon)
  SELECT event_id AS claim_id, CASE WHEN logon_type = 7 THEN 'cites events that do not exist' WHEN action = 'failure' THEN 'cites events that were not retrieved'
    ELSE 'source may not state facts' END AS reason FROM c WHERE logon_type = 7 OR action = 'failure' OR (t = 'fact' AND logon_type = 10)""")
def j13(spark, sf):
    tel = P.telemetry(spark, sf)
    kind = F.when(F.col("logon_type") == 2, "hypothesis").when(F.col("logon_type") == 3, "inference").otherwise("fact")
    cited = F.when(F.col("logon_type") == 7, F.concat(F.lit("x"), F.col("event_id"))).otherwise(F.col("event_id"))
    claims = tel.logons.select(
        F.col("event_id").alias("claim_id"), kind.alias("claim_type"),
        F.when(F.col("logon_type") == 10, "model").otherwise("telemetry").alias("source"),
        F.array(cited).alias("event_ids"), F.array(cited).alias("assertion_ids"))
    return retrieve.verify_citations(claims, tel, tel.logons.where("action = 'success'"), ("telemetry",))


@query("j14_events_by_capture", P.with_tables("logon") + """
  SELECT CAST(NULL AS VARCHAR) AS capture, 0 AS n FROM logon WHERE regexp_extract(source_ref, 'File=([^;]+)', 1) <> ''
  UNION ALL SELECT 'cap' || (n % 7), count(*) FROM ev GROUP BY n % 7""")
def j14(spark, sf):
    tel = P.telemetry(spark, sf)
    named = tel.controls.withColumn("source_ref", F.concat(
        F.col("source_ref"), F.lit(";File=cap"), (F.substring("event_id", 2, 20).cast("long") % 7).cast("string")))
    found = retrieve.events_by_capture(tel.with_table("control", named))
    return found.groupBy("capture").agg(F.count(F.lit(1)).alias("n"))


@query("j16_join_quality", P.with_tables("network", "process") + """,
  h AS (SELECT lower(device) AS d, process_id AS pid, count(DISTINCT CASE WHEN process_guid <> '' THEN process_guid ELSE 'row ' || event_id END) AS i FROM process GROUP BY ALL),
  g AS (SELECT DISTINCT process_guid AS g FROM process WHERE process_guid <> ''),
  j AS (SELECT n.*, h.i, g.g FROM network n LEFT JOIN h ON h.d = lower(n.device) AND h.pid = n.process_id LEFT JOIN g ON g.g = n.process_guid)
  SELECT count(*) AS network_rows, count(i) AS by_pid, count(g) AS by_identity, count(*) FILTER (process_guid <> '') AS carry_identity,
    count(*) FILTER (i IS NOT NULL AND g IS NULL) AS pid_not_identity, count(*) FILTER (i IS NULL AND g IS NOT NULL) AS identity_not_pid,
    count(*) FILTER (i > 1) AS ambiguous_rows, coalesce(max(i), 0) AS worst_slot_instances FROM j""")
def j16(spark, sf):
    ev = P.events(spark, sf)
    return retrieve.join_quality(P.processes(ev), P.network(ev))


@query("j17_reused_slots", P.with_tables("process") + """
  SELECT device, process_id, count(DISTINCT nullif(process_guid, '')) AS instances, count(*) AS rows FROM process GROUP BY ALL
  HAVING count(DISTINCT nullif(process_guid, '')) > 1 ORDER BY instances DESC, rows DESC, device, process_id LIMIT 25""")
def j17(spark, sf):
    return instances.reused_slots(P.processes(P.events(spark, sf))).select("device", "process_id", "instances", "rows")


@query("j19_provenance_trace", P.with_tables("control") + """,
  t AS (SELECT * FROM control WHERE resource_type LIKE 'cloudtrail:%' AND verb IN ('stop', 'delete'))
  SELECT 'AWS-002' AS rule_id, count(*) AS cited, count(*) AS located, count(*) FILTER (source_ref IN (SELECT 'event=' || n || ';kind=' || kind FROM ev WHERE k < 90)) AS reconstructed FROM t""")
def j19(spark, sf):
    tel = P.telemetry(spark, sf)
    raw = P.events(spark, sf).where("k < 90").select(
        F.concat(F.lit("event="), F.col("event_id").cast("string"), F.lit(";kind="), F.col("event_type")).alias("source_ref"))
    return retrieve.provenance_trace(REGISTRY["AWS-002"].run(tel, CONFIG).evidence, tel, raw)


@query("j20_ip_verdict_agreement", P.with_tables("network") + f""",
  f AS (SELECT remote_ip, max(remote_port = 80) AS theirs, any_value({P.PUBLIC_IP_SQL}) AS ours FROM network GROUP BY 1)
  SELECT ours, theirs, count(*) AS addresses FROM f GROUP BY ALL""")
def j20(spark, sf):
    net = P.network(P.events(spark, sf))
    return retrieve.ip_verdict_agreement(net.select("remote_ip", (F.col("remote_port") == 80).alias("corpus_public")))


@query("j21_link_diff", _NODES + """,
  s AS (SELECT left_id, right_id, gap, unnest([CASE WHEN same_process THEN 'same_process' END, CASE WHEN lineage THEN 'process_lineage' END,
    CASE WHEN sibling THEN 'sibling_lineage' END, CASE WHEN principal THEN 'shared_principal' END, CASE WHEN device = device_1 THEN 'same_device' END,
    CASE WHEN u = u_1 THEN 'same_user' END, CASE WHEN gap <= 7200000000 THEN 'temporal_close' ELSE 'temporal_near' END]) AS signal
    FROM pairs JOIN links ON left_id = id AND right_id = id_1)
  SELECT left_id, right_id, signal, CASE WHEN gap % 2 = 0 THEN 'lost' ELSE 'gained' END AS change FROM s WHERE signal IS NOT NULL AND gap % 3 <> 0""")
def j21(spark, sf):
    """Two sets of links that share every third and hold the others one by one in turn."""
    found, links = _linked(spark, sf)
    seen = found.findings.select("finding_id", F.unix_micros("first_seen").alias("us"))
    apart = links.join(seen.toDF("left_id", "a"), "left_id").join(seen.toDF("right_id", "b"), "right_id").withColumn("gap", F.abs(F.col("b") - F.col("a")))
    return evaluate.link_diff(apart.where("gap % 3 = 0 OR gap % 2 = 0"), apart.where("gap % 3 = 0 OR gap % 2 <> 0"))


@query("j22_case_evidence", _NODES + _GROUPS + """,
  g AS (SELECT component, min((us, rule, id)) AS first, count(*) AS n, max(sev) AS sev FROM nodes JOIN comp USING (id) GROUP BY 1),
  k AS (SELECT component, row_number() OVER (ORDER BY first) AS i FROM g WHERE n >= 2 OR sev >= 3)
  SELECT 'CASE-' || CASE WHEN i < 1000 THEN lpad(CAST(i AS VARCHAR), 3, '0') ELSE CAST(i AS VARCHAR) END AS case_id, split_part(id, ':', 2) AS event_id,
    us AS "timestamp" FROM k JOIN comp USING (component) JOIN nodes USING (id)""")
def j22(spark, sf):
    found, links = _linked(spark, sf)
    members = correlate.group_cases(found.findings, links, config=_LINK_CONFIG)
    out = retrieve.case_evidence(members, found.evidence, P.telemetry(spark, sf))
    return out.select("case_id", "event_id", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("timestamp"))


@query("w07_time_prefix", P.with_tables("logon", "control", "network", "process") + """,
  b AS (SELECT min(us) AS lo, max(us) AS hi FROM ev)
  """ + " UNION ALL ".join(f"""SELECT '{t}' AS "table", count(*) AS rows FROM {t}, b WHERE us <= lo + (hi - lo) * 0.25""" for t in ("logon", "control", "network", "process")))
def w07(spark, sf):
    part = retrieve.time_prefix(P.telemetry(spark, sf), 0.25)
    one = lambda df, n: df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("rows"))
    return reduce(DataFrame.unionByName, [one(df, name) for name, df in part.tables().items()])


@query("p11_timeline", P.with_tables("logon", "control", "network", "process") + " " + " UNION ALL ".join(
    f"""SELECT event_id, us AS "timestamp", event_type FROM {t}""" for t in ("logon", "control", "network", "process")))
def p11(spark, sf):
    from ..sources.canonical import unified

    return retrieve.timeline(unified(P.telemetry(spark, sf))).select("event_id", us("timestamp"), "event_type")


@query("p12_search_processes", P.with_tables("process") + f""",
  h AS (SELECT * FROM process WHERE regexp_matches(command_line, {lit('(?i)delete|stop')}))
  SELECT event_id, (SELECT count(*) FROM h) AS total FROM h""")
def p12(spark, sf):
    found, total = retrieve.search_processes(P.processes(P.events(spark, sf)), contains="delete|stop", limit=None)
    return found.select("event_id", total.scalar().alias("total"))


@query("p13_events_by_id", P.with_tables("logon", "network") + """
  SELECT l.event_id, 'logon' AS found_in FROM logon l WHERE action = 'failure' UNION ALL SELECT event_id, 'network' FROM network WHERE remote_port = 80""")
def p13(spark, sf):
    tel = P.telemetry(spark, sf)
    ids = tel.logons.where("action = 'failure'").select("event_id").unionByName(tel.network.where("remote_port = 80").select("event_id"))
    return retrieve.events_by_id(tel, ids)[0].select("event_id", "found_in")


@query("p15_scoped_controls", P.with_tables("rbac") + " SELECT source, count(*) AS n FROM rbac GROUP BY 1")
def p15(spark, sf):
    scoped = REGISTRY["K8S-001"].scoped(P.telemetry(spark, sf, rbac=True))
    return scoped.controls.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ A32-A50


def _labels(spark, sf):
    """Labelled process events: two attack scenarios and a look-alike, by ``k``."""
    ev = P.events(spark, sf).where("event_type IN ('view', 'purchase') AND k % 4 <> 3")
    return ev.select(
        F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("event_id"),
        F.when(F.col("k") % 4 == 2, "lookalike").otherwise("intrusion").alias("scenario"),
        F.when(F.col("k") % 4 == 0, "2-execution").when(F.col("k") % 4 == 1, "8-lateral-movement").otherwise("1-normal").alias("stage"),
        (F.col("k") % 4 != 2).alias("malicious"))


_LABEL_SQL = """labels AS (SELECT 'p' || n AS event_id, k % 4 <> 2 AS malicious, CASE k % 4 WHEN 0 THEN '2-execution' WHEN 1 THEN '8-lateral-movement' ELSE '1-normal' END AS stage
    FROM ev WHERE kind IN ('view', 'purchase') AND k % 4 <> 3)"""
_ROWS = {
    "ATH-001": (f"{_PARENT} IN {inlist(V.OFFICE_APPLICATIONS)} AND {_IMAGE} IN {inlist(V.SCRIPT_INTERPRETERS)}", "2-execution"),
    "ATH-007": (f"{_PARENT} = 'services.exe' AND {_IMAGE} IN {inlist(V.SERVICE_SHELLS)}", "8-lateral-movement"),
}
_FOUND = "found AS (" + " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, event_id, device, \"user\", us, '{s}' AS want FROM process WHERE {w}" for r, (w, s) in _ROWS.items()) + ")"


def _two_rules(spark, sf):
    tel = P.telemetry(spark, sf)
    return tel, hunt.run_hunt(tel, list(_ROWS), CONFIG)


@query("a32_score_rules", P.with_tables("process") + f""", {_LABEL_SQL}, {_FOUND},
  j AS (SELECT f.*, coalesce(malicious, false) AS m, coalesce(NOT malicious, false) AS b, stage FROM found f LEFT JOIN labels l USING (event_id))
  SELECT rule_id, count(*) FILTER (m) AS true_positives, count(*) FILTER (NOT m) AS false_positives, count(*) FILTER (b) AS fp_lookalike,
    bool_or(m AND stage = want)::INT AS detected_stages, round(count(*) FILTER (m) / count(*), 6) AS precision, bool_or(m AND stage = want)::INT::DOUBLE AS recall FROM j GROUP BY rule_id""")
def a32(spark, sf):
    _, found = _two_rules(spark, sf)
    cover = {r: evaluate.RULE_COVERAGE[r] for r in _ROWS}
    return evaluate.score_rules(found.findings, found.evidence, _labels(spark, sf), cover).select(
        "rule_id", "true_positives", "false_positives", "fp_lookalike", "detected_stages", F.round("precision", 6).alias("precision"), "recall")


@query("a33_score_incident", P.with_tables("process") + f""", {_LABEL_SQL}, {_FOUND},
  j AS (SELECT f.*, coalesce(malicious, false) AS m, CASE WHEN length(f.device) % 2 = 0 THEN 'likely_benign' ELSE 'suspicious' END = 'likely_benign' AS benign, {_IMAGE} AS image
    FROM found f JOIN process USING (event_id) LEFT JOIN labels USING (event_id)),
  t AS (SELECT 'T1059.001' AS t FROM j WHERE rule_id = 'ATH-001' AND image IN ('powershell.exe', 'pwsh.exe') UNION SELECT 'T1569.002' FROM j WHERE rule_id = 'ATH-007')
  SELECT count(*) AS findings, count(*) FILTER (NOT benign) AS findings_after_triage, count(*) FILTER (NOT m) AS benign_findings,
    count(*) FILTER (NOT m AND benign) AS benign_identified, count(DISTINCT event_id) FILTER (m) AS malicious_events_surfaced,
    (SELECT count(DISTINCT event_id) FROM labels WHERE malicious) AS malicious_events_total, count(*) FILTER (m AND benign) AS malicious_called_benign,
    (SELECT coalesce(string_agg(t, ',' ORDER BY t), '') FROM t) AS techniques_found,
    (SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (SELECT unnest(['T1059.001', 'T1569.002', 'T1490']) AS x) WHERE x NOT IN (SELECT t FROM t)) AS techniques_missing
  FROM j""")
def a33(spark, sf):
    _, found = _two_rules(spark, sf)
    # Dispositions by host name, so that both kinds occur; triage itself has queries of its own.
    said = found.findings.select("finding_id", F.when(F.length("device") % 2 == 0, "likely_benign").otherwise("suspicious").alias("disposition"))
    out = evaluate.score_incident(found.findings, found.evidence, said, _labels(spark, sf), ["T1059.001", "T1569.002", "T1490"])
    return out.select("findings", "findings_after_triage", "benign_findings", "benign_identified", "malicious_events_surfaced", "malicious_events_total",
                      "malicious_called_benign", joined("techniques_found"), joined("techniques_missing"))


_MEMBERS = P.with_tables("process") + f""", {_LABEL_SQL}, {_FOUND},
  members AS (SELECT 'C-' || device AS case_id, rule_id || ':' || event_id AS finding_id, event_id, rule_id FROM found)"""


def _host_cases(findings):
    """Cases by host: a grouping SQL can restate."""
    return findings.select(F.concat(F.lit("C-"), F.col("device")).alias("case_id"), "finding_id")


@query("a34_case_quality", _MEMBERS + """,
  c AS (SELECT case_id, count(DISTINCT event_id) AS events, count(DISTINCT event_id) FILTER (malicious) AS hits FROM members LEFT JOIN labels USING (event_id) GROUP BY 1),
  p AS (SELECT * FROM c ORDER BY hits DESC, case_id LIMIT 1), t AS (SELECT count(DISTINCT event_id) AS n FROM labels WHERE malicious)
  SELECT (SELECT count(*) FROM c) AS cases, (SELECT count(*) FROM c WHERE hits = 0) AS noise_cases, round(p.hits / t.n, 6) AS primary_recall, round(p.hits / p.events, 6) AS primary_purity FROM p, t""")
def a34(spark, sf):
    _, found = _two_rules(spark, sf)
    out = evaluate.case_quality(_host_cases(found.findings), found.evidence, _labels(spark, sf))
    return out.select("cases", "noise_cases", F.round("primary_recall", 6).alias("primary_recall"), F.round("primary_purity", 6).alias("primary_purity"))


@query("a35_incident_match", _MEMBERS + """,
  a AS (SELECT 'I' || (k % 9) AS incident_id, CASE WHEN k % 9 = 8 THEN NULL ELSE 'p' || n END AS event_id FROM ev WHERE kind IN ('view', 'purchase')),
  h AS (SELECT incident_id, count(a.event_id) AS anchored, count(DISTINCT case_id) AS cases FROM a LEFT JOIN members m USING (event_id) GROUP BY 1)
  SELECT incident_id, CASE WHEN anchored = 0 THEN 'unresolved' WHEN cases = 0 THEN 'undetected' WHEN cases > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM h""")
def a35(spark, sf):
    _, found = _two_rules(spark, sf)
    ev = P.events(spark, sf).where("event_type IN ('view', 'purchase')")
    anchors = ev.select(F.concat(F.lit("I"), (F.col("k") % 9).cast("string")).alias("incident_id"),
                        F.when(F.col("k") % 9 != 8, F.concat(F.lit("p"), F.col("event_id").cast("string"))).alias("event_id"))
    return evaluate.incident_match(anchors, _host_cases(found.findings), found.evidence).select("incident_id", "status")


@query("a36_dataset_profile", P.with_tables("logon", "control", "network", "process") + f""", {_FOUND},
  e AS (SELECT device, us FROM logon UNION ALL SELECT device, us FROM control UNION ALL SELECT device, us FROM network UNION ALL SELECT device, us FROM process),
  t AS (SELECT count(*)::DOUBLE AS events, count(DISTINCT nullif(device, ''))::DOUBLE AS hosts, (max(us) - min(us)) / 86400000000 AS days, (SELECT count(*)::DOUBLE FROM found) AS n FROM e),
  g AS (SELECT CASE WHEN f.rule_id = 'ATH-001' OR regexp_matches(command_line, {lit(V.ADMIN_SHARE_REDIRECT)}) THEN 'high' ELSE 'medium' END AS severity FROM found f JOIN process USING (event_id))
  SELECT 'events' AS measure, '' AS key, events AS value FROM t UNION ALL SELECT 'hosts', '', hosts FROM t UNION ALL SELECT 'findings', '', n FROM t
  UNION ALL SELECT 'days', '', days FROM t UNION ALL SELECT 'findings_per_day', '', n / days FROM t UNION ALL SELECT 'findings_per_host_day', '', n / days / hosts FROM t
  UNION ALL SELECT 'findings_by_rule', rule_id, count(*) FROM found GROUP BY rule_id UNION ALL SELECT 'findings_by_severity', severity, count(*) FROM g GROUP BY severity
  UNION ALL SELECT 'cases', '', count(DISTINCT device) FROM found""")
def a36(spark, sf):
    tel, found = _two_rules(spark, sf)
    return evaluate.dataset_profile(tel, found.findings, cases=_host_cases(found.findings))


@query("a37_detection_report", P.with_tables("logon", "control", "network", "process") + f""", {_FOUND},
  u AS (SELECT count(*) FILTER (remote_url <> '') / count(*) AS url FROM network),
  r(rule_id, input_rows) AS (SELECT unnest(['ATH-001', 'ATH-002', 'ATH-004', 'ATH-007', 'ATH-008', 'ATH-009', 'ATH-010', 'ATH-011', 'ATH-012']), (SELECT count(*) FROM process)
    UNION ALL SELECT 'ATH-003', (SELECT count(*) FROM network) UNION ALL SELECT unnest(['ATH-005', 'ATH-006']), (SELECT count(*) FROM logon)
    UNION ALL SELECT unnest(['AWS-001', 'AWS-002', 'AWS-003', 'AWS-004', 'AWS-005', 'AWS-006', 'K8S-001', 'K8S-002']), (SELECT count(*) FROM control)),
  v AS (SELECT *, CASE WHEN rule_id LIKE 'K8S%' THEN 'unusable' WHEN rule_id = 'ATH-003' AND url < 0.5 THEN 'degraded' ELSE 'usable' END AS verdict FROM r, u),
  c AS (SELECT f.rule_id, count(*) AS n, max(CASE WHEN f.rule_id = 'ATH-001' OR regexp_matches(command_line, {lit(V.ADMIN_SHARE_REDIRECT)}) THEN 3 ELSE 2 END) AS worst
    FROM found f JOIN process USING (event_id) GROUP BY 1)
  SELECT rule_id, input_rows, verdict, coalesce(n, 0) AS findings, worst AS severity_rank,
    CASE WHEN n > 0 THEN '' WHEN verdict = 'unusable' THEN 'a required field or channel is missing' ELSE 'input was usable and nothing matched' END AS zero_reason
  FROM v LEFT JOIN c USING (rule_id)""")
def a37(spark, sf):
    from ..plans import coverage

    tel, found = _two_rules(spark, sf)
    return evaluate.detection_report(found.findings, coverage.rule_verdicts(coverage.field_population(tel)))


@query("a38_capture_recall", P.with_tables("process") + f""", {_FOUND},
  cap AS (SELECT 'p' || n AS event_id, 'cap' || (n % 25) AS capture FROM ev), h AS (SELECT DISTINCT capture, rule_id, event_id FROM found JOIN cap USING (event_id)),
  l AS (SELECT 'cap' || i AS capture, 'T1569.002' AS technique_id FROM range(25) r(i))
  SELECT l.capture, technique_id, count(h.event_id) AS findings, count(h.event_id) > 0 AS caught, coalesce(bool_or(rule_id = 'ATH-007'), false) AS caught_as_labelled FROM l LEFT JOIN h USING (capture) GROUP BY ALL""")
def a38(spark, sf):
    tel, found = _two_rules(spark, sf)
    ev = P.events(spark, sf)
    capture = F.concat(F.lit("cap"), (F.col("event_id") % 25).cast("string")).alias("capture")
    captures = ev.select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("event_id"), capture)
    labels = ev.select(capture).distinct().withColumn("technique_id", F.lit("T1569.002"))
    return evaluate.capture_recall(found.evidence, captures, techniques.map_techniques(found.findings), labels)


@query("a39_background_volume", P.with_tables("logon", "control", "network", "process") + f""", {_FOUND},
  e AS (SELECT us FROM logon UNION ALL SELECT us FROM control UNION ALL SELECT us FROM network UNION ALL SELECT us FROM process),
  t AS (SELECT greatest(1.0, (max(us) - min(us)) / 86400000000) AS span_days FROM e),
  g AS (SELECT f.*, f.rule_id = 'ATH-001' OR regexp_matches(command_line, {lit(V.ADMIN_SHARE_REDIRECT)}) AS high FROM found f JOIN process USING (event_id))
  SELECT rule_id, count(*) AS episodes, count(DISTINCT "user") AS actors, count(DISTINCT us // 86400000000) AS days, 0 AS low, count(*) FILTER (NOT high) AS medium,
    count(*) FILTER (high) AS high, 0 AS critical, any_value(span_days) AS span_days, count(*) / any_value(span_days) AS per_day FROM g, t GROUP BY rule_id""")
def a39(spark, sf):
    tel, found = _two_rules(spark, sf)
    return evaluate.background_volume(found.findings, tel)


@query("a39_volume_change", P.with_tables("process") + f""", {_FOUND}
  SELECT rule_id, count(*) AS before, count(*) FILTER (device <> 'H1') AS after FROM found GROUP BY rule_id""")
def a39_change(spark, sf):
    findings = _two_rules(spark, sf)[1].findings
    return evaluate.volume_change(findings, findings.where("device <> 'H1'"))


@query("a44_findings_per_actor", P.with_tables("process") + f""", {_FOUND}
  SELECT rule_id, "user" AS actor, count(*) AS findings, count(DISTINCT us // 86400000000) AS days FROM found GROUP BY ALL""")
def a44(spark, sf):
    return statistics.findings_per_actor(_two_rules(spark, sf)[1].findings)


def _verdict_log(spark, sf):
    ev = P.events(spark, sf)
    return ev.select(
        F.concat(F.lit("f"), (F.col("event_id") % 97).cast("string")).alias("finding_id"), F.concat(F.lit("R"), (F.col("event_id") % 97 % 5).cast("string")).alias("rule_id"),
        F.when(F.col("k") % 4 == 0, "true_positive").when(F.col("k") % 4 == 1, "false_positive").when(F.col("k") % 4 == 2, "benign_true_positive").otherwise("undetermined").alias("verdict"),
        F.when(F.col("k") % 3 == 0, "likely_benign").when(F.col("k") % 3 == 1, "likely_malicious").otherwise("needs_review").alias("system_disposition"),
        F.col("ts").alias("recorded_at"), F.col("event_id").alias("line_no"))


_VERDICTS = P.with_tables().rstrip(",\n") + """, w AS (SELECT 'f' || (n % 97) AS finding_id, 'R' || (n % 97 % 5) AS rule_id, CASE k % 4 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive'
    WHEN 2 THEN 'benign_true_positive' ELSE 'undetermined' END AS verdict, CASE k % 3 WHEN 0 THEN 'likely_benign' WHEN 1 THEN 'likely_malicious' ELSE 'needs_review' END AS d, us, n FROM ev),
  l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY us DESC, n DESC) = 1)"""


@query("w06_latest_verdict", _VERDICTS + " SELECT finding_id, verdict, d AS system_disposition FROM l")
def w06(spark, sf):
    return evaluate.latest_verdict(_verdict_log(spark, sf)).select("finding_id", "verdict", "system_disposition")


@query("a40_feedback_metrics", _VERDICTS + """,
  s AS (SELECT *, d <> 'needs_review' AND verdict <> 'undetermined' AS o, (verdict <> 'true_positive') = (d = 'likely_benign') AS a FROM l)
  SELECT count(*) AS total, count(*) FILTER (o) AS scored, count(*) FILTER (o AND a) AS agreed, count(*) FILTER (o AND NOT a) AS disagreed,
    count(*) FILTER (NOT o) AS no_opinion, count(*) FILTER (o AND d = 'likely_benign' AND verdict = 'true_positive') AS dangerous FROM s""")
def a40(spark, sf):
    return evaluate.feedback_metrics(evaluate.latest_verdict(_verdict_log(spark, sf))).select(
        "total", "scored", "agreed", "disagreed", "no_opinion", "dangerous")


def _arms(spark, sf):
    ev = P.events(spark, sf)
    arm, case = F.concat(F.lit("arm"), (F.col("user_id") % 3).cast("string")), F.col("event_id")
    label = F.when(F.col("k") % 2 == 0, "malicious").otherwise("benign")
    manifest = ev.select(arm.alias("arm"), case.alias("case_id"), label.alias("label"))
    rows = ev.where("k % 10 <> 9").select(
        arm.alias("arm"), case.alias("case_id"), F.when(F.col("k") % 5 == 0, "abstain").when(F.col("k") % 7 == 0, "benign").otherwise(label).alias("disposition"),
        F.col("value").alias("seconds"))
    return manifest, rows


@query("a41_decision_metrics", P.with_tables().rstrip(",\n") + """,
  m AS (SELECT 'arm' || (user_id % 3) AS arm, CASE WHEN k % 2 = 0 THEN 'malicious' ELSE 'benign' END AS label, k % 10 <> 9 AS seen,
    CASE WHEN k % 10 = 9 THEN 'missing' WHEN k % 5 = 0 THEN 'abstain' WHEN k % 7 = 0 THEN 'benign' WHEN k % 2 = 0 THEN 'malicious' ELSE 'benign' END AS d, value FROM ev)
  SELECT arm, count(*) AS expected, count(*) FILTER (seen) AS observed, count(*) FILTER (d = label) AS correct, count(*) FILTER (d = 'abstain') AS abstained,
    count(*) FILTER (label = 'malicious' AND d = 'benign') AS unsafe_clears,
    round((count(*) FILTER (label = 'malicious' AND d = 'malicious') / count(*) FILTER (label = 'malicious') + count(*) FILTER (label = 'benign' AND d = 'benign') / count(*) FILTER (label = 'benign')) / 2, 6) AS balanced_accuracy,
    round(quantile_cont(value, 0.5) FILTER (seen), 6) AS median_seconds, quantile_disc(value, 0.9) FILTER (seen) AS p90_seconds, max(value) FILTER (seen) AS max_seconds FROM m GROUP BY arm""")
def a41(spark, sf):
    out = evaluate.decision_metrics(*_arms(spark, sf))
    return out.select("arm", "expected", "observed", "correct", "abstained", "unsafe_clears", F.round("balanced_accuracy", 6).alias("balanced_accuracy"),
                      F.round("median_seconds", 6).alias("median_seconds"), "p90_seconds", "max_seconds")


@query("a42_paired_comparison", """WITH a AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0),
  j AS (SELECT a.o_totalprice AS x, b.o_totalprice * (CASE WHEN b.o_custkey % 3 = 0 THEN 2 WHEN b.o_custkey % 3 = 1 THEN 1 ELSE 0.5 END) AS y, a.o_orderkey AS ka, b.o_orderkey AS kb FROM a FULL JOIN b USING (o_orderkey))
  SELECT 'price' AS measure, count(*) FILTER (y > x) AS better, count(*) FILTER (y < x) AS worse, count(*) FILTER (x = y) AS same, count(*) FILTER (ka IS NULL OR kb IS NULL) AS unpaired FROM j""")
def a42(spark, sf):
    orders = P.table(spark, sf, "orders")
    factor = F.when(F.col("o_custkey") % 3 == 0, 2.0).when(F.col("o_custkey") % 3 == 1, 1.0).otherwise(0.5)
    a = orders.where("o_orderkey % 5 <> 0").select("o_orderkey", F.col("o_totalprice").alias("price"))
    b = orders.where("o_orderkey % 7 <> 0").select("o_orderkey", (F.col("o_totalprice") * factor).alias("price"))
    return evaluate.paired_comparison(a, b, "o_orderkey", {"price": True}).drop("unmeasured")


_MIXED = P.with_tables("process", "control", "logon") + _FOREIGN + f""",
  m AS (SELECT device, 'endpoint' AS fam, 'ATH-001:' || event_id AS id FROM process WHERE {_ROWS["ATH-001"][0]}
    UNION ALL SELECT device, 'control_plane', 'AWS-002:' || event_id FROM control WHERE resource_type LIKE 'cloudtrail:%' AND verb IN ('stop', 'delete')
    UNION ALL SELECT CASE WHEN count(DISTINCT device) = 1 THEN min(device) ELSE source_device END, 'identity', 'ATH-006:' || arg_min(event_id, (us, event_id)) FROM rem JOIN fp USING (source_device, "user") GROUP BY source_device, "user")"""


def _mixed(spark, sf):
    found = hunt.run_hunt(P.telemetry(spark, sf), ["ATH-001", "AWS-002", "ATH-006"], CONFIG)
    return found, _host_cases(found.findings)


@query("a43_domain_necessity", _MIXED + """
  SELECT 'C-' || device AS case_id, array_to_string(list_sort(list(DISTINCT fam)), ',') AS domains, count(DISTINCT fam) >= 2 AS qualifies FROM m GROUP BY device""")
def a43(spark, sf):
    found, members = _mixed(spark, sf)
    return evaluate.domain_necessity(members, found.findings).select("case_id", joined("domains"), "qualifies")


@query("a48_case_summary", _MIXED + """, c AS (SELECT device, count(*) AS n, count(DISTINCT fam) AS f FROM m GROUP BY 1)
  SELECT count(*) AS cases, count(*) FILTER (n = 1) AS singletons, max(n) AS largest, count(*) FILTER (f >= 2) AS multi_domain FROM c""")
def a48(spark, sf):
    found, members = _mixed(spark, sf)
    return evaluate.case_summary(members, found.findings)


@query("a48_case_sizes", _MIXED + """, c AS (SELECT device, count(*) AS n FROM m GROUP BY 1)
  SELECT n AS size, count(*) AS cases FROM c GROUP BY 1""")
def a48_sizes(spark, sf):
    return evaluate.case_sizes(_mixed(spark, sf)[1])


@query("a49_case_disposition", _EGRESS + """, x AS (SELECT f.*, split_part(finding_id, ':', 2) AS e FROM f)
  SELECT 'C-' || device AS case_id, CASE WHEN bool_or(clear OR n >= 5) THEN 'malicious' ELSE 'abstain' END AS disposition FROM x JOIN network ON e = event_id GROUP BY device""")
def a49(spark, sf):
    tel = P.telemetry(spark, sf)
    found = REGISTRY["ATH-003"].run(tel, CONFIG).findings
    # Without image names the identity veto has nothing to read.
    out = triage.assess_findings(found.withColumn("process_name", F.lit(None).cast("string")), tel)
    return evaluate.case_disposition(_host_cases(found), out)


def _sessions(spark, sf):
    """One declared session per purchase: its user, from a minute to 30 hours after it, some skipped."""
    ev = P.events(spark, sf).where("event_type = 'purchase'")
    return ev.select(
        F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session_id"), F.array(F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("principals"),
        (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("start"), (F.col("ts") + F.expr("INTERVAL 30 HOURS")).alias("end"),
        F.when(F.col("k") % 5 == 0, "skipped").otherwise("done").alias("status"))


_SESSIONS = P.with_tables("control", "logon") + f""",
  s AS (SELECT 's' || n AS session_id, 'u' || user_id AS p, us + 60000000 AS lo, us + {30 * H} AS hi, CASE WHEN k % 5 = 0 THEN 'skipped' ELSE 'done' END AS status FROM ev WHERE kind = 'purchase'),
  act AS (SELECT event_id, us, actor AS p FROM control UNION ALL SELECT event_id, us, "user" FROM logon)"""


@query("a45_session_coverage", _SESSIONS + """,
  r AS (SELECT session_id, status, count(event_id) AS rows FROM s LEFT JOIN act ON s.p = act.p AND us BETWEEN lo AND hi GROUP BY ALL)
  SELECT session_id, rows, CASE WHEN status = 'skipped' AND rows > 0 THEN 'skipped_with_activity' WHEN status = 'skipped' THEN 'skipped' WHEN rows > 0 THEN 'covered' ELSE 'uncovered' END AS verdict FROM r""")
def a45(spark, sf):
    return evaluate.session_coverage(_sessions(spark, sf), P.telemetry(spark, sf)).select("session_id", "rows", "verdict")


@query("a45_unclaimed_by_actor", _SESSIONS + """,
  u AS (SELECT * FROM act WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.p = act.p AND act.us BETWEEN lo AND hi))
  SELECT p AS principal, count(*) AS n FROM u GROUP BY 1""")
def a45_unclaimed(spark, sf):
    return evaluate.unclaimed_activity(_sessions(spark, sf), P.telemetry(spark, sf))["by_actor"]


@query("a46_a47_matched_controls", P.with_tables("process") + f""",
  c AS (SELECT event_id, us, us // {24 * H} AS day, device, regexp_matches(lower(command_line), 'net |sc |taskkill') AS is_admin, md5('7:' || event_id) AS h FROM process),
  d AS (SELECT *, row_number() OVER (PARTITION BY is_admin, day, device ORDER BY h, event_id) AS r FROM c),
  t AS (SELECT *, row_number() OVER (PARTITION BY is_admin ORDER BY r, h, event_id) AS q FROM d),
  picked AS (SELECT *, row_number() OVER (ORDER BY us, event_id) - 1 AS i FROM t WHERE q <= CASE WHEN is_admin THEN 8 ELSE 32 END),
  seed AS (SELECT event_id AS case_id, us, row_number() OVER (ORDER BY us, event_id) - 1 AS i FROM process WHERE lower(process_name) = 'whoami.exe'),
  cover AS (SELECT day, min(us) AS lo, max(us) AS hi FROM c GROUP BY 1),
  m AS (SELECT p.event_id, s.case_id, p.us - {H // 6} AS b, p.us + {5 * (H // 6)} AS e, lo, hi FROM picked p JOIN seed s ON p.i % (SELECT count(*) FROM seed) = s.i JOIN cover USING (day)),
  f AS (SELECT *, CASE WHEN b < lo THEN lo - b WHEN e > hi THEN hi - e ELSE 0 END AS shift FROM m)
  SELECT event_id, case_id, greatest(b + shift, lo) AS start, least(e + shift, hi) AS "end" FROM f""")
def a46(spark, sf):
    procs = P.processes(P.events(spark, sf))
    admin = F.lower("command_line").rlike("net |sc |taskkill")
    picked = evaluate.sample_controls(procs, 40, seed=7, admin=admin)
    seeds = procs.where(F.lower("process_name") == "whoami.exe").select(
        F.col("event_id").alias("case_id"), F.col("timestamp").alias("seed_time"),
        (F.col("timestamp") - F.expr("INTERVAL 10 MINUTES")).alias("start"), (F.col("timestamp") + F.expr("INTERVAL 50 MINUTES")).alias("end"))
    cover = procs.groupBy(F.to_date("timestamp").alias("day")).agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    out = evaluate.match_windows(seeds, picked, cover)
    return out.select("event_id", "case_id", us("start"), us("end"))


@query("d24_d25_candidates", P.with_tables("process") + f""", {_LABEL_SQL},
  o AS (SELECT event_id, regexp_matches({_CMD}, '[.](docm|dotm|xlsm|xlsb|pptm|ppsm)') AS v2 FROM process WHERE {_PARENT} = 'outlook.exe' AND {_IMAGE} IN {inlist(V.MAIL_OPENED_OFFICE_APPLICATIONS)}),
  j AS (SELECT o.*, coalesce(malicious, false) AS m FROM o LEFT JOIN labels USING (event_id))
  SELECT '1-initial-access' AS stage, count(*) FILTER (m) AS v1_true_positives, count(*) FILTER (NOT m) AS v1_false_positives,
    count(*) FILTER (m AND v2) AS v2_true_positives, count(*) FILTER (NOT m AND v2) AS v2_false_positives, count(*) FILTER (NOT m AND NOT v2) AS fp_removed FROM j""")
def d25(spark, sf):
    out = hunt.propose_and_iterate(P.telemetry(spark, sf), _labels(spark, sf), CONFIG)
    return out.where("stage = '1-initial-access'").select(
        "stage", "v1_true_positives", "v1_false_positives", "v2_true_positives", "v2_false_positives", "fp_removed")


@query("u01_unified_counts", P.with_tables("logon", "control", "network", "process") + " " + " UNION ALL ".join(
    f"SELECT event_type, count(*) AS n, min(us) AS first FROM {t} GROUP BY 1" for t in ("logon", "control", "network", "process")))
def u01(spark, sf):
    from ..sources.canonical import unified

    return unified(P.telemetry(spark, sf)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.min("timestamp")).alias("first"))


@query("u02_without", P.with_tables("logon", "control", "network", "process") + """
  SELECT event_id, 'logon' AS "table" FROM logon WHERE action <> 'failure' UNION ALL SELECT event_id, 'control' FROM control
  UNION ALL SELECT event_id, 'network' FROM network WHERE remote_port <> 80 UNION ALL SELECT event_id, 'process' FROM process""")
def u02(spark, sf):
    from ..sources.canonical import without

    tel = P.telemetry(spark, sf)
    ids = tel.logons.where("action = 'failure'").select("event_id").unionByName(tel.network.where("remote_port = 80").select("event_id"))
    left = without(tel, ids)
    return reduce(DataFrame.unionByName, [df.select("event_id", F.lit(name).alias("table")) for name, df in left.tables().items()])


@query("u03_label_overlap", P.with_tables("process") + f""", {_LABEL_SQL}, {_FOUND}
  SELECT rule_id, count(*) FILTER (malicious) AS in_labels, count(*) FILTER (coalesce(NOT malicious, true)) AS outside FROM found LEFT JOIN labels USING (event_id) GROUP BY 1""")
def u03(spark, sf):
    _, found = _two_rules(spark, sf)
    judged = evaluate.score_findings(found.evidence, _labels(spark, sf))
    return judged.groupBy("rule_id").agg(F.count_if("is_malicious").alias("in_labels"), F.count_if(~F.col("is_malicious")).alias("outside"))


