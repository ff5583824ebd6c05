"""Linking findings into cases.

A link needs a structural signal, and every structural signal is an equality on some key
(an event, a process instance, a parent, a host, a principal).  Candidates therefore come
from hash joins on that key plus an hour bucket; no step compares findings that share
nothing, and nothing compares all findings of an hour.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import instance_tag
from ..functions.time import micros
from ..operators.components import connected_components
from ..operators.lineage_cut import cut
from ..operators.instances import join_instances, with_instance
from ..operators.ranking import numbered
from ..schemas import Telemetry
from ..vocab import SEVERITIES, SEVERITY_RANK
from .coverage import rule_channels
from .rules import REGISTRY
from .techniques import map_techniques, tactics_covered


@dataclass(frozen=True)
class CorrelationConfig:
    """Parameters of the link graph (fixed values)."""

    min_score: int = 5
    require_structural: bool = True
    max_gap: timedelta = timedelta(minutes=60)
    tight_window: timedelta = timedelta(minutes=10)
    auth_exec_window: timedelta = timedelta(minutes=15)
    cross_domain_window: timedelta = timedelta(minutes=15)
    sibling_window: timedelta = timedelta(minutes=10)
    max_session_fan_out: int = 12
    max_session_span: timedelta = timedelta(minutes=10)
    min_case_size: int = 2
    singleton_min_severity: str = "high"

    def __post_init__(self):
        if self.cross_domain_window > self.max_gap:
            raise ValueError("cross_domain_window must not exceed max_gap")


# Signal weights (fixed values).
STRUCTURAL = {
    "shared_evidence": 3, "same_process": 3, "process_lineage": 3, "sibling_lineage": 2,
    "host_movement": 3, "auth_then_exec": 3, "shared_principal": 3,
}
CIRCUMSTANTIAL = {"same_device": 2, "same_user": 2, "temporal_close": 2, "temporal_near": 1}

# Channel -> family (fixed values).  Message telemetry belongs to no family.
FAMILY = {
    "process_execution": "endpoint", "process_command_line": "endpoint",
    "process_lineage": "endpoint", "handle_access": "endpoint", "file_events": "endpoint",
    "registry": "endpoint", "script_block": "endpoint",
    "authentication": "identity", "auth_source_attribution": "identity", "auth_factor": "identity",
    "network_flow": "network", "network_inbound": "network", "network_url": "network",
    "dns_query": "network",
    "cloud_control_plane": "control_plane", "cloud_management_activity": "control_plane",
    "container_audit": "control_plane",
}


def families_of(rule_id: Column) -> Column:
    """Channel families of a finding, from what its rule declares."""
    out = F.array().cast("array<string>")
    for name, rule in REGISTRY.items():
        found = sorted({FAMILY[c] for c in rule_channels(rule) if c in FAMILY})
        out = F.when(rule_id == name, F.array(*[F.lit(f) for f in found])).otherwise(out)
    return out


def _gap(a: str, b: str) -> Column:
    """Microseconds between two windows, zero when they overlap."""
    return F.greatest(
        F.lit(0), F.col(b + "lo") - F.col(a + "hi"), F.col(a + "lo") - F.col(b + "hi"))


def finding_nodes(findings: DataFrame) -> DataFrame:
    """The slim form of a finding that links are decided on."""
    hosts = F.array_distinct(F.array_compact(F.concat(
        F.array("device", F.nullif(F.col("source_device"), F.lit(""))),
        F.coalesce("target_devices", F.array().cast("array<string>")))))
    return findings.select(
        "finding_id", "rule_id", "device", "user", F.unix_micros("first_seen").alias("lo"),
        F.unix_micros("last_seen").alias("hi"), hosts.alias("hosts"),
        families_of(F.col("rule_id")).alias("families"), "severity_rank")


def _in_buckets(nodes: DataFrame, width: int) -> DataFrame:
    """One row per bucket a finding can meet a neighbour in."""
    return nodes.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("lo") / width), F.floor((F.col("hi") + width) / width))))


def _pairs(joined: DataFrame, signal: str, inferred: Column | None = None) -> DataFrame:
    """Unordered pairs of ``l_finding_id, r_finding_id`` as one signal row per pair.

    A relation asked in both directions, or met in several buckets, collapses here; it is
    inferred only when no identity-backed match exists.
    """
    l, r = F.col("l_finding_id"), F.col("r_finding_id")
    return (
        joined.where(l != r)
        .groupBy(F.least(l, r).alias("a"), F.greatest(l, r).alias("b"))
        .agg(F.bool_and(inferred if inferred is not None else F.lit(False)).alias("inferred"))
        .withColumn("signal", F.lit(signal)).withColumn("weight", F.lit(STRUCTURAL[signal]))
    )


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def evidence_instances(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Process instances behind the cited rows, and the instances that started them."""
    own = with_instance(evidence, "process_guid", "device", "process_id").where(
        (F.col("i_identity") != "") | F.col("i_pid").isNotNull())
    cited = F.col("event_type") == "process"
    parent = with_instance(
        evidence.where(cited), "parent_process_guid", "device", "parent_process_id"
    ).where((F.col("i_identity") != "") | F.col("i_pid").isNotNull())
    keep = ["finding_id", "i_identity", "i_scheme", "i_device", "i_pid"]
    shape = lambda df: df.select(*[F.col(c).alias(c.removeprefix("i_")) for c in keep]).distinct()
    return shape(own), shape(parent)


def session_parents(parents: DataFrame, processes: DataFrame, config: CorrelationConfig) -> DataFrame:
    """Parents that started few children, close together."""
    tag = F.when(F.col("identity") != "", F.col("identity")).otherwise(
        F.concat(F.lit("pid|"), F.col("device"), F.lit("|"), F.col("pid").cast("string")))
    asked = parents.withColumn("tag", tag)
    started = processes.select(
        instance_tag(F.col("parent_process_guid"), F.col("device"), F.col("parent_process_id")).alias("tag"),
        instance_tag(F.col("process_guid"), F.col("device"), F.col("process_id")).alias("child"),
        "timestamp",
    ).join(asked.select("tag").distinct(), "tag", "left_semi")
    measured = started.groupBy("tag").agg(
        F.countDistinct("child").alias("fan_out"),
        (F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))).alias("span"))
    quiet = measured.where(
        (F.col("fan_out") <= config.max_session_fan_out)
        & (F.col("span") <= micros(config.max_session_span)))
    return asked.join(quiet.select("tag"), "tag", "left_semi").drop("tag")


def structural_signals(
    nodes: DataFrame, evidence: DataFrame, tel: Telemetry, config: CorrelationConfig
) -> DataFrame:
    """``a, b, signal, weight, inferred``: every structural relation between two findings."""
    width = micros(config.max_gap)
    placed = _in_buckets(nodes.select("finding_id", "lo", "hi"), width).select("finding_id", "bucket")
    near = lambda df: df.join(placed, "finding_id")

    cited = evidence.select("finding_id", "event_id").distinct()
    shared = _pairs(
        _prefixed(cited, "l_").join(_prefixed(cited, "r_"), F.col("l_event_id") == F.col("r_event_id")),
        "shared_evidence")

    own, parents = evidence_instances(evidence)

    def instances(left: DataFrame, right: DataFrame) -> DataFrame:
        """Instance matches inside one bucket: the bucket travels with the slot and identity."""
        carry = lambda df, p: _prefixed(
            near(df).withColumn("identity", F.when(F.col("identity") != "", F.concat_ws("@", "identity", "bucket")).otherwise(""))
            .withColumn("device", F.when(F.col("device") != "", F.concat_ws("@", "device", "bucket")).otherwise("")), p)
        return join_instances(carry(left, "l_"), carry(right, "r_"))

    same = _pairs(instances(own, own), "same_process", F.col("inferred"))
    lineage = _pairs(instances(own, parents), "process_lineage", F.col("inferred"))
    sessions = session_parents(parents, tel.processes, config)
    siblings = _pairs(instances(sessions, sessions), "sibling_lineage", F.col("inferred"))
    siblings = _within(siblings, nodes, micros(config.sibling_window))

    hosts = near(nodes.select("finding_id", "device", F.explode("hosts").alias("host")))
    moved = _pairs(
        _prefixed(hosts.select("finding_id", "device", "bucket").distinct(), "l_").join(
            _prefixed(hosts, "r_"),
            (F.col("l_device") == F.col("r_host")) & (F.col("l_bucket") == F.col("r_bucket"))
            & (F.col("l_device") != F.col("r_device"))),
        "host_movement")
    return reduce(DataFrame.unionByName, [
        shared, same, lineage, siblings, moved, *cross_family_signals(nodes, evidence, config)])


def _ends(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    return pairs.join(_prefixed(nodes, "a_").withColumnRenamed("a_finding_id", "a"), "a").join(
        _prefixed(nodes, "b_").withColumnRenamed("b_finding_id", "b"), "b")


def _within(pairs: DataFrame, nodes: DataFrame, span: int) -> DataFrame:
    slim = nodes.select("finding_id", "lo", "hi")
    return _ends(pairs, slim).where(_gap("a_", "b_") <= span).select(*pairs.columns)


def principals(evidence: DataFrame) -> DataFrame:
    """``finding_id, principal``: identities the cited rows name."""
    names = F.array(F.trim("principal"), F.trim("other_principal"))
    return evidence.select("finding_id", F.explode(names).alias("principal")).where(
        F.coalesce("principal", F.lit("")) != ""
    ).where(~F.lower("principal").isin("nan", "none", "<na>", "nat")).distinct()


def cross_family_signals(
    nodes: DataFrame, evidence: DataFrame, config: CorrelationConfig
) -> list[DataFrame]:
    """The links between findings that rest on different kinds of telemetry."""
    width = micros(config.max_gap)
    near = _in_buckets(nodes.select("finding_id", "device", "families", "lo", "hi"), width)
    identity = near.where(F.array_contains("families", "identity"))
    endpoint = near.where(F.array_contains("families", "endpoint"))
    lag = F.col("r_lo") - F.col("l_hi")
    disjoint = ~F.arrays_overlap("l_families", "r_families")
    followed = _pairs(
        _prefixed(identity, "l_").join(
            _prefixed(endpoint, "r_"),
            (F.col("l_device") == F.col("r_device")) & (F.col("l_bucket") == F.col("r_bucket"))
        ).where(lag.between(0, micros(config.auth_exec_window)) & disjoint), "auth_then_exec")
    named = near.where(F.size("families") > 0).join(principals(evidence), "finding_id")
    shared = _pairs(
        _prefixed(named, "l_").join(
            _prefixed(named, "r_"),
            (F.col("l_principal") == F.col("r_principal")) & (F.col("l_bucket") == F.col("r_bucket"))
            & (F.col("l_finding_id") < F.col("r_finding_id"))
        ).where(disjoint & (_gap("l_", "r_") <= micros(config.cross_domain_window))), "shared_principal")
    # One cross-family signal per pair; following an authentication says more.
    return [followed, shared.join(followed.select("a", "b"), ["a", "b"], "left_anti")]


def link_findings(
    findings: DataFrame, evidence: DataFrame, tel: Telemetry, config: CorrelationConfig | None = None
) -> DataFrame:
    """``left_id, right_id, score, signals, structural, inferred_from_pid``.

    The result is written to the checkpoint folder: cases, attributes and statistics all
    read it.
    """
    config = config or CorrelationConfig()
    # Findings are few next to events but read by every signal: evaluate the rules once.
    nodes = cut(finding_nodes(findings))
    evidence = cut(evidence)
    signals = structural_signals(nodes, evidence, tel, config)
    grouped = signals.groupBy("a", "b").agg(
        F.sum("weight").alias("structural_score"),
        F.array_sort(F.collect_list(F.struct("signal", "weight", "inferred"))).alias("found"),
        F.bool_or("inferred").alias("inferred_from_pid"))
    ends = _ends(grouped, nodes.select("finding_id", "rule_id", "device", "user", "lo", "hi"))
    gap = _gap("a_", "b_")
    extra = {
        "same_device": F.col("a_device") == F.col("b_device"),
        "same_user": F.col("a_user") == F.col("b_user"),
        "temporal_close": gap <= micros(config.tight_window),
        "temporal_near": (gap > micros(config.tight_window)) & (gap <= micros(config.max_gap)),
    }
    score = F.col("structural_score")
    for name, holds in extra.items():
        score = score + F.when(F.coalesce(holds, F.lit(False)), CIRCUMSTANTIAL[name]).otherwise(0)
    more = F.array_compact(F.array(*[F.when(c, F.struct(
        F.lit(n).alias("signal"), F.lit(CIRCUMSTANTIAL[n]).alias("weight"),
        F.lit(False).alias("inferred"))) for n, c in extra.items()]))
    a_first = F.struct("a_lo", "a_rule_id", "a") <= F.struct("b_lo", "b_rule_id", "b")
    return cut(ends.where(gap <= micros(config.max_gap)).withColumn("score", score).where(
        F.col("score") >= config.min_score
    ).select(
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("left_id"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("right_id"),
        "score", F.concat("found", more).alias("signals"), F.lit(True).alias("structural"),
        "inferred_from_pid"))


def assert_unique_findings(findings: DataFrame) -> None:
    """Two findings under one id would be merged without a link being recorded."""
    twice = findings.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    found = twice.select("finding_id").limit(5).collect()
    if found:
        raise ValueError("duplicate finding ids: " + ", ".join(r.finding_id for r in found))


def group_cases(
    findings: DataFrame, links: DataFrame, set_aside: DataFrame | None = None,
    config: CorrelationConfig | None = None,
) -> DataFrame:
    """``case_id, finding_id``: linked groups that warrant a case.

    A group wholly set aside by triage is not raised; a single finding is raised only from
    ``singleton_min_severity`` on.  Cases are numbered by start time.
    """
    config = config or CorrelationConfig()
    slim = findings.select("finding_id", "rule_id", "first_seen", "severity_rank")
    grouped = connected_components(slim, links, node="finding_id", left="left_id", right="right_id")
    aside = F.lit(False)
    members = slim.join(grouped, "finding_id")
    if set_aside is not None:
        members = members.join(
            set_aside.select("finding_id", F.lit(True).alias("_aside")), "finding_id", "left")
        aside = F.coalesce("_aside", F.lit(False))
    first = F.min(F.struct("first_seen", "rule_id", "finding_id")).alias("first")
    cases = members.groupBy("component").agg(
        first, F.count(F.lit(1)).alias("size"), F.max("severity_rank").alias("rank"),
        F.bool_and(aside).alias("all_aside")
    ).where(
        ~F.col("all_aside")
        & ((F.col("size") >= config.min_case_size)
           | (F.col("rank") >= SEVERITY_RANK[config.singleton_min_severity])))
    return number_cases(cases).join(grouped, "component").select("case_id", "finding_id")


def number_cases(cases: DataFrame) -> DataFrame:
    """``CASE-001`` onward in start order, without sorting all cases, or all of a day, in one task."""
    ranked = numbered(cases, ["first"])
    number = F.col("_n") + 1
    padded = F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))
    return ranked.select("component", F.concat(F.lit("CASE-"), padded).alias("case_id"))


def case_attributes(
    members: DataFrame, findings: DataFrame, links: DataFrame, evidence: DataFrame
) -> DataFrame:
    """Span, hosts, users, rules, severity, techniques, tactics and confidence."""
    rows = members.join(findings, "finding_id")
    hosts = F.array_compact(F.concat(
        F.array("device", F.nullif(F.col("source_device"), F.lit(""))),
        F.coalesce("target_devices", F.array().cast("array<string>"))))
    basic = rows.groupBy("case_id").agg(
        F.min("first_seen").alias("start_time"), F.max("last_seen").alias("end_time"),
        F.count(F.lit(1)).alias("findings"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(hosts)))).alias("devices"),
        F.array_sort(F.collect_set("user")).alias("users"),
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.max("severity_rank").alias("severity_rank"))
    mapped = tactics_covered(map_techniques(findings).join(members, "finding_id"), ["case_id"])
    inside = links.join(members.select(F.col("finding_id").alias("left_id"), "case_id"), "left_id")
    linked = inside.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("links"), F.count_if("structural").alias("structural_links"))
    events = members.join(evidence.select("finding_id", "event_id"), "finding_id").groupBy("case_id").agg(
        F.countDistinct("event_id").alias("events"))
    none = F.array().cast("array<string>")
    out = basic.join(mapped, "case_id", "left").join(linked, "case_id", "left").join(events, "case_id", "left")
    out = out.fillna(0, ["links", "structural_links", "events"])
    for c in ("techniques", "tactics"):
        out = out.withColumn(c, F.coalesce(c, none))
    breadth, strength = F.size("tactics"), F.col("structural_links")
    severity = F.lit(None).cast("string")
    for rank, name in enumerate(SEVERITIES):
        severity = F.when(F.col("severity_rank") == rank, name).otherwise(severity)
    return out.withColumn("severity", severity).withColumn(
        "confidence",
        F.when(F.col("findings") == 1, "low")
        .when((breadth >= 4) & (strength >= 3), "high")
        .when((breadth >= 2) & (strength >= 1), "medium").otherwise("low"))


def case_timeline(members: DataFrame, findings: DataFrame) -> DataFrame:
    """Members of every case by time with their techniques and movement."""
    techniques = map_techniques(findings).groupBy("finding_id").agg(
        F.array_sort(F.collect_set("technique_id")).alias("techniques"))
    return members.join(findings, "finding_id").join(techniques, "finding_id", "left").select(
        "case_id", F.col("first_seen").alias("timestamp"), "finding_id", "rule_id", "severity", "title",
        "device", "user", F.nullif(F.col("source_device"), F.lit("")).alias("source_device"),
        "target_devices", F.coalesce("techniques", F.array().cast("array<string>")).alias("techniques"),
    ).orderBy("case_id", "timestamp", "rule_id", "finding_id")


def explain_case() -> Column:
    """A mechanical sentence over the columns of :func:`case_attributes`."""
    text = lambda c: F.col(c).cast("string")
    chain = F.concat(
        F.col("case_id"), F.lit(": "), text("findings"), F.lit(" findings on "),
        F.array_join("devices", ", "), F.lit(" by "), F.array_join("users", ", "))
    single = F.concat(
        F.col("case_id"), F.lit(": one "), F.col("severity"), F.lit(" finding, raised on its own severity"))
    tactics = F.when(F.size("tactics") > 0, F.concat(
        F.lit("; tactics "), F.array_join("tactics", " -> "))).otherwise("")
    backing = F.when(F.col("structural_links") > 0, F.concat(
        F.lit("; "), text("structural_links"), F.lit(" of "), text("links"),
        F.lit(" links structural"))).otherwise("")
    return F.concat(
        F.when(F.col("findings") == 1, single).otherwise(chain), tactics, backing,
        F.lit("; grouping confidence "), F.col("confidence"), F.lit(", "), text("events"),
        F.lit(" events"))


def correlation_stats(links: DataFrame) -> DataFrame:
    """Links per signal, and how many of them rest on a pid slot (C14)."""
    return links.select(F.explode("signals").alias("s")).groupBy("s.signal").agg(
        F.count(F.lit(1)).alias("links"), F.count_if("s.inferred").alias("inferred_links"))


def candidate_pairs(findings: DataFrame, keys: list[str], max_gap: timedelta) -> DataFrame:
    """Pairs sharing ``keys`` whose windows are at most ``max_gap`` apart."""
    width = micros(max_gap)
    nodes = findings.select(
        *keys, "finding_id", F.unix_micros("first_seen").alias("lo"), F.unix_micros("last_seen").alias("hi"))
    placed = _in_buckets(nodes, width)
    same = F.col("l_bucket") == F.col("r_bucket")
    for k in keys:
        same = same & (F.col("l_" + k) == F.col("r_" + k))
    met = _prefixed(placed, "l_").join(
        _prefixed(placed, "r_"), same & (F.col("l_finding_id") < F.col("r_finding_id")))
    # A pair meets in every bucket both reach; keep it in the first such bucket only.
    home = F.floor(F.greatest(F.col("l_lo"), F.col("r_lo")) / width)
    return met.where((_gap("l_", "r_") <= width) & (F.col("l_bucket") == home)).select(
        F.col("l_finding_id").alias("left_id"), F.col("r_finding_id").alias("right_id"),
        _gap("l_", "r_").alias("gap_us"))
