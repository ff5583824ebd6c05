"""Retrieval in batch form: a frame of keys in, rows or groups per key out.

P10-P13, A26-A31, J10-J14, J16, J19, J20, J22, W07.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.control import is_grant
from ..functions.identity import identity_scheme, usable_identity
from ..functions.network import is_public_ip
from ..operators.instances import resolve_parent
from ..operators.timing import connection_patterns, support_note
from ..schemas import Telemetry
from ..vocab import CONTROL, LOGON

# Resources whose use follows a grant (fixed values).
USE_RESOURCES = ("pods/exec", "pods/attach", "secrets", "serviceaccounts/token")


def slice_telemetry(tel: Telemetry, start: str, end: str, devices: list[str] | None = None) -> Telemetry:
    """Rows with ``start <= timestamp <= end``, on the given devices (P10)."""
    lo, hi = (F.lit(t).cast("timestamp") for t in (start, end))

    def cut(_, df):
        kept = df.where(F.col("timestamp").between(lo, hi))
        return kept if devices is None else kept.where(F.col("device").isin(*devices))

    return tel.map(cut)


def time_prefix(tel: Telemetry, fraction: float) -> Telemetry:
    """The earliest part of the observed time span, not of the rows."""
    bounds = reduce(DataFrame.unionByName, [
        df.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")) for df in tel.tables().values()
    ]).agg(F.min(F.unix_micros("lo")).alias("lo"), F.max(F.unix_micros("hi")).alias("hi"))
    end = bounds.select((F.col("lo") + (F.col("hi") - F.col("lo")) * fraction)).scalar()
    return tel.map(lambda _, df: df.where(F.unix_micros("timestamp") <= end))


def timeline(unified: DataFrame, device=None, user=None, event_type=None, limit: int | None = None) -> DataFrame:
    """The unified view filtered and in time order."""
    for name, value in (("device", device), ("user", user), ("event_type", event_type)):
        if value is not None:
            unified = unified.where(F.col(name) == value)
    ordered = unified.orderBy("timestamp", "event_id")
    return ordered if limit is None else ordered.limit(limit)


def search_processes(
    processes: DataFrame, device=None, name=None, contains=None, limit: int | None = 25
) -> tuple[DataFrame, DataFrame]:
    """Earliest matches (all without a ``limit``) and the true total; ``contains`` is a case-blind pattern."""
    hits = processes
    if device is not None:
        hits = hits.where(F.col("device") == device)
    if name is not None:
        hits = hits.where(F.lower("process_name") == name.lower())
    if contains is not None:
        hits = hits.where(F.coalesce("command_line", F.lit("")).rlike("(?i)" + contains))
    ordered = hits.orderBy("timestamp", "event_id")
    return ordered if limit is None else ordered.limit(limit), hits.agg(F.count(F.lit(1)).alias("total"))


def _located(tel: Telemetry, ids: DataFrame, *columns: str) -> DataFrame:
    """The asked rows of every table; missing columns are null."""
    parts = []
    for name, df in tel.tables().items():
        have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
        parts.append(df.join(ids, "event_id", "left_semi").select("event_id", F.lit(name).alias("found_in"), *have))
    return reduce(DataFrame.unionByName, parts)


def events_by_id(tel: Telemetry, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The asked rows with their table, and the ids found nowhere."""
    wanted = ids.select("event_id").distinct()
    rows = _located(tel, wanted, "timestamp", "device", "user", "source_ref")
    return rows, wanted.join(rows, "event_id", "left_anti")


# ---------------------------------------------------------------- A26-A31


def auth_history(logons: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Totals, failures, sources, targets and types per account."""
    rows = logons if users is None else logons.join(users.select("user").distinct(), "user", "left_semi")
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    # Reduce to combinations first: the distinct counts then run over few rows.
    slim = rows.groupBy("user", "device", "source_ip", "source_device", "logon_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") != "success").alias("f"),
        F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    return slim.groupBy("user").agg(
        F.sum("n").alias("total"), F.sum("f").alias("failures"), F.countDistinct(full("source_ip")).alias("source_ips"),
        F.countDistinct(full("source_device")).alias("source_devices"), F.countDistinct("device").alias("targets"),
        F.array_sort(F.collect_set("logon_type")).alias("logon_types"), F.min("lo").alias("first_seen"), F.max("hi").alias("last_seen"))


def host_network_activity(network: DataFrame, devices: DataFrame | None = None, top: int = 15) -> DataFrame:
    """Per host the busiest (address, image) pairs and the instances behind them."""
    rows = network if devices is None else network.join(devices.select("device").distinct(), "device", "left_semi")
    counted = rows.groupBy("device", "remote_ip", "process_name").agg(
        F.count(F.lit(1)).alias("connections"), F.countDistinct("process_id").alias("pids"),
        F.countDistinct(F.nullif(F.col("process_guid"), F.lit(""))).alias("instances"))
    rank = F.row_number().over(Window.partitionBy("device").orderBy(F.col("connections").desc(), "remote_ip", "process_name"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


def beacon_report(network: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Timing per (device, address) over all images together, with a verdict."""
    keys = ["device", "remote_ip"]
    rows = network if pairs is None else network.join(pairs.select(*keys).distinct(), keys, "left_semi")
    measured = connection_patterns(rows, keys, "timestamp")
    return measured.withColumn(
        "verdict",
        F.when(F.col("robust_cv").isNull(), "too few").when(F.col("is_regular"), "regular").otherwise("irregular"),
    ).withColumn("support", support_note())


def _counts(df: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """``keys, attribute, value, n``: how often each value of each column occurs."""
    cells = F.explode(F.array(*[F.struct(
        F.lit(c).alias("attribute"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("?")).alias("value")) for c in columns]))
    return df.select(*keys, cells.alias("c")).groupBy(*keys, "c.attribute", "c.value").agg(F.count(F.lit(1)).alias("n"))


def actor_history(controls: DataFrame) -> DataFrame:
    """Verbs, resources, results and source addresses of each actor, counted."""
    return _counts(controls, ["actor"], ("verb", "resource_type", "decision", "source_ip"))


def history_span(controls: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rows, first_seen, last_seen, span_seconds`` of each actor or object."""
    return controls.groupBy(*[F.coalesce(F.col(k), F.lit("")).alias(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6).alias("span_seconds"))


def resource_history(controls: DataFrame) -> DataFrame:
    """Actors, verbs and results of each object, counted."""
    return _counts(controls, ["resource_type", "resource_name", "resource_namespace"], ("actor", "verb", "decision"))


def identity_grants(controls: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """Grants to an identity and its uses from the first grant on: ``identity, kind, event_id``."""
    rows = controls
    grants = rows.where(is_grant(F.col("verb"), F.col("resource_type")) & (F.coalesce("target_actor", F.lit("")) != "")).select(
        F.col("target_actor").alias("identity"), "event_id", "timestamp")
    if identities is not None:
        grants = grants.join(identities.select("identity").distinct(), "identity", "left_semi")
    first = grants.groupBy("identity").agg(F.min("timestamp").alias("first_grant"))
    uses = rows.where(F.col("resource_type").isin(*USE_RESOURCES)).select(F.col("actor").alias("identity"), "event_id", "timestamp")
    if identities is not None:
        uses = uses.join(identities.select("identity").distinct(), "identity", "left_semi")
    later = uses.join(first, "identity", "left").where(F.col("first_grant").isNull() | (F.col("timestamp") >= F.col("first_grant")))
    mark = lambda df, kind: df.select("identity", F.lit(kind).alias("kind"), "event_id", "timestamp")
    return mark(grants, "grant").unionByName(mark(later, "use"))


# ---------------------------------------------------------------- J10


def seed_ancestry(seeds: DataFrame, tel: Telemetry) -> DataFrame:
    """``event_id, parent_event_id, by``: every record of each seed's parent."""
    procs = tel.processes
    asked = procs.join(seeds.select("event_id").distinct(), "event_id", "left_semi")
    named = asked.select("event_id", usable_identity(F.col("parent_process_guid")).alias("identity")).where("identity <> ''")
    records = procs.select("event_id", "process_guid").unionByName(tel.network.select("event_id", "process_guid")).select(
        F.col("event_id").alias("parent_event_id"), usable_identity(F.col("process_guid")).alias("identity")).where("identity <> ''")
    by_identity = named.join(records, "identity").select("event_id", "parent_event_id", F.lit("identity").alias("by"))
    by_pid = resolve_parent(asked, procs).where("status = 'inferred'").select(
        "event_id", "parent_event_id", F.lit("pid").alias("by"))
    return by_identity.unionByName(by_pid).where(F.col("event_id") != F.col("parent_event_id"))


def benign_guard(seeds: DataFrame, retrieved: DataFrame, tel: Telemetry) -> DataFrame:
    """``case_id, withheld``: a benign label needs the parent of every process seed retrieved.

    ``seeds``: ``case_id, event_id`` of process seeds; ``retrieved``: ``case_id, event_id``.
    """
    parents = seed_ancestry(seeds, tel)
    shown = seeds.join(parents, "event_id", "left").join(
        retrieved.select("case_id", F.col("event_id").alias("parent_event_id"), F.lit(True).alias("_seen")).distinct(),
        ["case_id", "parent_event_id"], "left")
    per_seed = shown.groupBy("case_id", "event_id").agg(F.bool_or(F.coalesce("_seen", F.lit(False))).alias("ok"))
    return per_seed.groupBy("case_id").agg((~F.bool_and("ok")).alias("withheld"))


# ---------------------------------------------------------------- J11-J14


def _pairs(ref: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(ref, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != ""))


def resolve_refs(refs: DataFrame, tel: Telemetry) -> DataFrame:
    """``ref, status, event_id, matches`` of references made of ``k=v`` pairs.

    A reference matches rows whose ``source_ref`` carries all its pairs.  Rows are looked up
    by each reference's rarest pair only, so a pair shared by a whole file is never joined on.
    """
    asked = refs.select("ref").distinct().withColumn("pairs", _pairs(F.col("ref")))
    each = asked.select("ref", F.explode("pairs").alias("pair"))
    rows = reduce(DataFrame.unionByName, [df.select("event_id", "source_ref") for df in tel.tables().values()]).withColumn(
        "row_pairs", _pairs(F.col("source_ref")))
    placed = rows.select("event_id", "row_pairs", F.explode("row_pairs").alias("pair"))
    frequency = placed.select("pair").join(each.select("pair").distinct(), "pair", "left_semi").groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"))
    anchor = each.join(frequency, "pair", "left").groupBy("ref").agg(
        F.min_by("pair", F.struct(F.coalesce("n", F.lit(0)), "pair")).alias("pair"))
    found = anchor.join(asked, "ref").join(placed, "pair").where(F.size(F.array_except("pairs", "row_pairs")) == 0)
    counted = found.groupBy("ref").agg(F.countDistinct("event_id").alias("matches"), F.min("event_id").alias("_id"))
    matches = F.coalesce("matches", F.lit(0))
    return asked.join(counted, "ref", "left").select(
        "ref", F.when(matches == 0, "unresolved").when(matches == 1, "resolved").otherwise("ambiguous").alias("status"),
        F.when(matches == 1, F.col("_id")).otherwise("").alias("event_id"), matches.alias("matches"))


_FACTS = ("timestamp", "device", "action", "verb", "resource_type", "process_guid", "process_id",
          "parent_process_guid", "parent_process_id")


def verify_assertions(assertions: DataFrame, tel: Telemetry) -> DataFrame:
    """``kind, event_id, other_event_id, expected, status, reason``.

    Kinds: auth_outcome, control_action, process_identity (one event and an expected value);
    before, same_process, parent_child (two events).  An id found nowhere, or twice, cannot
    be verified.
    """
    ids = assertions.select("event_id").union(
        assertions.where(F.coalesce("other_event_id", F.lit("")) != "").select("other_event_id")).distinct()
    # The first row stands for the id; the count says whether it may.
    facts = _located(tel, ids, *_FACTS).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct("found_in", *_FACTS)).alias("f"))
    side = lambda p, key: facts.select(F.col("event_id").alias(key), F.col("n").alias(p + "n"), F.col("f").alias(p))
    joined = assertions.withColumn("other_event_id", F.coalesce("other_event_id", F.lit(""))).join(
        side("a", "event_id"), "event_id", "left").join(side("b", "other_event_id"), "other_event_id", "left")
    binary = F.col("other_event_id") != ""
    known = lambda p: F.coalesce(F.col(p + "n"), F.lit(0)) == 1
    text = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    kind = F.col("kind")
    own, want = text(F.col("a.process_guid")), F.col("expected")
    action = text(F.col("a.action"))
    done = F.concat_ws(" ", text(F.col("a.verb")), text(F.col("a.resource_type")))
    parent = kind == "parent_child"
    right = F.when(parent, text(F.col("b.parent_process_guid"))).otherwise(text(F.col("b.process_guid")))
    right_pid = F.when(parent, F.col("b.parent_process_id")).otherwise(F.col("b.process_id"))
    comparable = lambda x, y: (identity_scheme(x) != "") & (identity_scheme(x) == identity_scheme(y))
    fits = lambda p: F.col(p + ".found_in").isin("process", "network") & (~parent | (F.col(p + ".found_in") == "process"))
    verdict = lambda s, r: F.struct(F.lit(s).alias("status"), F.lit(r).alias("reason"))
    yes, no, open_ = "supported", "contradicted", "unverifiable"
    out = (
        F.when(~known("a") | (binary & ~known("b")), verdict(open_, "event id is missing or ambiguous"))
        .when((kind == "auth_outcome") & (F.col("a.found_in") != LOGON), verdict(no, "not an authentication event"))
        .when((kind == "auth_outcome") & ~action.isin("success", "failure"), verdict(open_, "outcome is missing"))
        .when(kind == "auth_outcome", F.when(action == want, verdict(yes, "recorded outcome")).otherwise(verdict(no, "recorded outcome")))
        .when((kind == "control_action") & (F.col("a.found_in") != CONTROL), verdict(no, "not a control-plane event"))
        .when((kind == "control_action") & ((text(F.col("a.verb")) == "") | (text(F.col("a.resource_type")) == "")), verdict(open_, "action is incomplete"))
        .when(kind == "control_action", F.when(done == want, verdict(yes, "recorded action")).otherwise(verdict(no, "recorded action")))
        .when((kind == "process_identity") & ~F.col("a.found_in").isin("process", "network"), verdict(no, "not about a process instance"))
        .when((kind == "process_identity") & ~comparable(own, want), verdict(open_, "identity missing or of another authority"))
        .when(kind == "process_identity", F.when(own == want, verdict(yes, "recorded identity")).otherwise(verdict(no, "recorded identity")))
        .when((F.col("event_id") == F.col("other_event_id")) & (kind != "same_process"), verdict(no, "needs distinct events"))
        .when((kind == "before") & (F.col("a.timestamp").isNull() | F.col("b.timestamp").isNull()), verdict(open_, "needs two instants"))
        .when(kind == "before", F.when(F.col("a.timestamp") < F.col("b.timestamp"), verdict(yes, "recorded times")).otherwise(verdict(no, "recorded times")))
        .when(~fits("a") | ~fits("b"), verdict(no, "event types do not fit"))
        .when((text(F.col("a.device")) == "") | (text(F.col("b.device")) == ""), verdict(open_, "host missing"))
        .when(text(F.col("a.device")) != text(F.col("b.device")), verdict(no, "different hosts"))
        .when(~comparable(own, right), verdict(open_, "identities absent or incomparable"))
        .when(own != right, verdict(no, "identities disagree"))
        .when(F.coalesce(F.col("a.process_id") != right_pid, F.lit(False)), verdict(no, "identity matches but pids conflict"))
        .when(parent & (own == text(F.col("b.process_guid"))), verdict(no, "own parent"))
        .when(parent & (F.col("a.timestamp").isNull() | F.col("b.timestamp").isNull()), verdict(open_, "needs two instants"))
        .when(parent & (F.col("a.timestamp") > F.col("b.timestamp")), verdict(no, "parent after child"))
        .otherwise(verdict(yes, "matching identity on one host")))
    return joined.withColumn("_v", out).select("kind", "event_id", "other_event_id", "expected", "_v.status", "_v.reason")


def verify_citations(claims: DataFrame, tel: Telemetry, retrieved: DataFrame, fact_sources: tuple[str, ...]) -> DataFrame:
    """``claim_id, reason`` of every rejected claim.

    ``claims``: ``claim_id, claim_type, source, event_ids, assertion_ids``; ``retrieved``:
    ``event_id``.  Reasons in order: no evidence, unknown id, id not retrieved, a source that
    may not state facts, an assertion outside the citations.
    """
    cited = claims.select("claim_id", F.explode("event_ids").alias("event_id")).distinct()
    known = _located(tel, cited.select("event_id").distinct()).select("event_id").distinct()
    seen = lambda df, name: df.select("event_id", F.lit(True).alias(name)).distinct()
    checked = cited.join(seen(known, "_k"), "event_id", "left").join(seen(retrieved, "_r"), "event_id", "left")
    state = checked.groupBy("claim_id").agg(
        F.bool_or(F.col("_k").isNull()).alias("unknown"), F.bool_or(F.col("_r").isNull()).alias("unseen"))
    fact = F.col("claim_type") == "fact"
    reason = (
        F.when((F.size("event_ids") == 0) & F.col("claim_type").isin("fact", "inference"), "cites no evidence")
        .when(F.col("unknown"), "cites events that do not exist").when(F.col("unseen"), "cites events that were not retrieved")
        .when(fact & ~F.col("source").isin(*fact_sources), "source may not state facts")
        .when(F.size(F.array_except("assertion_ids", "event_ids")) > 0, "assertion outside its citations"))
    return claims.join(state, "claim_id", "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).select("claim_id", "reason")


def events_by_capture(tel: Telemetry) -> DataFrame:
    """``capture, event_id`` from the file named in ``source_ref``."""
    rows = reduce(DataFrame.unionByName, [df.select("event_id", "source_ref") for df in tel.tables().values()])
    name = F.regexp_extract("source_ref", "File=([^;]+)", 1)
    return rows.select(name.alias("capture"), "event_id").where(F.col("capture") != "")


# ---------------------------------------------------------------- J16, J19, J20, J22


def join_quality(processes: DataFrame, network: DataFrame) -> DataFrame:
    """One row: how well connections join processes by slot and by identity."""
    slot = lambda df: F.concat_ws("|", F.lower("device"), F.col("process_id").cast("string"))
    guid = F.coalesce("process_guid", F.lit(""))
    held = processes.where(F.col("process_id").isNotNull()).groupBy(slot(processes).alias("slot")).agg(
        F.countDistinct(F.when(guid != "", guid).otherwise(F.concat(F.lit("row "), F.col("event_id")))).alias("instances"))
    named = processes.where(guid != "").select(guid.alias("guid"), F.lit(True).alias("_g")).distinct()
    net = network.select(
        F.when(F.col("process_id").isNotNull(), slot(network)).alias("slot"), guid.alias("guid"))
    joined = net.join(held, "slot", "left").join(named, "guid", "left")
    by_pid, by_guid = F.col("instances").isNotNull(), F.col("_g").isNotNull()
    return joined.agg(
        F.count(F.lit(1)).alias("network_rows"), F.count_if(by_pid).alias("by_pid"), F.count_if(by_guid).alias("by_identity"),
        F.count_if(F.col("guid") != "").alias("carry_identity"), F.count_if(by_pid & ~by_guid).alias("pid_not_identity"),
        F.count_if(by_guid & ~by_pid).alias("identity_not_pid"), F.count_if(F.col("instances") > 1).alias("ambiguous_rows"),
        F.coalesce(F.max("instances"), F.lit(0)).alias("worst_slot_instances"))


def provenance_trace(evidence: DataFrame, tel: Telemetry, raw: DataFrame) -> DataFrame:
    """``rule_id, cited, located, reconstructed`` from finding to raw record.

    ``raw`` has ``source_ref``, one row per raw record.
    """
    cited = evidence.select("rule_id", "event_id").distinct()
    rows = _located(tel, cited.select("event_id").distinct(), "source_ref").select("event_id", "source_ref")
    known = raw.select("source_ref", F.lit(True).alias("_raw")).distinct()
    return cited.join(rows, "event_id", "left").join(known, "source_ref", "left").groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("cited"), F.count("source_ref").alias("located"), F.count("_raw").alias("reconstructed"))


def ip_verdict_agreement(flagged: DataFrame) -> DataFrame:
    """Per distinct address, our public test against the corpus' own flag.

    ``flagged``: ``remote_ip, corpus_public``.
    """
    each = flagged.groupBy("remote_ip").agg(F.max("corpus_public").alias("theirs")).withColumn("ours", is_public_ip(F.col("remote_ip")))
    return each.groupBy("ours", "theirs").agg(F.count(F.lit(1)).alias("addresses"))


def case_evidence(members: DataFrame, evidence: DataFrame, tel: Telemetry) -> DataFrame:
    """The rows behind every id a case cites."""
    cited = members.join(evidence.select("finding_id", "event_id"), "finding_id").select("case_id", "event_id").distinct()
    rows = _located(tel, cited.select("event_id").distinct(), "timestamp", "device", "user", "source", "source_ref")
    return cited.join(rows, "event_id")
