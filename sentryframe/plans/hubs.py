"""Cases of any size without the pairs behind them: spanning links of the link graph.

``correlate.link_findings`` lists every pair, so n findings of one principal in an hour give
n * n / 2 rows.  Here findings meet in hubs.  A *relation table* holds one row per finding, kind of
relation and key (an event, a process instance, a host, a principal ...), and a group of that
table is refined until every pair in it that is close enough in time is a link for certain:

* one relation, and also the same device or the same user (``near`` in time adds the last point);
* one relation within the tight window;
* two relations of different kinds.

Any link falls under one of these, as long as ``min_score`` is at most 5.  In a group, findings
are placed in time buckets as wide as the gap that is allowed.  Two findings in one bucket are near
enough, so its first finding stands for all others; across the border of two buckets the one
that ends last and the one that starts first stand for theirs.  Every row says a link that
``link_findings`` lists too, and the rows connect what its rows connect: at most three a finding,
group and bucket.  Groups are only ever aggregated and looked up, so a hot key costs no task more
than its share of rows; members of a hub are counted by :func:`hubs`.

A finding that lasts long has a row in each bucket it touches, as for the pairs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import START, SYSMON
from ..functions.time import micros
from ..operators.lineage_cut import cut
from ..schemas import Telemetry
from .correlate import (
    CIRCUMSTANTIAL, FAMILY, STRUCTURAL, CorrelationConfig, evidence_instances, finding_nodes, principals,
    session_parents,
)
from .coverage import rule_channels
from .rules import REGISTRY

#: Sides of a group: findings of side 0 meet each other, those of side 1 meet those of side 2.
EITHER, LEFT, RIGHT = 0, 1, 2

_SCHEMES = ("", START, SYSMON)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _opposite(side: Column) -> Column:
    return F.when(side == EITHER, EITHER).otherwise(3 - side)


def _rows(df: DataFrame, kind: str, key: Column, side: Column | int) -> DataFrame:
    side = F.lit(side) if isinstance(side, int) else side
    return df.select("finding_id", F.lit(kind).alias("kind"), key.alias("key"), side.cast("int").alias("side"))


def _paired(df: DataFrame, own: Column, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row per pair of labels that the row's own label is in: ``_pair`` and its ``_side``."""
    options = [
        F.when(own == label, F.struct(F.lit(f"{a}>{b}").alias("pair"), F.lit(EITHER if a == b else side).alias("side")))
        for a, b in pairs for side, label in ((LEFT, a), (RIGHT, b)) if not (a == b and side == RIGHT)]
    return df.withColumn("_o", F.explode(F.array_compact(F.array(*options)))).withColumn(
        "_pair", F.col("_o.pair")).withColumn("_side", F.col("_o.side"))


def _same_instance(instances: DataFrame, kind: str) -> list[DataFrame]:
    """Findings of one instance: by its identity, else by its slot where identities do not compare."""
    named = instances.where(F.col("identity") != "")
    slots = instances.where((F.col("device") != "") & F.col("pid").isNotNull())
    pairs = [("", "")] + [(a, b) for i, a in enumerate(_SCHEMES) for b in _SCHEMES[i + 1:]]
    slots = _paired(slots, F.col("scheme"), pairs)
    return [_rows(named, kind, F.col("identity"), EITHER), _rows(slots, kind, _slot(F.col("_pair")), F.col("_side"))]


def _slot(pair: Column) -> Column:
    return F.concat_ws("|", F.lit("slot"), pair, "device", F.col("pid").cast("string"))


def _lineage(own: DataFrame, parents: DataFrame, kind: str) -> list[DataFrame]:
    """Findings on an instance and those on what it started."""
    out = []
    for instances, side in ((own, LEFT), (parents, RIGHT)):
        out.append(_rows(instances.where(F.col("identity") != ""), kind, F.col("identity"), side))
        slots = instances.where((F.col("device") != "") & F.col("pid").isNotNull())
        for other in _SCHEMES:
            pair = F.concat("scheme", F.lit(">" + other)) if side == LEFT else F.concat(F.lit(other + ">"), "scheme")
            out.append(_rows(slots.where((F.col("scheme") == "") | (F.col("scheme") != other)), kind, _slot(pair), side))
    return out


def _family_pairs() -> list[tuple[str, str]]:
    """Pairs of disjoint sets of channel families that rules have, each set as comma-joined text."""
    sets = {",".join(sorted({FAMILY[c] for c in rule_channels(rule) if c in FAMILY})) for rule in REGISTRY.values()} - {""}
    return [(a, b) for a in sorted(sets) for b in sorted(sets) if not set(a.split(",")) & set(b.split(","))]


def relations(nodes: DataFrame, evidence: DataFrame, tel: Telemetry, config: CorrelationConfig) -> DataFrame:
    """``finding_id, kind, key, side``: everything a finding can share with another one."""
    own, parents = (cut(x) for x in evidence_instances(evidence))
    sessions = session_parents(parents, tel.processes, config)
    hosts = nodes.select("finding_id", "device", F.explode("hosts").alias("host"))
    family = F.array_join(F.array_sort("families"), ",")
    named = nodes.withColumn("_family", family).join(principals(evidence), "finding_id")
    crossed = _paired(named, F.col("_family"), [(a, b) for a, b in _family_pairs() if a < b])
    return _union([
        _rows(evidence.select("finding_id", "event_id").distinct(), "shared_evidence", F.col("event_id"), EITHER),
        *_same_instance(own, "same_process"), *_lineage(own, parents, "process_lineage"),
        *_same_instance(sessions, "sibling_lineage"),
        _rows(hosts.where(F.col("device").isNotNull()).select("finding_id", "device").distinct(), "host_movement", F.col("device"), LEFT),
        _rows(hosts.where(F.col("host") != F.coalesce("device", F.lit(""))), "host_movement", F.col("host"), RIGHT),
        _rows(crossed, "shared_principal", F.concat_ws("|", "_pair", "principal"), F.col("_side")),
    ]).where(F.col("key").isNotNull()).distinct()


def _reach(kind: str, config: CorrelationConfig) -> int:
    """The gap that a kind of relation allows."""
    own = {"sibling_lineage": config.sibling_window, "shared_principal": config.cross_domain_window}
    return min(micros(own.get(kind, config.max_gap)), micros(config.max_gap))


def certain_groups(related: DataFrame, nodes: DataFrame, config: CorrelationConfig) -> DataFrame:
    """``finding_id, group, side, lo, hi, reach``: groups in which every pair within reach is a link."""
    if config.min_score > STRUCTURAL["sibling_lineage"] + min(STRUCTURAL.values()) + CIRCUMSTANTIAL["temporal_near"]:
        raise ValueError("hubs need a min_score that two relations reach; list the pairs instead")
    reach = F.create_map(*[F.lit(x) for k in STRUCTURAL for x in (k, _reach(k, config))])
    weight = F.create_map(*[F.lit(x) for k, w in STRUCTURAL.items() for x in (k, w)])
    # A key of a single finding links nothing.
    shared = related.groupBy("kind", "key").agg(F.min("finding_id").alias("_a"), F.max("finding_id").alias("_b")).where(
        F.col("_a") != F.col("_b")).select("kind", "key")
    related = cut(related.join(shared, ["kind", "key"], "left_semi"))
    slim = nodes.select("finding_id", "device", "user", "lo", "hi")
    single = related.join(slim, "finding_id").withColumn("reach", reach[F.col("kind")]).withColumn("w", weight[F.col("kind")])
    near, close = CIRCUMSTANTIAL["temporal_near"], CIRCUMSTANTIAL["temporal_close"]
    tight = F.least("reach", F.lit(micros(config.tight_window)))
    point, groups = CIRCUMSTANTIAL["same_device"], []  # of a device and of a user alike
    for columns in ([], ["device"], ["user"], ["device", "user"]):
        score, known = F.col("w") + point * len(columns), F.lit(True)
        for c in columns:
            known = known & F.col(c).isNotNull()
        enough = lambda more: score + more >= config.min_score  # noqa: B023, E731
        least = lambda more: enough(more) & ((score - point + more < config.min_score) if columns else F.lit(True))  # noqa: B023, E731
        for label, holds, within in (("near", least(near), F.col("reach")), ("close", least(close) & ~enough(near), tight)):
            name = F.to_json(F.array(F.lit("+".join([label, *columns])), "kind", "key", *columns))
            groups.append(single.where(holds & known).select("finding_id", name.alias("group"), "side", "lo", "hi", within.alias("reach")))
    other = related.select("finding_id", F.col("kind").alias("kind2"), F.col("key").alias("key2"), F.col("side").alias("side2"))
    both = single.join(other, "finding_id").where(F.col("kind") < F.col("kind2"))
    # Sides of two relations: a pair is opposite in both.
    mine = F.concat(F.col("side").cast("string"), F.col("side2").cast("string"))
    theirs = F.concat(_opposite(F.col("side")).cast("string"), _opposite(F.col("side2")).cast("string"))
    name = F.to_json(F.array(F.lit("two"), "kind", "key", "kind2", "key2", F.least(mine, theirs)))
    groups.append(both.where(weight[F.col("kind")] + weight[F.col("kind2")] + near >= config.min_score).select(
        "finding_id", name.alias("group"), F.when(mine == theirs, EITHER).when(mine < theirs, LEFT).otherwise(RIGHT).alias("side"),
        "lo", "hi", F.least("reach", reach[F.col("kind2")]).alias("reach")))
    return _union(groups)


def spanning_pairs(members: DataFrame) -> DataFrame:
    """``a, b``: pairs of a group at most ``reach`` apart that connect what all such pairs connect.

    ``members`` has ``finding_id, group, side, lo, hi, reach``; ``reach`` is one per group.
    """
    low, high = F.floor(F.col("lo") / F.col("reach")), F.floor(F.col("hi") / F.col("reach"))
    placed = members.withColumn("bucket", F.explode(F.sequence(low, high))).withColumn(
        "starts", F.col("bucket") == low).withColumn("ends", F.col("bucket") == high)
    cells = placed.groupBy("group", "bucket", "side").agg(
        F.min("finding_id").alias("first"),
        F.max(F.when(F.col("ends"), F.struct("hi", "finding_id"))).alias("last"),
        F.min(F.when(F.col("starts"), F.struct("lo", "finding_id"))).alias("next"))
    # What a cell offers to the opposite side of its own bucket, of the one behind and of the one before it.
    offers = cells.withColumn("_o", F.explode(F.array(*[
        F.struct(F.lit(by).alias("by"), *[(F.col(c) if c == name else F.lit(None)).alias(c) for c in ("first", "last", "next")])
        for by, name in ((0, "first"), (1, "last"), (-1, "next"))]))).groupBy(
        "group", (F.col("bucket") + F.col("_o.by")).alias("bucket"), _opposite(F.col("side")).cast("int").alias("side")).agg(
        *[F.max(F.col("_o")[c]).alias(c) for c in ("first", "last", "next")])
    ends = F.array_compact(F.array(
        F.col("first"),
        F.when(F.col("starts") & (F.col("lo") - F.col("last.hi") <= F.col("reach")), F.col("last.finding_id")),
        F.when(F.col("ends") & (F.col("next.lo") - F.col("hi") <= F.col("reach")), F.col("next.finding_id"))))
    met = placed.join(offers, ["group", "bucket", "side"]).select(F.col("finding_id").alias("a"), F.explode(ends).alias("b"))
    return met.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def followed_pairs(nodes: DataFrame, config: CorrelationConfig) -> DataFrame:
    """``a, b`` that connect what ``auth_then_exec`` connects: an endpoint finding that starts at most
    the window after an authentication on its device has ended.  The device makes each a link."""
    reach = min(micros(config.auth_exec_window), micros(config.max_gap))
    known = nodes.where(F.col("device").isNotNull()).withColumn("_family", F.array_join(F.array_sort("families"), ","))
    pairs = [(a, b) for a, b in _family_pairs() if "identity" in a.split(",") and "endpoint" in b.split(",")]
    found = _paired(known, F.col("_family"), pairs)
    # The instant that counts: the end of an authentication, the start of what follows.
    points = found.select(
        "finding_id", F.concat_ws("|", "_pair", "device").alias("group"), F.col("_side").alias("side"),
        F.when(F.col("_side") == LEFT, F.col("hi")).otherwise(F.col("lo")).alias("at"))
    points = points.withColumn("bucket", F.floor(F.col("at") / reach))
    cells = points.groupBy("group", "bucket", "side").agg(
        F.min(F.struct("at", "finding_id")).alias("least"), F.max(F.struct("at", "finding_id")).alias("most"))
    left, right = (cells.where(F.col("side") == s).drop("side") for s in (LEFT, RIGHT))
    shift = lambda df, by, **names: df.select(
        "group", (F.col("bucket") + by).alias("bucket"), *[F.col(c).alias(n) for c, n in names.items()])
    # In a bucket the order decides, across its border the reach.
    met_right = points.where(F.col("side") == RIGHT).join(shift(left, 0, least="here"), ["group", "bucket"], "left").join(
        shift(left, 1, most="there"), ["group", "bucket"], "left")
    met_left = points.where(F.col("side") == LEFT).join(shift(right, 0, most="here"), ["group", "bucket"], "left").join(
        shift(right, -1, least="there"), ["group", "bucket"], "left")

    def ends(met: DataFrame, lag_here: Column, lag_there: Column) -> DataFrame:
        found = F.array_compact(F.array(
            F.when(lag_here >= 0, F.col("here.finding_id")), F.when(lag_there <= reach, F.col("there.finding_id"))))
        return met.select(F.col("finding_id").alias("a"), F.explode(found).alias("b"))

    at = F.col("at")
    both = ends(met_right, at - F.col("here.at"), at - F.col("there.at")).unionByName(
        ends(met_left, F.col("here.at") - at, F.col("there.at") - at))
    return both.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def spanning_links(
    findings: DataFrame, evidence: DataFrame, tel: Telemetry, config: CorrelationConfig | None = None
) -> DataFrame:
    """``left_id, right_id``: links that connect the same findings as all of ``link_findings``.

    What ``group_cases`` needs, in rows that grow with the findings and not with their pairs.
    """
    config = config or CorrelationConfig()
    nodes, evidence = cut(finding_nodes(findings)), cut(evidence)
    members = certain_groups(relations(nodes, evidence, tel, config), nodes, config)
    return cut(spanning_pairs(members).unionByName(followed_pairs(nodes, config)).distinct().select(
        F.col("a").alias("left_id"), F.col("b").alias("right_id")))


def hubs(findings: DataFrame, evidence: DataFrame, tel: Telemetry, config: CorrelationConfig | None = None) -> DataFrame:
    """``kind, key, members``: how many findings share a key, for keys of more than one."""
    config = config or CorrelationConfig()
    nodes, evidence = cut(finding_nodes(findings)), cut(evidence)
    return relations(nodes, evidence, tel, config).select("kind", "key", "finding_id").distinct().groupBy("kind", "key").agg(
        F.count(F.lit(1)).alias("members")).where(F.col("members") > 1)
