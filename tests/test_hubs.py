"""Spanning links connect what all links connect, in rows that grow with the findings."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sentryframe.operators.components import connected_components
from sentryframe.plans import correlate, hubs
from sentryframe.schemas import EVIDENCE_COLUMNS, FINDING_SCHEMA

from .builders import process, telemetry

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
RULES = ("ATH-001", "ATH-003", "ATH-005", "ATH-006", "ATH-007", "AWS-002", "K8S-001")
EVIDENCE = ("finding_id string, rule_id string, event_id string, event_type string, timestamp timestamp, summary string, device string, "
            "principal string, other_principal string, process_id long, process_guid string, parent_process_id long, parent_process_guid string")


def tables(spark, findings, evidence):
    names = [f.name for f in FINDING_SCHEMA.fields]
    made = spark.createDataFrame([tuple(f.get(n) for n in names) for f in findings], FINDING_SCHEMA)
    return made, spark.createDataFrame([tuple(e.get(c) for c in EVIDENCE_COLUMNS) for e in evidence], EVIDENCE)


def made_up(seed, n, hours):
    """Findings of few hosts, users, processes and principals, sparse enough that not all are linked."""
    rng = random.Random(seed)
    pick = lambda name, k: f"{name}{rng.randrange(k)}"
    findings, evidence = [], []
    for i in range(n):
        rule, name = rng.choice(RULES), f"f{i:03d}"
        first = T0 + timedelta(seconds=rng.randrange(hours * 3600))
        last = first + timedelta(seconds=rng.choice((0, 0, 30, 900, 9000)))
        findings.append({
            "finding_id": name, "rule_id": rule, "severity": "high", "severity_rank": 3, "device": pick("h", 12), "user": pick("u", 12),
            "first_seen": first, "last_seen": last, "source_device": rng.choice(("", "", "", pick("h", 12))),
            "target_devices": [pick("h", 12)] if rng.random() < 0.1 else None})
        for k in range(rng.choice((1, 1, 2))):
            guid = lambda: rng.choice(("", "sysmon:" + pick("g", 30), f"start:{pick('h', 12)}|{rng.randrange(9)}|x"))
            evidence.append({
                "finding_id": name, "rule_id": rule, "event_id": pick("e", 8 * n), "event_type": rng.choice(("process", "logon")), "timestamp": first,
                "device": pick("h", 12), "principal": pick("p", 14), "other_principal": rng.choice((None, "", pick("p", 14))),
                "process_id": rng.choice((None, rng.randrange(9))), "process_guid": guid(),
                "parent_process_id": rng.choice((None, rng.randrange(9))), "parent_process_guid": guid()})
    return findings, evidence


def components(findings, links):
    return {r["finding_id"]: r["component"] for r in connected_components(findings, links, "finding_id", "left_id", "right_id").collect()}


@pytest.mark.parametrize("seed, n, hours", [(1, 60, 30), (2, 140, 20), (3, 40, 3), (4, 200, 90)])
def test_spanning_links_are_links_and_connect_the_same(spark, seed, n, hours):
    findings, evidence = tables(spark, *made_up(seed, n, hours))
    launched = [process(timestamp=f"2024-01-01 00:0{i}:00", device=f"h{i}", process_id=i, parent_process_guid=f"sysmon:g{i % 5}") for i in range(9)]
    tel = telemetry(spark, launched)
    every = correlate.link_findings(findings, evidence, tel)
    some = hubs.spanning_links(findings, evidence, tel)
    pair = lambda df: {frozenset((r["left_id"], r["right_id"])) for r in df.collect()}
    assert pair(some) <= pair(every)
    whole = components(findings, every)
    assert components(findings, some) == whole
    assert 2 < len(set(whole.values())) < n, "neither one case nor none, or the test says little"


def test_pairs_of_a_group_at_every_distance(spark):
    rng = random.Random(6)
    rows = []
    for g in range(40):
        for i in range(rng.randrange(2, 9)):
            lo = rng.randrange(60)
            rows.append((f"{g}-{i}", f"g{g}", rng.choice((1, 2)) if g % 2 else 0, lo, lo + rng.choice((0, 1, 5, 30)), rng.choice((3, 7)) if g < 0 else 3 + g % 5))
    members = spark.createDataFrame(rows, "finding_id string, group string, side int, lo long, hi long, reach long")

    def joined(pairs):
        label = {r[0]: r[0] for r in rows}
        for a, b in pairs:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
        return label

    every = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (a[2] == b[2] == 0 or a[2] + b[2] == 3)
             and max(0, b[3] - a[4], a[3] - b[4]) <= a[5]]
    some = [(r["a"], r["b"]) for r in hubs.spanning_pairs(members).distinct().collect()]
    assert set(some) <= set(every) and joined(some) == joined(every)


def test_a_principal_with_fifty_thousand_findings_in_an_hour(spark):
    n = 50_000
    row = spark.range(n).select(
        F.concat(F.lit("f"), F.col("id").cast("string")).alias("finding_id"),
        F.when(F.col("id") % 2 == 0, "AWS-002").otherwise("ATH-001").alias("rule_id"),
        (F.lit(T0) + F.make_dt_interval(secs=F.col("id") % 3600)).alias("at"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("device"))
    fields = {"finding_id": F.col("finding_id"), "rule_id": F.col("rule_id"), "device": F.col("device"), "user": F.lit("u"),
              "first_seen": F.col("at"), "last_seen": F.col("at"), "severity_rank": F.lit(3)}
    findings = row.select(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FINDING_SCHEMA.fields])
    cited = {"finding_id": F.col("finding_id"), "rule_id": F.col("rule_id"), "event_id": F.col("finding_id"), "event_type": F.lit("control"),
             "timestamp": F.col("at"), "principal": F.lit("root")}
    types = dict(spark.createDataFrame([], EVIDENCE).dtypes)
    evidence = row.select(*[cited.get(c, F.lit(None)).cast(types[c]).alias(c) for c in EVIDENCE_COLUMNS])
    tel = telemetry(spark)
    links = hubs.spanning_links(findings, evidence, tel)
    assert n - 1 <= links.count() <= 6 * n
    grouped = connected_components(findings, links, "finding_id", "left_id", "right_id")
    assert grouped.groupBy("component").count().collect() == [("f0", n)]
    top = hubs.hubs(findings, evidence, tel).where(F.col("kind") == "shared_principal").agg(F.max("members")).first()[0]
    assert top == n // 2 or top == n
