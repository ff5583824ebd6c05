"""Lifetime joins, distributed numbers and bounded samples against plain Python."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sentryframe.operators import lifetimes, ranking
from sentryframe.plans import evaluate

PROCESS = "event_id string, process_guid string, device string, process_id long, parent_process_guid string, parent_process_id long, s double"
NETWORK = "event_id string, process_guid string, device string, process_id long, s double"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("timestamp", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    instant = lambda: rng.choice([None] * 2 + [rng.randrange(40) * 900.0 for _ in range(48)])
    guid = lambda: rng.choice(["", None, "sysmon:%d" % rng.randrange(30), "start:%d" % rng.randrange(30), "other:1"])
    pid = lambda: rng.choice([None, 1, 2, 3, 4])
    device = lambda: rng.choice(["h1", "h2", "", None])
    procs = [(f"p{i:03d}", guid(), device(), pid(), guid(), pid(), instant()) for i in range(150)]
    nets = [(f"n{i:03d}", guid(), device(), pid(), instant()) for i in range(200)]
    return procs, nets, frame(spark, procs, PROCESS).repartition(5), frame(spark, nets, NETWORK).repartition(3)


def scheme(guid):
    return (guid or "").split(":")[0] if (guid or "").startswith(("sysmon:", "start:")) else ""


def holders(rows, starts, strict):
    """``(row id, start id, inferred)``: rows and starts are (id, guid, device, pid, s)."""
    out = []
    for rid, g, d, p, s in rows:
        out += [(rid, sid, False) for sid, sg, *_ in starts if scheme(g) and g == sg]
        if not d or p is None or s is None:
            continue
        held = [(ss, sid, sg) for sid, sg, sd, sp, ss in starts
                if sd == d and sp == p and ss is not None and (ss < s if strict else ss <= s)]
        if held:
            _, sid, sg = max(held, key=lambda h: h[:2])
            if not (scheme(g) and scheme(g) == scheme(sg)):
                out.append((rid, sid, True))
    return sorted(out)


def test_network_to_holder_equals_brute_force(tables):
    procs, nets, procs_df, nets_df = tables
    got = lifetimes.network_to_holder(nets_df, procs_df).collect()
    want = holders(nets, [(e, g, d, p, s) for e, g, d, p, _, _, s in procs], strict=False)
    assert sorted(map(tuple, got)) == want
    assert any(inferred for *_, inferred in want) and not all(inferred for *_, inferred in want)


def test_held_children_equal_brute_force(tables):
    procs, _, procs_df, _ = tables
    seeds = {e for e, *_ in procs if int(e[1:]) % 3 == 0}
    rows = [(e, pg, d, pp, s) for e, _, d, _, pg, pp, s in procs]
    want = sorted((sid, e, i) for e, sid, i in holders(rows, [(e, g, d, p, s) for e, g, d, p, _, _, s in procs], strict=True) if sid in seeds)
    got = lifetimes.held_children(procs_df.where((F.substring("event_id", 2, 3).cast("int") % 3) == 0), procs_df).collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("width", [1, 900, 100_000])
def test_bucket_width_changes_nothing(tables, width):
    procs, nets, procs_df, nets_df = tables
    got = lifetimes.last_before(
        nets_df.na.drop(subset=["device"]), procs_df, ["device", "process_id"], left_ts="timestamp", right_ts="timestamp",
        right_id="event_id", width=timedelta(seconds=width)).select("l.event_id", F.col("r.event_id").alias("held")).collect()
    want = []
    for e, _, d, p, s in nets:
        held = [(ss, pe) for pe, _, pd, pp, _, _, ss in procs if None not in (d, p, s, ss) and pd == d and pp == p and ss <= s]
        if held:
            want.append((e, max(held)[1]))
    assert sorted(map(tuple, got)) == sorted(want)


def test_one_slot_used_ten_thousand_times(spark):
    """One match a row, and the slot's rows in many tasks."""
    n = 10_000
    at = F.timestamp_seconds(F.col("id") * 600)
    procs = spark.range(n).select(F.format_string("p%05d", "id").alias("event_id"), F.lit("").alias("process_guid"),
                                  F.lit("h").alias("device"), F.lit(7).cast("long").alias("process_id"), at.alias("timestamp"))
    nets = procs.withColumns({"event_id": F.replace("event_id", F.lit("p"), F.lit("n")), "timestamp": F.col("timestamp") + F.expr("INTERVAL 5 MINUTES")})
    found = lifetimes.network_to_holder(nets, procs)
    assert found.count() == n
    assert found.where(F.substring("net_event_id", 2, 5) != F.substring("proc_event_id", 2, 5)).count() == 0
    held = lifetimes.last_before(nets, procs, ["device", "process_id"], left_ts="timestamp", right_ts="timestamp", right_id="event_id")
    spread = [r["n"] for r in held.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(spread) == 1 or max(spread) < n / 2


def test_empty_sides(spark, tables):
    _, _, procs_df, nets_df = tables
    assert lifetimes.network_to_holder(nets_df.limit(0), procs_df).count() == 0
    assert lifetimes.network_to_holder(nets_df, procs_df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 8])
def test_numbers_of_one_day(spark, parts):
    """All rows on one day and many at one instant: numbers as in one sorted list, in several tasks."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 2, 3]), f"e{i:04d}") for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "t int, event_id string").repartition(parts)
    got = ranking.numbered(df, ["t", "event_id"]).orderBy("_n").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r["t"], r["event_id"]) for r in got] == want
    assert [r["_n"] for r in got] == list(range(3000))
    assert ranking.numbered(df.limit(0), ["t", "event_id"]).count() == 0


def test_sample_of_a_hot_host_is_cut_before_the_shuffle(spark):
    rows = spark.range(20_000).select(
        F.format_string("p%05d", "id").alias("event_id"), F.timestamp_seconds(F.col("id")).alias("timestamp"),
        F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("device"), F.lit("u").alias("user"))
    picked = evaluate.sample_controls(rows, 30, seed=3)
    assert "WindowGroupLimit" in picked._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["device"], r["event_id"]) for r in picked.collect())
    again = sorted((r["device"], r["event_id"]) for r in evaluate.sample_controls(rows.repartition(7), 30, seed=3).collect())
    assert got == again and len(got) == 24
    assert sum(d == "cold" for d, _ in got) == 12
