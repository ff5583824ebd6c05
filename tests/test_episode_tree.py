"""Episodes by a tree of step functions: blocks of blocks, hot keys, bounded state."""

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentryframe.operators import episodes

from .test_operators import sweep


def greedy(starts, span):
    out, after = [], -(2**62)
    for s in starts:
        if s > after:
            out.append(s)
            after = s + span
    return out


def test_height_follows_from_the_window():
    assert episodes.tree_height(10**6 * 3600 * 48) == 0
    assert episodes.tree_height(10**6 * 600) == 1
    assert episodes.tree_height(10**6) == 3


@pytest.mark.parametrize("span,minimum", [(2, 1), (2, 3), (7, 2)])
def test_three_levels_equal_a_sweep(spark, monkeypatch, span, minimum):
    """Blocks of two buckets, so that few rows reach every level; gaps that leave whole blocks empty."""
    monkeypatch.setattr(episodes, "FAN_IN", 2)
    monkeypatch.setattr(episodes, "CHAIN_WINDOWS", 2)
    monkeypatch.setattr(episodes, "EXPECTED_SPAN", timedelta(seconds=span * 2 * 2**4))
    assert episodes.tree_height(span * 10**6) == 3
    rng, rows = random.Random(span), []
    for key in range(12):
        t = rng.randrange(-500, 500)
        for _ in range(rng.randrange(1, 250)):
            t += rng.choice([0, 0, 1, 1, 2, 3, 4, 9, 40, 300])
            rows.append((f"k{key}", t))
    df = spark.createDataFrame(rows, "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    want = set()
    for key in {k for k, _ in rows}:
        times = sorted(t for k, t in rows if k == key)
        want |= {(key, *e) for e in sweep(times, minimum, span)}
    got = episodes.episodes(df.repartition(5), ["k"], "ts", minimum, timedelta(seconds=span))
    assert {(r.k, r.start_us // 10**6, r.end_us // 10**6, r.n) for r in got.collect()} == want


def test_one_key_with_all_rows_is_dealt_by_bucket(spark):
    """Steps, blocks and replay of a single key lie in many partitions; the picks equal a plain sweep."""
    rows = spark.range(0, 300_000).select(F.lit("all").alias("k"), F.timestamp_micros(F.col("id") * 7_000_003 % 10**12).alias("ts"))
    got = episodes.episode_starts(rows, ["k"], "ts", 1, timedelta(seconds=60))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small pieces stay apart
    try:
        spread = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    times = sorted({i * 7_000_003 % 10**12 for i in range(300_000)})
    want = greedy(times, 60 * 10**6)
    assert sorted(r.start_us for r in got.select("start_us").collect()) == want
    assert len(spread) > 4 and max(r["count"] for r in spread) < len(want) / 2


def test_state_is_bounded_by_one_window():
    """A bucket of two million starts, fed in batches, leaves no more than a window's entries in the fold."""
    span, batch = 10_000, 10_000
    rng = np.random.default_rng(1)
    starts = np.cumsum(rng.integers(1, 40, 2_000_000))
    fold, most = episodes.Steps(0, span), 0
    for at in range(0, len(starts), batch):
        fold.feed(starts[at:at + batch], starts[at:at + batch])
        most = max(most, len(fold.entries))
    assert most <= span
    entries, exits = fold.end()
    for after in (-1, 17, span // 2, span - 1):
        picked = greedy(starts[starts > after].tolist(), span)
        assert exits[np.searchsorted(entries, after, side="right")] == picked[-1]
    replay, got = episodes.Replay(span), []
    for at in range(0, len(starts), batch):
        got += replay.feed(np.full(batch, -1), starts[at:at + batch])[0].tolist()
    assert got == greedy(starts.tolist(), span)
