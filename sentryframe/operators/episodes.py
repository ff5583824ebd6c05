"""Episodes: non-overlapping clusters of at least ``min_events`` within ``window``.

The sweep is: stand on the earliest event not yet reported; if at least ``min_events``
events lie in ``[t, t + window]`` report them as one episode and continue behind them,
otherwise step to the next event.  Two facts turn that into a distributed job.

1.  Whether an event *qualifies* as a start depends only on the ``min_events``-th event
    counted from it, one ``lead`` inside a time bucket with a halo of one window.
2.  Events that do not qualify never influence the sweep.  Over the qualifying instants the
    sweep is "take the first, then repeatedly the first one later than the last taken plus
    the window", which needs one remembered instant.

A key is never swept whole.  Its qualifying instants are cut into time buckets; each bucket
turns into a monotone step function (last start before the bucket -> last start inside it).
Step functions of neighbouring buckets are composed into those of blocks, blocks into wider
blocks, up to a few per key; those are chained, and what enters a block is handed down level
by level, until every bucket replays with the start it was handed: a parallel prefix over a
tree whose depth follows from the window alone.  Everything streams over sorted rows: a task
holds a batch of them and the steps of one block, at most the distinct instants of one window,
not a bucket and never a key.  Every key takes this way, whatever its size, and nothing runs
while the plan is made.
"""

from __future__ import annotations

import sys
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.time import micros
from .buckets import BUCKET, OWN, US, WINDOWS_PER_BUCKET, bucket_of, own_bucket, with_halo

# Windows per bucket: a bucket passes on the steps that one of its windows leads to.
CHAIN_WINDOWS = 16
# Buckets per block, and blocks per wider block, of the tree.
FAN_IN = 256
# The tree is made high enough for a key to have at most FAN_IN top blocks in this time; longer
# telemetry makes the last chain longer, nothing else.
EXPECTED_SPAN = timedelta(days=3653)

START, END_BOUND = "start_us", "bound_us"

# The functions travel with the task: executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])


def qualifying_starts(
    events: DataFrame, keys: list[str], ts: str, min_events: int, window: timedelta
) -> DataFrame:
    """Distinct ``(keys, start_us)`` at which a cluster of ``min_events`` begins."""
    span = micros(window)
    width = span * WINDOWS_PER_BUCKET
    slim = events.select(*keys, ts).where(F.col(ts).isNotNull())
    if min_events <= 1:
        return slim.select(*keys, F.unix_micros(ts).alias(START)).distinct()
    placed = with_halo(slim, ts, width, after=span)
    order = Window.partitionBy(*keys, BUCKET).orderBy(US)
    reached = F.lead(US, min_events - 1).over(order)
    return (
        placed.withColumn("_reach", reached - F.col(US))
        .where(F.col(OWN) & (F.col("_reach") <= span))
        .groupBy(*keys, BUCKET, F.col(US).alias(START))
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, START)
    )


def _streamed(df: DataFrame, groups: list[str], values: list[str], fold, schema: T.StructType) -> DataFrame:
    """Each group of rows, sorted by ``values``, through ``fold(group)``, piece by piece.

    Rows are dealt by group and sorted.  A fold has ``feed(values as arrays)`` and ``end()``;
    both give the columns that ``schema`` has after the group's own, or None.  A task holds
    one batch and the fold of the group at hand.
    """
    added = [f.name for f in schema.fields if f.name not in groups]
    kept = [g for g in groups if g in schema.names]

    def table(done):
        """One frame of what the folds gave, each with its group's keys repeated."""
        sizes = [len(made[0]) for _, made in done]
        columns = {g: np.repeat(np.array([head[g] for head, _ in done], dtype=object), sizes) for g in kept}
        for i, name in enumerate(added):
            columns[name] = np.concatenate([made[i] for _, made in done]).astype(np.int64)
        return pd.DataFrame(columns)[schema.names]

    def run(batches):
        head = state = None  # the group at hand
        for pdf in batches:
            if not len(pdf):
                continue
            keys = [pdf[g].to_numpy() for g in groups]
            data = [pdf[v].to_numpy() for v in values]
            new = np.ones(len(pdf), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            if head is not None:
                new[0] = any(head[g] != k[0] for g, k in zip(groups, keys))
            starts, done = np.flatnonzero(new), []
            cuts = [0, *starts[starts > 0], len(pdf)]
            for lo, hi in zip(cuts, cuts[1:]):
                if new[lo]:
                    if state is not None:
                        done.append((head, state.end()))
                    head = {g: k[lo] for g, k in zip(groups, keys)}
                    state = fold(head)
                done.append((head, state.feed(*[d[lo:hi] for d in data])))
            done = [(group, made) for group, made in done if made is not None]
            if done:
                yield table(done)
        last = None if state is None else state.end()
        if last is not None:
            yield table([(head, last)])

    dealt = df.select(*groups, *values).repartition(*[F.col(g) for g in groups]).sortWithinPartitions(*groups, *values)
    return dealt.mapInPandas(run, schema)


class Steps:
    """The step function of a block, from the steps of its parts (a start is a step to itself).

    A start taken before the block reaches less than one window into it, so the sweep enters
    at an instant up to there or at the first one beyond.  Each entry's path is followed
    through the block; paths that meet stay together, and the last entry of them stands for all.
    """

    def __init__(self, begin: int, span: int):
        self.span, self.first_window, self.open = span, begin + span, True
        self.entries = self.picks = np.empty(0, np.int64)

    def feed(self, entries, exits):
        if self.open:
            n = int(np.searchsorted(entries, self.first_window, side="right")) + 1
            self.open = n > len(entries)
            self.entries = np.concatenate([self.entries, entries[:n]])
            self.picks = np.concatenate([self.picks, exits[:n]])
        moved = True
        while moved:
            at = np.searchsorted(entries, self.picks + self.span, side="right")
            on = at < len(entries)
            moved = bool(on.any())
            if moved:
                self.picks[on] = exits[at[on]]
            apart = np.r_[self.picks[1:] != self.picks[:-1], True]
            self.entries, self.picks = self.entries[apart], self.picks[apart]

    def end(self):
        return self.entries, self.picks


class Chain:
    """What enters each part of a block (``after``: the reach of the last start taken), given what enters the block.

    A part whose steps arrive in two pieces is told once; its exits lead to no step of its own.
    """

    def __init__(self, span: int, after: int | None = None):
        self.span, self.after, self.part = span, after, None

    def feed(self, parts, entries, exits):
        bounds = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
        told, after = [], []
        for lo, hi in zip(bounds, np.r_[bounds[1:], len(parts)]):
            if parts[lo] != self.part:
                self.part = parts[lo]
                told.append(self.part)
                after.append(self.after)
            at = lo + int(np.searchsorted(entries[lo:hi], self.after, side="right"))
            if at < hi:
                self.after = int(exits[at]) + self.span
        return np.array(told, np.int64), np.array(after, np.int64)

    def end(self):
        return None


class HandedChain(Chain):
    """A chain whose rows carry what enters their block."""

    def __init__(self, span: int):
        super().__init__(span)

    def feed(self, after, parts, entries, exits):
        if self.after is None:
            self.after = int(after[0])
        return super().feed(parts, entries, exits)


class Replay:
    """The starts taken in a bucket, given what enters it."""

    def __init__(self, span: int):
        self.span, self.after = span, None

    def feed(self, after, us):
        if self.after is None:
            self.after = int(after[0])
        picked, at = [], int(np.searchsorted(us, self.after, side="right"))
        while at < len(us):
            picked.append(int(us[at]))
            self.after = picked[-1] + self.span
            at = int(np.searchsorted(us, self.after, side="right"))
        return (np.array(picked, np.int64),)

    def end(self):
        return None


def tree_height(span: int) -> int:
    """Levels of blocks above the buckets, for windows of ``span`` microseconds."""
    height, parts = 0, micros(EXPECTED_SPAN) // (span * CHAIN_WINDOWS)
    while parts > FAN_IN:
        height, parts = height + 1, parts // FAN_IN
    return height


def _picks(starts: DataFrame, keys: list[str], span: int) -> DataFrame:
    """The greedy picks of every key, bucket by bucket."""
    width = span * CHAIN_WINDOWS
    own = list(starts.select(*keys).schema.fields)
    long = lambda *names: T.StructType([*own, *(T.StructField(n, T.LongType()) for n in names)])
    key_columns = [F.col(k) for k in keys]
    stepped_as = long(BUCKET, "_entry", "_exit")

    def steps_of(size):
        return lambda group: Steps(int(group[BUCKET]) * size, span)

    # Dealt once: the steps and the replay read the same exchange.
    placed = starts.withColumn(BUCKET, bucket_of(F.col(START), width)).select(*keys, BUCKET, START).repartition(
        *key_columns, F.col(BUCKET))
    stepped = _streamed(
        placed.select(*keys, BUCKET, F.col(START).alias("_entry"), F.col(START).alias("_exit")),
        [*keys, BUCKET], ["_entry", "_exit"], steps_of(width), stepped_as)
    # Up the tree: the parts of a block become one step function.
    levels, size = [], width
    for _ in range(tree_height(span)):
        size *= FAN_IN
        parts = stepped.withColumnRenamed(BUCKET, "_part").withColumn(
            BUCKET, bucket_of(F.col("_part"), FAN_IN)).repartition(*key_columns, F.col(BUCKET))
        levels.append(parts)
        stepped = _streamed(parts, [*keys, BUCKET], ["_entry", "_exit"], steps_of(size), stepped_as)
    # Along the top, then down again with what enters each block.
    entered = _streamed(
        stepped, keys, [BUCKET, "_entry", "_exit"], lambda group: Chain(span, -(2**62)), long(BUCKET, "_after"))
    for parts in reversed(levels):
        entered = _streamed(
            parts.join(entered, [*keys, BUCKET]), [*keys, BUCKET], ["_after", "_part", "_entry", "_exit"],
            lambda group: HandedChain(span), long("_part", "_after")).withColumnRenamed("_part", BUCKET)
    joined = placed.join(entered, [*keys, BUCKET])
    return _streamed(joined, [*keys, BUCKET], ["_after", START], lambda group: Replay(span), long(START))


def episode_starts(
    events: DataFrame, keys: list[str], ts: str, min_events: int, window: timedelta
) -> DataFrame:
    """One row per episode: keys, ``start_us`` and ``bound_us`` (start plus window).

    Key columns must not be null (canonical strings never are).
    """
    span = micros(window)
    starts = qualifying_starts(events, keys, ts, min_events, window)
    return _picks(starts, keys, span).withColumn(END_BOUND, F.col(START) + F.lit(span))


def episode_events(
    events: DataFrame,
    keys: list[str],
    ts: str,
    min_events: int,
    window: timedelta,
) -> DataFrame:
    """The events of every episode, each with the ``start_us`` of the one it belongs to.

    An episode is at most one window long, so it touches at most two buckets: the join back
    to the events is an equality on (keys, bucket) with the range as a residual test, and
    an event matches at most one episode.
    """
    width = micros(window) * WINDOWS_PER_BUCKET
    found = episode_starts(events, keys, ts, min_events, window).withColumn(
        BUCKET,
        F.explode(
            F.sequence(bucket_of(F.col(START), width), bucket_of(F.col(END_BOUND), width))
        ),
    )
    placed = own_bucket(events, ts, width)
    return (
        placed.join(found, [*keys, BUCKET])
        .where(F.col(US).between(F.col(START), F.col(END_BOUND)))
        .drop(BUCKET, END_BOUND)
    )


def episodes(
    events: DataFrame,
    keys: list[str],
    ts: str,
    min_events: int,
    window: timedelta,
    aggregates: list | None = None,
) -> DataFrame:
    """One row per episode: keys, ``start_us``, ``end_us``, ``n`` and extra aggregates."""
    rows = episode_events(events, keys, ts, min_events, window)
    return rows.groupBy(*keys, START).agg(
        F.max(US).alias("end_us"), F.count(F.lit(1)).alias("n"), *(aggregates or [])
    )
