"""Who held a process slot at an instant: joins by lifetime instead of by slot alone.

A process row starts a lifetime in its (device, pid) slot; the next row of the slot ends it.  A
row that names a slot belongs to the latest start at or before it, so it meets one holder however
often the pid was used again: 10,000 uses and 10,000 rows give 10,000 matches, not 10^8 pairs.

Lifetimes have no longest length, so a start can be any distance back.  Starts and rows are laid
out by ``(slot, time bucket)`` and each row reads the start before it in one running pass; a
bucket is handed the last start of all buckets before it.  Only that hand-over looks at a whole
slot, at one row for each of its buckets, so a hot slot spreads over its buckets.

Rows without a time, a device or a pid meet no holder.  Of starts at one instant the largest id
holds the slot.  Repeated rows come back as often as they are there; empty sides give no matches.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros
from .buckets import BUCKET, US, own_bucket
from .instances import with_instance

#: Width of a bucket: a slot's hand-over has as many rows as hours in which it was used.
WIDTH = timedelta(hours=1)


def last_before(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    *,
    left_ts: str,
    right_ts: str,
    right_id: str,
    strict: bool = False,
    width: timedelta = WIDTH,
) -> DataFrame:
    """Each left row with its latest right row at or before it, as structs ``l`` and ``r``.

    ``strict`` takes only right rows of an earlier instant.  Left rows without one are left out;
    rows with a null key or time meet nothing.  ``width`` sizes the buckets and changes no result.
    """
    span = micros(width)

    def usable(df: DataFrame, ts: str) -> DataFrame:
        known = F.col(ts).isNotNull()
        for key in keys:
            known = known & F.col(key).isNotNull()
        return own_bucket(df.where(known), ts, span)

    starts = usable(right.select(*keys, F.col(right_ts).alias("_ts"), F.col(right_id).alias("_rid"),
                                 F.struct("*").alias("r")), "_ts")
    rows = usable(left.select(*keys, F.col(left_ts).alias("_ts"), F.struct("*").alias("l")), "_ts")
    nothing = lambda df, name: F.lit(None).cast(df.schema[name].dataType).alias(name)

    # Hand-over: per bucket its last start, then the last start of the buckets before.
    lasts = starts.groupBy(*keys, BUCKET).agg(F.max_by("r", F.struct(US, "_rid")).alias("r"))
    asked = rows.select(*keys, BUCKET).distinct().select(*keys, BUCKET, nothing(starts, "r"), F.lit(True).alias("_asked"))
    earlier = Window.partitionBy(*keys).orderBy(BUCKET).rangeBetween(Window.unboundedPreceding, -1)
    handed = (
        lasts.select(*keys, BUCKET, "r", F.lit(False).alias("_asked")).unionByName(asked)
        .withColumn("r", F.last("r", ignorenulls=True).over(earlier))
        .where("_asked AND r IS NOT NULL")
    )
    # In a bucket: what was handed over, then starts and rows by time.
    begin, before, at, after = 0, 1, 2, 3
    stream = (
        handed.select(*keys, BUCKET, F.col(BUCKET) * F.lit(span), F.lit(begin), nothing(starts, "_rid"), "r", nothing(rows, "l"))
        .toDF(*keys, BUCKET, US, "_kind", "_rid", "r", "l")
        .unionByName(starts.select(*keys, BUCKET, US, F.lit(at).alias("_kind"), "_rid", "r", nothing(rows, "l")))
        .unionByName(rows.select(*keys, BUCKET, US, F.lit(before if strict else after).alias("_kind"),
                                 nothing(starts, "_rid"), nothing(starts, "r"), "l"))
    )
    order = (
        Window.partitionBy(*keys, BUCKET).orderBy(US, "_kind", "_rid")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = stream.withColumn("r", F.last("r", ignorenulls=True).over(order))
    return found.where(F.col("l").isNotNull() & F.col("r").isNotNull()).select("l", "r")


def join_holders(
    left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, right_id: str,
    left_prefix: str = "l_", right_prefix: str = "r_", strict: bool = False,
) -> DataFrame:
    """:func:`.instances.join_instances` with slots read by lifetime: columns of both sides, ``inferred``.

    Equal identities match as there.  A slot gives the holder at the row's instant, and nothing if
    both carry an identity of one scheme.  The column names of the two sides must differ.
    """
    lp, rp = left_prefix, right_prefix
    by_identity = left.where(F.col(lp + "identity") != "").join(
        right.where(F.col(rp + "identity") != ""), F.col(lp + "identity") == F.col(rp + "identity"),
    ).withColumn("inferred", F.lit(False))
    slot = lambda df, p: df.where(F.col(p + "device") != "").withColumns({"_device": F.col(p + "device"), "_pid": F.col(p + "pid")})
    held = last_before(slot(left, lp), slot(right, rp), ["_device", "_pid"],
                       left_ts=left_ts, right_ts=right_ts, right_id=right_id, strict=strict)
    comparable = (F.col(lp + "scheme") != "") & (F.col(lp + "scheme") == F.col(rp + "scheme"))
    by_slot = held.select(*[F.col(f"l.{c}").alias(c) for c in left.columns],
                          *[F.col(f"r.{c}").alias(c) for c in right.columns])
    return by_identity.unionByName(by_slot.where(~comparable).withColumn("inferred", F.lit(True)))


def _starts(processes: DataFrame, event: str) -> DataFrame:
    keyed = with_instance(processes, "process_guid", "device", "process_id", "r_")
    return keyed.select(F.col("event_id").alias(event), F.col("timestamp").alias("r_at"),
                        "r_identity", "r_scheme", "r_device", "r_pid")


def network_to_holder(network: DataFrame, processes: DataFrame) -> DataFrame:
    """Attribute connections (J05) by identity or by who held the slot: ``net_event_id, proc_event_id, inferred``."""
    left = with_instance(network, "process_guid", "device", "process_id", "l_").select(
        F.col("event_id").alias("net_event_id"), F.col("timestamp").alias("l_at"),
        "l_identity", "l_scheme", "l_device", "l_pid")
    return join_holders(
        left, _starts(processes, "proc_event_id"), left_ts="l_at", right_ts="r_at", right_id="proc_event_id",
    ).select("net_event_id", "proc_event_id", "inferred")


def held_children(seeds: DataFrame, processes: DataFrame) -> DataFrame:
    """Rows whose parent is the seed's instance (J08): ``seed_id, event_id, inferred``.

    ``seeds`` are rows of ``processes``: every start of the slot, seed or not, ends the lifetime
    before it.  A parent found by its slot started at an earlier instant than the child.
    """
    child = with_instance(processes, "parent_process_guid", "device", "parent_process_id", "l_").select(
        "event_id", F.col("timestamp").alias("l_at"), "l_identity", "l_scheme", "l_device", "l_pid")
    wanted = seeds.select(F.col("event_id").alias("seed_id")).distinct()
    found = join_holders(child, _starts(processes, "seed_id"), left_ts="l_at", right_ts="r_at", right_id="seed_id", strict=True)
    return found.select("seed_id", "event_id", "inferred").join(wanted, "seed_id", "left_semi")
