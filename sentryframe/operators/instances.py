"""Joins between rows that name a process instance.

Two rows name the same instance when both carry an identity of one scheme and it is equal;
when either has none, or the schemes differ, the (device, pid) slot decides and the match is
marked as inferred.  Both tests are equalities, so both are hash joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import identity_scheme, usable_identity


def with_instance(
    df: DataFrame, identity: str | Column, device: str, pid: str, prefix: str = "i_"
) -> DataFrame:
    """Add ``<prefix>identity, scheme, device, pid``, the columns the joins read."""
    column = F.col(identity) if isinstance(identity, str) else identity
    known = usable_identity(column)
    return (
        df.withColumn(prefix + "identity", known)
        .withColumn(prefix + "scheme", identity_scheme(known))
        .withColumn(prefix + "device", F.trim(F.coalesce(F.col(device), F.lit(""))))
        .withColumn(prefix + "pid", F.col(pid).cast("long"))
    )


def join_instances(
    left: DataFrame, right: DataFrame, left_prefix: str = "l_", right_prefix: str = "r_"
) -> DataFrame:
    """All matching pairs of two sides prepared by :func:`with_instance`, plus ``inferred``.

    Slots are joined with the scheme as part of the condition, so rows that both carry an
    identity of one scheme never meet through their slot.
    """
    lp, rp = left_prefix, right_prefix
    by_identity = left.where(F.col(lp + "identity") != "").join(
        right.where(F.col(rp + "identity") != ""),
        F.col(lp + "identity") == F.col(rp + "identity"),
    ).withColumn("inferred", F.lit(False))
    slot = lambda df, p: df.where((F.col(p + "device") != "") & F.col(p + "pid").isNotNull())
    comparable = (F.col(lp + "scheme") != "") & (F.col(lp + "scheme") == F.col(rp + "scheme"))
    by_slot = slot(left, lp).join(
        slot(right, rp),
        (F.col(lp + "device") == F.col(rp + "device"))
        & (F.col(lp + "pid") == F.col(rp + "pid")) & ~comparable,
    ).withColumn("inferred", F.lit(True))
    return by_identity.unionByName(by_slot)


def network_to_process(network: DataFrame, processes: DataFrame) -> DataFrame:
    """Attribute connections to processes (J05): ``net_event_id, proc_event_id, inferred``."""
    left = with_instance(
        network.select(F.col("event_id").alias("net_event_id"), "process_guid", "device", "process_id"),
        "process_guid", "device", "process_id", "l_",
    ).select("net_event_id", "l_identity", "l_scheme", "l_device", "l_pid")
    right = with_instance(
        processes.select(F.col("event_id").alias("proc_event_id"), "process_guid", "device", "process_id"),
        "process_guid", "device", "process_id", "r_",
    ).select("proc_event_id", "r_identity", "r_scheme", "r_device", "r_pid")
    return join_instances(left, right).select("net_event_id", "proc_event_id", "inferred")


def instances_per_slot(processes: DataFrame) -> DataFrame:
    """``device, process_id, instances, unidentified``: what held each slot."""
    keyed = with_instance(processes, "process_guid", "device", "process_id")
    return keyed.where(F.col("process_id").isNotNull()).groupBy("device", "process_id").agg(
        F.countDistinct(F.when(F.col("i_identity") != "", F.col("i_identity"))).alias("instances"),
        F.count_if(F.col("i_identity") == "").alias("unidentified"),
        F.count(F.lit(1)).alias("rows"),
    )


def reused_slots(processes: DataFrame, top: int = 25) -> DataFrame:
    """The slots held by more than one instance, most reused first."""
    return (
        instances_per_slot(processes).where(F.col("instances") > 1)
        .orderBy(F.col("instances").desc(), F.col("rows").desc(), "device", "process_id")
        .limit(top)
    )


def slot_candidates(processes: DataFrame, slots: DataFrame) -> DataFrame:
    """The distinct instances behind each requested ``device, process_id``, earliest row each.

    Rows without an identity are one unnamed instance of the slot.
    """
    wanted = processes.join(slots.select("device", "process_id").distinct(), ["device", "process_id"], "left_semi")
    keyed = wanted.withColumn("identity", usable_identity(F.col("process_guid")))
    row = F.struct("timestamp", "event_id", "process_name", "command_line")
    return (
        keyed.groupBy("device", "process_id", "identity")
        .agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("rows"))
        .select("device", "process_id", "identity", "_first.*", "rows")
    )


def first_row_per_instance(processes: DataFrame) -> DataFrame:
    """Earliest row of every instance that has an identity."""
    row = F.struct("timestamp", "event_id", "process_name", "parent_process_name",
                   "parent_process_id", "parent_process_guid", "device", "process_id")
    return (
        processes.withColumn("identity", usable_identity(F.col("process_guid")))
        .where(F.col("identity") != "")
        .groupBy("identity").agg(F.min(row).alias("_r")).select("identity", "_r.*")
    )


def resolve_parent(children: DataFrame, processes: DataFrame) -> DataFrame:
    """The parent row of every child row.

    By the parent's identity when the child names one (a missing instance is a gap, never a
    guess); else by the parent slot, but only when exactly one instance is known to have held
    it.  ``children`` has event_id, device, parent_process_id, parent_process_guid; the
    result is ``event_id, parent_event_id, parent_name, status`` with status one of
    identity, inferred, ambiguous, gap, unknown.
    """
    asked = children.select(
        "event_id", "device", "parent_process_id",
        usable_identity(F.col("parent_process_guid")).alias("parent_identity"),
    )
    by_identity = asked.where(F.col("parent_identity") != "").join(
        first_row_per_instance(processes).select(
            F.col("identity").alias("parent_identity"), F.col("event_id").alias("parent_event_id"),
            F.col("process_name").alias("parent_name"),
        ),
        "parent_identity", "left",
    ).select(
        "event_id", "parent_event_id", "parent_name",
        F.when(F.col("parent_event_id").isNull(), "gap").otherwise("identity").alias("status"),
    )
    # An unnamed row is its own instance only if nothing named held the slot.
    row = F.struct("timestamp", "event_id", "process_name")
    slots = (
        processes.where(F.col("process_id").isNotNull())
        .withColumn("_identity", usable_identity(F.col("process_guid")))
        .groupBy("device", "process_id")
        .agg(
            F.countDistinct("_identity").alias("_held"), F.min(row).alias("_r"),
        )
        .select("device", F.col("process_id").alias("parent_process_id"), "_held",
                F.col("_r.event_id").alias("_pid_event"), F.col("_r.process_name").alias("_pid_name"))
    )
    by_slot = asked.where(F.col("parent_identity") == "").join(
        slots, ["device", "parent_process_id"], "left"
    )
    one = F.coalesce(F.col("_held") == 1, F.lit(False))
    by_slot = by_slot.select(
        "event_id",
        F.when(one, F.col("_pid_event")).alias("parent_event_id"),
        F.when(one, F.col("_pid_name")).alias("parent_name"),
        F.when(F.col("parent_process_id").isNull(), "unknown")
        .when(F.col("_held").isNull(), "gap").when(one, "inferred").otherwise("ambiguous")
        .alias("status"),
    )
    return by_identity.unionByName(by_slot)


def ancestry(seeds: DataFrame, processes: DataFrame, depth: int = 3) -> DataFrame:
    """Repeated parent resolution (J07): ``seed_id, hop, event_id, process_name, status``.

    The parent of every row is resolved once; the walk is then ``depth`` joins on event id.
    A row already on the path ends the walk.
    """
    parents = resolve_parent(processes, processes).where(F.col("parent_event_id").isNotNull())
    edge = parents.select(
        F.col("event_id").alias("_child"), F.col("parent_event_id").alias("event_id"),
        F.col("parent_name").alias("process_name"), "status",
    )
    walk = seeds.select(
        F.col("event_id").alias("seed_id"), F.col("event_id").alias("_at"),
        F.array("event_id").alias("_path"),
    )
    hops = []
    for hop in range(1, depth + 1):
        reached = walk.join(edge, F.col("_at") == F.col("_child")).where(
            ~F.array_contains("_path", F.col("event_id"))
        )
        hops.append(reached.select("seed_id", F.lit(hop).alias("hop"), "event_id", "process_name", "status"))
        walk = reached.select(
            "seed_id", F.col("event_id").alias("_at"),
            F.array_append("_path", F.col("event_id")).alias("_path"),
        )
    out = hops[0]
    for part in hops[1:]:
        out = out.unionByName(part)
    return out


def children(seeds: DataFrame, processes: DataFrame) -> DataFrame:
    """Rows whose parent is the seed's instance (J08): ``seed_id, event_id, inferred``."""
    left = with_instance(
        seeds.select(F.col("event_id").alias("seed_id"), "process_guid", "device", "process_id"),
        "process_guid", "device", "process_id", "l_",
    ).select("seed_id", "l_identity", "l_scheme", "l_device", "l_pid")
    right = with_instance(
        processes.select("event_id", "parent_process_guid", "device", "parent_process_id"),
        "parent_process_guid", "device", "parent_process_id", "r_",
    ).select("event_id", "r_identity", "r_scheme", "r_device", "r_pid")
    return join_instances(left, right).select("seed_id", "event_id", "inferred")
