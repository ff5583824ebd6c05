"""Numbering all rows of a table without one task that sees them, or all rows of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage_cut import cut

#: Bits of a row's place inside its partition in what ``monotonically_increasing_id`` gives.
PLACE_BITS = 33


def numbered(df: DataFrame, order: list[str], name: str = "_n") -> DataFrame:
    """Add ``name``: 0, 1, 2 and so on by the columns ``order``, nulls first.

    Rows are dealt to tasks by ranges of ``order`` and sorted there; a partition's offset is the
    count of the partitions before it, one row for each.  Ranges are sampled, so the dealt rows are
    written once and offsets and places read from that.  ``order`` should end in a unique column:
    rows equal in all of it are numbered in any order, and stand in one task.
    """
    at = F.monotonically_increasing_id()
    dealt = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part = F.shiftright("_at", PLACE_BITS)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return (
        dealt.withColumn("_part", part).join(offsets, "_part")
        .withColumn(name, place + F.col("_before")).drop("_at", "_part", "_before")
    )
