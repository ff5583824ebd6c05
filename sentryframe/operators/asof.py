"""Forward as-of joins: the earliest right row within a window after each left row.

Left and right rows are laid out in one ordered stream per ``(key, time bucket)`` and each
left row reads the next right row ahead of it.  No pair is ever materialised, so the cost
is one sort however many rows share a key, and a hot key spreads over its buckets.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros
from .buckets import BUCKET, US, WINDOWS_PER_BUCKET, with_halo


def first_after(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    *,
    left_ts: str,
    right_ts: str,
    window: timedelta,
    right_columns: list[str],
    right_id: str,
    until: Column | None = None,
    how: str = "inner",
    prefix: str = "next_",
) -> DataFrame:
    """Attach to each left row the earliest right row with ``left <= right <= until``.

    ``keys`` exist on both sides.  ``window`` bounds the reach and sizes the buckets;
    ``until`` (an instant, computed from left columns) replaces ``left + window`` as the
    limit but must not exceed it.  Ties on time go to the smallest ``right_id``.  Matched
    values arrive in ``<prefix><column>``; ``how='left'`` keeps unmatched left rows.
    """
    span = micros(window)
    width = span * WINDOWS_PER_BUCKET
    payload = F.struct(*[F.col(c) for c in dict.fromkeys([right_ts, right_id, *right_columns])])
    limit = F.unix_micros(until) if until is not None else F.unix_micros(left_ts) + F.lit(span)

    ahead = with_halo(
        right.select(*keys, F.col(right_ts), F.col(right_id).alias("_rid"), payload.alias("_r")),
        right_ts, width, after=span,
    ).select(*keys, BUCKET, US, F.lit(1).alias("_kind"), "_rid", "_r",
             F.lit(None).alias("_left"), F.lit(None).cast("long").alias("_limit"))
    here = with_halo(
        left.select(*keys, F.col(left_ts), F.struct("*").alias("_left"), limit.alias("_limit")),
        left_ts, width,
    ).select(*keys, BUCKET, US, F.lit(0).alias("_kind"), F.lit(None).alias("_rid"),
             F.lit(None).alias("_r"), "_left", "_limit")

    stream = here.unionByName(ahead)
    order = (
        Window.partitionBy(*keys, BUCKET).orderBy(F.col(US).desc(), F.col("_kind").desc(),
                                                  F.col("_rid").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Walking backwards in time, the last right row seen is the next one ahead.
    found = stream.withColumn("_next", F.last("_r", ignorenulls=True).over(order)).where(
        F.col("_kind") == 0
    )
    hit = F.unix_micros(F.col(f"_next.{right_ts}")) <= F.col("_limit")
    found = found.withColumn("_next", F.when(hit, F.col("_next")))
    if how == "inner":
        found = found.where(F.col("_next").isNotNull())
    return found.select(
        "_left.*", *[F.col(f"_next.{c}").alias(prefix + c)
                     for c in dict.fromkeys([right_ts, right_id, *right_columns])]
    )
