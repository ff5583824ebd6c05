"""Time buckets: how a per-key time operator avoids putting one key in one task.

A window function partitioned by a key alone sorts everything that key owns in a single
task.  Every sequence operator here partitions by ``(key, bucket)`` instead, with a bucket
several times wider than the operator's reach, and copies the rows near a bucket edge into
the neighbour (the halo), so each bucket can be evaluated alone and exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET = "_bucket"
US = "_us"
OWN = "_own"

# A bucket spans this many windows: 1/8 of the rows at most are copied into a neighbour.
WINDOWS_PER_BUCKET = 8


def bucket_of(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(width)).cast("long")


def own_bucket(df: DataFrame, ts: str, width: int) -> DataFrame:
    """Add the instant in microseconds and the bucket that owns the row."""
    us = F.unix_micros(F.col(ts))
    return df.withColumn(US, us).withColumn(BUCKET, bucket_of(us, width))


def with_halo(
    df: DataFrame, ts: str, width: int, *, before: int = 0, after: int = 0
) -> DataFrame:
    """Place each row in its own bucket and in any bucket it can reach.

    ``before`` copies a row into buckets that start within ``before`` microseconds after it
    (so they can look back at it); ``after`` copies it into buckets that end within
    ``after`` before it (so they can look ahead to it).  ``_own`` marks the original.
    """
    us = F.unix_micros(F.col(ts))
    home = bucket_of(F.col(US), width)
    reach = F.sequence(
        bucket_of(F.col(US) - F.lit(after), width), bucket_of(F.col(US) + F.lit(before), width)
    )
    return (
        df.withColumn(US, us)
        .withColumn(BUCKET, F.explode(reach))
        .withColumn(OWN, F.col(BUCKET) == home)
    )
