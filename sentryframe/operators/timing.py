"""Gaps between successive events, and exact medians, without one task per key."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros
from .buckets import BUCKET, US, own_bucket
from .lineage_cut import cut

# Gaps are measured inside day buckets; the few gaps across buckets are stitched after.
GAP_BUCKET = timedelta(days=1)
# Bins per unit of natural logarithm: neighbouring bins differ by 0.4 %.
BINS_PER_LOG = 256


def inter_arrival(
    events: DataFrame, keys: list[str], ts: str, bucket: timedelta = GAP_BUCKET
) -> DataFrame:
    """``keys, gap_us``: one row per pair of successive events of a key.

    Inside a bucket the gap is a ``lag``; across buckets it is the distance between one
    bucket's last event and the next non-empty bucket's first, taken from the per-bucket
    bounds (one small row per key and bucket).
    """
    placed = own_bucket(events.select(*keys, ts).where(F.col(ts).isNotNull()), ts, micros(bucket))
    inside = placed.select(
        *keys,
        (F.col(US) - F.lag(US).over(Window.partitionBy(*keys, BUCKET).orderBy(US))).alias("gap_us"),
    ).where(F.col("gap_us").isNotNull())
    bounds = placed.groupBy(*keys, BUCKET).agg(F.min(US).alias("_lo"), F.max(US).alias("_hi"))
    across = bounds.select(
        *keys,
        (F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*keys).orderBy(BUCKET))).alias("gap_us"),
    ).where(F.col("gap_us").isNotNull())
    return inside.unionByName(across)


def exact_median(values: DataFrame, keys: list[str], value: str, out: str, times: str | None = None) -> DataFrame:
    """``keys, out``: the exact median of non-negative values per group.

    ``times`` names a column that says how often a row's value occurs.

    The mean of the middle two when even.  Values are counted, then binned on a logarithmic
    scale; the bins a group can have are bounded (about 11,000 for 64-bit values), so ranking
    them in one task is safe, and only the one or two bins that hold the middle ranks are
    ranked value by value.  A group of any size is therefore spread over its values.
    """
    counts = (
        values.select(*keys, F.col(value).cast("double").alias("_v"), (F.col(times) if times else F.lit(1)).alias("_w"))
        .where(F.col("_v").isNotNull())
        .groupBy(*keys, F.floor(F.ln(F.col("_v") + 1) * BINS_PER_LOG).alias("_bin"), "_v")
        .agg(F.sum("_w").alias("_c"))
    )
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = (
        counts.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_size"))
        .withColumn("_n", F.sum("_size").over(Window.partitionBy(*keys)))
        .withColumn("_before", F.sum("_size").over(upto) - F.col("_size"))
    )
    left, right = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    inside = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_size"))
    middle = bins.where(inside(left) | inside(right)).select(*keys, "_bin", "_n", "_before")
    within = (
        Window.partitionBy(*keys, "_bin").orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranked = (
        counts.join(middle, [*keys, "_bin"])
        .withColumn("_upto", F.col("_before") + F.sum("_c").over(within))
        .withColumn("_from", F.col("_upto") - F.col("_c"))
    )
    holds = lambda rank: F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col("_v"))
    return ranked.groupBy(*keys).agg(
        ((F.max(holds(left)) + F.max(holds(right))) / 2).alias(out)
    )


# Regularity (fixed values).
REGULARITY_THRESHOLD = 0.15
MIN_MEANINGFUL_INTERVAL_SECONDS = 5.0
MIN_INTERVALS = 3


def connection_patterns(events: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Timing of every relationship named by ``keys``.

    Count, span, and the robust shape of the gaps: median, median absolute deviation and
    their ratio, which stay null below three gaps, the ratio also when the median is zero.
    """
    counted = events.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("connection_count"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
    )
    # Counted once and written: bounds, median and deviations all read the counts.
    gaps = cut(inter_arrival(events, keys, ts).groupBy(*keys, "gap_us").agg(F.count(F.lit(1)).alias("_times")))
    bounds = gaps.groupBy(*keys).agg(
        (F.min("gap_us") / 1e6).alias("min_interval"), (F.max("gap_us") / 1e6).alias("max_interval")
    )
    medians = exact_median(gaps, keys, "gap_us", "_median", "_times")
    spread = gaps.join(medians, keys).select(
        *keys, F.abs(F.col("gap_us") - F.col("_median")).alias("_dev"), "_times"
    )
    mads = exact_median(spread, keys, "_dev", "_mad", "_times")
    out = counted.join(bounds, keys, "left").join(medians, keys, "left").join(mads, keys, "left")
    n_gaps = F.col("connection_count") - 1
    out = out.select(
        *keys, "connection_count", "first_seen", "last_seen",
        ((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 1e6).alias("span_seconds"),
        n_gaps.alias("interarrival_count"),
        F.when(n_gaps >= MIN_INTERVALS, F.col("_median") / 1e6).alias("median_interval"),
        F.when(n_gaps >= MIN_INTERVALS, F.col("_mad") / 1e6).alias("interval_mad"),
        F.when((n_gaps >= MIN_INTERVALS) & (F.col("_median") > 0), F.col("_mad") / F.col("_median"))
        .alias("robust_cv"),
        "min_interval", "max_interval",
    )
    return out.withColumn("is_regular", is_regular())


def is_regular() -> Column:
    """Tightly clustered gaps, from the columns of :func:`connection_patterns`."""
    return F.coalesce(
        (F.col("interarrival_count") >= MIN_INTERVALS)
        & (F.col("robust_cv") < REGULARITY_THRESHOLD)
        & (F.col("median_interval") > MIN_MEANINGFUL_INTERVAL_SECONDS),
        F.lit(False),
    )


def support_note() -> Column:
    n, gaps = F.col("connection_count").cast("string"), F.col("interarrival_count")
    return (
        F.when(gaps == 0, "one connection has no gap")
        .when(
            gaps < MIN_INTERVALS,
            F.concat(n, F.lit(" connections, only "), gaps.cast("string"),
                     F.lit(" gap(s): not enough to tell a rhythm")),
        )
        .otherwise(F.concat(n, F.lit(" connections, "), gaps.cast("string"), F.lit(" gaps")))
    )
