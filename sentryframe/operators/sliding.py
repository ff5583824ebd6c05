"""Trailing-window measures at every event, and their maximum per key.

A sliding frame re-reads the whole window at each row.  Here every row instead contributes
``+1`` when it enters and ``-1`` when it leaves, and a running sum over those marks is the
measure: one sort and one pass per (key, time bucket), however dense the window.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import micros
from .buckets import BUCKET, OWN, US, WINDOWS_PER_BUCKET, with_halo


def trailing_measure(
    events: DataFrame,
    keys: list[str],
    ts: str,
    window: timedelta,
    value: str | None = None,
    out: str = "in_window",
) -> DataFrame:
    """Rows (or distinct values of ``value``) in ``[t - window, t]`` at each event.

    Rows at one instant are ordered by ``event_id`` when present, and the measure at a row
    counts the rows up to and including it, so the last row of an instant has seen them all.
    Returns ``keys, ts, out``.
    """
    span = micros(window)
    width = span * WINDOWS_PER_BUCKET
    tie = [c for c in ("event_id",) if c in events.columns]
    columns = list(dict.fromkeys([*keys, ts, *tie, *([value] if value else [])]))
    placed = with_halo(events.select(*columns).where(F.col(ts).isNotNull()), ts, width, before=span)

    if value is None:
        enters, leaves = F.lit(1), F.col(US) + F.lit(span)
    else:
        per_value = Window.partitionBy(*keys, BUCKET, value).orderBy(US, *tie)
        previous, following = F.lag(US).over(per_value), F.lead(US).over(per_value)
        placed = placed.withColumn("_prev", previous).withColumn("_next", following)
        absent = F.col("_prev").isNull() | (F.col("_prev") < F.col(US) - F.lit(span))
        enters = F.when(absent & F.col(value).isNotNull(), 1).otherwise(0)
        ends = F.col("_next").isNull() | (F.col("_next") > F.col(US) + F.lit(span))
        leaves = F.when(ends & F.col(value).isNotNull(), F.col(US) + F.lit(span))

    # A row leaves after its last inclusive instant: at equal time, entries come first.
    marks = placed.select(
        *keys, BUCKET, *tie, ts,
        F.explode(
            F.array(
                F.struct(F.col(US).alias("at"), F.lit(0).alias("kind"), enters.alias("delta"),
                         F.col(OWN).alias("own")),
                F.struct(leaves.alias("at"), F.lit(1).alias("kind"), F.lit(-1).alias("delta"),
                         F.lit(False).alias("own")),
            )
        ).alias("_mark"),
    ).where(F.col("_mark.at").isNotNull())
    running = (
        Window.partitionBy(*keys, BUCKET).orderBy("_mark.at", "_mark.kind", *tie)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return marks.withColumn(out, F.sum("_mark.delta").over(running)).where("_mark.own").select(
        *keys, ts, out
    )


def sliding_max(
    events: DataFrame,
    keys: list[str],
    ts: str,
    window: timedelta,
    value: str | None = None,
    out: str = "max_in_window",
) -> DataFrame:
    """The largest trailing measure per key."""
    measured = trailing_measure(events, keys, ts, window, value, out="_m")
    return measured.groupBy(*keys).agg(F.max("_m").alias(out))
