"""Column functions over wording and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V
from ..vocab import CONTROL, LOGON, NETWORK, PROCESS


def logon_type_name(logon_type: Column) -> Column:
    out = F.concat(F.lit("Type "), logon_type.cast("string"))
    for code, name in V.LOGON_TYPE_NAMES.items():
        out = F.when(logon_type == code, F.lit(name)).otherwise(out)
    return F.when(logon_type.isNull(), F.lit("Unknown")).otherwise(out)


def _or_mark(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("?"))


def _part(template: str, name: str) -> Column:
    value = F.coalesce(F.col(name), F.lit(""))
    return F.when(value == "", "").otherwise(F.format_string(template, value))


def event_summary(event_type: str) -> Column:
    """One line of text describing a row of the given table."""
    if event_type == PROCESS:
        return F.concat(
            _or_mark("parent_process_name"), F.lit(" -> "), _or_mark("process_name"),
            F.lit(" | "), F.substring(F.coalesce(F.col("command_line"), F.lit("")), 1, 160),
        )
    if event_type == NETWORK:
        return F.concat(
            _or_mark("process_name"), F.lit(" -> "), _or_mark("remote_ip"), F.lit(":"),
            _or_mark("remote_port"), F.lit(" ("), _or_mark("direction"), F.lit(")"),
        )
    if event_type == CONTROL:
        return F.concat(
            _or_mark("actor"), F.lit(" "), _or_mark("verb"), F.lit(" "),
            _or_mark("resource_type"), _part(" (%s)", "resource_name"),
            _part(" -> %s", "target_actor"), F.lit(" ["), _or_mark("decision"), F.lit("]"),
        )
    if event_type == LOGON:
        return F.concat(
            _or_mark("action"), F.lit(" logon ["), logon_type_name(F.col("logon_type")),
            F.lit("] from "), _or_mark("source_ip"), _part(" reason=%s", "failure_reason"),
        )
    raise ValueError(f"unknown event type {event_type!r}")


# Calibration vocabulary (fixed values).
CERTAINTY_WORDS = (
    "proves", "proof that", "certainly", "definitely", "undeniably", "conclusively",
    "without doubt", "guaranteed", "confirms that",
)
HEDGE_WORDS = ("might have", "may have", "possibly", "perhaps", "it is thought")


def calibration_issues(statement: Column, claim_type: Column) -> Column:
    """Certainty words in a non-fact, hedges in a fact."""
    lowered = F.lower(F.coalesce(statement, F.lit("")))
    found = lambda words: F.array_compact(
        F.array(*[F.when(lowered.contains(w), F.lit(w)) for w in words])
    )
    return F.when(claim_type == "fact", found(HEDGE_WORDS)).otherwise(found(CERTAINTY_WORDS))
