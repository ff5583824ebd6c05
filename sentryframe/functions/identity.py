"""Column functions that name a process instance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYSMON, START = "sysmon", "start"
INFERRED = "inferred from pid"


def sysmon_identity(guid: Column) -> Column:
    """``sysmon:<guid>``, braces stripped and lower-cased; empty when the source has none."""
    text = F.trim(F.coalesce(guid, F.lit("")))
    core = F.trim(F.lower(F.regexp_replace(text, r"^[{}]+|[{}]+$", "")))
    absent = text.isin("", "-", "null", "nan", "<NA>") | (core == "")
    return F.when(absent, "").otherwise(F.concat(F.lit(SYSMON + ":"), core))


def start_identity(device: Column, pid: Column, created: Column) -> Column:
    """``start:<device>|<pid>|<UTC ISO ms>``; empty when any part is missing."""
    host = F.lower(F.trim(F.coalesce(device, F.lit(""))))
    stamp = F.date_format(created, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    key = F.concat(F.lit(START + ":"), host, F.lit("|"), pid.cast("string"), F.lit("|"), stamp)
    return F.coalesce(F.when(host != "", key), F.lit(""))


def identity_scheme(identity: Column) -> Column:
    scheme = F.substring_index(F.coalesce(identity, F.lit("")), ":", 1)
    has_separator = F.coalesce(identity, F.lit("")).contains(":")
    return F.when(has_separator & scheme.isin(SYSMON, START), scheme).otherwise(F.lit(""))


def usable_identity(identity: Column) -> Column:
    """The identity when minted under a known scheme, else empty."""
    return F.when(identity_scheme(identity) != "", F.trim(identity)).otherwise(F.lit(""))


def instance_tag(identity: Column, device: Column, pid: Column) -> Column:
    """Exact-equality key of an instance: its identity, else its (device, pid) slot."""
    known = usable_identity(identity)
    slot = F.concat(
        F.lit("pid|"), F.trim(F.coalesce(device, F.lit(""))), F.lit("|"), pid.cast("string")
    )
    return F.when(known != "", known).otherwise(slot)
