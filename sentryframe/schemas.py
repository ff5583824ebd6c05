"""Canonical event tables, the Telemetry bundle and the finding/evidence schemas."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .vocab import CONTROL, EVENT_TYPES, LOGON, NETWORK, PROCESS

_STR, _LONG, _TS = T.StringType(), T.LongType(), T.TimestampType()

CORE = (
    ("event_id", _STR), ("timestamp", _TS), ("event_type", _STR), ("device", _STR),
    ("user", _STR), ("source", _STR), ("source_ref", _STR),
)
_EXTRA = {
    PROCESS: (
        ("process_name", _STR), ("process_id", _LONG), ("command_line", _STR),
        ("parent_process_name", _STR), ("parent_process_id", _LONG), ("file_path", _STR),
        ("sha256", _STR), ("signer", _STR), ("signature_status", _STR),
        ("process_guid", _STR), ("parent_process_guid", _STR),
    ),
    NETWORK: (
        ("process_name", _STR), ("process_id", _LONG), ("process_guid", _STR),
        ("remote_ip", _STR), ("remote_port", _LONG), ("protocol", _STR),
        ("direction", _STR), ("remote_url", _STR),
    ),
    LOGON: (
        ("logon_type", _LONG), ("source_ip", _STR), ("source_device", _STR),
        ("action", _STR), ("failure_reason", _STR),
    ),
    CONTROL: (
        ("actor", _STR), ("actor_groups", _STR), ("verb", _STR), ("resource_type", _STR),
        ("resource_name", _STR), ("resource_namespace", _STR), ("target_actor", _STR),
        ("role_ref", _STR), ("decision", _STR), ("source_ip", _STR),
    ),
}
TABLE_SCHEMAS = {
    name: T.StructType([T.StructField(c, t) for c, t in CORE + _EXTRA[name]])
    for name in EVENT_TYPES
}
TABLE_COLUMNS = {name: tuple(s.fieldNames()) for name, s in TABLE_SCHEMAS.items()}
UNIFIED_COLUMNS = tuple(c for c, _ in CORE) + ("summary",)

# Table name -> attribute of Telemetry and file stem of the stored layout.
TABLE_STEMS = {
    PROCESS: "process_events", NETWORK: "network_events",
    LOGON: "logon_events", CONTROL: "control_events",
}


class SchemaError(ValueError):
    """A table does not have the declared columns, types or identifiers."""


@dataclass(frozen=True)
class Telemetry:
    """The four event tables that travel together."""

    processes: DataFrame
    network: DataFrame
    logons: DataFrame
    controls: DataFrame

    _FIELDS = {PROCESS: "processes", NETWORK: "network", LOGON: "logons", CONTROL: "controls"}

    def table(self, event_type: str) -> DataFrame:
        return getattr(self, self._FIELDS[event_type])

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in EVENT_TYPES}

    def map(self, fn) -> "Telemetry":
        """Apply ``fn(event_type, df)`` to every table."""
        return Telemetry(**{self._FIELDS[n]: fn(n, self.table(n)) for n in EVENT_TYPES})

    def with_table(self, event_type: str, df: DataFrame) -> "Telemetry":
        return replace(self, **{self._FIELDS[event_type]: df})

    @property
    def spark(self) -> SparkSession:
        return self.processes.sparkSession


def empty_table(spark: SparkSession, event_type: str) -> DataFrame:
    return spark.createDataFrame([], TABLE_SCHEMAS[event_type])


def empty_telemetry(spark: SparkSession) -> Telemetry:
    return Telemetry(*(empty_table(spark, n) for n in EVENT_TYPES))


# One row per cited event.  Evidence is a table of its own, never an array on the finding,
# so a finding over a very large group stays one narrow row.  It carries the identities the
# correlation reads, so linking findings never goes back to the event tables for them.
EVIDENCE_CONTEXT = (
    ("device", T.StringType()), ("principal", T.StringType()), ("other_principal", T.StringType()),
    ("process_id", T.LongType()), ("process_guid", T.StringType()),
    ("parent_process_id", T.LongType()), ("parent_process_guid", T.StringType()),
)
EVIDENCE_COLUMNS = (
    "finding_id", "rule_id", "event_id", "event_type", "timestamp", "summary",
    *(name for name, _ in EVIDENCE_CONTEXT),
)


# Typed metadata a finding may carry (null where a rule does not record it).
_ARR, _ARRL, _INT, _BOOL = T.ArrayType(_STR), T.ArrayType(_LONG), T.IntegerType(), T.BooleanType()
FINDING_METADATA = (
    ("parent_process", _STR), ("child_process", _STR), ("process_name", _STR),
    ("command_line", _STR), ("decoded_command", _STR), ("encoded_length", _INT),
    ("evasion_flags", _ARR), ("download_indicators", _ARR), ("indicators", _ARR),
    ("admin_share_redirect", _BOOL), ("bulk_source", _BOOL), ("staging_destination", _BOOL),
    ("remote_ip", _STR), ("ports", _ARRL), ("connection_count", _LONG),
    ("process_id", _LONG), ("process_guid", _STR), ("has_url", _BOOL),
    ("cleartext_http", _BOOL), ("failure_count", _LONG), ("source_ip", _STR),
    ("source_device", _STR), ("succeeded", _BOOL), ("success_time", _TS),
    ("source_host_owners", _ARR), ("target_devices", _ARR), ("logon_count", _LONG),
    ("logon_types", _ARRL), ("matched_binaries", _ARR), ("candidate_techniques", _ARR),
    ("parent_process_id", _LONG), ("procedures", _ARR), ("descriptions", _ARR),
    ("actor", _STR), ("actor_groups", _ARR), ("target_actor", _STR), ("role_ref", _STR),
    ("resource_type", _STR), ("resource_name", _STR), ("resource_namespace", _STR),
    ("verb", _STR), ("lag_seconds", _LONG), ("call_count", _LONG), ("denied_count", _LONG),
    ("denied_fraction", T.DoubleType()), ("denied_majority", _BOOL),
    ("distinct_services", _LONG), ("distinct_resource_types", _LONG),
    ("resource_type_breadth", _BOOL), ("target_actors", _ARR), ("verb_classes", _ARR),
    ("window_start", _TS), ("window_end", _TS),
)
FINDING_SCHEMA = T.StructType(
    [
        T.StructField(c, t) for c, t in (
            ("finding_id", _STR), ("rule_id", _STR), ("title", _STR), ("severity", _STR),
            ("severity_rank", _INT), ("device", _STR), ("user", _STR), ("first_seen", _TS),
            ("last_seen", _TS), ("evidence_count", _LONG), ("reason", _STR),
        ) + FINDING_METADATA
    ]
)
FINDING_COLUMNS = tuple(FINDING_SCHEMA.fieldNames())
