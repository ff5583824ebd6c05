"""Which telemetry is present, which rules can therefore work, what is covered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions.control import is_identity_grant
from ..schemas import TABLE_COLUMNS, TABLE_SCHEMAS, Telemetry
from ..vocab import CONTROL, EVENT_TYPES, LOGON, NETWORK, PROCESS
from .rules import REGISTRY, Rule
from .techniques import MAPPINGS

PARTIAL_BELOW = 0.5
RARE_BELOW = 0.01
UNUSABLE_BELOW = 0.01
DEGRADED_BELOW = PARTIAL_BELOW

# channel -> (evidence as (table, column or column:value), partial threshold).  Fixed values.
CHANNELS = {
    "process_execution": (((PROCESS, "process_name"),), PARTIAL_BELOW),
    "process_command_line": (((PROCESS, "command_line"),), PARTIAL_BELOW),
    "process_lineage": (((PROCESS, "parent_process_name"),), PARTIAL_BELOW),
    "handle_access": ((), PARTIAL_BELOW),
    "network_flow": (((NETWORK, "remote_ip"),), PARTIAL_BELOW),
    "network_inbound": (((NETWORK, "direction:inbound"),), RARE_BELOW),
    "network_url": (((NETWORK, "remote_url"),), PARTIAL_BELOW),
    "dns_query": ((), PARTIAL_BELOW),
    "authentication": (((LOGON, "action"),), PARTIAL_BELOW),
    "auth_source_attribution": (((LOGON, "source_device"), (LOGON, "source_ip")), PARTIAL_BELOW),
    "auth_factor": ((), PARTIAL_BELOW),
    "file_events": ((), PARTIAL_BELOW),
    "registry": ((), PARTIAL_BELOW),
    "script_block": ((), PARTIAL_BELOW),
    "email": ((), PARTIAL_BELOW),
    "cloud_control_plane": (((LOGON, "source:cloudtrail"),), RARE_BELOW),
    "cloud_management_activity": (((CONTROL, "source:cloudtrail_mgmt"),), RARE_BELOW),
    "container_audit": (((CONTROL, "source:k8s_audit"),), RARE_BELOW),
}
# field -> channel, for rules that declare no channels themselves.  Fixed values.
FIELD_CHANNEL = {
    "process_name": "process_execution", "process_id": "process_execution",
    "file_path": "process_execution", "process_guid": "process_execution",
    "command_line": "process_command_line",
    "parent_process_name": "process_lineage", "parent_process_id": "process_lineage",
    "parent_process_guid": "process_lineage",
    "remote_ip": "network_flow", "remote_port": "network_flow", "protocol": "network_flow",
    "direction": "network_flow", "remote_url": "network_url",
    "action": "authentication", "logon_type": "authentication", "failure_reason": "authentication",
    "source_ip": "auth_source_attribution", "source_device": "auth_source_attribution",
}
# Techniques assessed for coverage, with the channels needed to see them at all (fixed values).
WATCHLIST = (
    ("T1059.001", ("process_execution", "process_command_line")),
    ("T1204.002", ("process_execution", "process_lineage")),
    ("T1027.010", ("process_command_line",)),
    ("T1003.001", ("process_command_line",)),
    ("T1110.001", ("authentication",)),
    ("T1021.002", ("authentication", "auth_source_attribution")),
    ("T1071.001", ("network_flow",)),
    ("T1560.001", ("process_command_line",)),
    ("T1569.002", ("process_execution", "process_command_line")),
    ("T1033", ("process_execution", "process_lineage")),
    ("T1053.005", ("process_command_line",)),
    ("T1490", ("process_command_line",)),
    ("T1685", ("process_command_line",)),
    ("T1136.001", ("process_command_line",)),
    ("T1021.001", ("authentication", "auth_source_attribution")),
    ("T1003.001-handle", ("handle_access",)),
    ("T1071.004", ("dns_query",)),
    ("T1566.001", ("email",)),
    ("T1547.001", ("registry",)),
    ("T1112", ("registry",)),
    ("T1486", ("file_events",)),
    ("T1041", ("network_flow", "network_url")),
    ("T1059.001-scriptblock", ("script_block",)),
    ("T1078.004", ("cloud_control_plane", "auth_factor")),
    ("T1610", ("container_audit",)),
    ("T1098", ("cloud_management_activity",)),
    ("T1526", ("cloud_management_activity",)),
    ("T1580", ("cloud_management_activity",)),
)


def rule_channels(rule: Rule, gating_only: bool = False) -> tuple[str, ...]:
    """The channels a rule depends on; ``gating_only`` leaves optional fields out."""
    if rule.channels:
        return rule.channels
    fields = [f for f in rule.fields_used if not (gating_only and f in rule.optional_fields)]
    return tuple(sorted({FIELD_CHANNEL[f] for f in fields if f in FIELD_CHANNEL}))


# ---------------------------------------------------------------- A14, A15


def _applicable(table: str, column: str) -> Column | None:
    """The rows a column can carry a value on, when that is not every row."""
    if table == CONTROL and column in ("target_actor", "role_ref"):
        return is_identity_grant(F.col("verb"), F.col("resource_type")) & (F.col("decision") == V.ALLOWED)
    if table == LOGON and column == "failure_reason":
        return F.col("action") == "failure"
    if table == LOGON and column in ("source_device", "source_ip"):
        return F.col("logon_type").isNull() | F.col("logon_type").isin(*V.REMOTE_LOGON_TYPES)
    return None


def _populated(table: str, column: str) -> Column:
    if ":" in column:
        name, value = column.split(":", 1)
        return F.coalesce(F.col(name) == value, F.lit(False))
    if TABLE_SCHEMAS[table][column].dataType.typeName() == "string":
        return F.coalesce(F.col(column) != "", F.lit(False))
    return F.col(column).isNotNull()


def _valued_columns(table: str) -> list[str]:
    return [c for evidence, _ in CHANNELS.values() for t, c in evidence if t == table and ":" in c]


def field_population(tel: Telemetry) -> DataFrame:
    """Rows and populated rows of every column of every table, one pass per table.

    ``table, column, rows, populated, applicable_rows, applicable_populated``; the last two
    equal the first two where a column applies to every row.  ``column:value`` entries count
    one value.
    """
    parts = []
    for table in EVENT_TYPES:
        names = [*TABLE_COLUMNS[table], *_valued_columns(table)]
        measures = [F.count(F.lit(1)).alias("rows")]
        for i, name in enumerate(names):
            filled, mask = _populated(table, name), _applicable(table, name)
            measures.append(F.count_if(filled).alias(f"p{i}"))
            if mask is not None:
                measures.append(F.count_if(mask).alias(f"a{i}"))
                measures.append(F.count_if(mask & filled).alias(f"q{i}"))
        wide = tel.table(table).agg(*measures)
        cells = [
            F.struct(
                F.lit(name).alias("column"), F.col(f"p{i}").alias("populated"),
                (F.col(f"a{i}") if f"a{i}" in wide.columns else F.col("rows")).alias("applicable_rows"),
                (F.col(f"q{i}") if f"q{i}" in wide.columns else F.col(f"p{i}")).alias("applicable_populated"))
            for i, name in enumerate(names)
        ]
        parts.append(wide.select(F.lit(table).alias("table"), "rows", F.explode(F.array(*cells)).alias("c"))
                     .select("table", "c.column", "rows", "c.populated", "c.applicable_rows", "c.applicable_populated"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- A16


def channel_dimension(spark: SparkSession) -> DataFrame:
    rows = [
        (channel, table, column, threshold)
        for channel, (evidence, threshold) in CHANNELS.items()
        for table, column in (evidence or ((None, None),))
    ]
    return spark.createDataFrame(rows, "channel string, table string, column string, threshold double")


def channel_availability(population: DataFrame) -> DataFrame:
    """``channel, state, populated, rows``: the best of a channel's alternative columns."""
    dim = channel_dimension(population.sparkSession)
    measured = dim.join(population.select("table", "column", "rows", "populated"), ["table", "column"], "left")
    share = F.when(F.col("rows") > 0, F.col("populated") / F.col("rows")).otherwise(F.lit(0.0))
    best = measured.withColumn("share", share).groupBy("channel", "threshold").agg(
        F.max_by(F.struct("populated", "rows", "share"), F.struct("share", "rows")).alias("b"),
        F.bool_and(F.col("table").isNull()).alias("no_schema"))
    return best.select(
        "channel",
        F.when(F.col("no_schema"), "absent_by_schema")
        .when(F.coalesce("b.rows", F.lit(0)) == 0, "absent_in_data")
        .when(F.col("b.populated") == 0, "absent_in_data")
        .when(F.col("b.share") < F.col("threshold"), "partial").otherwise("available").alias("state"),
        F.coalesce("b.populated", F.lit(0)).alias("populated"), F.coalesce("b.rows", F.lit(0)).alias("rows"))


# ---------------------------------------------------------------- A17


def rule_verdicts(population: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``rule_id, support, verdict`` and the fields and channels behind them."""
    rules = rules or [REGISTRY[r] for r in sorted(REGISTRY)]
    spark = population.sparkSession
    fields = spark.createDataFrame(
        [(r.rule_id, t, f, f not in r.optional_fields) for r in rules for t in r.tables
         for f in r.fields_used if f in TABLE_COLUMNS[t]],
        "rule_id string, table string, column string, required boolean")
    needs = spark.createDataFrame(
        [(r.rule_id, c, c in rule_channels(r, gating_only=True)) for r in rules for c in rule_channels(r)],
        "rule_id string, channel string, gating boolean")
    tables = spark.createDataFrame([(r.rule_id, t) for r in rules for t in r.tables], "rule_id string, table string")

    rows = population.groupBy("table").agg(F.max("rows").alias("rows"))
    inputs = tables.join(rows, "table", "left").groupBy("rule_id").agg(
        F.max(F.coalesce("rows", F.lit(0))).alias("input_rows"))
    share = F.when(F.col("applicable_rows") > 0, F.col("applicable_populated") / F.col("applicable_rows"))
    graded = fields.join(population, ["table", "column"]).where(F.col("rows") > 0).withColumn("share", share)
    names = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("column"))))
    starved = F.col("required") & (F.col("share") < UNUSABLE_BELOW)
    sparse = F.col("required") & (F.col("share") >= UNUSABLE_BELOW) & (F.col("share") < DEGRADED_BELOW)
    by_field = graded.groupBy("rule_id").agg(
        names(starved).alias("starved_fields"), names(sparse).alias("sparse_fields"),
        names(~F.col("required") & (F.col("share") < DEGRADED_BELOW)).alias("sparse_optional_fields"),
        names(F.col("share").isNull()).alias("not_applicable_fields"))
    state = channel_availability(population).select("channel", "state")
    absent = F.col("state").isin("absent_in_data", "absent_by_schema")
    chans = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("channel"))))
    by_channel = needs.join(state, "channel").groupBy("rule_id").agg(
        chans(absent).alias("missing_channels"), chans(absent & F.col("gating")).alias("missing_gating"),
        chans(F.col("state") == "partial").alias("partial_channels"))
    none = F.array().cast("array<string>")
    out = inputs.join(by_field, "rule_id", "left").join(by_channel, "rule_id", "left")
    for c in ("starved_fields", "sparse_fields", "sparse_optional_fields", "not_applicable_fields",
              "missing_channels", "missing_gating", "partial_channels"):
        out = out.withColumn(c, F.coalesce(c, none))
    any_of = lambda c: F.size(c) > 0
    support = F.when(any_of("missing_channels"), "unsupported").when(
        any_of("partial_channels"), "degraded").otherwise("supported")
    return out.withColumn("support", support).withColumn(
        "verdict",
        F.when(F.col("input_rows") == 0, "not_eligible")
        .when(any_of("starved_fields") | any_of("missing_gating"), "unusable")
        .when(any_of("sparse_fields") | (F.col("support") != "supported"), "degraded")
        .otherwise("usable"))


# ---------------------------------------------------------------- A18


def technique_coverage(population: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """``technique_id, state, covering_rules, missing_channels`` over the watch list."""
    spark = population.sparkSession
    verdicts = rule_verdicts(population, rules).select("rule_id", "verdict")
    needs = spark.createDataFrame([(t, c) for t, cs in WATCHLIST for c in cs], "technique_id string, channel string")
    covers = spark.createDataFrame(
        sorted({(m.technique_id, m.rule_id) for m in MAPPINGS}), "technique_id string, rule_id string")
    states = channel_availability(population).select("channel", "state")
    absent = F.col("state").isin("absent_in_data", "absent_by_schema")
    seen = needs.join(states, "channel").groupBy("technique_id").agg(
        F.array_sort(F.collect_set(F.when(absent, F.col("channel")))).alias("missing_channels"))
    ruled = covers.join(verdicts, "rule_id", "left").groupBy("technique_id").agg(
        F.array_sort(F.collect_set("rule_id")).alias("covering_rules"),
        F.bool_or(F.coalesce(F.col("verdict").isin("usable", "degraded"), F.lit(False))).alias("credited"))
    return seen.join(ruled, "technique_id", "left").select(
        "technique_id",
        F.when(F.size("missing_channels") > 0, "unobservable")
        .when(F.col("covering_rules").isNull(), "observable_undetected")
        .when(F.col("credited"), "detectable").otherwise("unverifiable").alias("state"),
        F.coalesce("covering_rules", F.array().cast("array<string>")).alias("covering_rules"),
        "missing_channels")


# ---------------------------------------------------------------- J18


def channels_of_row(event_type: str) -> Column:
    """Every channel one row evidences, as an array."""
    found = [
        F.when(F.greatest(*[_populated(t, c).cast("int") for t, c in here], F.lit(0)) == 1, F.lit(channel))
        for channel, (evidence, _) in CHANNELS.items()
        if (here := [(t, c) for t, c in evidence if t == event_type])
    ]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def cited_rows(evidence: DataFrame, tel: Telemetry) -> DataFrame:
    """``event_id, found_in, observed``: the cited rows of every table with their channels."""
    ids = evidence.select("event_id").distinct()
    parts = [
        tel.table(t).join(ids, "event_id", "left_semi")
        .select("event_id", F.lit(t).alias("found_in"), channels_of_row(t).alias("observed"))
        for t in EVENT_TYPES
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def channel_violations(evidence: DataFrame, tel: Telemetry, rules: list[Rule] | None = None) -> DataFrame:
    """Cited rows outside the channels their rule declares, with the reason."""
    rules = rules or list(REGISTRY.values())
    declared = tel.spark.createDataFrame(
        [(r.rule_id, list(rule_channels(r))) for r in rules], "rule_id string, declared array<string>")
    joined = evidence.select("rule_id", "event_id").distinct().join(
        cited_rows(evidence, tel), "event_id", "left").join(declared, "rule_id", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    reason = (
        F.when(F.col("found_in").isNull(), "no such row")
        .when(size("declared") == 0, "no channel declared")
        .when(size("observed") == 0, "channel of the row unknown")
        .when(~F.arrays_overlap("observed", "declared"), "channel not declared"))
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "rule_id", "event_id", F.coalesce("found_in", F.lit("")).alias("event_type"), "reason")
