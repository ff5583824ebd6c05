"""Running rules over telemetry (D23) and the candidate versions of two of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators.lineage_cut import shared_folder
from ..schemas import EVIDENCE_COLUMNS, EVIDENCE_CONTEXT, FINDING_SCHEMA, Telemetry
from ..vocab import CONTROL, PROCESS, SEVERITY_RANK
from .rules import REGISTRY, HuntConfig, Rule, RuleOutput, rows_as_findings


#: The ids of the rules that read a row, beside the row.
_READ_BY = "_read_by"


@dataclass
class HuntResult:
    """Findings and evidence of every rule that could be planned, and what failed."""

    findings: DataFrame
    evidence: DataFrame
    rules_run: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _chosen(rule_ids) -> list[Rule]:
    if rule_ids is None:
        return [REGISTRY[r] for r in sorted(REGISTRY)]
    unknown = sorted(set(rule_ids) - set(REGISTRY))
    if unknown:
        raise KeyError(f"unknown rule id(s): {', '.join(unknown)}")
    return [REGISTRY[r] for r in rule_ids]


def sieve(telemetry: Telemetry, rules: list[Rule], config: HuntConfig | None = None) -> Callable[[Rule], Telemetry]:
    """One pass over each table for all rules: the telemetry each rule needs to read.

    The row tests that rules declare (``reads``) become one condition per table.  Rows that any
    rule reads are written to the checkpoint folder as Parquet, each with the ids of those rules;
    a rule then reads its rows from there, however often its plan refers to them.  A rule without
    a row test for a table, or with one that does not fit the table, reads the table itself.
    """
    config, path = config or HuntConfig(), None
    sifted: dict[str, tuple[set[str], DataFrame]] = {}
    for name, table in telemetry.tables().items():
        tests = {}
        for rule in rules:
            if name not in rule.reads:
                continue
            scope = F.col("source").isin(*rule.control_sources) if name == CONTROL and rule.control_sources else F.lit(True)
            try:
                table.select(scope & rule.reads[name](config))
            except AnalysisException:
                continue
            tests[rule.rule_id] = scope & rule.reads[name](config)
        if not tests:
            continue
        if path is None:
            path = shared_folder(telemetry.spark, "sieve")
        by = F.array_compact(F.array(*[F.when(test, F.lit(rule_id)) for rule_id, test in tests.items()]))
        table.withColumn(_READ_BY, by).where(F.size(_READ_BY) > 0).write.parquet(f"{path}/{name}")
        sifted[name] = set(tests), telemetry.spark.read.parquet(f"{path}/{name}")

    def of(rule: Rule) -> Telemetry:
        out = telemetry
        for name, (ids, rows) in sifted.items():
            if rule.rule_id in ids:
                out = out.with_table(name, rows.where(F.array_contains(_READ_BY, rule.rule_id)).drop(_READ_BY))
        return out

    return of


def run_hunt(
    telemetry: Telemetry,
    rule_ids: list[str] | None = None,
    config: HuntConfig | None = None,
    min_severity: str | None = None,
    one_pass: bool = False,
) -> HuntResult:
    """Evaluate rules lazily and return one findings and one evidence table.

    An unknown rule id raises.  A rule that cannot be planned is recorded in ``errors`` and
    the rest still run; for isolation at run time as well, see :func:`hunt_to`.  With ``one_pass``
    a job runs at once that reads every table a single time for all rules (:func:`sieve`).
    """
    outputs, run, errors = [], [], {}
    chosen = _chosen(rule_ids)
    of = sieve(telemetry, chosen, config) if one_pass else lambda rule: telemetry
    for rule in chosen:
        try:
            outputs.append(rule.run(of(rule), config))
            run.append(rule.rule_id)
        except Exception as exc:  # noqa: BLE001 - one rule must not stop the others
            errors[rule.rule_id] = f"{type(exc).__name__}: {exc}"
    spark = telemetry.spark
    if not outputs:
        nothing = spark.createDataFrame([], FINDING_SCHEMA)
        blank = nothing.select(
            "finding_id", "rule_id", F.lit("").alias("event_id"), F.lit("").alias("event_type"),
            F.col("first_seen").alias("timestamp"), F.lit("").alias("summary"),
            *[F.lit(None).cast(kind).alias(name) for name, kind in EVIDENCE_CONTEXT])
        return HuntResult(nothing, blank, run, errors)
    findings = _union([o.findings for o in outputs])
    evidence = _union([o.evidence for o in outputs]).select(*EVIDENCE_COLUMNS)
    if min_severity is not None:
        findings = findings.where(F.col("severity_rank") >= SEVERITY_RANK[min_severity])
        evidence = evidence.join(findings.select("finding_id"), "finding_id", "left_semi")
    return HuntResult(findings, evidence, run, errors)


def triage_order(findings: DataFrame) -> DataFrame:
    """Highest severity first, then the order in which they were first seen."""
    return findings.orderBy(F.col("severity_rank").desc(), "first_seen", "finding_id")


def hunt_to(
    telemetry: Telemetry, path: str, rule_ids: list[str] | None = None,
    config: HuntConfig | None = None,
) -> HuntResult:
    """Write each rule's findings and evidence to its own folder under ``path``.

    A rule that fails while running is recorded and leaves no folder others depend on.
    """
    run, errors, parts = [], {}, []
    for rule in _chosen(rule_ids):
        base = f"{path}/rule={rule.rule_id}"
        try:
            out = rule.run(telemetry, config)
            out.findings.write.mode("overwrite").parquet(base + "/findings")
            out.evidence.write.mode("overwrite").parquet(base + "/evidence")
        except Exception as exc:  # noqa: BLE001
            errors[rule.rule_id] = f"{type(exc).__name__}: {exc}"
            continue
        run.append(rule.rule_id)
        parts.append(base)
    read = telemetry.spark.read
    if not parts:
        empty = run_hunt(telemetry, [])
        return HuntResult(empty.findings, empty.evidence, run, errors)
    findings = read.schema(FINDING_SCHEMA).parquet(*[p + "/findings" for p in parts])
    evidence = read.parquet(*[p + "/evidence" for p in parts])
    return HuntResult(findings, evidence, run, errors)


# Candidates: first and tightened versions of the two promoted rules --------------------


def _mail_opened(tel: Telemetry) -> DataFrame:
    return tel.processes.where(
        (F.lower("parent_process_name") == "outlook.exe")
        & F.lower("process_name").isin(*V.MAIL_OPENED_OFFICE_APPLICATIONS))


def _document_v1(rule, tel, cfg) -> RuleOutput:
    return rows_as_findings(
        rule, _mail_opened(tel), PROCESS, F.col("command_line"),
        reason=F.lit("an email client opened an Office document"))


def _document_v2(rule, tel, cfg) -> RuleOutput:
    macro = "|".join(e.replace(".", r"\.") for e in V.MACRO_EXTENSIONS)
    return rows_as_findings(
        rule, _mail_opened(tel).where(F.lower("command_line").rlike(macro)), PROCESS,
        F.col("command_line"), reason=F.lit("an email client opened a macro-capable document"))


def _discovery_v1(rule, tel, cfg) -> RuleOutput:
    hits = tel.processes.where(
        F.lower("process_name").isin(*V.DISCOVERY_BINARIES)
        | F.lower("command_line").contains("ipconfig"))
    return rows_as_findings(
        rule, hits, PROCESS, F.col("command_line"), reason=F.lit("a discovery command ran"))


def _discovery_v2(rule, tel, cfg) -> RuleOutput:
    return REGISTRY["ATH-010"].detect(rule, tel, cfg)


def _candidate(rule_id, title, fn) -> Rule:
    return Rule(rule_id=rule_id, title=title, severity="medium", tables=(PROCESS,),
                fields_used=("process_name", "command_line"), detect=fn)


# stage -> (v1, v2, the rule v2 became).  Stage names are fixed values.
CANDIDATES = {
    "1-initial-access": (
        _candidate("CAND-INITACCESS-v1", "Mail program started Office", _document_v1),
        _candidate("CAND-INITACCESS-v2", "Mail program opened a document that can carry macros", _document_v2),
        "ATH-009",
    ),
    "5-discovery": (
        _candidate("CAND-DISCOVERY-v1", "A discovery tool ran", _discovery_v1),
        _candidate("CAND-DISCOVERY-v2", "Several discovery tools under one parent", _discovery_v2),
        "ATH-010",
    ),
}


def propose_and_iterate(
    telemetry: Telemetry, labels: DataFrame, config: HuntConfig | None = None
) -> DataFrame:
    """Score v1 against v2 per stage.

    ``labels``: ``scenario, stage, event_id, malicious``.  One row per stage: true and false
    positives and stage coverage of both versions, the false positives removed, and whether
    coverage was lost.
    """
    from .evaluate import score_rules

    reports = []
    for stage, (v1, v2, promoted) in sorted(CANDIDATES.items()):
        scored = []
        for version in (v1, v2):
            out = version.run(telemetry, config)
            scored.append(
                score_rules(out.findings, out.evidence, labels, {version.rule_id: (stage,)})
                .select("true_positives", "false_positives", "precision",
                        (F.col("detected_stages") > 0).alias("covers")))
        a, b = (s.select(*[F.col(c).alias(f"{v}_{c}") for c in s.columns])
                for v, s in zip(("v1", "v2"), scored))
        # Each side is exactly one row (the score of one rule).
        reports.append(
            a.join(b, F.lit(True)).select(
                F.lit(stage).alias("stage"), F.lit(promoted).alias("promoted_as"), "*",
                (F.col("v1_false_positives") - F.col("v2_false_positives")).alias("fp_removed"),
                (F.col("v1_covers") & ~F.col("v2_covers")).alias("coverage_lost")))
    return _union(reports)
