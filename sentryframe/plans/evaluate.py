"""Labels, scoring, profiles and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from ..schemas import Telemetry
from .correlate import families_of
from .techniques import map_techniques

# Labelled stages each rule is designed to cover (fixed values).
RULE_COVERAGE = {
    "ATH-001": ("2-execution",), "ATH-002": ("2-execution",),
    "ATH-003": ("3-payload-download", "4-command-and-control", "10-exfiltration"),
    "ATH-004": ("6-credential-access",), "ATH-005": ("7-brute-force",), "ATH-006": ("7-brute-force",),
    "ATH-007": ("8-lateral-movement",), "ATH-008": ("9-collection",), "ATH-009": ("1-initial-access",),
    "ATH-010": ("5-discovery",), "ATH-011": ("2-recovery-inhibition",), "ATH-012": ("1-defense-impairment",),
    "AWS-001": (), "AWS-002": (), "AWS-003": (), "AWS-004": (), "AWS-005": (), "AWS-006": (),
    "K8S-001": (), "K8S-002": (),
}

PROVENANCES = ("real", "real+injected", "emulated-testbed", "synthetic")


# ---------------------------------------------------------------- S13-S15, W06, A40


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``dataset, provenance, scenario, malicious, stage, ref`` from a label file."""
    stage = "STRUCT<note: STRING, refs: ARRAY<STRING>, event_ids: ARRAY<STRING>>"
    schema = (
        "dataset STRING, provenance STRING, scenarios MAP<STRING, STRUCT<malicious: BOOLEAN, note: STRING, "
        f"stages: MAP<STRING, {stage}>, event_ids: ARRAY<STRING>>>")
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    scenarios = raw.select("dataset", "provenance", F.explode("scenarios").alias("scenario", "s"))
    if scenarios.where(~F.coalesce("provenance", F.lit("")).isin(*PROVENANCES)).limit(1).count():
        raise ValueError(f"{path}: provenance must be one of {PROVENANCES}")
    if scenarios.where(F.col("s.malicious").isNull()).limit(1).count():
        raise ValueError(f"{path}: every scenario must say whether it is malicious")
    stages = scenarios.select(
        "dataset", "provenance", "scenario", F.col("s.malicious").alias("malicious"), F.explode("s.stages").alias("stage", "st"))
    return stages.select(
        "dataset", "provenance", "scenario", "malicious", "stage",
        F.explode(F.coalesce("st.refs", "st.event_ids", F.array().cast("array<string>"))).alias("ref"))


def build_label_refs(raw: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """``day, ref``: references of published malicious events, first occurrence kept."""
    ref = F.concat_ws(";", *[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys])
    return raw.withColumn("ref", ref).groupBy("ref").agg(F.min(ts).alias("_first")).select(
        F.to_date("_first").alias("day"), "ref")


VERDICT = "finding_id STRING, rule_id STRING, verdict STRING, analyst STRING, note STRING, system_disposition STRING, recorded_at STRING"


def append_verdicts(verdicts: DataFrame, path: str) -> None:
    """Append analyst verdicts to the log; nothing is ever rewritten."""
    verdicts.write.mode("append").json(path)


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The log, malformed lines skipped, each line with its place."""
    raw = spark.read.schema(VERDICT).option("mode", "DROPMALFORMED").json(path)
    # A file's age and name, the split's start and the order inside it: the same however files are split.
    place = F.struct(
        F.col("_metadata.file_modification_time").alias("age"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    return raw.select("*", place.alias("line_no")).where(F.col("finding_id").isNotNull() & F.col("verdict").isNotNull())


def latest_verdict(log: DataFrame) -> DataFrame:
    """The newest record per finding; at equal times the later line stands."""
    fields = [c for c in log.columns if c not in ("finding_id", "line_no")]
    newest = F.max_by(F.struct(*fields), F.struct("recorded_at", "line_no"))
    return log.groupBy("finding_id").agg(newest.alias("v")).select("finding_id", "v.*")


SEVERITY_NAMES = ("low", "medium", "high", "critical")
THREAT = "true_positive"


def feedback_metrics(verdicts: DataFrame) -> DataFrame:
    """Agreement between analysts and dispositions, one row."""
    v, d = F.col("verdict"), F.coalesce("system_disposition", F.lit("needs_review"))
    opinion = d.isin("likely_benign", "likely_malicious") & v.isin(THREAT, "false_positive", "benign_true_positive")
    agreed = F.when(d == "likely_malicious", v == THREAT).when(d == "likely_benign", v != THREAT)
    return verdicts.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(opinion).alias("scored"), F.count_if(opinion & agreed).alias("agreed"),
        F.count_if(opinion & ~agreed).alias("disagreed"), F.count_if(~opinion).alias("no_opinion"),
        F.count_if(opinion & (d == "likely_benign") & (v == THREAT)).alias("dangerous")
    ).withColumn("agreement_rate", F.when(F.col("scored") > 0, F.col("agreed") / F.col("scored")).otherwise(0.0)).withColumn(
        "opinion_rate", F.when(F.col("total") > 0, F.col("scored") / F.col("total")).otherwise(0.0))


def verdicts_by_rule(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("rule_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


def noisiest_rules(verdicts: DataFrame) -> DataFrame:
    return verdicts.where("verdict = 'false_positive'").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.col("n").desc(), "rule_id")


# ---------------------------------------------------------------- A32-A35


def score_findings(evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """``finding_id, rule_id, is_malicious, is_lookalike``: what each finding's evidence touches."""
    marks = labels.groupBy("event_id").agg(
        F.bool_or("malicious").alias("_m"), F.bool_or(~F.col("malicious")).alias("_b"))
    return evidence.select("finding_id", "rule_id", "event_id").join(marks, "event_id", "left").groupBy("finding_id", "rule_id").agg(
        F.bool_or(F.coalesce("_m", F.lit(False))).alias("is_malicious"), F.bool_or(F.coalesce("_b", F.lit(False))).alias("is_lookalike"))


def score_rules(findings: DataFrame, evidence: DataFrame, labels: DataFrame, coverage=RULE_COVERAGE) -> DataFrame:
    """Finding-level precision, stage-level recall and F1 per rule.

    ``labels``: ``scenario, stage, event_id, malicious``.  A rule that emitted nothing has
    precision 1, one that declares no stage recall 1.
    """
    spark = findings.sparkSession
    rules = spark.createDataFrame([(r, len(s)) for r, s in coverage.items()], "rule_id string, declared int")
    declared = spark.createDataFrame([(r, s) for r, ss in coverage.items() for s in ss], "rule_id string, stage string")
    judged = score_findings(evidence.join(findings.select("finding_id"), "finding_id", "left_semi"), labels)
    counts = judged.groupBy("rule_id").agg(
        F.count_if("is_malicious").alias("true_positives"), F.count_if(~F.col("is_malicious")).alias("false_positives"),
        F.count_if(~F.col("is_malicious") & F.col("is_lookalike")).alias("fp_lookalike"))
    hits = evidence.select("finding_id", "rule_id", "event_id").join(
        judged.where("is_malicious").select("finding_id"), "finding_id", "left_semi"
    ).join(labels.where("malicious").select("event_id", "stage"), "event_id").select("rule_id", "stage").distinct()
    detected = hits.join(declared, ["rule_id", "stage"], "left_semi").groupBy("rule_id").agg(F.count(F.lit(1)).alias("detected_stages"))
    out = rules.join(counts, "rule_id", "left").join(detected, "rule_id", "left").fillna(
        0, ["true_positives", "false_positives", "fp_lookalike", "detected_stages"])
    emitted = F.col("true_positives") + F.col("false_positives")
    return (
        out.withColumn("precision", F.when(emitted == 0, 1.0).otherwise(F.col("true_positives") / emitted))
        .withColumn("recall", F.when(F.col("declared") == 0, 1.0).otherwise(F.col("detected_stages") / F.col("declared")))
        .withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(
            2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))
        .withColumn("fp_unexplained", F.col("false_positives") - F.col("fp_lookalike")))


def score_incident(findings: DataFrame, evidence: DataFrame, assessments: DataFrame, labels: DataFrame, expected: list[str]) -> DataFrame:
    """Event recall, benign recall, misjudged findings and technique hits, one row."""
    bad = labels.where("malicious").select("event_id").distinct()
    judged = score_findings(evidence, labels).join(assessments.select("finding_id", "disposition"), "finding_id", "left")
    benign = F.col("disposition") == "likely_benign"
    counts = judged.agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(~benign).alias("findings_after_triage"),
        F.count_if(~F.col("is_malicious")).alias("benign_findings"), F.count_if(~F.col("is_malicious") & benign).alias("benign_identified"),
        F.count_if(F.col("is_malicious") & benign).alias("malicious_called_benign"))
    surfaced = evidence.select("event_id").distinct().join(bad, "event_id", "left_semi").agg(F.count(F.lit(1)).alias("surfaced"))
    total = bad.agg(F.count(F.lit(1)).alias("total"))
    found = map_techniques(findings).select("technique_id").distinct().where(F.col("technique_id").isin(*expected) if expected else F.lit(False)).agg(
        F.array_sort(F.collect_set("technique_id")).alias("techniques_found"))
    row = counts.withColumn("malicious_events_surfaced", surfaced.scalar()).withColumn("malicious_events_total", total.scalar()).withColumn(
        "techniques_found", found.scalar())
    share = lambda n, d: F.when(F.col(d) == 0, 1.0).otherwise(F.col(n) / F.col(d))
    return row.withColumn("event_recall", share("malicious_events_surfaced", "malicious_events_total")).withColumn(
        "benign_recall", share("benign_identified", "benign_findings")).withColumn(
        "techniques_missing", F.array_sort(F.array_except(F.array(*[F.lit(t) for t in expected]).cast("array<string>"), "techniques_found")))


def case_quality(members: DataFrame, evidence: DataFrame, labels: DataFrame) -> DataFrame:
    """Noise cases, case precision, recall and purity of the primary case, one row."""
    bad = labels.where("malicious").select("event_id").distinct()
    events = members.join(evidence.select("finding_id", "event_id"), "finding_id").select("case_id", "event_id").distinct()
    per_case = events.join(bad.withColumn("_m", F.lit(True)), "event_id", "left").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("events"), F.count("_m").alias("hits"))
    total = bad.agg(F.count(F.lit(1))).scalar()
    # The first case in number order stands among those that captured the most.
    best = F.min_by(F.struct("hits", "events"), F.struct(-F.col("hits"), "case_id"))
    row = per_case.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("hits") == 0).alias("noise_cases"), best.alias("p")).withColumn("total", total)
    return row.select(
        "cases", "noise_cases",
        F.when(F.col("cases") == 0, 1.0).otherwise((F.col("cases") - F.col("noise_cases")) / F.col("cases")).alias("case_precision"),
        F.when((F.col("total") > 0) & (F.col("cases") > 0), F.col("p.hits") / F.col("total")).otherwise(0.0).alias("primary_recall"),
        F.when((F.col("total") > 0) & (F.col("cases") > 0), F.col("p.hits") / F.col("p.events")).otherwise(0.0).alias("primary_purity"))


def incident_match(anchors: DataFrame, members: DataFrame, evidence: DataFrame) -> DataFrame:
    """``incident_id, status``: unresolved, undetected, ambiguous or matched.

    ``anchors``: ``incident_id, event_id`` (null where an anchor resolved to no event).
    """
    events = members.join(evidence.select("finding_id", "event_id"), "finding_id").select("case_id", "event_id").distinct()
    hit = anchors.join(events, "event_id", "left").groupBy("incident_id").agg(
        F.count("event_id").alias("anchored"), F.countDistinct("case_id").alias("cases"), F.min("case_id").alias("_case"))
    status = (
        F.when(F.col("anchored") == 0, "unresolved").when(F.col("cases") == 0, "undetected")
        .when(F.col("cases") > 1, "ambiguous").otherwise("matched"))
    return hit.select("incident_id", status.alias("status"), F.when(F.col("cases") == 1, F.col("_case")).otherwise("").alias("case_id"))


# ---------------------------------------------------------------- A36-A39


def dataset_profile(
    tel: Telemetry, findings: DataFrame, assessments: DataFrame | None = None, cases: DataFrame | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """``measure, key, value``: volumes, findings, cases and links, daily and per-host rates."""
    rows = reduce(DataFrame.unionByName, [
        df.groupBy("device", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n")) for df in tel.tables().values()])
    hours = reduce(DataFrame.unionByName, [
        df.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")) for df in tel.tables().values()]).agg(
        ((F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / 86_400_000_000).alias("days")).scalar()
    totals = rows.agg(F.sum("n").alias("events"), F.countDistinct(F.nullif(F.col("device"), F.lit(""))).alias("hosts"))
    found = findings.agg(F.count(F.lit(1))).scalar()
    head = totals.withColumn("findings", found).withColumn("days", hours)
    rate = lambda c: F.when(F.col("days") > 0, c / F.col("days"))
    cells = {
        "events": F.col("events"), "hosts": F.col("hosts"), "findings": F.col("findings"), "days": F.col("days"),
        "findings_per_day": rate(F.col("findings")),
        "findings_per_host_day": F.when(F.col("hosts") > 0, rate(F.col("findings")) / F.col("hosts"))}
    flat = head.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("measure"), F.lit("").alias("key"), c.cast("double").alias("value")) for n, c in cells.items()])).alias("c")).select("c.*")
    count = lambda df, m, c: df.groupBy(F.lit(m).alias("measure"), F.col(c).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    parts = [flat, count(findings, "findings_by_rule", "rule_id"), count(findings, "findings_by_severity", "severity")]
    if assessments is not None:
        parts.append(count(assessments, "dispositions", "disposition"))
    total = lambda df, m, c: df.agg(c.cast("double").alias("value")).select(F.lit(m).alias("measure"), F.lit("").alias("key"), "value")
    if cases is not None:
        parts.append(total(cases, "cases", F.countDistinct("case_id")))
    if links is not None:
        parts.append(total(links, "links", F.count(F.lit(1))))
    return reduce(DataFrame.unionByName, parts)


def detection_report(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every rule with its input, findings and why a zero is a zero."""
    counted = findings.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"), F.max("severity_rank").alias("worst"))
    n = F.coalesce("findings", F.lit(0))
    return verdicts.join(counted, "rule_id", "left").select(
        "rule_id", "input_rows", "verdict", n.alias("findings"), F.col("worst").alias("severity_rank"),
        F.when(n > 0, "").when(F.col("verdict") == "not_eligible", "no input rows")
        .when(F.col("verdict") == "unusable", "a required field or channel is missing")
        .otherwise("input was usable and nothing matched").alias("zero_reason"))


def capture_recall(evidence: DataFrame, captures: DataFrame, mapped: DataFrame, labels: DataFrame) -> DataFrame:
    """``capture, technique_id, caught, caught_as_labelled`` per labelled capture.

    ``captures``: ``capture, event_id``; ``labels``: ``capture, technique_id``.
    """
    hit = evidence.select("finding_id", "event_id").join(captures, "event_id").select("capture", "finding_id").distinct()
    named = hit.join(mapped.select("finding_id", "technique_id"), "finding_id").select("capture", "technique_id", F.lit(True).alias("_t")).distinct()
    caught = hit.groupBy("capture").agg(F.count(F.lit(1)).alias("findings"))
    return labels.join(caught, "capture", "left").join(named, ["capture", "technique_id"], "left").select(
        "capture", "technique_id", F.coalesce("findings", F.lit(0)).alias("findings"),
        F.col("findings").isNotNull().alias("caught"), F.col("_t").isNotNull().alias("caught_as_labelled"))


def telemetry_days(tel: Telemetry) -> DataFrame:
    """``span_days``: the telemetry's own span, one day at least; one row."""
    bounds = reduce(DataFrame.unionByName, [
        df.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")) for df in tel.tables().values()])
    span = (F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / 86_400_000_000
    return bounds.agg(F.greatest(F.lit(1.0), F.coalesce(span, F.lit(1.0))).alias("span_days"))


def background_volume(findings: DataFrame, tel: Telemetry) -> DataFrame:
    """Episodes by severity, actors, days and rate per day of telemetry, of each rule."""
    actor = F.coalesce(F.nullif(F.col("actor"), F.lit("")), F.col("user"))
    graded = [F.count_if(F.col("severity") == name).alias(name) for name in SEVERITY_NAMES]
    return findings.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("episodes"), F.countDistinct(actor).alias("actors"),
        F.countDistinct(F.to_date("first_seen")).alias("days"), *graded,
    ).withColumn("span_days", telemetry_days(tel).scalar()).withColumn("per_day", F.col("episodes") / F.col("span_days"))


def volume_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """``rule_id, before, after``: findings of each rule in two runs."""
    count = lambda df, name: df.groupBy("rule_id").agg(F.count(F.lit(1)).alias(name))
    return count(before, "before").join(count(after, "after"), "rule_id", "full_outer").fillna(0, ["before", "after"])


def top_finding_actors(findings: DataFrame, top: int = 10) -> DataFrame:
    actor = F.coalesce(F.nullif(F.col("actor"), F.lit("")), F.col("user")).alias("actor")
    counted = findings.groupBy("rule_id", actor).agg(F.count(F.lit(1)).alias("episodes"))
    rank = F.row_number().over(Window.partitionBy("rule_id").orderBy(F.col("episodes").desc(), "actor"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top)


# ---------------------------------------------------------------- A41, A42, J21


def decision_metrics(manifest: DataFrame, rows: DataFrame) -> DataFrame:
    """Per arm: correct, abstained, unsafe clears, recalls, latency.

    ``manifest``: ``arm, case_id, label``, the expected rows and the denominator; ``rows``:
    ``arm, case_id, disposition, seconds``.  A missing row is neither correct nor abstained.
    """
    joined = manifest.join(rows, ["arm", "case_id"], "left")
    label, said = F.col("label"), F.coalesce("disposition", F.lit("missing"))
    recall = lambda name: F.when(F.count_if(label == name) > 0, F.count_if((label == name) & (said == name)) / F.count_if(label == name))
    return joined.groupBy("arm").agg(
        F.count(F.lit(1)).alias("expected"), F.count("disposition").alias("observed"), F.count_if(said == label).alias("correct"),
        F.count_if(said == "abstain").alias("abstained"), F.count_if((label == "malicious") & (said == "benign")).alias("unsafe_clears"),
        recall("malicious").alias("malicious_recall"), recall("benign").alias("benign_recall"),
        F.percentile("seconds", 0.5).alias("median_seconds"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY seconds)").alias("p90_seconds"), F.max("seconds").alias("max_seconds")
    ).withColumn("balanced_accuracy", (F.col("malicious_recall") + F.col("benign_recall")) / 2)


def paired_comparison(a: DataFrame, b: DataFrame, key: str, measures: dict[str, bool]) -> DataFrame:
    """``measure, better, worse, same, unpaired``: b against a on paired keys.

    ``measures`` maps a column to whether a higher value is better.
    """
    pick = lambda df, p: df.select(key, F.lit(True).alias(p), *[F.col(m).alias(f"{p}_{m}") for m in measures])
    both = pick(a, "a").join(pick(b, "b"), key, "full_outer")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    cells = []
    for m, higher in measures.items():
        x, y = F.col(f"a_{m}"), F.col(f"b_{m}")
        gain = (y > x) if higher else (y < x)
        outcome = F.when(~paired, "unpaired").when(x.isNull() | y.isNull(), "unmeasured").when(x == y, "same").when(gain, "better").otherwise("worse")
        cells.append(F.struct(F.lit(m).alias("measure"), outcome.alias("outcome")))
    each = both.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return each.groupBy("measure").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("better", "worse", "same", "unpaired", "unmeasured")])


def link_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``left_id, right_id, signal, change``: links lost and gained between two sets."""
    flat = lambda df, p: df.select("left_id", "right_id", F.explode("signals").alias("s")).select(
        "left_id", "right_id", F.col("s.signal").alias("signal"), F.lit(True).alias(p)).distinct()
    joined = flat(before, "_b").join(flat(after, "_a"), ["left_id", "right_id", "signal"], "full_outer")
    change = F.when(F.col("_a").isNull(), "lost").when(F.col("_b").isNull(), "gained")
    return joined.withColumn("change", change).where(F.col("change").isNotNull()).select("left_id", "right_id", "signal", "change")


# ---------------------------------------------------------------- A43, A48, A49


def domain_necessity(members: DataFrame, findings: DataFrame) -> DataFrame:
    """``case_id, domains, carrying, qualifies``: do two domains each own a finding."""
    rows = members.join(findings.select("finding_id", families_of(F.col("rule_id")).alias("families")), "finding_id")
    own = F.when(F.size("families") == 1, F.get("families", F.lit(0)))
    per_case = rows.groupBy("case_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))).alias("domains"),
        F.array_sort(F.collect_set(own)).alias("carrying"))
    return per_case.withColumn("qualifies", (F.size("domains") >= 2) & (F.size("carrying") >= 2))


def evidence_rows_per_table(members: DataFrame, evidence: DataFrame) -> DataFrame:
    return members.join(evidence.select("finding_id", "event_id", "event_type"), "finding_id").select(
        "case_id", "event_id", "event_type").distinct().groupBy("case_id", "event_type").agg(F.count(F.lit(1)).alias("rows"))


def case_summary(members: DataFrame, findings: DataFrame) -> DataFrame:
    """Sizes of the cases, singletons, the largest, cases over several domains, one row."""
    sized = members.groupBy("case_id").agg(F.count(F.lit(1)).alias("size")).join(domain_necessity(members, findings), "case_id")
    return sized.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("size") == 1).alias("singletons"),
        F.coalesce(F.max("size"), F.lit(0)).alias("largest"), F.count_if(F.size("domains") >= 2).alias("multi_domain"))


def case_sizes(members: DataFrame) -> DataFrame:
    """``size, cases``: how many cases hold how many findings."""
    return members.groupBy("case_id").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("cases"))


def case_signals(members: DataFrame, links: DataFrame) -> DataFrame:
    """``case_id, signal, links``: links inside each case by signal."""
    side = members.select("case_id", F.col("finding_id").alias("left_id"))
    return links.select("left_id", F.explode("signals").alias("s")).join(side, "left_id").groupBy(
        "case_id", F.col("s.signal").alias("signal")).agg(F.count(F.lit(1)).alias("links"))


def case_disposition(members: DataFrame, assessments: DataFrame) -> DataFrame:
    """Malicious if any finding is likely malicious, benign if all are likely benign."""
    d = F.col("disposition")
    return members.join(assessments.select("finding_id", "disposition"), "finding_id").groupBy("case_id").agg(
        F.when(F.bool_or(d == "likely_malicious"), "malicious").when(F.bool_and(d == "likely_benign"), "benign").otherwise("abstain").alias("disposition"))


# ---------------------------------------------------------------- A45-A47, A50


def _activity(tel: Telemetry) -> DataFrame:
    what = F.concat_ws(" ", "verb", "resource_type")
    return tel.controls.select("event_id", "timestamp", F.lower("actor").alias("principal"), F.lit("control").alias("table"), what.alias("what")).unionByName(
        tel.logons.select("event_id", "timestamp", F.lower("user").alias("principal"), F.lit("logon").alias("table"),
                          F.concat(F.lit("logon "), F.col("action")).alias("what")))


def session_activity(sessions: DataFrame, tel: Telemetry) -> DataFrame:
    """``session_id, event_id``: rows inside a declared session of one of its principals.

    ``sessions``: ``session_id, principals, start, end, status``.  Sessions are placed in day
    buckets, so the join is an equality on (principal, day) with the bounds as a residual.
    """
    named = sessions.where(F.col("end") >= F.col("start")).select(
        "session_id", "start", "end", F.explode("principals").alias("principal"),
        F.sequence(F.to_date("start"), F.to_date("end")).alias("days")).select(
        "session_id", "start", "end", F.lower("principal").alias("principal"), F.explode("days").alias("day"))
    rows = _activity(tel).withColumn("day", F.to_date("timestamp"))
    return rows.join(named, ["principal", "day"]).where(F.col("timestamp").between(F.col("start"), F.col("end"))).select(
        "session_id", "event_id", "table").distinct()


def session_coverage(sessions: DataFrame, tel: Telemetry) -> DataFrame:
    """``session_id, status, rows, verdict`` of every declared session."""
    counted = session_activity(sessions, tel).groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"))
    rows = F.coalesce("rows", F.lit(0))
    checked = F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("end") >= F.col("start"))
    return sessions.join(counted, "session_id", "left").select(
        "session_id", "status", rows.alias("rows"),
        F.when(~F.coalesce(checked, F.lit(False)), "unchecked").when((F.col("status") == "skipped") & (rows > 0), "skipped_with_activity")
        .when(F.col("status") == "skipped", "skipped").when(rows > 0, "covered").otherwise("uncovered").alias("verdict"))


def unclaimed_activity(sessions: DataFrame, tel: Telemetry, top: int | None = None) -> dict[str, DataFrame]:
    """Rows no session claims: actors and actions, the largest first (``top`` of them if given), and the earliest samples."""
    rest = _activity(tel).join(session_activity(sessions, tel).select("event_id").distinct(), "event_id", "left_anti")

    def best(column: str) -> DataFrame:
        sizes = rest.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column)
        return sizes if top is None else sizes.limit(top)

    return {"rows": rest, "by_actor": best("principal"), "by_action": best("what"), "sample": rest.orderBy("timestamp", "event_id").limit(40)}


def sample_controls(processes: DataFrame, n: int, seed: int = 0, admin: Column | None = None, admin_share: float = 0.2) -> DataFrame:
    """``n`` process events spread over (day, host), a fixed seed, some admin-looking.

    Each cell is ordered by a seeded digest and the cells are dealt round by round, so the
    choice is deterministic and does not depend on partitioning.  No cell gives more than ``n``
    rows: every task keeps its first ``n`` of a cell before the shuffle, so a hot host is cut
    where it is read.
    """
    admin = F.lit(False) if admin is None else admin
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("event_id").cast("string")))
    rows = processes.select("event_id", "timestamp", "device", "user", admin.alias("is_admin"), order.alias("_h"))
    cell = Window.partitionBy("is_admin", F.to_date("timestamp"), "device").orderBy("_h", "event_id")
    dealt = rows.withColumn("_round", F.row_number().over(cell)).where(F.col("_round") <= n)
    wanted_admin = int(n * admin_share)
    take = lambda df, k: df.orderBy("_round", "_h", "event_id").limit(k)
    return take(dealt.where("is_admin"), wanted_admin).unionByName(take(dealt.where(~F.col("is_admin")), n - wanted_admin)).drop("_round", "_h")


def match_windows(cases: DataFrame, controls: DataFrame, coverage: DataFrame) -> DataFrame:
    """Give each control its partner's duration and offset, kept inside the day's coverage.

    ``cases``: ``case_id, seed_time, start, end``; ``controls``: ``event_id, timestamp``;
    ``coverage``: ``day, lo, hi``.  Pairs by time and id, cases repeating when controls
    outnumber them; without cases there are no pairs.
    """
    size = F.nullif(cases.agg(F.count(F.lit(1))).scalar(), F.lit(0))
    us = F.unix_micros
    paired = numbered(controls, ["timestamp", "event_id"]).withColumn("_n", F.col("_n") % size).join(
        numbered(cases, ["seed_time", "case_id"]), "_n")
    begin = us("timestamp") - (us("seed_time") - us("start"))
    finish = begin + (us("end") - us("start"))
    placed = paired.withColumn("day", F.to_date("timestamp")).withColumn("_b", begin).withColumn("_e", finish).join(coverage, "day")
    shift = F.when(F.col("_b") < us("lo"), us("lo") - F.col("_b")).when(F.col("_e") > us("hi"), us("hi") - F.col("_e")).otherwise(0)
    return placed.withColumn("_s", shift).select(
        "event_id", "case_id", F.timestamp_micros(F.greatest(F.col("_b") + F.col("_s"), us("lo"))).alias("start"),
        F.timestamp_micros(F.least(F.col("_e") + F.col("_s"), us("hi"))).alias("end"))


def follow_up_lag(findings: DataFrame) -> DataFrame:
    """Seconds from the last failure to the success of each brute-force finding."""
    return findings.where((F.col("rule_id") == "ATH-005") & F.col("succeeded")).select(
        "finding_id", "device", "user", "lag_seconds",
        (F.col("success_time") < F.col("window_end")).alias("negative"))
