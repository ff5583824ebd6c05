"""Weighing findings: benign signals, vetoes, a disqualifier, a disposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators.timing import connection_patterns
from ..schemas import Telemetry
from .environment import destination_profiles, host_inventory, process_profiles, public_connections

BENIGN_THRESHOLD = 4
MAX_BENIGN_SEVERITY = V.SEVERITY_RANK["medium"]
SUSTAINED_CONTACTS = 5
WIDE_REACH = 0.5

# signal -> (weight, affirmative).  Fixed values.
SIGNALS = {
    "known_management_tool": (3, True),
    "established_tooling": (2, True),
    "ubiquitous_destination": (3, True),
    "no_evasion_indicators": (2, False),
    "no_download_indicators": (2, False),
    "encrypted_standard_port": (1, False),
}
DISPOSITIONS = ("likely_malicious", "needs_review", "likely_benign")


def destination_timing(network: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Timing per (device, address); of several images the lexically last one stands."""
    rows = public_connections(network)
    if only is not None:
        rows = rows.join(only, ["device", "remote_ip"], "left_semi")
    measured = connection_patterns(rows, ["device", "process_name", "remote_ip"], "timestamp")
    fields = ("is_regular", "median_interval", "robust_cv", "interarrival_count")
    return measured.groupBy("device", "remote_ip").agg(
        F.max_by(F.struct(*fields), "process_name").alias("_t")
    ).select("device", "remote_ip", "_t.*")


def triage_context(findings: DataFrame, tel: Telemetry) -> DataFrame:
    """Findings with the environment facts the signals read.

    Profiles are computed for the images and addresses findings name, not for all.
    """
    total = host_inventory(tel).agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = findings.where(F.coalesce("remote_ip", F.lit("")) != "").select("device", "remote_ip").distinct()
    profiles = process_profiles(tel.processes)
    parent = profiles.select(
        F.col("image").alias("_parent"), F.col("consistently_signed").alias("parent_signed"),
        F.col("hosts").alias("parent_hosts"), F.col("spawned_children").alias("parent_children"),
        _conflict().alias("parent_conflict"))
    own = profiles.select(F.col("image").alias("_own"), _conflict().alias("own_conflict"))
    reach = destination_profiles(tel.network, wanted.select("remote_ip")).select(
        F.col("remote_ip"), F.col("hosts").alias("destination_hosts"),
        F.col("images").alias("destination_images"),
        F.col("is_established").alias("destination_established"))
    timing = destination_timing(tel.network, wanted).select("device", "remote_ip", "is_regular")
    lowered = lambda c: F.nullif(F.lower(F.col(c)), F.lit(""))
    return (
        findings.withColumn("_parent", lowered("parent_process")).withColumn("_own", lowered("process_name"))
        .join(parent, "_parent", "left").join(own, "_own", "left")
        .join(reach, "remote_ip", "left").join(timing, ["device", "remote_ip"], "left")
        .withColumn("_hosts", total)
    )


def _conflict() -> Column:
    odd = F.filter("signature_states", lambda s: s != "valid")
    return (F.col("signers") > 1) | ((F.col("signers") > 0) & (F.size(odd) > 0))


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _signals() -> dict[str, Column]:
    known = F.col("_parent").isin(*V.SECURITY_PRODUCTS) & F.col("parent_signed")
    share = lambda c: F.when(F.col("_hosts") > 0, F.col(c) / F.col("_hosts"))
    return {
        "known_management_tool": known,
        "established_tooling": ~_yes(known) & (share("parent_hosts") >= WIDE_REACH)
        & (F.col("parent_children") >= 5),
        "ubiquitous_destination": (share("destination_hosts") >= WIDE_REACH)
        & (F.col("destination_images") >= 3) & F.col("destination_established"),
        "no_evasion_indicators": F.size("evasion_flags") == 0,
        "no_download_indicators": F.size("download_indicators") == 0,
        "encrypted_standard_port": (F.col("ports") == F.array(F.lit(443).cast("long")))
        & ~_yes(F.col("cleartext_http")),
    }


def _vetoes() -> dict[str, Column]:
    return {
        "evasion_flags_present": F.size("evasion_flags") > 0,
        "download_indicators_present": F.size("download_indicators") > 0,
        "office_application_parent": F.col("_parent").isin(*V.OFFICE_APPLICATIONS),
        "cleartext_external_retrieval": F.col("cleartext_http"),
        "sustained_interpreter_contact": F.col("connection_count") >= SUSTAINED_CONTACTS,
        "process_identity_conflict": _yes(F.col("parent_conflict")) | _yes(F.col("own_conflict")),
        "graded_high_by_detection": F.col("severity_rank") > MAX_BENIGN_SEVERITY,
    }


def assess_findings(findings: DataFrame, tel: Telemetry) -> DataFrame:
    """``finding_id, rule_id, disposition, score`` and the signals, vetoes and disqualifiers."""
    return dispose(triage_context(findings, tel))


def dispose(context: DataFrame) -> DataFrame:
    """Dispositions from prepared context: a veto beats a disqualifier beats the score."""
    signals = F.array_compact(F.array(*[
        F.when(_yes(cond), F.struct(
            F.lit(name).alias("name"), F.lit(SIGNALS[name][0]).alias("weight"),
            F.lit(SIGNALS[name][1]).alias("affirmative")))
        for name, cond in _signals().items()
    ]))
    vetoes = F.array_compact(F.array(*[F.when(_yes(c), F.lit(n)) for n, c in _vetoes().items()]))
    regular = F.array_compact(F.array(F.when(_yes(F.col("is_regular")), F.lit("suspiciously_regular_contact"))))
    facts = context.select(
        "finding_id", "rule_id", signals.alias("benign_signals"), vetoes.alias("vetoes"),
        regular.alias("disqualifiers"))
    score = F.aggregate("benign_signals", F.lit(0), lambda acc, s: acc + s["weight"])
    affirmed = F.exists("benign_signals", lambda s: s["affirmative"])
    return facts.withColumn("score", score).withColumn(
        "disposition",
        F.when(F.size("vetoes") > 0, "likely_malicious")
        .when(F.size("disqualifiers") > 0, "needs_review")
        .when((F.col("score") >= BENIGN_THRESHOLD) & affirmed, "likely_benign")
        .otherwise("needs_review"))


def triage_summary(assessments: DataFrame) -> DataFrame:
    """Findings per disposition, every disposition present."""
    counted = assessments.groupBy("disposition").agg(F.count(F.lit(1)).alias("findings"))
    every = assessments.sparkSession.createDataFrame([(d,) for d in DISPOSITIONS], "disposition string")
    return every.join(counted, "disposition", "left").fillna(0, ["findings"])


def set_aside_ids(assessments: DataFrame) -> DataFrame:
    return assessments.where(F.col("disposition") == "likely_benign").select("finding_id")
