"""Technique catalogue and the gated mapping of findings to techniques."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIDENCE_RANK = {"low": 0, "medium": 1, "high": 2}
# Tactics in the order a case is told in (fixed values).
TACTIC_ORDER = (
    "Initial Access", "Execution", "Persistence", "Privilege Escalation", "Stealth",
    "Credential Access", "Discovery", "Lateral Movement", "Collection",
    "Command and Control", "Exfiltration", "Impact", "Defense Impairment",
)
_ACCOUNTS = ("Persistence", "Privilege Escalation", "Initial Access", "Stealth")
_MANIPULATION = ("Persistence", "Privilege Escalation")
# id -> (name, tactics, parent).  Fixed values.
TECHNIQUES = {
    "T1059": ("Command and Scripting Interpreter", ("Execution",), None),
    "T1059.001": ("PowerShell", ("Execution",), "T1059"),
    "T1059.003": ("Windows Command Shell", ("Execution",), "T1059"),
    "T1204": ("User Execution", ("Execution",), None),
    "T1204.002": ("Malicious File", ("Execution",), "T1204"),
    "T1569": ("System Services", ("Execution",), None),
    "T1569.002": ("Service Execution", ("Execution",), "T1569"),
    "T1027": ("Obfuscated Files or Information", ("Stealth",), None),
    "T1027.010": ("Command Obfuscation", ("Stealth",), "T1027"),
    "T1218": ("System Binary Proxy Execution", ("Stealth",), None),
    "T1218.011": ("Rundll32", ("Stealth",), "T1218"),
    "T1003": ("OS Credential Dumping", ("Credential Access",), None),
    "T1003.001": ("LSASS Memory", ("Credential Access",), "T1003"),
    "T1110": ("Brute Force", ("Credential Access",), None),
    "T1110.001": ("Password Guessing", ("Credential Access",), "T1110"),
    "T1078": ("Valid Accounts", _ACCOUNTS, None),
    "T1078.002": ("Domain Accounts", _ACCOUNTS, "T1078"),
    "T1021": ("Remote Services", ("Lateral Movement",), None),
    "T1021.001": ("Remote Desktop Protocol", ("Lateral Movement",), "T1021"),
    "T1021.002": ("SMB/Windows Admin Shares", ("Lateral Movement",), "T1021"),
    "T1071": ("Application Layer Protocol", ("Command and Control",), None),
    "T1071.001": ("Web Protocols", ("Command and Control",), "T1071"),
    "T1105": ("Ingress Tool Transfer", ("Command and Control",), None),
    "T1560": ("Archive Collected Data", ("Collection",), None),
    "T1560.001": ("Archive via Utility", ("Collection",), "T1560"),
    "T1074": ("Data Staged", ("Collection",), None),
    "T1074.001": ("Local Data Staging", ("Collection",), "T1074"),
    "T1033": ("System Owner/User Discovery", ("Discovery",), None),
    "T1069": ("Permission Groups Discovery", ("Discovery",), None),
    "T1069.002": ("Domain Groups", ("Discovery",), "T1069"),
    "T1482": ("Domain Trust Discovery", ("Discovery",), None),
    "T1526": ("Cloud Service Discovery", ("Discovery",), None),
    "T1580": ("Cloud Infrastructure Discovery", ("Discovery",), None),
    "T1490": ("Inhibit System Recovery", ("Impact",), None),
    "T1685": ("Disable or Modify Tools", ("Defense Impairment",), None),
    "T1112": ("Modify Registry", ("Defense Impairment",), None),
    "T1098": ("Account Manipulation", _MANIPULATION, None),
    "T1098.003": ("Additional Cloud Roles", _MANIPULATION, "T1098"),
    "T1098.001": ("Additional Cloud Credentials", _MANIPULATION, "T1098"),
    "T1098.006": ("Additional Container Cluster Roles", _MANIPULATION, "T1098"),
    "T1609": ("Container Administration Command", ("Execution",), None),
}
# Retired ids and what replaced them (fixed values).
RETIRED = {"T1562": "T1685", "T1562.001": "T1685"}


@dataclass(frozen=True)
class Mapping:
    rule_id: str
    technique_id: str
    confidence: str
    gate: str = "always"

    def __post_init__(self):
        if self.technique_id in RETIRED or self.technique_id not in TECHNIQUES:
            raise KeyError(f"{self.technique_id} is not a current technique of the catalogue")


# (rule, technique, confidence, gate).  Fixed values.
MAPPINGS = tuple(Mapping(*m) for m in (
    ("ATH-001", "T1204.002", "medium"),
    ("ATH-001", "T1059.001", "high", "child_powershell"),
    ("ATH-001", "T1059.003", "high", "child_cmd"),
    ("ATH-002", "T1059.001", "high"),
    ("ATH-002", "T1027.010", "high"),
    ("ATH-002", "T1105", "medium", "downloads"),
    ("ATH-003", "T1071.001", "medium", "web_port"),
    ("ATH-003", "T1105", "medium", "retrieved"),
    ("ATH-004", "T1003.001", "high", "lsass"),
    ("ATH-004", "T1218.011", "medium", "rundll32_proxy"),
    ("ATH-005", "T1110.001", "high"),
    ("ATH-005", "T1078", "medium", "succeeded"),
    ("ATH-006", "T1021.002", "medium", "logon_network"),
    ("ATH-006", "T1021.001", "medium", "logon_rdp"),
    ("ATH-006", "T1078", "medium"),
    ("ATH-007", "T1569.002", "high"),
    ("ATH-007", "T1021.002", "medium", "admin_share"),
    ("ATH-008", "T1560.001", "high"),
    ("ATH-008", "T1074.001", "medium", "staged"),
    ("ATH-009", "T1204.002", "medium"),
    ("ATH-010", "T1033", "medium", "found_t1033"),
    ("ATH-010", "T1069.002", "medium", "found_t1069_002"),
    ("ATH-010", "T1482", "medium", "found_t1482"),
    ("ATH-011", "T1490", "high"),
    ("ATH-012", "T1685", "high"),
    ("AWS-001", "T1098.003", "high"),
    ("AWS-001", "T1098.001", "high"),
    ("AWS-002", "T1685", "high"),
    ("AWS-003", "T1526", "high"),
    ("AWS-003", "T1580", "medium"),
    ("AWS-004", "T1580", "medium"),
    ("AWS-005", "T1098", "medium"),
    ("AWS-006", "T1098", "low"),
    ("K8S-001", "T1098.006", "high"),
    ("K8S-002", "T1098.006", "high"),
    ("K8S-002", "T1609", "high"),
))


def _gates() -> dict[str, Column]:
    """Named conditions over a finding's typed metadata."""
    child = F.lower(F.coalesce("child_process", F.lit("")))
    command = F.lower(F.coalesce("command_line", F.lit("")))
    overlaps = lambda name, *values: F.arrays_overlap(
        F.col(name), F.array(*[F.lit(v).cast("long") if isinstance(v, int) else F.lit(v) for v in values]))
    named = F.exists("indicators", lambda i: F.lower(i).rlike("lsass|comsvcs|procdump|sekurlsa|minidump|dump"))
    return {
        "always": F.lit(True),
        "child_powershell": child.isin("powershell.exe", "pwsh.exe"),
        "child_cmd": child == "cmd.exe",
        "downloads": F.size("download_indicators") > 0,
        "web_port": overlaps("ports", 80, 443, 8080, 8443),
        "retrieved": F.col("cleartext_http") | F.col("has_url"),
        "lsass": named,
        "rundll32_proxy": command.contains("rundll32") & command.contains("comsvcs.dll"),
        "succeeded": F.col("succeeded"),
        "logon_network": overlaps("logon_types", 3),
        "logon_rdp": overlaps("logon_types", 10),
        "admin_share": F.col("admin_share_redirect"),
        "staged": F.col("staging_destination"),
        "found_t1033": overlaps("candidate_techniques", "T1033"),
        "found_t1069_002": overlaps("candidate_techniques", "T1069.002"),
        "found_t1482": overlaps("candidate_techniques", "T1482"),
    }


def map_techniques(findings: DataFrame) -> DataFrame:
    """``finding_id, rule_id, technique_id, confidence, confidence_rank``.

    The mapping table is small and fixed, so it travels inside the expression: each finding
    explodes into the mappings of its rule whose gate holds, without a join.
    """
    gates = _gates()
    by_rule: dict[str, list[Mapping]] = {}
    for m in MAPPINGS:
        by_rule.setdefault(m.rule_id, []).append(m)
    entry = lambda m: F.when(
        F.coalesce(gates[m.gate], F.lit(False)),
        F.struct(F.lit(m.technique_id).alias("technique_id"), F.lit(m.confidence).alias("confidence"),
                 F.lit(CONFIDENCE_RANK[m.confidence]).alias("confidence_rank")))
    chosen = F.lit(None)
    for rule_id, mappings in by_rule.items():
        options = F.array_compact(F.array(*[entry(m) for m in mappings]))
        chosen = F.when(F.col("rule_id") == rule_id, options).otherwise(chosen)
    return findings.select("finding_id", "rule_id", F.explode(chosen).alias("m")).select(
        "finding_id", "rule_id", "m.*")


def mapping_order(mapped: DataFrame) -> DataFrame:
    return mapped.orderBy("finding_id", F.col("confidence_rank").desc(), "technique_id")


def technique_dimension(spark: SparkSession) -> DataFrame:
    """``technique_id, name, tactic, tactic_position, parent_id`` (M02), one row per tactic."""
    return spark.createDataFrame(
        [(t, name, tactic, TACTIC_ORDER.index(tactic), parent)
         for t, (name, tactics, parent) in TECHNIQUES.items() for tactic in tactics],
        "technique_id string, name string, tactic string, tactic_position int, parent_id string")


def unknown_techniques(mapped: DataFrame) -> DataFrame:
    """Technique ids outside the catalogue, retired ones included."""
    known = technique_dimension(mapped.sparkSession).select("technique_id")
    return mapped.select("technique_id").distinct().join(known, "technique_id", "left_anti")


def primary_tactic() -> Column:
    """The first tactic of a technique, as an expression over ``technique_id``."""
    out = F.lit(None).cast("string")
    for t, (_, tactics, _) in TECHNIQUES.items():
        out = F.when(F.col("technique_id") == t, F.lit(tactics[0])).otherwise(out)
    return out


def tactics_covered(mapped: DataFrame, by: list[str]) -> DataFrame:
    """Distinct tactics and techniques per group, tactics in telling order."""
    position = F.create_map(*[x for i, t in enumerate(TACTIC_ORDER) for x in (F.lit(t), F.lit(i))])
    step = F.struct(position[F.col("tactic")].alias("i"), F.col("tactic").alias("t"))
    return mapped.withColumn("tactic", primary_tactic()).groupBy(*by).agg(
        F.array_sort(F.collect_set("technique_id")).alias("techniques"),
        F.transform(F.array_sort(F.collect_set(step)), lambda s: s["t"]).alias("tactics"))
