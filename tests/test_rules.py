"""Rules, triage and correlation on hand-built rows with the real thresholds."""

from datetime import datetime, timedelta

import pytest

from sentryframe.plans import correlate, hunt, techniques, triage
from sentryframe.plans.rules import REGISTRY
from tests.builders import control, logon, network, process, telemetry

T0 = datetime(2024, 1, 1, 8)


def at(seconds):
    return (T0 + timedelta(seconds=seconds)).isoformat(sep=" ")


def run(spark, rule_id, **tables):
    out = REGISTRY[rule_id].run(telemetry(spark, **tables))
    return sorted(out.findings.collect(), key=lambda r: r.first_seen), out.evidence.collect()


def failures(n, gap=30, start=0, **more):
    return [logon(timestamp=at(start + i * gap), action="failure", source_ip="10.0.0.9", **more) for i in range(n)]


def test_brute_force_grades_by_outcome(spark):
    quiet, _ = run(spark, "ATH-005", logons=failures(9))
    assert quiet == []
    [alone], _ = run(spark, "ATH-005", logons=failures(12))
    assert (alone.severity, alone.failure_count, alone.succeeded) == ("medium", 12, False)
    won = logon(timestamp=at(400), source_ip="10.0.0.9")
    [hit], cited = run(spark, "ATH-005", logons=[*failures(12), won])
    assert hit.severity == "critical" and hit.lag_seconds == 70 and len(cited) == 13
    # A success inside the burst counts: the search starts at the burst's start.
    [inside], _ = run(spark, "ATH-005", logons=[*failures(12), logon(timestamp=at(45), source_ip="10.0.0.9")])
    assert inside.severity == "critical" and inside.lag_seconds < 0
    [late], _ = run(spark, "ATH-005", logons=[*failures(12), logon(timestamp=at(12 * 30 + 900), source_ip="10.0.0.9")])
    assert late.severity == "medium"


def test_denial_burst_needs_25_and_grades_by_breadth(spark):
    rows = lambda n, kinds: [control(timestamp=at(i), actor="eve", verb="get", resource_type=f"s{i % kinds}:x", decision="denied") for i in range(n)]
    assert run(spark, "AWS-004", controls=rows(24, 5))[0] == []
    [narrow], _ = run(spark, "AWS-004", controls=rows(25, 1))
    [broad], cited = run(spark, "AWS-004", controls=rows(40, 5))
    assert (narrow.severity, broad.severity, len(cited), broad.evidence_count) == ("medium", "high", 40, 40)
    assert broad.last_seen.isoformat(sep=" ") == at(39)


def test_rules_see_only_their_channels(spark):
    rows = [control(timestamp=at(i), actor="eve", verb="delete", resource_type="iam:role", decision="allowed", source="k8s_audit") for i in range(3)]
    assert run(spark, "AWS-005", controls=rows)[0] == []


def test_grant_then_use(spark):
    grant = control(timestamp=at(0), actor="adm", verb="attach", resource_type="iam:user-policy", target_actor="bob", role_ref="P")
    use = lambda s, who="bob": control(timestamp=at(s), actor=who, verb="create", resource_type="iam:access-key")
    [hit], _ = run(spark, "AWS-001", controls=[grant, use(60), use(30), use(-5)])
    assert (hit.user, hit.lag_seconds) == ("bob", 30)
    assert run(spark, "AWS-001", controls=[grant, use(1801)])[0] == []
    assert run(spark, "AWS-001", controls=[grant, use(10, "adm")])[0] == []


def test_superuser_grants(spark):
    bind = lambda **m: control(timestamp=at(0), source="k8s_audit", verb="create", resource_type="clusterrolebindings", role_ref="cluster-admin", actor="a", **m)
    assert len(run(spark, "K8S-001", controls=[bind(target_actor="x", actor_groups="dev")])[0]) == 1
    assert run(spark, "K8S-001", controls=[bind(target_actor="x", actor_groups="dev,system:masters")])[0] == []
    assert run(spark, "K8S-001", controls=[bind(target_actor="system:masters", actor_groups="dev")])[0] == []
    shell = control(timestamp=at(60), source="k8s_audit", verb="exec", resource_type="pods/exec", actor="x")
    # A superuser's grant still counts once it is used.
    assert len(run(spark, "K8S-002", controls=[bind(target_actor="x", actor_groups="system:masters"), shell])[0]) == 1
    assert run(spark, "K8S-002", controls=[bind(target_actor="x,y"), shell])[0] == []


def test_discovery_tests_the_whole_group(spark):
    row = lambda s, image: process(timestamp=at(s), process_name=image, parent_process_id=7)
    assert len(run(spark, "ATH-010", processes=[row(0, "whoami.exe"), row(200, "NET.exe")])[0]) == 1
    assert run(spark, "ATH-010", processes=[row(0, "whoami.exe"), row(200, "net.exe"), row(9000, "net.exe")])[0] == []


def test_lsass_naming_itself_is_not_access(spark):
    boot = process(process_name="lsass.exe", command_line=r"D:\Program Files\v\lsass.exe", file_path=r"D:\Program Files\v\lsass.exe")
    assert run(spark, "ATH-004", processes=[boot])[0] == []
    [hit], _ = run(spark, "ATH-004", processes=[process(process_name="procdump.exe", command_line="procdump.exe -ma lsass.exe o.dmp")])
    assert set(hit.indicators) == {"explicit lsass reference", "procdump against lsass"}


def test_unknown_rule_is_an_error(spark):
    with pytest.raises(KeyError):
        hunt.run_hunt(telemetry(spark), ["ATH-999"])


def test_hunt_over_empty_telemetry(spark):
    result = hunt.run_hunt(telemetry(spark))
    assert result.errors == {} and result.findings.count() == 0 and len(result.rules_run) == 20


def test_triage_order_of_precedence(spark):
    signed = dict(signer="Microsoft", signature_status="valid")
    tool = [process(timestamp=at(i), device=f"PC{i}", process_name="CcmExec.exe", **signed) for i in range(3)]
    blob = "RwBlAHQALQBQAHIAbwBjAGUAcwBzACAALQBJAGQAIAAxAA=="
    benign = process(timestamp=at(10), process_name="powershell.exe", parent_process_name="CcmExec.exe", command_line=f"powershell -enc {blob}")
    hidden = process(timestamp=at(20), process_name="powershell.exe", parent_process_name="CcmExec.exe", command_line=f"powershell -w hidden -enc {blob}")
    tel = telemetry(spark, processes=[*tool, benign, hidden])
    found = hunt.run_hunt(tel, ["ATH-002"]).findings
    said = {r.finding_id: r for r in triage.assess_findings(found, tel).collect()}
    by_id = {r.finding_id: r for r in found.collect()}
    low = next(r for r in by_id.values() if r.severity == "low")
    other = next(r for r in by_id.values() if r.severity == "medium")
    assert said[low.finding_id].disposition == "likely_benign" and said[low.finding_id].score == 7
    assert said[other.finding_id].disposition == "likely_malicious"
    assert {r.technique_id for r in techniques.map_techniques(found).collect()} == {"T1059.001", "T1027.010"}


def test_cases_link_what_shares_structure(spark):
    shell = process(timestamp=at(0), process_name="powershell.exe", parent_process_name="WINWORD.EXE", process_id=50, process_guid="sysmon:a", command_line="powershell")
    out = network(timestamp=at(30), process_id=50, process_guid="sysmon:a", remote_ip="8.8.8.8", remote_port=443)
    lone = process(timestamp=at(40), device="PC77", user="zoe", process_name="cmd.exe", parent_process_name="EXCEL.EXE", command_line="cmd")
    tel = telemetry(spark, processes=[shell, lone], networks=[out])
    found = hunt.run_hunt(tel, ["ATH-001", "ATH-003"])
    links = correlate.link_findings(found.findings, found.evidence, tel)
    [link] = links.collect()
    assert link.score == 3 + 2 + 2 + 2 and {s.signal for s in link.signals} == {"same_process", "same_device", "same_user", "temporal_close"}
    assert not link.inferred_from_pid
    members = correlate.group_cases(found.findings, links)
    attributes = {r.case_id: r for r in correlate.case_attributes(members, found.findings, links, found.evidence).collect()}
    assert [attributes[c].findings for c in sorted(attributes)] == [2, 1]
    assert attributes["CASE-001"].confidence == "medium" and attributes["CASE-002"].confidence == "low"
    correlate.assert_unique_findings(found.findings)


def test_hunt_to_isolates_a_rule_that_fails_while_running(spark, tmp_path, monkeypatch):
    from dataclasses import replace

    from pyspark.sql import functions as F

    from sentryframe.plans import hunt

    rule = hunt.REGISTRY["ATH-012"]
    broken = replace(rule, detect=lambda r, t, c: hunt.rows_as_findings(
        r, t.processes.withColumn("command_line", F.raise_error(F.lit("broken"))), "process", F.col("command_line"), reason=F.lit("x")))
    monkeypatch.setitem(hunt.REGISTRY, "ATH-012", broken)
    tel = telemetry(spark, processes=[process(parent_process_name="services.exe", process_name="cmd.exe")])
    found = hunt.hunt_to(tel, str(tmp_path), ["ATH-007", "ATH-012"])
    assert found.rules_run == ["ATH-007"] and list(found.errors) == ["ATH-012"]
    assert [r.rule_id for r in found.findings.collect()] == ["ATH-007"] and found.evidence.count() == 1
