"""A hunt that reads every table once finds what the rules find alone."""

from pyspark.sql import functions as F

from sentryframe.checks import projection as P
from sentryframe.checks.hunting import CONFIG
from sentryframe.plans import hunt
from sentryframe.plans.rules import REGISTRY
from sentryframe.schemas import EVIDENCE_COLUMNS

from .builders import control, logon, network, process, telemetry
from .conftest import TESTDATA


def cells(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_one_pass_finds_the_same(spark):
    tel = P.telemetry(spark, f"{TESTDATA}/sf0.001", rbac=True)
    # The SQL twin of d23_one_pass_hunt covers every rule.
    some = ["ATH-001", "ATH-002", "ATH-003", "ATH-004", "ATH-010", "ATH-012", "AWS-001", "AWS-002", "K8S-001", "K8S-002"]
    alone, sifted = hunt.run_hunt(tel, some, CONFIG), hunt.run_hunt(tel, some, CONFIG, one_pass=True)
    assert alone.rules_run == sifted.rules_run == some and not sifted.errors
    columns = ("finding_id", "severity", "device", "user", "first_seen", "last_seen", "evidence_count", "reason")
    assert cells(alone.findings, columns) == cells(sifted.findings, columns)
    assert cells(alone.evidence, EVIDENCE_COLUMNS) == cells(sifted.evidence, EVIDENCE_COLUMNS)


def test_rules_of_a_sieved_table_do_not_read_it_again(spark):
    tel = P.telemetry(spark, f"{TESTDATA}/sf0.001", rbac=True)
    scans = lambda df: sum(f.endswith("events.parquet") for f in df.inputFiles())
    assert len([r for r in REGISTRY.values() if set(r.tables) <= set(r.reads)]) == 18
    with_tests = ["ATH-001", "ATH-003", "ATH-011", "AWS-001", "AWS-002", "AWS-004", "K8S-002"]
    sifted = hunt.run_hunt(tel, with_tests, CONFIG, one_pass=True)
    assert scans(sifted.findings) == scans(sifted.evidence) == 0
    assert scans(hunt.run_hunt(tel, with_tests, CONFIG).findings) > 0


def test_a_test_that_does_not_fit_a_table_stops_only_its_rule(spark):
    tel = telemetry(spark, [process(parent_process_name="winword.exe", process_name="powershell.exe", command_line="x")],
                    [network()], [logon()], [control()])
    less = tel.controls.drop("resource_type")
    tel = tel.with_table("control", spark.createDataFrame(less.collect(), less.schema))
    out = hunt.run_hunt(tel, ["ATH-001", "AWS-002"], one_pass=True)
    assert out.rules_run == ["ATH-001"] and "AWS-002" in out.errors
    assert [r.rule_id for r in out.findings.collect()] == ["ATH-001"]
    assert hunt.run_hunt(tel, [], one_pass=True).findings.where(F.lit(True)).count() == 0
