"""Every registered query against its SQL twin at the smallest scale.

The whole catalogue takes several minutes; ORACLE_QUERIES=all runs it, the default is a
spread over the families.  tests/compare.py runs any selection at any scale.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck
from tests.conftest import TESTDATA

SPREAD = (
    "w01_episodes_3_in_48h", "w01_episodes_5_in_72h_bucketed", "w02_sliding_max_distinct_types", "a28_beacon_report",
    "j01_first_use_after_grant", "j02_follow_up_success", "j03_foreign_pairs", "j04_j05_network_to_process",
    "j06_resolve_parent", "j11_resolve_refs", "j12_verify_assertions", "d02_encoded_powershell", "d03_interpreter_egress",
    "d04_lsass_access", "d05_evidence", "d06_foreign_host_logon", "d11_recovery_inhibition", "d16_denial_burst",
    "d19_rbac_escalation", "a05_host_inventory", "a06_a07_identity_inventory", "a14_a15_field_population",
    "a17_rule_verdicts", "a22_distributions", "a32_score_rules", "a41_decision_metrics", "a45_session_coverage",
    "c09_c11_cases", "m01_egress_techniques", "n08_api_names", "n21_n23_verb_classes", "s05_n15_k8s_controls",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("ORACLE_QUERIES") == "all" else SPREAD


@pytest.fixture(scope="module")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, sf_dir, name):
    got, want = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], sf_dir)
    assert got[0] == want[0]
    assert got[1] == want[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
