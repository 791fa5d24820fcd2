"""A sample of registered queries against DuckDB; ``python tests/oracle_check.py`` runs them all."""

import pytest

from lodegrid.plans import load_all
from tests.oracle_check import check, connect

SF = "/root/testdata/sf0.001"
SAMPLE = ["score_ladder", "score_ladder_ultra", "corroborate", "collapse_dups", "suppress_null_global", "verdict_guardrails", "target_summary", "change_detect", "csv_export",
          "nested_export", "source_decode", "module_expansion", "proxy_resolution", "value_context", "tool_slither", "exact_layouts", "call_edges", "reach_depth8", "components",
          "bytecode_risks", "slot_numbering", "role_inference", "rule_zk_verifier", "rule_oracle_manipulation", "rule_access_control", "rule_privacy_pool"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_statement(spark, con, name):
    q, o = load_all()
    ok, msg = check(spark, con, SF, name, q[name], o[name])
    assert ok, msg
