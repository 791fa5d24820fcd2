"""Expected hits stated by hand, not taken from the rules' own patterns; whole-body keys, stored reads and plan shapes."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lodegrid.operators import dedup, graph
from lodegrid.plans import load_all
from lodegrid.plans.pipeline import special_hits, to_candidates, tool_candidates
from lodegrid.rules.catalog import rules_for
from lodegrid.rules.engine import evaluate, parse

SF = "/root/testdata/sf0.001"
FILES = "target_id long, chain string, path string, pos int, raw string"


def hits(spark, detector, *texts):
    files = spark.createDataFrame([(i, "ethereum", "a.sol", 0, "contract A {\n" + t + "\n}\n") for i, t in enumerate(texts)], FILES)
    out = evaluate(files, rules_for("deep", only=detector)).collect()
    return [sorted((r["function"], r["impact"], r["conf"], tuple(r["ev_flags"])) for r in out if r["target_id"] == i) for i in range(len(texts))]


def test_arbitrary_call_names_need_two_words(spark):
    none, named, multi = hits(
        spark, "arbitrary_call", 'function f(address) external { address(this).call(""); }', 'function f(address to) external { to.call(""); }',
        'function f(\n    address to,\n    bytes calldata data\n)\n    external\n    onlyOwner\n{\n    if (data.length > 0) {\n        to.call(data);\n    }\n}')
    assert none == [("f", 7.0, 4.0, ())]
    assert named == [("f", 7.0, 7.0, ("user_controlled_target_or_data",))]
    assert multi == [("f", 6.0, 5.0, ("user_controlled_target_or_data", "has_access_control"))]


def test_unsafe_downcast_once_for_each_variable(spark):
    two, bounded, other, none = hits(
        spark, "unsafe_downcast", "function f(uint256 q) external { uint64 a = uint64(q); uint128 b = uint128(q); total += a; }",
        "function f(uint256 q) external { require(q <= type(uint64).max); uint64 a = uint64(q); uint128 b = uint128(q); total += a; }",
        "function f(uint256 q, uint256 r) external {\n  uint64 a = uint64(q);\n  uint64 b = uint64(r);\n  total += a + b;\n}", "function f(uint256 q) external { total += q; }")
    assert [h[0] for h in two] == ["f"] and two[0][1:3] == (7.0, 4.5)
    assert len(bounded) == 1 and len(other) == 2 and none == []


def test_long_bodies_with_one_head_stay_apart(spark):
    head = "x = 1; " * 300
    texts = [f'function f(address to) external {{ {head} to.call("{k}"); }}' for k in "ab"]
    files = spark.createDataFrame([(0, "ethereum", f"{i}.sol", i, "contract A {\n" + t + "\n}\n") for i, t in enumerate(texts)], FILES)
    cand = dedup.with_keys(to_candidates(evaluate(files, rules_for("deep", only="arbitrary_call"))))
    assert cand.select("content_key").distinct().count() == 2 and cand.select("snippet").distinct().count() == 1


def test_rules_over_stored_reads(spark):
    from lodegrid.plans.corpus import contract_files, stored_reads

    files, known = contract_files(spark, SF), stored_reads(spark, SF)
    hit = evaluate(files, rules_for("ultra-deep-v2", only="reentrancy"))
    found = special_hits(files, parse(files), "ultra-deep-v2", hit.select("target_id", "function"), known).cache()
    seen = {r["detector"] for r in found.select("detector").distinct().collect()}
    assert {"governance_blast_radius", "timelock_roles", "bytecode_periphery", "delegatecall"} <= seen
    assert found.where("rule_no IS NULL").isEmpty()
    assert tool_candidates(known["tool"]).columns == hit.columns == found.columns


def test_closure_raises_if_it_does_not_settle(spark):
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}") for i in range(6)], "target_id long, src string, dst string")
    seeds = spark.createDataFrame([(1, "n6")], "target_id long, node string")
    assert graph.backward_closure(seeds, edges).count() == 7
    with pytest.raises(RuntimeError):
        graph.backward_closure(seeds, edges, max_rounds=2)


@pytest.mark.parametrize("name", ["function_iterator", "function_facts"])
def test_each_file_is_parsed_once(spark, name):
    p = load_all()[0][name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert p.count("parse_sources(") == 1


def test_documents_are_rows(spark):
    d = load_all()[0]["nested_export"](spark, SF)
    assert d.where("finding_id IS NULL").count() == d.select("target_id").distinct().count()
    assert d.where(F.length("doc") > 200).isEmpty()


def test_executors_find_the_package_from_another_folder(tmp_path):
    code = ("import sys; sys.path.insert(0, sys.argv[1]); import __spark_entry__ as e; from pyspark.sql import SparkSession; "
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', 2).getOrCreate(); "
            f"print('ROWS', e.queries()['function_iterator'](s, '{SF}').count())")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 1058" in out.stdout, out.stderr[-800:]
