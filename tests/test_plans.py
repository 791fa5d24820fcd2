"""Plan shape and determinism: pushed filters, pruned columns, no nested-loop joins, stable under repartitioning."""

import pytest

from lodegrid.plans import load_all

SF = "/root/testdata/sf0.001"
JOINING = ["scan_counts", "target_summary", "suppress_null_global", "corroborate", "tool_agreement", "call_edges", "deployer_creations", "companion_select", "xref_join",
           "benchmark_report", "corpus_match", "rule_reentrancy"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JOINING)
def test_no_nested_loops(spark, name):
    p = plan(load_all()[0][name](spark, SF))
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_pushdown_and_pruning(spark):
    from lodegrid.plans.registry import table

    p = plan(table(spark, SF, "lineitem").where("l_returnflag = 'R'").select("l_orderkey"))
    assert "EqualTo(l_returnflag,R)" in p and "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in p


@pytest.mark.parametrize("name", ["collapse_dups", "corroborate", "budget_per_target", "slot_numbering"])
def test_same_result_for_any_partitioning(spark, name):
    out = []
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(str, load_all()[0][name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert out[0] == out[1]


def test_sanity_gates_take_the_whole_catalog(spark, monkeypatch):
    from lodegrid.plans import pipeline
    from lodegrid.rules.catalog import PROFILES, detectors

    seen = []

    def triage(files, profile, known):
        seen.append(profile)
        return spark.createDataFrame([("d", False, None)], "detector string, suppressed boolean, suppressed_reason string")

    monkeypatch.setattr(pipeline, "triage", triage)
    load_all()[0]["sanity_gates"](spark, SF)
    assert set(detectors(seen[0])) == {d for p in PROFILES for d in detectors(p)}


def test_a_pass_is_not_planned_again_in_the_next(spark):
    from pyspark.sql import functions as F

    from lodegrid.plans.pipeline import in_turn

    d = in_turn(spark.range(5), lambda x: x.withColumn("first_pass", F.md5(F.col("id").cast("string"))), lambda x: x.join(x.withColumnRenamed("first_pass", "again"), "id"))
    assert "md5" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert d.where("first_pass = again").count() == 5


def test_a_large_input_is_not_dealt(spark, monkeypatch):
    from lodegrid.plans import registry

    d = spark.read.parquet(f"{SF}/lineitem.parquet")
    assert "Repartition" in registry.spread(d)._jdf.queryExecution().analyzed().toString()
    size = registry._size(d)
    assert 50_000 < size < 5_000_000
    monkeypatch.setattr(registry, "_size", lambda df: size * 10_000)
    assert "Repartition" not in registry.spread(d)._jdf.queryExecution().analyzed().toString()
    assert "Repartition" in registry.spread(d, always=True)._jdf.queryExecution().analyzed().toString()
