"""Registered queries: every catalog rule, one query per detector, and the whole catalog per profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..rules.catalog import all_rules, catalog_frame, rules_for
from ..rules.engine import evaluate, oracle_sql
from .corpus import contract_files, contract_files_sql
from .registry import ORACLES, QUERIES, query

OUT = ["target_id", "file", "detector", "variant", "function", "impact", "conf"]
PROFILE = "ultra-deep-v2"


def _one(detector: str):
    def run(spark, sf):
        return evaluate(contract_files(spark, sf), rules_for(PROFILE, only=detector)).select(*OUT)
    return run


def _register() -> None:
    files = contract_files_sql()
    for d in dict.fromkeys(r.detector for r in all_rules()):
        name = f"rule_{d}"
        QUERIES[name] = _one(d)
        rules = rules_for(PROFILE, only=d)
        sql = oracle_sql(files, rules)
        if sql:
            ORACLES[name] = sql
            continue
        # Look-around patterns have no RE2 form: the remaining rules of the detector are still checked.
        some = [r for r in rules if oracle_sql("SELECT 1", [r])]
        if some:
            QUERIES[f"{name}_checked"] = lambda spark, sf, some=some: evaluate(contract_files(spark, sf), some).select(*OUT)
            ORACLES[f"{name}_checked"] = oracle_sql(files, some)


_register()


@query("rule_catalog_deep", oracle_sql(contract_files_sql(), [r for r in rules_for("deep") if oracle_sql("SELECT 1", [r])]))
def rule_catalog_deep(spark, sf):
    return evaluate(contract_files(spark, sf), [r for r in rules_for("deep") if oracle_sql("SELECT 1", [r])]).select(*OUT)


@query("detector_profiles")
def detector_profiles(spark, sf):
    """Profile projection joined to the hits of the profile's detectors."""
    hits = evaluate(contract_files(spark, sf), rules_for("deep")).groupBy("detector").agg(F.count(F.lit(1)).alias("hits"))
    return F.broadcast(catalog_frame(spark)).join(hits, "detector", "left").select("detector", "profile", "tier", F.coalesce("hits", F.lit(0)).alias("hits"))
