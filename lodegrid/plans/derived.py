"""Findings-model relations derived from the driver tables.

Each SELECT is plain SQL that Spark and DuckDB read alike, so a query and its
oracle start from the same relation without sharing an engine. Names of driver
tables stand between blanks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import shared, table

# (order, line) is not unique in the table: parts and suppliers complete the position.
POS = "l_linenumber * CAST(100000000 AS BIGINT) + l_partkey * 1000 + l_suppkey"
DETECTOR_CASE = (
    "CASE l_partkey % 8 WHEN 0 THEN 'reentrancy' WHEN 1 THEN 'access_control' WHEN 2 THEN 'proxy_upgrade' WHEN 3 THEN 'arbitrary_call' "
    "WHEN 4 THEN 'zk_verifier' WHEN 5 THEN 'oracle_manipulation' WHEN 6 THEN 'permit_misuse' ELSE 'token_logic' END")
FLAGS = {
    "poc_passed": "l_partkey % 29 = 0", "governance_controlled": "l_suppkey % 7 = 0", "documented_centralization": "l_suppkey % 11 = 0",
    "refuted": "l_partkey % 9 = 0", "has_access_control": "l_orderkey % 3 = 0", "open_roles": "l_partkey % 31 = 0",
    "unguarded": "l_suppkey % 13 = 0", "value_at_risk": "l_partkey % 3 = 0", "value_to": "l_partkey % 4 = 0",
    "attacker_controls": "l_suppkey % 3 = 0", "never_initialized": "l_partkey % 6 = 0", "unprivileged": "l_suppkey % 2 = 0",
    "informational": "l_partkey % 41 = 0", "economic_leverage": "l_partkey % 12 = 0", "critical_slots": "l_suppkey % 17 = 0",
    "refutation_attempted": "l_partkey % 2 = 0", "refutation_is_real": "l_suppkey % 5 = 0", "refuted_concrete": "l_partkey % 27 = 0",
}
CANDIDATES = (
    "SELECT l_orderkey AS target_id, " + POS + " AS pos, " + DETECTOR_CASE + " AS detector, "
    "concat('fn', CAST(l_suppkey % 4 AS VARCHAR(9))) AS fn, concat('Rule ', CAST(l_partkey % 6 AS VARCHAR(9)), ' hit 0x', l_returnflag, 'abc12 in: fn', CAST(l_suppkey % 4 AS VARCHAR(9))) AS title, "
    "concat('desc ', l_returnflag) AS description, CAST(CAST(l_quantity AS BIGINT) % 11 AS DOUBLE) AS impact, CAST(l_partkey * 3 % 11 AS DOUBLE) AS conf, "
    "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE concat('r', CAST(l_partkey % 5 AS VARCHAR(9))) END AS rule_id, concat('class', CAST(l_suppkey % 3 AS VARCHAR(9))) AS bug_class, "
    "concat('src/', l_returnflag, '/', l_linestatus, '.sol') AS file, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE concat('x = ', l_returnflag, ' onlyOwner') END AS snippet, "
    "CASE l_partkey % 5 WHEN 0 THEN 'confirmable' WHEN 1 THEN 'lead_only' ELSE NULL END AS tier, l_partkey % 10 = 7 AS lead_only, "
    "CASE l_suppkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'no_value' WHEN 2 THEN 'has_value' ELSE NULL END AS value_state, "
    "CASE l_suppkey % 8 WHEN 1 THEN 'inert_unreferenced' ELSE 'unknown' END AS value_signal, CASE l_partkey % 2 WHEN 0 THEN 'none' ELSE 'present' END AS reference_state, "
    "CASE l_partkey % 7 WHEN 0 THEN 'attacker_controlled' ELSE NULL END AS destination_control, l_partkey % 14 = 3 AS tool_agree, "
    "l_partkey % 37 = 5 AS suppressed, "
    + ", ".join(f"{c} AS f_{k}" for k, c in FLAGS.items()) + " FROM lineitem ")
# scans, targets, findings, reviews
SCANS = ("SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' ELSE 'completed' END AS status, "
         "c_mktsegment AS chain, CASE c_custkey % 3 WHEN 0 THEN 'deep' WHEN 1 THEN 'ultra-deep' ELSE 'ultra-deep-v2' END AS scan_profile, "
         "c_nationkey AS total_targets, CAST(c_custkey % 4 AS INT) AS critical_count, CAST(c_custkey % 6 AS INT) AS needs_investigation_count, "
         "CAST(c_custkey % 9 AS INT) AS low_info_count FROM customer ")
TARGETS = ("SELECT o_orderkey AS id, o_custkey AS scan_id, concat('0xA', CAST(o_orderkey AS VARCHAR(20))) AS address, o_orderpriority AS chain, o_orderpriority AS label, "
           "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'failed' END AS status, "
           "concat('Contract', CAST(o_orderkey % 50 AS VARCHAR(20))) AS contract_name FROM orders ")
CLASS_CASE = ("CASE WHEN l_quantity >= 46 THEN 'CONFIRMED_CRITICAL' WHEN l_quantity >= 40 THEN 'LIKELY_CRITICAL_NEEDS_POC' WHEN l_quantity >= 25 THEN 'NEEDS_MORE_INVESTIGATION' "
              "WHEN l_quantity >= 8 THEN 'LOW_OR_INFO' ELSE 'FALSE_POSITIVE' END")
FINDINGS = ("SELECT l_orderkey * CAST(1000000000 AS BIGINT) + " + POS + " AS id, l_orderkey AS target_id, " + DETECTOR_CASE + " AS detector, concat('T', CAST(l_partkey % 9 AS VARCHAR(9))) AS title, "
            "l_quantity / 5 AS impact_score, l_discount * 100 AS confidence_score, " + CLASS_CASE + " AS classification, l_linestatus AS status, "
            "CASE WHEN l_suppkey % 4 = 0 THEN l_partkey ELSE NULL END AS ai_review_id, CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE concat('test ', l_returnflag) END AS next_test FROM lineitem ")
REVIEWS = "SELECT p_partkey AS id, p_name AS rationale FROM part WHERE p_size > 10 "


def rel(spark: SparkSession, sf: str, sql: str, heavy: bool = False) -> DataFrame:
    for t in ("lineitem", "orders", "customer", "part", "supplier", "documents", "events", "pages", "benchmark", "labels", "conversations", "nation"):
        if f" FROM {t} " in sql:
            return shared(spark, sf, sql.replace("VARCHAR(9)", "STRING").replace("VARCHAR(20)", "STRING"), t, heavy=heavy)
    raise ValueError("no driver table in the statement")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    d = rel(spark, sf, CANDIDATES, heavy=True)  # long expression ladders per row
    flags = F.array_compact(F.array(*[F.when(F.col(f"f_{k}"), k) for k in FLAGS]))
    return d.withColumns({"ev_flags": flags, "functions": F.array("fn"), "function": F.lit(None).cast("string"), "pattern_class": F.lit(None).cast("string"),
                          "corroborated": F.lit(False), "corroborated_by": F.lit(None).cast("array<string>"),
                          "suppressed_reason": F.lit(None).cast("string")}).drop(*[f"f_{k}" for k in FLAGS])


def findings(spark: SparkSession, sf: str) -> DataFrame:
    return rel(spark, sf, FINDINGS, heavy=True).withColumn("next_tests", F.when(F.col("next_test").isNotNull(), F.array("next_test")))
