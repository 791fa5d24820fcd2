"""Bytecode facts: opcode rows, histograms, selectors, clusters, risk signals and probe plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.evm import CLUSTERS, PROXY_SLOTS, SIGNATURES, decode_opcodes, keccak256, minimal_proxy_target, normalize_bytecode, strip_metadata
from .dedup import keep_first, top_per_key

# ---- Fixed values: risk scores and probe focus -------------------------------------------
IMPACT = {"closed_source_delegatecall_executor": 9.0, "legacy_callcode_runtime": 9.0, "tx_origin_mutable_flow": 8.0,
          "closed_source_approval_spender": 8.5, "unverified_upgrade_surface": 8.0, "selfdestruct_runtime_surface": 7.5,
          "minimal_proxy_unverified_impl": 5.5}
VERIFIED_SAFE = ("closed_source_delegatecall_executor", "legacy_callcode_runtime", "tx_origin_mutable_flow")
FOCUS = {
    "closed_source_delegatecall_executor": ("executor", ("arbitrary_execution",), False),
    "legacy_callcode_runtime": ("legacy-callcode", ("arbitrary_execution",), False),
    "tx_origin_mutable_flow": ("tx-origin", ("upgrade_admin", "approval_spender", "arbitrary_execution"), False),
    "closed_source_approval_spender": ("approval-drain", ("approval_spender", "arbitrary_execution"), False),
    "unverified_upgrade_surface": ("upgrade-auth", ("upgrade_admin",), True),
    "selfdestruct_runtime_surface": ("selfdestruct", ("upgrade_admin", "arbitrary_execution"), False),
    "minimal_proxy_unverified_impl": ("clone-implementation", ("upgrade_admin", "arbitrary_execution", "approval_spender"), False),
}
UNKNOWN_DISPATCH = ("legacy_callcode_runtime", "selfdestruct_runtime_surface")
# -------------------------------------------------------------------------------------------


def normalized(contracts: DataFrame) -> DataFrame:
    """contracts(target_id, code, source_verified) -> clean hex, metadata stripped, minimal-proxy target."""
    d = contracts.withColumn("code_hex", normalize_bytecode(F.col("code"))).withColumn("stripped", strip_metadata(F.col("code_hex")))
    return d.withColumns({"code_bytes": F.length("code_hex") / 2, "stripped_bytes": F.length("stripped") / 2,
                          "proxy_target": minimal_proxy_target(F.col("stripped"))})


def opcodes(contracts: DataFrame) -> DataFrame:
    """One row per instruction: (target_id, pc, opcode, name, push_data)."""
    return normalized(contracts).select("target_id", F.explode(decode_opcodes("stripped")).alias("o")).select("target_id", "o.*")


#: Instructions that signals, selectors and constants look at.
NEEDED = "name IN ('DELEGATECALL', 'CALL', 'CALLCODE', 'ORIGIN', 'SSTORE', 'SELFDESTRUCT', 'PUSH4', 'PUSH32')"


def opcode_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("target_id", "name").agg(F.count(F.lit(1)).alias("n"))


def known_signatures(spark) -> DataFrame:
    """Selector dictionary with clusters: a fixed list of a few dozen rows."""
    rows = [(keccak256(s.encode())[:8], s, [c for c, ps in CLUSTERS.items() if any(s.startswith(p) for p in ps)]) for s in SIGNATURES]
    return spark.createDataFrame(rows, "selector string, signature string, clusters array<string>")


def selectors(ops: DataFrame) -> DataFrame:
    """First position of every 4-byte push, left-joined to the known signatures."""
    s = ops.where("name = 'PUSH4' AND length(push_data) = 8").select("target_id", F.col("push_data").alias("selector"), "pc")
    s = s.groupBy("target_id", "selector").agg(F.min("pc").alias("pc"))
    return s.join(F.broadcast(known_signatures(ops.sparkSession)), "selector", "left")


def clusters(sel: DataFrame) -> DataFrame:
    """Distinct (target, cluster, signature)."""
    return sel.where("signature IS NOT NULL").select("target_id", F.explode("clusters").alias("cluster"), "signature").distinct()


def constants(contracts: DataFrame, ops: DataFrame) -> DataFrame:
    """Standard proxy slots present in the code, number of 32-byte pushes and the first 24 of them."""
    code = normalized(contracts)
    slots = F.array_compact(F.array(*[F.when(F.contains("stripped", F.lit(v)), k) for k, v in PROXY_SLOTS.items()]))
    p32 = ops.where("name = 'PUSH32' AND length(push_data) = 64")
    first = top_per_key(p32, ["target_id"], 24, F.col("pc")).groupBy("target_id").agg(F.array_sort(F.collect_list(F.struct("pc", "push_data"))).alias("s"))
    n = p32.groupBy("target_id").agg(F.count(F.lit(1)).alias("push32_count"))
    return code.select("target_id", slots.alias("proxy_slots")).join(n, "target_id", "left").join(first, "target_id", "left").select(
        "target_id", "proxy_slots", F.coalesce("push32_count", F.lit(0)).alias("push32_count"),
        F.transform(F.coalesce("s", F.array().cast("array<struct<pc:int,push_data:string>>")), lambda x: F.concat(F.lit("0x"), x["push_data"])).alias("push32_sample"))


def risk_signals(contracts: DataFrame, ops: DataFrame) -> DataFrame:
    """(target_id, rule_id, confidence): seven boolean rules over one aggregate row per target."""
    c = lambda n: F.count_if(F.col("name") == n).alias(n)
    agg = ops.groupBy("target_id").agg(*[c(n) for n in ("DELEGATECALL", "CALL", "CALLCODE", "ORIGIN", "SSTORE", "SELFDESTRUCT")])
    cl = clusters(selectors(ops)).groupBy("target_id").agg(F.collect_set("cluster").alias("cl"))
    base = normalized(contracts).withColumn("slot", F.coalesce(*[F.when(F.contains("stripped", F.lit(v)), F.lit(True)) for v in PROXY_SLOTS.values()], F.lit(False)))
    d = base.select("target_id", "source_verified", "proxy_target", "slot").join(agg, "target_id").join(cl, "target_id", "left")
    has = lambda x: F.coalesce(F.array_contains("cl", x), F.lit(False))
    un = ~F.col("source_verified")
    sig = lambda rid, cond, conf: F.when(cond, F.struct(F.lit(rid).alias("rule_id"), conf.cast("double").alias("confidence")))
    rules = F.array_compact(F.array(
        sig("closed_source_delegatecall_executor", (F.col("DELEGATECALL") > 0) & has("arbitrary_execution"), F.when(un, 6.0).otherwise(4.0)),
        sig("legacy_callcode_runtime", F.col("CALLCODE") > 0, F.lit(5.5)),
        sig("tx_origin_mutable_flow", (F.col("ORIGIN") > 0) & ((F.col("SSTORE") > 0) | (F.col("CALL") > 0)), F.lit(5.5)),
        sig("closed_source_approval_spender", has("approval_spender") & (F.col("CALL") > 0), F.when(un, 5.0).otherwise(3.5)),
        sig("unverified_upgrade_surface", has("upgrade_admin") & (F.col("slot") | (F.col("DELEGATECALL") > 0)), F.when(un, 4.5).otherwise(3.0)),
        sig("selfdestruct_runtime_surface", F.col("SELFDESTRUCT") > 0, F.lit(4.5)),
        sig("minimal_proxy_unverified_impl", F.col("proxy_target").isNotNull() & un, F.lit(4.0))))
    return d.select("target_id", "source_verified", F.explode(rules).alias("r")).select("target_id", "source_verified", "r.*")


def periphery(signals: DataFrame, resolved: DataFrame) -> DataFrame:
    """Signals promoted to candidates; resolved(target_id) lists targets with a known implementation."""
    imp = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in IMPACT.items() for x in (F.lit(k), F.lit(v))]), "rule_id"), F.lit(7.0))
    known = resolved.select("target_id").distinct().withColumn("known_impl", F.lit(True))
    d = signals.join(known, "target_id", "left")
    keep = (~F.col("source_verified") | F.col("rule_id").isin(*VERIFIED_SAFE)) & ~(
        (F.col("rule_id") == "minimal_proxy_unverified_impl") & F.coalesce("known_impl", F.lit(False)))
    return d.where(keep).select("target_id", F.lit("bytecode_periphery").alias("detector"), "rule_id", imp.alias("impact"),
                                F.col("confidence").alias("conf"))


def probe_plan(signals: DataFrame, sel: DataFrame, per_rule: int = 8) -> DataFrame:
    """Up to ``per_rule`` distinct signatures per (target, rule); the cap is the probe budget."""
    spark = signals.sparkSession
    focus = spark.createDataFrame([(r, k, c, m) for r, (k, cs, m) in FOCUS.items() for c in cs], "rule_id string, kind string, cluster string, must_fail boolean")
    kinds = spark.createDataFrame([(r, k, m) for r, (k, _, m) in FOCUS.items()], "rule_id string, kind string, must_fail boolean")
    cl = clusters(sel)
    focused = signals.select("target_id", "rule_id").join(F.broadcast(focus), "rule_id").join(cl, ["target_id", "cluster"]).select("target_id", "rule_id", "signature").distinct()
    has = focused.select("target_id", "rule_id").distinct()
    rest = signals.select("target_id", "rule_id").join(has, ["target_id", "rule_id"], "left_anti")
    any_sig = rest.join(sel.where("signature IS NOT NULL").select("target_id", "signature").distinct(), "target_id")
    none = rest.join(any_sig.select("target_id", "rule_id").distinct(), ["target_id", "rule_id"], "left_anti").where(
        F.col("rule_id").isin(*UNKNOWN_DISPATCH)).withColumn("signature", F.lit("<unknown-dispatch>"))
    allp = focused.unionByName(any_sig).unionByName(none)
    return top_per_key(allp, ["target_id", "rule_id"], per_rule, F.col("signature")).join(F.broadcast(kinds), "rule_id")
