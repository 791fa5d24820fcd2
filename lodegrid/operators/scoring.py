"""Corroboration, ordered scoring ladder, priority and verdict guardrails.

Candidate rows carry evidence booleans as ``ev_flags array<string>``; the ladder
is one chain of Column expressions, so Catalyst keeps it in a single projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CONFIRMED, FALSE_POSITIVE, LIKELY, LOW, NEEDS, clamp, classify, confidence_label, severity

# Words of a tool finding that agree with a detector.
TOOL_KEYWORDS = {
    "proxy_upgrade": ("upgrade", "unprotected-upgrade", "initialize", "uninitialized"),
    "arbitrary_call": ("delegatecall", "controlled-delegatecall", "arbitrary-send", "arbitrary", "low level call", "unchecked"),
    "permit_misuse": ("permit", "signature", "ecrecover"),
    "timelock_roles": ("role", "access", "authorization", "owner"),
    "governance_blast_radius": ("upgrade", "owner", "access", "authorization", "suicidal", "selfdestruct"),
    "bytecode_periphery": ("bytecode", "delegatecall", "callcode", "selfdestruct", "tx.origin", "approval", "upgrade", "executor"),
    "actual_received_accounting": ("transferfrom", "balance", "fee on transfer", "received"),
    "merkle_claim_binding": ("merkle", "proof", "claim"),
    "bridge_replay_key": ("bridge", "processed", "replay", "message"),
    "oracle_freshness_sequencer": ("oracle", "chainlink", "latestrounddata", "stale"),
    "forced_eth_accounting": ("address(this).balance", "balance", "selfdestruct"),
    "multicall_state_cache": ("delegatecall", "msg.value", "multicall"),
    "duplicate_batch_item": ("batch", "duplicate", "loop"),
}
# Detectors of concrete code shapes, kept visible under the ultra profiles.
STRUCTURAL = (
    "hook_pair_burn_sync", "reentrancy", "solvency_check", "access_control", "flashloan_governance", "deposit_callback_cei",
    "receiver_hook_credit", "ecrecover_zero", "eip1271_spoof", "arbitrary_from_transferfrom", "cross_chain_receiver_source_auth",
    "vault_share_donation_inflation", "erc2771_msgsender_spoof", "reinitializable_proxy_delegatecall",
    "payable_multicall_msgvalue_reuse", "signed_unsigned_cast_mismatch", "liquidation_collateral_not_cleared",
    "allowance_drain_router", "zero_value_transferfrom_bypass", "zero_transfer_reward_checkpoint", "erc777_hook_balance_bypass",
    "bridge_keeper_mutation", "bridge_zero_root_acceptance", "verifier_address_spoof", "vyper_nonreentrant_compiler",
    "thin_liquidity_spot_oracle", "lending_exchange_rate_donation", "clmm_tick_boundary_rounding", "invariant_precision_loss",
    "unsafe_mint_math", "flash_cycle_rounding_withdraw", "multisig_delegatecall_payload", "bytecode_periphery",
    "actual_received_accounting", "merkle_claim_binding", "bitmap_claim_collision", "bridge_replay_key", "address_alias_bridge",
    "oracle_freshness_sequencer", "twap_observation_cardinality", "forced_eth_accounting", "create2_metamorphic_trust",
    "trycatch_finalization", "reward_debt_order", "accumulator_zero_supply", "position_merge_split", "governance_snapshot_bypass",
    "pausability_bypass", "multicall_state_cache", "wad_ray_unit_mismatch", "duplicate_batch_item", "weird_hunt_taint_value_flow",
)
SEVERITY_BONUS = {"critical": 18.0, "high": 12.0, "medium": 6.0, "low": 1.0}


def flag(*names: str) -> Column:
    """Any of the named evidence booleans is set."""
    out = F.array_contains("ev_flags", names[0])
    for n in names[1:]:
        out = out | F.array_contains("ev_flags", n)
    return F.coalesce(out, F.lit(False))


def corroborate(cand: DataFrame, scope: list[str]) -> DataFrame:
    """Mark rows whose function at least two distinct detectors flag.

    Distinct (function, detector) pairs are formed first, so the shuffle carries one row per pair
    however many candidates a hot function has, and the per-function detector set is bounded by
    the size of the catalog. With several functions the last qualifying one counts.
    """
    live = cand.where(~F.coalesce(F.col("suppressed"), F.lit(False)))
    ex = live.select(*scope, "pos", "detector", F.posexplode("functions").alias("fn_pos", "fn")).where("fn IS NOT NULL AND fn <> ''")
    ex = ex.withColumn("fn_key", F.lower(F.trim("fn")))
    pairs = ex.groupBy(*scope, "fn_key", "detector").agg(F.min(F.struct("pos", "fn_pos")).alias("seen"))
    keys = pairs.groupBy(*scope, "fn_key").agg(F.collect_set("detector").alias("dets"), F.min("seen").alias("seen")).where(F.size("dets") >= 2)
    marked = (ex.join(keys, [*scope, "fn_key"]).withColumn("others", F.array_sort(F.array_except("dets", F.array("detector"))))
              .where(F.size("others") > 0).groupBy(*scope, "pos", "detector").agg(F.max_by("others", "seen").alias("corroborated_by")))
    return cand.join(marked, [*scope, "pos", "detector"], "left").withColumn(
        "corroborated", F.col("corroborated_by").isNotNull())


def tool_agreement(cand: DataFrame, tool_findings: DataFrame, scope: list[str]) -> DataFrame:
    """A tool finding of the same target mentions one of the detector's words (semi-join on word)."""
    spark = cand.sparkSession
    words = spark.createDataFrame([(d, w) for d, ws in TOOL_KEYWORDS.items() for w in ws], "detector string, word string")
    blob = F.lower(F.concat_ws(" ", F.coalesce("check", F.lit("")), F.coalesce("description", F.lit(""))))
    vocab = sorted({w for ws in TOOL_KEYWORDS.values() for w in ws})
    seen = tool_findings.select(*scope, F.explode(F.filter(F.array(*[F.lit(w) for w in vocab]), lambda w: F.contains(blob, w))).alias("word")).distinct()
    agree = seen.join(F.broadcast(words), "word").select(*scope, "detector").distinct().withColumn("tool_agree", F.lit(True))
    return cand.join(agree, [*scope, "detector"], "left").withColumn("tool_agree", F.coalesce("tool_agree", F.lit(False)))


def value_path() -> Column:
    """Value moves, to a controlled destination, under the attacker's control - or a proof passed."""
    moves = flag("value_at_risk", "value_moves", "asset") | (F.coalesce(F.col("value_state"), F.lit("")) == "has_value")
    dest = flag("attacker_controlled_destination", "value_to") | (F.lower(F.coalesce(F.col("destination_control"), F.lit(""))) == "attacker_controlled")
    ctl = flag("attacker_control_binding", "attacker_controls", "user_controlled_target_or_data", "open_roles", "unguarded")
    return flag("poc_passed") | (moves & dest & ctl)


def score(cand: DataFrame, profile: str = "deep", *, value_gate: bool = True, soft_refutation: bool = False) -> DataFrame:
    """The ordered ladder: caps and bumps apply in sequence, so the order of the steps is part of the result."""
    ultra = profile in ("ultra-deep", "ultra-deep-v2")
    state, signal = F.coalesce(F.col("value_state"), F.lit("")), F.coalesce(F.col("value_signal"), F.lit(""))
    ref_none = F.coalesce(F.col("reference_state"), F.lit("")) == "none"
    suppressed = F.coalesce(F.col("suppressed"), F.lit(False))
    notes: list[Column] = []

    def note(cond: Column, text: str) -> None:
        notes.append(F.when(cond, text))

    df = cand.withColumns({"s_impact": clamp(F.col("impact")), "s_conf": F.col("conf").cast("double")})
    if value_gate:
        inert = (state == "no_value") & (signal == "inert_unreferenced")
        dead = ~inert & flag("never_initialized") & (state == "no_value") & ref_none
        note(state == "unknown", "value context unknown")
        note(inert, "capped: inert and unreferenced")
        note(dead, "capped: never initialized, no value")
        df = df.withColumns({
            "s_impact": F.when(inert, F.least("s_impact", F.lit(4.0))).when(dead, F.least("s_impact", F.lit(5.0))).otherwise(F.col("s_impact")),
            "s_conf": F.when(inert, F.least("s_conf", F.lit(2.0))).when(dead, F.least("s_conf", F.lit(3.0))).otherwise(F.col("s_conf"))})
    bumps = [
        (F.col("tool_agree"), 2.0, "+2 tool agreement"), (flag("governance_controlled"), -3.0, "-3 governance only"),
        (flag("documented_centralization"), -3.0, "-3 documented trust"),
        (flag("open_roles", "zero_address_has_role", "dead_address_has_role"), 1.0, "+1 open role read"),
        (flag("poc_passed"), 2.0, "+2 fork proof"), (F.col("corroborated"), 2.0, "+2 corroborated"),
        (flag("critical_slots", "module_context"), 0.5, "+0.5 storage context"), (flag("graph_components"), 0.5, "+0.5 graph scenario"),
    ]
    conf = F.col("s_conf")
    for cond, delta, text in bumps:
        conf = conf + F.when(cond, delta).otherwise(0.0)
        note(cond, text)
    structural = F.col("detector").isin(*STRUCTURAL) | (F.coalesce(F.col("tier"), F.lit("")) == "confirmable")
    refuted = flag("refuted")
    floor = refuted & structural & ~suppressed if ultra else F.lit(False)
    survived = ~refuted & flag("refutation_attempted") & flag("refutation_is_real") & ~flag("poc_passed")
    note(floor, "refuted structural lead kept for investigation")
    note(refuted & ~floor, "capped: refuted")
    note(survived, "+1 survived refutation")
    df = df.withColumn("s_conf", conf)
    df = df.withColumn("s_conf", F.when(floor, 4.0).when(refuted, F.least("s_conf", F.lit(2.0))).when(survived, F.col("s_conf") + 1)
                       .otherwise(F.col("s_conf")))
    path = ~flag("has_access_control") | flag("open_roles", "unguarded", "poc_passed")
    cautious = ~path & (F.col("s_impact") >= 7) & ~flag("poc_passed")
    note(cautious, "capped: no unauthorized path")
    note(suppressed, "suppressed: marked false-positive")
    lead = F.coalesce(F.col("lead_only"), F.lit(False)) | (F.coalesce(F.col("tier"), F.lit("")) == "lead_only")
    lead_floor = lead & ~suppressed & ~refuted & (F.col("s_impact") >= 7)
    note(lead_floor, "lead floor")
    df = df.withColumn("s_conf", F.when(cautious, F.least("s_conf", F.lit(4.0))).otherwise(F.col("s_conf")))
    df = df.withColumn("s_conf", clamp(F.when(suppressed, 0.0).when(lead_floor, F.greatest("s_conf", F.lit(3.0))).otherwise(F.col("s_conf"))))
    df = df.withColumn("s_class", F.when(suppressed, FALSE_POSITIVE).otherwise(classify(F.col("s_impact"), F.col("s_conf"))))
    crit = F.col("s_class").isin(CONFIRMED, LIKELY)
    if value_gate:
        gate = ~suppressed & crit & (state == "no_value") & ~value_path()
        note(gate, "capped: no concrete value path")
        df = df.withColumn("gated", gate)
        df = df.withColumns({"s_class": F.when(F.col("gated"), NEEDS).otherwise(F.col("s_class")),
                             "s_conf": F.when(F.col("gated"), F.least("s_conf", F.lit(6.0))).otherwise(F.col("s_conf"))}).drop("gated")
    if soft_refutation:
        rare = flag("rare_lead", "economic_leverage", "cross_function", "needs_stateful_poc", "value_sink")
        soft = rare & ~suppressed & (F.col("s_impact") >= 7) & ~flag("refuted_concrete")
        note(soft, "soft-refutation floor")
        df = df.withColumns({"s_conf": F.when(soft, F.greatest("s_conf", F.lit(3.5))).otherwise(F.col("s_conf")),
                             "s_class": F.when(soft & F.col("s_class").isin(LOW, FALSE_POSITIVE), NEEDS).otherwise(F.col("s_class"))})
    open_lead = lead & ~suppressed & ~refuted
    up = open_lead & (F.col("s_impact") >= 7) & F.col("s_class").isin(LOW, FALSE_POSITIVE)
    down = open_lead & ~flag("poc_passed") & F.col("s_class").isin(CONFIRMED, LIKELY)
    df = df.withColumn("s_class", F.when(up | down, NEEDS).otherwise(F.col("s_class")))
    return df.withColumns({
        "impact_score": F.col("s_impact"), "confidence_score": F.col("s_conf"), "severity": severity(F.col("s_impact")),
        "confidence_before_ai": confidence_label(F.col("s_conf")), "classification": F.col("s_class"),
        "score_notes": F.array_compact(F.array(*notes))}).drop("s_impact", "s_conf", "s_class")


def priority() -> Column:
    """Weighted review priority of a candidate row."""
    sev = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in SEVERITY_BONUS.items() for x in (F.lit(k), F.lit(v))]),
                                      F.lower(F.coalesce(F.col("severity"), F.lit("")))), F.lit(0.0))
    n_by = F.coalesce(F.size(F.coalesce(F.col("corroborated_by"), F.array().cast("array<string>"))), F.lit(0))
    w = lambda c, x: F.when(c, x).otherwise(0.0)
    return (F.col("impact") * 10 + F.col("conf") * 4 + sev + F.when(F.col("corroborated"), 12.0 + F.least(F.lit(6), n_by)).otherwise(0.0)
            + w(flag("unprivileged", "attacker_controlled", "user_controlled_target_or_data"), 8.0)
            + w(flag("value_movement", "attacker_destination_control"), 6.0) + w(flag("economic_leverage", "exploit_class"), 4.0)
            + F.least(F.lit(6.0), F.size("next_tests") * 1.5) + F.least(F.lit(4), F.size("functions"))
            - w(F.coalesce(F.col("suppressed"), F.lit(False)) | flag("refuted"), 40.0) - w(flag("informational"), 20.0))


def high_signal() -> Column:
    """A row the review verdict may not bury."""
    protected = (F.coalesce(F.col("lead_only"), F.lit(False)) | F.coalesce(F.col("tier"), F.lit("")).isin("lead_only", "confirmable")
                 | F.coalesce(F.col("corroborated"), F.lit(False)))
    strong = (F.col("impact_score") >= 8) & (F.col("confidence_score") >= 4) & F.col("classification").isin(NEEDS, LIKELY, CONFIRMED)
    return protected | strong


def unauthorized_path() -> Column:
    return (flag("poc_passed", "open_roles", "zero_address_has_role", "dead_address_has_role", "unguarded")
            | (flag("user_controlled_target_or_data") & flag("no_access_control")))


def critical_path_complete() -> Column:
    """Verdict columns name the value, its receiver, an attacker-controlled destination and a bound variable."""
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return ((filled("value_moves") & filled("value_to") & (F.lower(F.trim(F.coalesce("destination_control", F.lit("")))) == "attacker_controlled")
             & filled("binding_variable")) | (flag("poc_passed") & unauthorized_path()))


def guardrails(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Floor and ceiling around an external review verdict; an error-free verdict replaces the class."""
    v = F.upper(F.replace(F.trim(F.coalesce(F.col(verdict), F.lit(""))), F.lit(" "), F.lit("_")))
    v = F.when(v.isin(CONFIRMED, LIKELY, NEEDS, LOW, FALSE_POSITIVE), v).otherwise(NEEDS)
    defused = F.coalesce(F.col("suppressed"), F.lit(False)) | flag("refuted_concrete", "concrete_mitigation", "concrete_defusing_control")
    over = (v == CONFIRMED) & ~unauthorized_path()
    buried = v.isin(FALSE_POSITIVE, LOW) & high_signal() & ~defused & ~F.coalesce(F.col("binding_refuted"), F.lit(False))
    final = F.when(over, LIKELY).when(buried, NEEDS).otherwise(v)
    has = F.col(verdict).isNotNull() & F.col("verdict_error").isNull()
    return df.withColumns({"enforced_downgrade": has & (over | buried),
                           "final_class": F.when(has, final).otherwise(F.col("classification"))})


def poc_eligible(detectors: list[str]) -> Column:
    return (F.col("detector").isin(*detectors) & ~flag("governance_controlled", "has_access_control")
            & (F.col("impact_score") >= 7) & (F.col("confidence_score") >= 4))


def invariant_eligible() -> Column:
    """Rows worth an invariant: not informational, not refuted, and a strong signal."""
    return ~flag("informational", "refuted") & ((F.col("impact") >= 7) | F.col("severity").isin("critical", "high")
                                               | (F.coalesce(F.col("tier"), F.lit("")) == "confirmable")
                                               | flag("poc_passed", "manipulation_confirmed"))
