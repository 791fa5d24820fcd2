"""Sanity gates: first matching reason per candidate, from set-valued function facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: gate vocabulary ------------------------------------------------------
STRICT_ABI = ("access_control", "proxy_upgrade", "delegatecall", "unprotected_initializer", "reinitializable_proxy_delegatecall",
              "bridge_zero_root_acceptance", "verifier_address_spoof", "bridge_keeper_mutation", "bridge_zero_root")
EXEMPT = ("uninitialized_implementation", "constructor_state_in_proxy_impl")
INIT_NAME = r"(?i)^(initialize|init|__init|setup|configure|reinitialize|reinit)\w*$"
INIT_GUARD = (r"(?i)\binitializer\b|\breinitializer\s*\(|\bonlyUninitialized\b|require\s*\([^)]*!+\s*_?initialized|"
              r"require\s*\([^)]*initialized|require\s*\([^)]*(owner|admin)\s*==\s*address\s*\(\s*0\s*\)")
ONE_TIME_INIT = (r"(?i)factory\s*==\s*address\s*\(\s*0\s*\)|address\s*\(\s*0\s*\)\s*==\s*factory|"
                 r"slot0\s*\.\s*sqrtPriceX96\s*==\s*0|0\s*==\s*slot0\s*\.\s*sqrtPriceX96")
ADMIN_GATE = (r"(?i)\bproxyCallIfNotAdmin\b|\bifAdmin\b|\bifNotAdmin\b|_requireAdmin\s*\(|_checkAdmin\s*\(|_fallback\s*\(")
UPGRADE_NAME = r"^(upgradeTo|upgradeToAndCall|upgrade|upgradeAndCall|changeImplementation|setImplementation)$"
USER_EXIT = r"(?i)^(withdraw|redeem)$"
USER_ENTRY = r"(?i)^(deposit|mint)$"
PRIV_WORD = (r"(?i)owner|admin|govern|guardian|operator|keeper|manager|treasury|collector|withdrawCollected|collectFees|"
             r"sweep|rescue|pause|upgrade|implementation")
VERIFY_HELPER = r"(?i)verify|verifier|proof|validate"
VALUE_OR_STATE = (r"(?i)=\s*[^=]|delete\b|push\s*\(|_mint\s*\(|_burn\s*\(|\.transfer\s*\(|safeTransfer\s*\(|safeTransferFrom\s*\(|"
                  r"transferFrom\s*\(|\.call\s*[({]")
LEAD_WORDS = (r"proof|settlement|numtx|num_tx|rollup|public input|nullifier|merkle|root|withdraw")
EMPTY_CODE = ("0x", "0x0", "0x00", "")
APPROVAL_LIKE = r"(?i)approval|allowance|transferfrom|drain|router"
SOURCE_ROLE = r"(?i)source|src|from|owner|payer|victim"
# -----------------------------------------------------------------------------------------


def candidate_function() -> Column:
    """First named function (before any '('), else the identifier after the title's last colon."""
    names = F.filter(F.concat(F.coalesce("functions", F.array().cast("array<string>")), F.array(F.col("function"))),
                     lambda x: x.isNotNull() & ~F.trim(x).isin("", "?"))
    named = F.get(names, F.lit(0))
    return F.coalesce(F.substring_index(F.trim(named), "(", 1),
                      F.nullif(F.regexp_extract("title", r":\s*([A-Za-z_]\w*)\s*$", 1), F.lit("")), F.lit(""))


def attribution_reason(targets: DataFrame) -> DataFrame:
    """Targets whose findings are all misattributed: proven chain mismatch, or proven empty code.

    targets(target_id, address, chain, chain_mismatch NULL = unknown, code NULL = unknown, rpc_ok).
    Unknown never suppresses.
    """
    reason = F.when(F.col("chain_mismatch") & F.col("rpc_ok"), F.lit("rpc chain mismatch")).when(
        F.col("rpc_ok") & F.lower(F.trim("code")).isin(*EMPTY_CODE), F.lit("no contract code on this chain"))
    return targets.select("target_id", reason.alias("attribution")).where("attribution IS NOT NULL")


def function_facts(fns: DataFrame) -> DataFrame:
    """One row per (target, lower name): the set-valued facts the gates ask about, all partial aggregates."""
    hdr = F.concat_ws("\n", "tail", "body")
    internal = F.col("tail").rlike(r"\b(internal|private)\b")
    priv = F.col("body").rlike(PRIV_WORD)
    pays = F.col("body").rlike(r"(msg\.sender|_msgSender\s*\(|receiver|to)")
    burns = F.col("body").rlike(r"(?i)_burn\s*\([^;]*(msg\.sender|_msgSender\s*\(|owner)|balances?\s*\[\s*(msg\.sender|_msgSender\s*\(|owner)")
    pulls = F.col("body").rlike(r"(?i)(transferFrom|safeTransferFrom)\s*\(")
    mints = F.col("body").rlike(r"(?i)_mint\s*\([^;]*(msg\.sender|_msgSender\s*\(|receiver|to|owner)")
    return fns.groupBy("target_id", F.lower("name").alias("fn_lc")).agg(
        F.bool_and(internal).alias("all_internal"), F.bool_or(F.replace("path", F.lit("\\"), F.lit("/")).startswith("_modules/")).alias("in_module"),
        F.bool_or(hdr.rlike(ADMIN_GATE)).alias("admin_gate"), F.bool_or(hdr.rlike(ONE_TIME_INIT)).alias("one_time"),
        F.bool_or(hdr.rlike(INIT_GUARD)).alias("init_guard"), F.bool_or(~priv & burns & pays).alias("user_exit"),
        F.bool_or(~priv & pulls & mints).alias("user_entry"), F.bool_and(~F.col("body").rlike(VALUE_OR_STATE)).alias("pure_helper"))


def sanity(cand: DataFrame, fns: DataFrame, targets: DataFrame, abi: DataFrame | None = None) -> DataFrame:
    """Attach ``suppressed`` and ``suppressed_reason``; rows already suppressed keep their reason.

    abi(target_id, name) lists exposed function names where an ABI is known. targets carries
    has_source and live_initialized (NULL = unknown) besides the attribution columns.
    """
    c = cand.withColumn("fn", candidate_function()).withColumn("fn_lc", F.lower("fn"))
    c = c.join(function_facts(fns), ["target_id", "fn_lc"], "left").join(attribution_reason(targets), "target_id", "left")
    c = c.join(targets.select("target_id", "has_source", "live_initialized"), "target_id", "left")
    if abi is None:
        c = c.withColumns({"has_abi": F.lit(False), "in_abi": F.lit(False)})
    else:
        have = abi.select("target_id").distinct().withColumn("has_abi", F.lit(True))
        names = abi.select("target_id", F.col("name").alias("fn")).distinct().withColumn("in_abi", F.lit(True))
        c = c.join(have, "target_id", "left").join(names, ["target_id", "fn"], "left")
        c = c.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("has_abi", "in_abi")})
    found = F.col("all_internal").isNotNull()
    blob = F.lower(F.concat_ws(" ", "detector", "title", "description", "bug_class"))
    lead = F.coalesce(F.col("lead_only"), F.lit(False)) | (F.coalesce(F.col("tier"), F.lit("")) == "lead_only")
    keep = lead & (F.col("detector").isin("zk_verifier", "invariant_reasoner") | blob.rlike(LEAD_WORDS))
    init = F.col("fn").rlike(INIT_NAME)
    exempt = F.col("detector").isin(*EXEMPT) | (F.col("fn") == "")
    reason = (F.when(F.col("attribution").isNotNull(), F.col("attribution"))
              .when(exempt, None)
              .when(F.col("has_source") & ~found & ~F.col("in_abi"), "function is absent from the source and ABI")
              .when(found & F.col("all_internal") & ~keep, "function is internal in the verified source")
              .when(F.col("has_abi") & F.col("detector").isin(*STRICT_ABI) & ~F.col("in_abi") & ~F.coalesce("in_module", F.lit(False)),
                    "function is not exposed by the ABI")
              .when(F.col("fn").rlike(UPGRADE_NAME) & F.col("admin_gate"), "function is behind a proxy admin gate")
              .when(init & F.col("live_initialized"), "target is already initialized")
              .when(init & F.col("one_time"), "one-time factory initializer")
              .when(init & F.col("init_guard"), "visible one-shot initializer guard")
              .when((F.col("detector") == "access_control") & ((F.col("fn").rlike(USER_EXIT) & F.col("user_exit"))
                                                              | (F.col("fn").rlike(USER_ENTRY) & F.col("user_entry"))),
                    "normal account-bound user method")
              .when(F.col("detector").isin("access_control", "verifier_address_spoof") & F.col("fn").rlike(VERIFY_HELPER) & F.col("pure_helper"),
                    "pure verifier helper"))
    was = F.coalesce(F.col("suppressed"), F.lit(False))
    new = F.when(~was, reason)
    drop = ["fn", "fn_lc", "all_internal", "in_module", "admin_gate", "one_time", "init_guard", "user_exit", "user_entry", "pure_helper",
            "attribution", "has_source", "live_initialized", "has_abi", "in_abi"]
    marks = F.when(new.isNotNull() & F.col("attribution").isNotNull(), F.array(F.lit("refuted"), F.lit("refuted_concrete"))).when(
        new.isNotNull(), F.array(F.lit("refuted"))).otherwise(F.array().cast("array<string>"))
    return c.withColumns({"suppressed": was | new.isNotNull(), "suppressed_reason": F.coalesce("suppressed_reason", new),
                          "ev_flags": F.array_union("ev_flags", marks)}).drop(*drop)


def binding_refutation(claims: DataFrame) -> DataFrame:
    """Refute claimed attacker-controlled variables from the cited code.

    claims(cand_id, pos, variable, role, code, blob): one row per claimed variable. The first
    refuted variable of a candidate gives the reason.
    """
    v = F.col("variable")
    q = lambda pre, post: F.concat(F.lit("(?i)" + pre), v, F.lit(post))
    c = claims.where(v.rlike(r"^[A-Za-z_]\w*$"))
    const = F.rlike("code", q(r"\b(?:immutable|constant)\b[^;\n]*\b", r"\b")) | F.rlike("code", q(r"\b", r"\b[^;\n]*\b(?:immutable|constant)\b"))
    own = F.rlike("code", q(r"\b", r"\b\s*=\s*address\s*\(\s*this\s*\)"))
    caller = F.rlike("code", q(r"\b", r"\b\s*=\s*(?:_msgSender\s*\(\s*\)|msg\.sender)\b"))
    source = F.col("role").rlike(SOURCE_ROLE) | F.rlike("code", q(r"(safeTransferFrom|transferFrom)\s*\(\s*", r"\s*,"))
    r = F.when(const, F.lit("constant")).when(caller & F.col("blob").rlike(APPROVAL_LIKE) & source, F.lit("caller-bound")).when(own, F.lit("self-bound"))
    return c.withColumn("reason", r).where("reason IS NOT NULL").groupBy("cand_id").agg(
        F.min_by(F.struct("variable", "reason"), "pos").alias("b")).select("cand_id", "b.variable", "b.reason")


def liveness(cand: DataFrame, facts: DataFrame, names: DataFrame) -> DataFrame:
    """Zero checks of owner/factory/asset getters for init-, proxy- or vault-like candidates.

    facts(target_id, method, value, ok); names(target_id, contract_name).
    """
    reads = (facts.where(F.col("method").isin("owner()", "factory()", "asset()") & F.col("value").isNotNull())
             .groupBy("target_id").agg(F.bool_or(F.col("value").rlike("(?i)^(0x)?0+$")).alias("zero_seen"), F.count(F.lit(1)).alias("liveness_reads")))
    blob = F.lower(F.concat_ws(" ", "detector", "title", "description", "contract_name"))
    return cand.join(names, "target_id", "left").join(reads, "target_id", "left").withColumn(
        "never_initialized", F.coalesce(blob.rlike("init|proxy|vault") & F.col("zero_seen"), F.lit(False))).drop("zero_seen", "contract_name")
