"""Rules over call edges, flows, role graphs, chain facts, tool rows and bytecode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import check_slug
from ..operators.dedup import keep_first, top_per_key
from ..operators.facts import last_definitions, loose_edges
from ..operators.graph import backward_closure
from ..session import cut
from . import core
from .dsl import lowered
from .model import INLINE_AUTH, LOCK_HEAD, nonreentrant
from .prefilter import with_matches

# ---- Fixed values: patterns and score tables of these rules ----------------------------------
HEALTH_NAME = (r"(?i)(check.*liquidity|account.*liquidity|liquidity.*check|health.?factor|health.?check|check.?health|solvenc|"
               r"collateral.?check|check.?collateral|require.*healthy|require.*collateral)")
HEALTH_CALL = (r"(?i)\b[A-Za-z_]\w*(?:[Ll]iquidity|Health|Solvency|Collateral)\w*\s*\(|\b(?:borrow|redeem|mint|seize|transfer|repay)Allowed\s*\(")
SOLVENCY_WRITE = (r"(?i)\b(?:reserves?|totalReserves|reserveBalance\w*|collateral\w*|debt\w*|borrows?|totalBorrows?|deposits?|shares?|principal|"
                  r"accountBorrows?|accountTokens?|balances?)\b\s*(?:\[[^\]]*\])?(?:\s*\.\w+)*\s*(?:[+\-*/]?=)(?:[^=]|$)")
PAUSED = r"(?i)whenNotPaused|notPaused|paused\s*\(\s*\)"
PAUSE_WORD = r"(?i)whenNotPaused|notPaused|paused"
ALTERNATE = r"(?i)multicall|callback|claim|emergency|execute|permitAndCall|batch"
RARE_SINK = (r"(?i)\.\s*(?:transfer|safeTransfer|transferFrom|safeTransferFrom)\s*\(|\.call\s*\{|_mint\s*\(|mint\s*\(|_burn\s*\(")
DELEGATE_TARGET = r"([A-Za-z_][\w.\[\]]*)\s*\.\s*delegatecall\s*[({]"
ASM_DELEGATE = r"\bdelegatecall\s*\(\s*[^,]+,\s*([A-Za-z_]\w*)\s*,"
SEMANTIC_GUARD = (r"(?i)only[A-Z_]|owner|admin|govern|guardian|keeper|manager|operator|hasRole|checkRole|auth|authoriz|controller|allowed|"
                  r"permission|role")
DANGEROUS = ("upgrade", "upgradeTo", "upgradeAndCall", "upgradeToAndCall", "changeProxyAdmin", "transferOwnership", "renounceOwnership",
             "diamondCut", "setImplementation", "setPause", "pause", "unpause", "updateSigner", "updateMessageQueueParameters",
             "updateEnforcedBatchParameters", "addSequencer", "removeSequencer", "addProver", "removeProver")
ROLE_IMPACT = {"DEFAULT_ADMIN_ROLE": (10.0, True), "TIMELOCK_ADMIN_ROLE": (9.0, True), "PROPOSER_ROLE": (9.0, True), "CANCELLER_ROLE": (7.0, True),
               "EXECUTOR_ROLE": (5.0, False)}
CRITICAL_ROLES = ("DEFAULT_ADMIN_ROLE", "TIMELOCK_ADMIN_ROLE", "PROPOSER_ROLE")
TOOL_CRITICAL = ("reentrancy-eth", "arbitrary-send-eth", "arbitrary-send-erc20", "controlled-delegatecall", "unprotected-upgrade", "suicidal",
                 "delegatecall-loop")
TOOL_IMPACT = {"critical": 9.0, "high": 8.0, "medium": 6.0, "low": 4.0, "informational": 2.5, "info": 2.5}
TOOL_CONF = {"high": 6.5, "medium": 5.0, "low": 3.5}
COMPOUND = r"(?i)\b(getUnderlyingPrice|PriceOracle|Comptroller|cToken|CToken|underlying\s+price)\b"
PRICE_UPDATE = (r"(?i)\b(validate|postPrices?|setPrice|setDirectPrice|pokeFailedOverPrice|activateFailover|deactivateFailover|failover|reporter|"
                r"anchorTolerance|prices\s*\[|priceInternal)\b")
BORROW_CTX = (r"(?i)\b(borrow|liquidat|collateral|getAccountLiquidity|shortfall|seize|accountLiquidity|market|comptroller|cToken)\b")
ORACLE_READ = (r"(?i)\b(getUnderlyingPrice|priceOracle|oracle\.get|oraclePrice|assetPrice|convertToAssets|previewRedeem|exchangeRate|totalAssets)\b")
BORROW_SINK = r"(?i)\b(borrow|liquidat|seize|enterMarkets|mint|redeemUnderlying)\w*\s*\("
LIQUIDITY = (r"(?i)\b(getAccountLiquidity|accountLiquidity|shortfall|collateralFactor|maxBorrow|borrowCapacity|healthFactor|ltv)\b")
RATE_PRICE = r"(?i)\b(convertToAssets|previewRedeem|totalAssets|totalSupply|balanceOf\s*\()\b"
PRICE_FN = r"(?i)price|oracle|getUnderlyingPrice|getPrice|assetPrice|collateralValue|quote"
BREAKER = (r"(?i)\b(maxStale|staleness|updatedAt|answeredInRound|heartbeat|sequencer|circuitBreaker|pauseGuardian|borrowPaused|marketPaused|"
           r"oracleGuard|maxDeviation|sanePrice|killSwitch|failClosed)\b")
TWAP = r"(?i)\b(twap|timeWeighted|observe\s*\(|cumulative|anchorPeriod)\b"
PROOF_ENTRY = r"(?i)[\w.]*verif(?:y|yproof|ytx|yplonk|ygroth16|yandupdate)\w*\s*\(|\bproof\b|publicInputs?|publicSignals?"
PROOF_PARAM = r"(?i)recipient|receiver|to$|amount|value|fee|relayer|root|nullifier|commitment|output"
# -----------------------------------------------------------------------------------------------


def _viewish() -> Column:
    return F.lower("tail").rlike("view|pure")


def _guarded() -> Column:
    return F.col("tail").rlike("(?i)" + nonreentrant) | F.substring("body", 1, LOCK_HEAD).rlike("(?i)" + nonreentrant)


def _out(df: DataFrame, detector: str, rule_id: str | None, impact, conf, bug: str, fn: str = "name") -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return df.select("target_id", F.lit(detector).alias("detector"), F.lit(rule_id).alias("rule_id"), lit(impact).cast("double").alias("impact"),
                     lit(conf).cast("double").alias("conf"), F.lit(bug).alias("bug_class"), F.col(fn).alias("function"))


def reentrancy_interprocedural(fns: DataFrame, flagged: DataFrame) -> DataFrame:
    """State written after a helper that reaches an external call; flagged(target_id, name) were found in one body already."""
    fns = last_definitions(fns)
    edges = loose_edges(fns)
    seeds = fns.where(F.col("body").rlike("(?i)" + core.EXT_CALL)).select("target_id", F.col("name").alias("node"))
    reaching = backward_closure(seeds, edges)
    cand = fns.where(~_viewish() & ~F.col("body").rlike("(?i)" + core.EXT_CALL)).join(
        flagged.select("target_id", F.col("function").alias("name")).distinct(), ["target_id", "name"], "left_anti")
    via = edges.join(reaching.withColumnRenamed("node", "dst"), ["target_id", "dst"], "left_semi").select("target_id", F.col("src").alias("name"), "dst")
    # position of the first call of each reaching helper; calls only, a mere mention does not count
    c = cand.join(via, ["target_id", "name"]).withColumn("at", F.expr(r"regexp_instr(body, concat(r'\b', dst, r'\s*\('))")).where("at > 0")
    first = keep_first(c.select("target_id", "name", "tail", "body", "dst", "at"), ["target_id", "name"], F.col("at"))
    rest = F.expr(r"regexp_replace(substring(body, at), concat(r'^', dst, r'\s*\('), '')")
    hit = first.where(rest.rlike("(?i)" + core.STATE_WRITE)).withColumn("own", _guarded())
    guarded_callers = edges.join(fns.where(_guarded()).select("target_id", F.col("name").alias("src")), ["target_id", "src"], "left_semi").select(
        "target_id", F.col("dst").alias("name")).distinct().withColumn("entry", F.lit(True))
    hit = hit.join(guarded_callers, ["target_id", "name"], "left")
    imp = F.when(F.col("own"), 5.0).when(F.col("entry"), 7.5).otherwise(9.0)
    cf = F.when(F.col("own"), 2.5).when(F.col("entry"), 4.5).otherwise(6.0)
    return _out(hit, "reentrancy", "reentrancy_interprocedural_cei", imp, cf, "reentrancy")


def solvency_check(fns: DataFrame) -> DataFrame:
    """Mutators of solvency state that reach no health check while a sibling mutator of the target does."""
    fns = last_definitions(fns)
    edges = loose_edges(fns)
    health_calls = edges.where(F.col("dst").rlike(HEALTH_NAME)).select("target_id", F.col("src").alias("node"))
    seeds = fns.where(F.col("body").rlike(HEALTH_CALL) | F.col("name").rlike(HEALTH_NAME)).select("target_id", F.col("name").alias("node"))
    ok = backward_closure(seeds.unionByName(health_calls), edges).withColumn("checked", F.lit(True)).withColumnRenamed("node", "name")
    vis = F.regexp_extract("tail", r"\b(public|external|internal|private)\b", 1)
    mut = fns.where(vis.isin("", "public", "external") & ~_viewish() & F.col("body").rlike(SOLVENCY_WRITE)).select("target_id", "name")
    mut = mut.join(ok, ["target_id", "name"], "left").withColumn("checked", F.coalesce("checked", F.lit(False)))
    has = mut.where("checked").select("target_id").distinct()
    return _out(mut.where("NOT checked").join(has, "target_id", "left_semi"), "solvency_check", None, 8.0, 6.0, "solvency")


def flashloan_governance(files: DataFrame, fns: DataFrame) -> DataFrame:
    """Spot-balance voting power together with emergency or arbitrary execution, per target."""
    said = with_matches(files.select("target_id", "raw"), "raw", vw="(?i)" + core.VOTE_WORDS, spot="(?i)" + core.SPOT_BALANCE, snap="(?i)" + core.SNAPSHOT)
    text = said.groupBy("target_id").agg(*[F.bool_or(k).alias(k) for k in ("vw", "spot", "snap")])
    f = last_definitions(fns)
    n = F.col("name")
    agg = f.groupBy("target_id").agg(F.bool_or(n.rlike("(?i)" + core.VOTE_NAME)).alias("vn"), F.bool_or(n.rlike("(?i)" + core.EMERGENCY_EXEC)).alias("em"),
                                     F.bool_or(n.rlike("(?i)" + core.EXEC_NAME) & F.col("body").rlike("(?i)" + core.ARBITRARY_EXEC)).alias("arb"))
    hit = text.join(agg, "target_id").where("(vw OR vn) AND spot AND NOT snap AND (em OR arb)").withColumn("name", F.lit(None).cast("string"))
    return _out(hit, "flashloan_governance", None, 9.0, 6.0, "governance_flashloan")


def pausability_bypass(fns: DataFrame, edges: DataFrame) -> DataFrame:
    """Alternate entrypoints without a pause gate that share a callee with a gated function, or move value."""
    hdr = F.concat("tail", "body")
    paused = fns.where(hdr.rlike(PAUSED)).select("target_id", F.col("name").alias("src"))
    guarded = edges.join(paused, ["target_id", "src"], "left_semi").select("target_id", "dst").distinct()
    alt = fns.where(F.col("name").rlike(ALTERNATE) & ~hdr.rlike(PAUSE_WORD)).select("target_id", "name", F.col("body").rlike(RARE_SINK).alias("sink"))
    shared = edges.join(guarded, ["target_id", "dst"], "left_semi").select("target_id", F.col("src").alias("name")).distinct().withColumn("shares", F.lit(True))
    any_guard = guarded.select("target_id").distinct()
    hit = alt.join(any_guard, "target_id", "left_semi").join(shared, ["target_id", "name"], "left").where("sink OR shares")
    return _out(hit, "pausability_bypass", "alternate_entrypoint_reaches_paused_sink", 7.5, 4.5, "pausability_bypass")


def delegatecall(fns: DataFrame, flows: DataFrame, acc: DataFrame) -> DataFrame:
    """Delegatecall into a target the caller influences; fns carry enrich() columns."""
    hl = F.regexp_extract("body", DELEGATE_TARGET, 1)
    full = F.when(hl != "", hl).otherwise(F.regexp_extract("body", ASM_DELEGATE, 1))
    d = fns.where(~F.col("tail").rlike(r"\b(internal|private|view|pure)\b")).withColumn("full", full).where("full <> ''")
    d = d.withColumn("base", F.regexp_extract("full", r"^([A-Za-z_]\w*)", 1)).where(~F.lower("base").isin("this", "address"))
    d = d.withColumn("in_params", F.array_contains(F.regexp_extract_all("params", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)), F.col("base")))
    d = d.withColumn("from_calldata", F.expr(r"body RLIKE concat(r'(?i)\b', base, r'\s*=\s*[^;]*(abi\.decode|calldata|msg\.data)')"))
    d = d.withColumn("key", F.expr(r"regexp_extract(body, concat(r'(?i)', base, r'\s*\[\s*([^\]]+)\]\s*\.\s*delegatecall'), 1)"))
    d = d.withColumn("by_key", (F.col("key") != "") & (F.col("key").contains("msg.sender") | F.arrays_overlap(F.regexp_extract_all("key", F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)), "param_names")))
    tainted = flows.where("sink_kind = 'delegatecall' AND confidence >= 0.75").select("target_id", F.col("function").alias("name")).distinct().withColumn("tainted", F.lit(True))
    d = d.join(tainted, ["target_id", "name"], "left").withColumn("tainted", F.coalesce("tainted", F.lit(False)))
    guard = F.concat_ws("\n", F.array_join("modifiers", " "), F.array_join("guards", " "), "tail", "body").rlike(SEMANTIC_GUARD) | F.col("body").rlike("(?i)" + INLINE_AUTH)
    g = fns.select("target_id", "name", "path", "visibility", guard.alias("has_guard"))
    writers = acc.where("writes").join(g, ["target_id", "name", "path", "visibility"]).groupBy("target_id", F.col("var").alias("base")).agg(
        F.bool_and(F.col("has_guard") | F.col("visibility").isin("internal", "private")).alias("admin_set"))
    d = d.join(writers, ["target_id", "base"], "left").where("in_params OR from_calldata OR by_key OR tainted")
    d = d.where("NOT (coalesce(admin_set, false) AND NOT in_params AND NOT from_calldata AND by_key)").withColumn("guarded", guard)
    imp = F.when(F.col("guarded"), 6.0).otherwise(9.0)
    cf = F.when(F.col("guarded"), 4.0).when(F.col("tainted"), 8.5).otherwise(8.0)
    return _out(d, "delegatecall", "delegatecall_to_untrusted_implementation", imp, cf, "delegatecall")


def taint_value_flow(flows: DataFrame) -> DataFrame:
    """Cross-function caller data into value sinks, all of them; a report takes the first few by rank_no."""
    f = flows.where("source_kind = 'calldata' AND sink_kind = 'value_transfer' AND confidence >= 0.75 AND cross_function")
    f = f.select("target_id", "entrypoint", "function", "sink", "source").distinct()
    return _out(f, "weird_hunt_taint_value_flow", "calldata_cross_function_value_sink", 8.0, 4.0, "cross_function_value_flow", fn="function")


def proof_value_flow(flows: DataFrame, fns: DataFrame) -> DataFrame:
    """Value flows of proof-gated entrypoints whose named fields appear in the sink but in no bound text."""
    from .zk import binding

    f = last_definitions(fns)
    e = f.select("target_id", F.col("name").alias("entrypoint"), F.col("body").alias("entry_body"), F.expr(binding.s).alias("binding"),
                 F.array_union(F.filter("param_names", lambda p: p.rlike(PROOF_PARAM)), F.col("decoded")).alias("fields"))
    s = f.select("target_id", F.col("name").alias("function"), F.col("body").alias("sink_body"))
    d = flows.where("sink_kind = 'value_transfer' AND confidence >= 0.75 AND source_kind IN ('calldata', 'proof_data')")
    d = d.join(e, ["target_id", "entrypoint"]).where(F.col("entry_body").rlike(PROOF_ENTRY)).join(s, ["target_id", "function"])
    names = F.array_union("fields", F.when(F.col("source").rlike(r"^[A-Za-z_]\w*$"), F.array("source")).otherwise(F.array().cast("array<string>")))
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"\b([a-z_]\w*)\b"), F.lit(1)))
    d = d.withColumns({"names": names, "in_sink": words(F.concat_ws("\n", "sink_text", "sink_body")), "bound": words(F.col("binding"))})
    miss = F.array_sort(F.filter("names", lambda n: F.array_contains("in_sink", F.lower(n)) & ~F.array_contains("bound", F.lower(n))))
    d = d.withColumn("missing", F.array_join(miss, ",")).where("missing <> ''").select("target_id", "entrypoint", "missing").distinct()
    return _out(d, "zk_verifier", "semantic_taint_proof_to_value_unbound",
                9.0, 4.5, "proof-to-value-binding", fn="entrypoint")


def governance_blast_radius(fns: DataFrame, abi: DataFrame, roles: DataFrame) -> DataFrame:
    """Dangerous selectors: unguarded ones, open roles (both may fire), else one governance-controlled row.

    abi(target_id, name); roles(target_id, role, zero_has, dead_has) with NULL for unknown reads.
    """
    ac = core.header_ac.s
    f = fns.select("*", *[F.expr(e) for e in lowered("tail")]).where(F.col("name").isin(*DANGEROUS)).withColumn("open", ~F.expr(ac) & ~F.col("tail").rlike(r"\b(internal|private)\b"))
    present = f.select("target_id", "name", "open").unionByName(abi.where(F.col("name").isin(*DANGEROUS)).select("target_id", "name", F.lit(False).alias("open")))
    t = present.groupBy("target_id").agg(F.bool_or("open").alias("unguarded"))
    open_role = F.coalesce("zero_has", F.lit(False)) | F.coalesce("dead_has", F.lit(False))
    r = roles.where(open_role).groupBy("target_id").agg(F.bool_or(F.col("role").isin(*CRITICAL_ROLES)).alias("crit"))
    d = t.join(r, "target_id", "left")
    row = lambda rid, imp, cf: F.struct(F.lit(rid).alias("k"), imp.cast("double").alias("i"), cf.cast("double").alias("c"))
    op = F.col("crit").isNotNull()
    rows = F.array_compact(F.array(
        F.when(F.col("unguarded"), row("unguarded", F.lit(9.0), F.lit(6.0))),
        F.when(op, row("open_role", F.when(F.col("crit"), 9.0).otherwise(6.0), F.when(F.col("crit"), 7.0).otherwise(5.0))),
        F.when(~F.col("unguarded") & ~op, row("by_design", F.lit(8.0), F.lit(2.0)))))
    return d.select("target_id", F.explode(rows).alias("r")).select("target_id", F.lit("governance_blast_radius").alias("detector"),
                                                                   F.col("r.k").alias("variant"), F.col("r.i").alias("impact"), F.col("r.c").alias("conf"))


def timelock_roles(roles: DataFrame, delays: DataFrame) -> DataFrame:
    """Open roles as findings; one informational row where only a delay exists. delays(target_id, min_delay)."""
    is_open = F.coalesce("zero_has", F.lit(False)) | F.coalesce("dead_has", F.lit(False))
    m = F.create_map(*[x for k, (i, _) in ROLE_IMPACT.items() for x in (F.lit(k), F.lit(i))])
    prop = roles.where((F.col("role") == "PROPOSER_ROLE") & is_open).select("target_id").distinct().withColumn("prop", F.lit(True))
    o = roles.where(is_open & F.col("role").isin(*ROLE_IMPACT)).join(prop, "target_id", "left")
    weak = (F.col("role") == "EXECUTOR_ROLE") & F.col("prop").isNull()
    found = o.select("target_id", F.lit("timelock_roles").alias("detector"), F.col("role").alias("function"),
                     F.when(weak, 4.0).otherwise(F.try_element_at(m, "role")).alias("impact"), F.when(weak, 5.0).otherwise(7.0).alias("conf"))
    info = delays.where("min_delay IS NOT NULL").join(o.select("target_id").distinct(), "target_id", "left_anti").select(
        "target_id", F.lit("timelock_roles").alias("detector"), F.lit(None).cast("string").alias("function"), F.lit(2.0).alias("impact"), F.lit(4.0).alias("conf"))
    return found.unionByName(info)


def analyzer_findings(tool: DataFrame) -> DataFrame:
    """Tool rows re-mapped to candidates: word scores, capped confidence, critical checks raised.

    tool(target_id, tool, check, impact, confidence, description, location, function, high_value)
    """
    m = lambda d, c, dflt: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))]), F.lower(F.coalesce(c, F.lit("")))), F.lit(dflt))
    check = F.trim(F.coalesce("check", F.lit("")))
    desc = F.trim(F.coalesce("description", F.lit("")))
    imp = m(TOOL_IMPACT, F.col("impact"), 4.0)
    sl = F.col("tool") == "slither"
    imp = F.when(sl & check.isin(*TOOL_CRITICAL), 9.0).when(sl & (F.coalesce("high_value", F.lit(False)) | (F.lower("impact") == "high")), F.greatest(imp, F.lit(7.0))).otherwise(imp)
    label = F.when(check != "", check).otherwise(check_slug(desc))
    return tool.where((check != "") | (desc != "")).select(
        "target_id", F.concat_ws(":", "tool", F.when(check != "", check_slug(check)).otherwise("issue")).alias("detector"),
        F.concat(F.lit("["), "tool", F.lit("] "), label, F.when(F.coalesce("function", F.lit("")) != "", F.concat(F.lit(": "), "function")).otherwise("")).alias("title"),
        label.alias("bug_class"), F.nullif(F.coalesce("function", F.lit("")), F.lit("")).alias("function"), imp.alias("impact"),
        F.least(m(TOOL_CONF, F.col("confidence"), 4.0), F.lit(7.0)).alias("conf"))


def economic_oracle_lending(files: DataFrame, fns: DataFrame, surfaces: DataFrame, roles: DataFrame) -> DataFrame:
    """Oracle-lending coupling: file rule on mutable Compound-style prices, and two function rules."""
    # read for the targets and for the files: a few marks per file, one pass over the texts
    said = cut(with_matches(files.select("target_id", "path", "raw"), "raw", comp=COMPOUND, ctx=BORROW_CTX, upd=PRICE_UPDATE, twap=TWAP, brk=BREAKER, rate=RATE_PRICE).drop("raw"))
    text = said.groupBy("target_id").agg(F.bool_or("comp").alias("comp"), F.bool_or("ctx").alias("ctx"))
    sid = surfaces.where(F.col("id").isin("oracle_lending", "erc4626_collateral_oracle")).select("target_id").distinct().withColumn("econ", F.lit(True))
    ro = roles.groupBy("target_id").agg((F.bool_or(F.col("role") == "oracle") & F.bool_or(F.col("role").isin("lending_controller", "lending_market"))).alias("coupled"))
    gate = text.join(sid, "target_id", "left").join(ro, "target_id", "left").where("comp OR ctx OR econ OR coupled").select("target_id", "comp", "ctx")
    per_file = said.select("target_id", "path", "upd", "twap", "brk", "rate")
    b = F.col("body")
    f = fns.join(gate, "target_id").join(per_file, ["target_id", "path"])
    up = f.where((F.lower("name") == "getunderlyingprice") & F.col("comp") & F.col("upd")).dropDuplicates(["target_id", "path"]).withColumn("name", F.lit("getUnderlyingPrice"))
    cf = F.greatest(F.lit(5.8), F.lit(7.0) - F.when(F.col("twap"), 0.7).otherwise(0.0) - F.when(F.col("brk"), 0.8).otherwise(0.0))
    a = _out(up, "economic_oracle_lending", "compound_oracle_lending_bad_debt", 8.8, F.round(cf, 6), "oracle_lending")
    guard = b.rlike(BREAKER)
    l = _out(f.where(b.rlike(ORACLE_READ) & b.rlike(LIQUIDITY) & b.rlike(BORROW_SINK)), "economic_oracle_lending", "oracle_price_controls_borrow_capacity",
             8.6, F.when(guard, 5.8).otherwise(6.8), "oracle_lending")
    r = _out(f.where(F.col("ctx") & F.col("rate") & (F.col("name").rlike(PRICE_FN) | b.rlike(PRICE_FN)) & b.rlike(RATE_PRICE)), "economic_oracle_lending",
             "erc4626_exchange_rate_lending_oracle", 8.7, F.when(guard, 5.7).otherwise(6.6), "erc4626_collateral_oracle")
    return a.unionByName(l).unionByName(r)
