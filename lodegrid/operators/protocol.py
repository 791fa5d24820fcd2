"""Protocol role graph: nodes, edges, surfaces, companions and their scan-level merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules.prefilter import with_matches
from .dedup import keep_first

# ---- Fixed values: role vocabulary -------------------------------------------------------
ROLES = (
    ("oracle", r"oracle|price(feed)?|aggregator|chainlink|pyth|redstone|twap|anchored|validatorproxy", "uses_oracle"),
    ("lending_controller", r"comptroller|unitroller|lendingpool|pooldata|controller|riskmanager|markets?", "uses_lending_controller"),
    ("lending_market", r"\b(c|v|a|d)token\b|ctoken|vtoken|atoken|debttoken|market|borrowable|collateral", "uses_lending_market"),
    ("erc4626_vault", r"erc4626|vault|wrapper|wrapped|share|shares", "uses_vault"),
    ("amm_pair", r"uniswap|pancake|sushiswap|camelot|curve|balancer|pair|amm|pool|lp", "uses_amm"),
    ("router", r"router|swaprouter|quoter|aggregator|executor", "uses_router"),
    ("asset", r"asset|underlying|collateral|borrowasset|debtasset|token0|token1|token|reward|stable|weth|usdc|dai", "uses_asset"),
    ("bridge_messenger", r"bridge|messenger|endpoint|inbox|outbox|relayer|receiver|gateway|mailbox|layerzero|ccip", "uses_bridge"),
    ("verifier", r"verifier|verify|proof|groth|plonk|snark|validator", "uses_verifier"),
    ("authority", r"owner|admin|governor|governance|guardian|pauser|timelock|multisig|manager", "controlled_by"),
    ("strategy", r"strategy|adapter|module|facet|implementation|beacon|logic", "uses_strategy"),
    ("hook", r"hook|callback|receiver|onerc|flashloan|flash", "uses_hook"),
)
MARKET_TOKEN = (r"ctoken|ictoken|vtoken|atoken|debttoken|c[A-Z][A-Za-z0-9_]*Token|v[A-Z][A-Za-z0-9_]*Token|a[A-Z][A-Za-z0-9_]*Token")
EXPANSION = {"oracle": 0, "lending_controller": 1, "lending_market": 2, "erc4626_vault": 3, "amm_pair": 4, "router": 5, "bridge_messenger": 6,
             "verifier": 7, "strategy": 8}
SKIP_TARGETS = ("msg", "tx", "block", "super", "this", "address", "abi", "type", "console", "assert", "require")
METHODS = (
    ("reads_price_or_rate", r"price|oracle|quote|latest|converttoassets|exchangerate|twap"),
    ("checks_liquidity", r"getaccountliquidity|health|shortfall|collateral"),
    ("moves_debt", r"borrow|liquidat|seize|repay"),
    ("moves_asset", r"transfer|mint|burn|redeem|withdraw|deposit"),
    ("uses_amm_reserve", r"sync|skim|getreserves|slot0"),
    ("verifies_proof", r"verify|proof"),
)
# id, severity (None = by text), confidence, roles whose nodes it lists
SURFACES = (
    ("oracle_lending", "high", 0.75, ("oracle", "lending_controller", "lending_market", "erc4626_vault", "asset")),
    ("erc4626_collateral_oracle", "high", 0.72, ("erc4626_vault", "oracle", "lending_controller", "lending_market", "asset")),
    ("amm_reserve_dependency", None, 0.68, ("amm_pair", "router", "asset")),
    ("vault_share_accounting", "medium", 0.62, ("erc4626_vault", "asset", "strategy")),
    ("bridge_or_proof_domain", "high", 0.70, ("bridge_messenger", "verifier", "asset")),
)
SURFACE_TEXT = {
    "lending": r"borrow|liquidat|getaccountliquidity|comptroller|ctoken", "oracle": r"getunderlyingprice|oracle|pricefeed|converttoassets|exchangerate",
    "rate": r"converttoassets|previewredeem|totalassets", "collateral": r"borrow|collateral|ltv|comptroller|liquidat",
    "reserve": r"\b(sync|skim|getreserves|slot0)\b", "burny": r"_burn|burn|_update|accumulated|sync",
    "vault": r"totalassets|convertoshares|converttoshares|deposit|redeem|withdraw", "share": r"share|supply|asset",
    "domain": r"proof|root|message|nonce|verify|relay|process",
}
# -------------------------------------------------------------------------------------------


def infer_role(name: Column, type_name: Column) -> Column:
    """struct(role, confidence): name match 0.62 plus type match 0.34, best of the ordered rules, floor 0.34, cap 0.96."""
    combined = F.concat_ws(" ", name, type_name)
    scored = [F.struct(
        F.when(F.lit(r == "asset") & F.lower(name).isin("owner", "admin", "manager"), 0.0).otherwise(
            F.least(F.lit(0.96), F.when(F.rlike(name, F.lit("(?i)" + p)), 0.62).otherwise(0.0) + F.when(F.rlike(type_name, F.lit("(?i)" + p)), 0.34).otherwise(0.0))).alias("score"),
        F.lit(-i).alias("rank"), F.lit(r).alias("role")) for i, (r, p, _) in enumerate(ROLES)]
    # a one-element transform binds the ranked list once; plain references would evaluate it again per use
    pick = lambda b: F.when(b["score"] >= 0.34, F.struct(b["role"].alias("role"), b["score"].alias("confidence")))
    ranked = F.get(F.transform(F.array(F.array_max(F.array(*scored))), pick), F.lit(0))
    return F.when(F.rlike(combined, F.lit(MARKET_TOKEN)), F.struct(F.lit("lending_market").alias("role"), F.lit(0.9).alias("confidence"))).otherwise(ranked)


def with_role(df: DataFrame, name: Column, type_name: Column) -> DataFrame:
    """Rows that have a role, as column ``r``.

    A generator drops the others: a filter on ``r`` would be pushed below a distinct in front and
    run the role patterns on every raw row instead of every distinct one.
    """
    return df.select("*", F.explode(F.array_compact(F.array(infer_role(name, type_name)))).alias("r"))


def role_edge(role: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for r, _, e in ROLES for x in (F.lit(r), F.lit(e))]), role)


def method_edge(method: Column) -> Column:
    out = None
    for kind, p in METHODS:
        c = F.lower(method).rlike(p)
        out = F.when(c, kind) if out is None else out.when(c, kind)
    return out.otherwise("calls")


def valid_address(a: Column) -> Column:
    return F.coalesce(a.rlike("^0x[0-9a-fA-F]{40}$") & ~a.rlike("^0x0{40}$"), F.lit(False))


def looks_like_reference(t: Column) -> Column:
    t = F.trim(t)
    return (~F.startswith(t, F.lit("mapping"))) & (t.isin("address", "address payable") | t.rlike(r"^(I[A-Z]|[A-Z])")
                                                   | t.rlike(r"(?i)contract|interface|token|oracle|pair|pool|router|vault|verifier|bridge"))


def nodes_and_edges(targets: DataFrame, svars: DataFrame, fns: DataFrame, acc: DataFrame, getters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Role nodes and reference edges.

    targets(target_id, address, contract_name, implementation, admin, admin_owner, owner, beacon),
    getters(target_id, name, address) hold resolved address getters.
    """
    t = targets.select("target_id", F.lit("target").alias("id"), F.coalesce("contract_name", "address").alias("label"), F.lit("target").alias("role"),
                       "address", F.lit("scan_target").alias("source"), F.lit(1.0).alias("confidence"))
    px = targets.select("target_id", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.col(c).alias("a"), F.lit(k).alias("k")) for r, c, k in (
        ("implementation", "implementation", "strategy"), ("proxy_admin", "admin", "authority"), ("proxy_admin_owner", "admin_owner", "authority"),
        ("owner", "owner", "authority"), ("beacon", "beacon", "strategy"))])).alias("p")).where("p.a IS NOT NULL")
    proxy = px.select("target_id", F.concat(F.lit("proxy:"), "p.r").alias("id"), F.col("p.r").alias("label"), F.col("p.k").alias("role"),
                      F.col("p.a").alias("address"), F.lit("proxy_resolution").alias("source"), F.lit(0.95).alias("confidence"))
    sv = with_role(svars, F.col("name"), F.col("type"))
    st = sv.join(getters.select("target_id", "name", "address"), ["target_id", "name"], "left").select(
        "target_id", F.concat(F.lit("state:"), "name").alias("id"), F.col("name").alias("label"), "r.role", "address", F.lit("state_var").alias("source"), "r.confidence")
    calls = fns.select("target_id", F.col("name").alias("function"), F.explode(F.arrays_zip(
        F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*\("), F.lit(1)).alias("t"),
        F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*\("), F.lit(2)).alias("m"))).alias("z")).select(
        "target_id", "function", F.col("z.t").alias("label"), F.col("z.m").alias("method")).where(~F.lower("label").isin(*SKIP_TARGETS)).distinct()
    state_keys = st.select("target_id", "label", F.col("id").alias("state_id"))
    c = calls.join(state_keys, ["target_id", "label"], "left").withColumn("r", infer_role(F.col("label"), F.lit("")))
    ct = (c.where("state_id IS NULL AND r IS NOT NULL").select("target_id", F.concat(F.lit("calltarget:"), "label").alias("id"), "label", "r.role",
          F.lit(None).cast("string").alias("address"), F.lit("typed_call_target").alias("source"), F.least(F.lit(0.8), F.col("r.confidence")).alias("confidence")).distinct())
    taken = st.select("target_id", "label").unionByName(ct.select("target_id", "label"))
    ab = (with_role(getters.where(F.coalesce("from_abi", F.lit(False))), F.col("name"), F.lit("address getter"))
          .withColumnRenamed("name", "label").join(taken, ["target_id", "label"], "left_anti").select(
              "target_id", F.concat(F.lit("abi:"), "label").alias("id"), "label", "r.role", "address", F.lit("abi_getter").alias("source"),
              F.greatest(F.lit(0.6), F.col("r.confidence") - 0.1).alias("confidence")))
    nodes = t.unionByName(proxy).unionByName(st).unionByName(ct).unionByName(ab)
    nodes = nodes.groupBy("target_id", "id").agg(F.min(F.struct("source", "label", "role")).alias("n"), F.max("address").alias("address"), F.max("confidence").alias("confidence"))
    nodes = nodes.select("target_id", "id", "n.label", "n.role", "address", "n.source", "confidence")
    none = F.lit(None).cast("string")
    e1 = proxy.select("target_id", F.col("id").alias("dst"), F.col("label").alias("kind"), none.alias("function"), none.alias("method"))
    e2 = st.select("target_id", F.col("id").alias("dst"), role_edge(F.col("role")).alias("kind"), none.alias("function"), none.alias("method"))
    e3 = acc.join(state_keys.withColumnRenamed("label", "var"), ["target_id", "var"]).select(
        "target_id", F.col("state_id").alias("dst"), F.when(F.col("writes"), "writes_reference").otherwise("reads_reference").alias("kind"),
        F.col("name").alias("function"), none.alias("method"))
    e4 = c.where("state_id IS NOT NULL OR r IS NOT NULL").select("target_id", F.coalesce("state_id", F.concat(F.lit("calltarget:"), "label")).alias("dst"),
                                                                 method_edge(F.col("method")).alias("kind"), "function", "method")
    e5 = ab.select("target_id", F.col("id").alias("dst"), role_edge(F.col("role")).alias("kind"), none.alias("function"), none.alias("method"))
    edges = e1.unionByName(e2).unionByName(e3).unionByName(e4).unionByName(e5).withColumn("src", F.lit("target")).distinct()
    return nodes, edges


def role_counts(nodes: DataFrame) -> DataFrame:
    """Roles per target and over the whole scan (rollup)."""
    return nodes.rollup("role", "target_id").agg(F.count(F.lit(1)).alias("n")).where("role IS NOT NULL")


def surfaces(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(target_id, id, severity, confidence): role presence and text flags, one aggregate row per target."""
    said = with_matches(files.select("target_id", F.lower("raw").alias("low")), "low", **{f"x_{k}": p for k, p in SURFACE_TEXT.items()})
    text = said.groupBy("target_id").agg(*[F.bool_or(f"x_{k}").alias(f"x_{k}") for k in SURFACE_TEXT])
    roles = nodes.groupBy("target_id").agg(F.collect_set("role").alias("roles"))
    d = text.join(roles, "target_id", "left")
    has = lambda *r: F.coalesce(F.arrays_overlap("roles", F.array(*[F.lit(x) for x in r])), F.lit(False))
    x = lambda k: F.col(f"x_{k}")
    cond = {"oracle_lending": (has("lending_controller", "lending_market") | x("lending")) & (has("oracle") | x("oracle")),
            "erc4626_collateral_oracle": x("rate") & x("collateral"), "amm_reserve_dependency": has("amm_pair") & x("reserve"),
            "vault_share_accounting": x("vault") & x("share"), "bridge_or_proof_domain": has("bridge_messenger", "verifier") & x("domain")}
    rows = [F.when(cond[i], F.struct(F.lit(i).alias("id"), (F.lit(s) if s else F.when(x("burny"), "high").otherwise("medium")).alias("severity"),
                                     F.lit(c).alias("confidence"))) for i, s, c, _ in SURFACES]
    return d.select("target_id", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("target_id", "s.*")


def surface_members(surf: DataFrame, nodes: DataFrame, limit: int = 12) -> DataFrame:
    """Group members of each surface, first ``limit`` by role order (the list is a bounded report field)."""
    from .dedup import top_per_key

    dim = surf.sparkSession.createDataFrame([(i, r, k) for i, _, _, rs in SURFACES for k, r in enumerate(rs)], "id string, role string, role_no int")
    m = surf.join(F.broadcast(dim), "id").join(nodes.select("target_id", F.col("id").alias("node_id"), "label", "role", "address"), ["target_id", "role"])
    return top_per_key(m, ["target_id", "id"], limit, F.col("role_no"), F.col("node_id"))


def companions(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """High-value related contracts of each target, first per address (or per role/label/source)."""
    own = targets.select("target_id", F.lower("address").alias("own"))
    n = nodes.where(F.col("role").isin(*EXPANSION)).join(own, "target_id").where("address IS NULL OR lower(address) <> own")
    key = F.lower(F.coalesce("address", F.concat_ws(":", "role", "label", "source")))
    return keep_first(n.withColumn("ckey", key).drop("own"), ["target_id", "ckey"], F.col("id")).withColumn("unresolved", F.col("address").isNull())


def merge_companions(comp: DataFrame, targets: DataFrame) -> DataFrame:
    """Scan-level merge: one row per companion key, who observed it, whether it is scanned already."""
    own = targets.select(F.lower("address").alias("addr_lc")).distinct().withColumn("already_in_scan", F.lit(True))
    d = comp.join(targets.select("target_id", F.col("address").alias("observer")), "target_id").withColumn(
        "mkey", F.lower(F.coalesce("address", F.concat_ws(":", "observer", "role", "label"))))
    g = d.groupBy("mkey").agg(F.min_by(F.struct("address", "role", "label", "source", "confidence"), F.struct("target_id", "id")).alias("c"),
                              F.count(F.lit(1)).alias("observations"), F.min("observer").alias("first_observer"))
    return g.select("mkey", "c.*", "observations", "first_observer").join(own, F.lower(F.col("address")) == F.col("addr_lc"), "left").drop("addr_lc").withColumn(
        "already_in_scan", F.coalesce("already_in_scan", F.lit(False)))


def merge_graphs(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One graph of a scan from the graphs of its targets(scan_id, target_id, address): nodes, edges and who observed which node.

    Nodes are the same if they have one address, else if target, role and label agree. Where targets differ on a node, the one of the
    smallest address speaks, then the smaller node id. An edge joins two merged nodes; it is kept once with the number of targets that
    have it. Observers stay rows (scan_id, node, target_id, id), so a node that every target knows makes no long list. Edges to nodes that
    are not there go; a null label counts as empty.
    """
    t = targets.select("target_id", "scan_id", F.lower("address").alias("observer"))
    n = nodes.join(t, "target_id").withColumn("node", F.lower(F.coalesce("address", F.concat_ws(":", "observer", "role", "label"))))
    seen = n.select("scan_id", "node", "target_id", "id").distinct()
    own = t.select("scan_id", F.col("observer").alias("node")).distinct().withColumn("in_scan", F.lit(True))
    # counted by target first: a node shared by all targets then shuffles as one row a target and task
    told = n.groupBy("scan_id", "node", "target_id", "observer").agg(F.min_by(F.struct("label", "role", "address", "source", "confidence"), "id").alias("v"), F.min("id").alias("id"))
    merged = told.groupBy("scan_id", "node").agg(F.min_by("v", F.struct("observer", "target_id", "id")).alias("v"), F.count(F.lit(1)).alias("targets"), F.min("observer").alias("first_observer"))
    merged = merged.join(own, ["scan_id", "node"], "left").select("scan_id", "node", "v.*", "targets", "first_observer", F.coalesce("in_scan", F.lit(False)).alias("in_scan"))
    end = lambda c: seen.select("target_id", F.col("id").alias(c), F.col("node").alias(f"{c}_node"))
    e = edges.join(seen.select("scan_id", "target_id", F.col("id").alias("src"), F.col("node").alias("src_node")), ["target_id", "src"]).join(end("dst"), ["target_id", "dst"])
    key = ["scan_id", "src_node", "dst_node", "kind", "function", "method"]
    return merged, e.select(*key, "target_id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("targets")), seen


def select_companions(merged: DataFrame, known: DataFrame, max_new: int) -> DataFrame:
    """Resolved, high-value, not yet known companions by role priority; the cap is the expansion budget."""
    pr = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in EXPANSION.items() for x in (F.lit(k), F.lit(v))]), "role"), F.lit(99))
    d = merged.where(F.col("role").isin(*EXPANSION) & valid_address(F.col("address"))).withColumn("addr_lc", F.lower("address"))
    d = d.join(known.select(F.lower("address").alias("addr_lc")).distinct(), "addr_lc", "left_anti")
    d = keep_first(d, ["addr_lc"], F.col("mkey")).withColumn("role_priority", pr)
    return d.orderBy("role_priority", F.desc("confidence"), "label", "addr_lc").limit(max_new)


def expansion_cap(requested: int | None, default: int = 8, hard_cap: int = 25) -> int:
    return max(0, min(default if requested is None else requested, hard_cap))


# Detectors and classes whose check needs the whole group of components, and the roles of its members.
GROUP_DETECTORS = ("economic_oracle_lending", "oracle_manipulation", "thin_liquidity_spot_oracle", "lending_exchange_rate_donation",
                   "vault_share_donation_inflation", "erc4626_dual_asset_redeem_double_count", "amm_pair_reserve_desync", "hook_pair_burn_sync")
GROUP_CLASSES = ("oracle", "erc4626_collateral_oracle", "vault_accounting", "amm_reserve_desync", "reserve_desync", "lending_exchange_rate_donation")
GROUP_SURFACES = ("oracle_lending", "erc4626_collateral_oracle", "amm_reserve_dependency", "vault_share_accounting")


def group_scenarios(cand: DataFrame, surf: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidates worth a component-group check and the scenario family of each.

    Needs at least one resolved component besides the target itself.
    """
    comp = nodes.where(F.col("role").isin(*EXPANSION) & F.col("address").isNotNull()).select("target_id", F.lower("address").alias("a")).distinct().groupBy("target_id").agg(
        F.count(F.lit(1)).alias("components"))
    ids = surf.groupBy("target_id").agg(F.collect_set("id").alias("ids"))
    d = cand.join(comp, "target_id").join(ids, "target_id", "left")
    has = lambda *x: F.coalesce(F.arrays_overlap("ids", F.array(*[F.lit(v) for v in x])), F.lit(False))
    det, bug = F.col("detector"), F.coalesce("bug_class", F.lit(""))
    ok = det.isin(*GROUP_DETECTORS) | bug.isin(*GROUP_CLASSES) | (has(*GROUP_SURFACES) & (F.col("impact") >= 7))
    kind = (F.when((det == "economic_oracle_lending") | has("oracle_lending") | (bug == "erc4626_collateral_oracle"), "oracle_lending_bad_debt")
            .when(det.isin("erc4626_dual_asset_redeem_double_count", "vault_share_donation_inflation") | has("vault_share_accounting"), "vault_redeem_share_accounting")
            .when(det.isin("amm_pair_reserve_desync", "hook_pair_burn_sync", "thin_liquidity_spot_oracle") | has("amm_reserve_dependency"), "amm_reserve_manipulation")
            .when(has("bridge_or_proof_domain"), "bridge_or_proof_domain_binding").otherwise("protocol_group_validation"))
    return d.where(ok).withColumn("scenario", kind).drop("ids")


def expand_companions(start: DataFrame, observe, cap: int) -> DataFrame:
    """Scan rounds: observe(frontier) returns merged companions; new addresses form the next frontier until none or the cap.

    The cap is the expansion budget of the scan; each round reads only its own frontier.
    """
    from ..session import cut

    known, frontier, left = start.select("address"), start.select("address"), cap
    while left > 0:
        new = cut(select_companions(observe(frontier), known, left).select("address"))
        n = new.count()
        if n == 0:
            break
        known, frontier, left = known.unionByName(new), new, left - n
    return known
