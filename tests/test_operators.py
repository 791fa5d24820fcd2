from pyspark.sql import functions as F

from lodegrid.functions.scalars import FALSE_POSITIVE, LOW, NEEDS
from lodegrid.operators import dedup, gates, graph, protocol, scoring, storage
from lodegrid.operators.facts import enrich, state_vars
from lodegrid.operators.taint import flows
from lodegrid.plans.snippets import SPECIAL_TWINS
from lodegrid.rules import graph_rules as gr
from lodegrid.rules.engine import functions, parse
from lodegrid.sources import targets
from lodegrid.streaming import watch

FILE = "target_id long, chain string, path string, pos int, raw string"
CAND = ("target_id long, pos long, detector string, title string, description string, impact double, conf double, rule_id string, bug_class string, file string, "
        "snippet string, tier string, lead_only boolean, ev_flags array<string>, functions array<string>, function string, suppressed boolean, tool_agree boolean, "
        "pattern_class string, value_state string, value_signal string, reference_state string, destination_control string, suppressed_reason string, "
        "corroborated boolean, corroborated_by array<string>")


def cand(spark, *rows):
    base = dict(target_id=1, pos=0, detector="d", title="t", description="", impact=8.0, conf=5.0, rule_id=None, bug_class="b", file="a.sol", snippet="x", tier=None,
                lead_only=False, ev_flags=[], functions=["go"], function=None, suppressed=False, tool_agree=False, pattern_class=None, value_state=None, value_signal=None,
                reference_state=None, destination_control=None, suppressed_reason=None, corroborated=False, corroborated_by=None)
    keys = [c.split(" ")[0] for c in CAND.split(", ")]
    return spark.createDataFrame([tuple({**base, "pos": i, **r}[k] for k in keys) for i, r in enumerate(rows)], CAND)


def test_score_cases(spark):
    d = scoring.score(cand(
        spark, dict(impact=8.0, conf=2.0, ev_flags=["governance_controlled", "documented_centralization", "has_access_control"]), dict(conf=4.0, tool_agree=True),
        dict(detector="reentrancy", impact=9.0, conf=7.0, ev_flags=["refuted"]), dict(impact=9.0, conf=8.0, value_state="no_value", value_signal="inert_unreferenced"),
        dict(impact=9.0, conf=8.0, value_state="unknown"), dict(impact=8.0, conf=1.0, lead_only=True), dict(impact=10.0, conf=9.0, lead_only=True),
        dict(impact=9.0, conf=9.0, suppressed=True), dict(impact=9.0, conf=9.0, value_state="no_value", value_signal="unknown")), "ultra-deep").orderBy("pos").collect()
    assert d[0].classification == LOW and d[0].confidence_score < 4
    assert d[1].confidence_score == 6.0
    assert (d[2].classification, d[2].confidence_score) == (NEEDS, 4.0)
    assert (d[3].impact_score, d[3].confidence_score) == (4.0, 2.0)
    assert d[4].impact_score == 9.0 and d[4].confidence_score == 8.0
    assert (d[5].classification, d[5].confidence_score) == (NEEDS, 3.0)
    assert d[6].classification == NEEDS
    assert (d[7].classification, d[7].confidence_score) == (FALSE_POSITIVE, 0.0)
    assert (d[8].classification, d[8].confidence_score) == (NEEDS, 6.0)


def test_corroborate_marks_both(spark):
    d = cand(spark, dict(detector="a", functions=["Go"]), dict(detector="b", functions=["go "]), dict(detector="a", functions=["solo"]), dict(detector="c", functions=["go"], suppressed=True))
    r = {(x.detector, x.pos): x.corroborated_by for x in scoring.corroborate(d.drop("corroborated", "corroborated_by"), ["target_id"]).collect()}
    assert r == {("a", 0): ["b"], ("b", 1): ["a"], ("a", 2): None, ("c", 3): None}


def test_collapse_hot_key_and_files(spark):
    d = cand(spark, *[dict(file=f"f{i % 3}.sol", impact=float(i % 9), snippet=" same  body ") for i in range(60)], dict(snippet="other"))
    d = dedup.with_keys(d)
    g = dedup.collapse_duplicates(d, ["target_id"]).orderBy("pos").collect()
    assert [(x.pos, x.dup_count, x.impact) for x in g] == [(0, 60, 8.0), (60, 1, 8.0)]
    assert [x.also_in_file for x in dedup.duplicate_files(d, ["target_id"]).orderBy("first_pos").collect()] == ["f1.sol", "f2.sol"]


def test_suppression_scope(spark):
    c = spark.createDataFrame([("f1", "p1", "0xA"), ("f2", "p2", "0xB"), ("f2", "p1", "0xC")], "fingerprint string, pattern_fingerprint string, address string").withColumns(
        {"suppressed": F.lit(False), "suppressed_reason": F.lit(None).cast("string")})
    s = spark.createDataFrame([("f1", None, "g"), ("f2", "0xb", "s"), ("p1", None, "prior")], "fingerprint string, address string, reason string")
    r = {x.address: (x.suppressed, x.suppressed_reason, x.prior_refutation) for x in dedup.suppress(c, s).collect()}
    assert r == {"0xA": (True, "g", None), "0xB": (True, "s", None), "0xC": (False, None, "prior")}


def test_sanity_reasons(spark):
    src = ("function hid() internal { x = 1; }\nfunction initialize() external initializer { owner = a; }\nfunction upgradeTo(address a) external ifAdmin { impl = a; }\n"
           "function withdraw(uint q) external { _burn(msg.sender, q); coin.transfer(msg.sender, q); }\nfunction verifyLeaf(bytes32 a) external view returns (bool) { return ok(a); }\nfunction setFee(uint q) external { fee = q; }")
    fns = functions(parse(spark.createDataFrame([(1, "ethereum", "a.sol", 0, src)], FILE)))
    t = spark.createDataFrame([(1, True, None, False, None, None), (2, True, None, True, True, "0x60")], "target_id long, has_source boolean, live_initialized boolean, rpc_ok boolean, chain_mismatch boolean, code string")
    names = ["hid", "initialize", "upgradeTo", "withdraw", "verifyLeaf", "setFee", "gone"]
    d = cand(spark, *[dict(detector="access_control", functions=[n]) for n in names], dict(target_id=2, functions=["setFee"]))
    r = [x.suppressed_reason for x in gates.sanity(d, fns, t).orderBy("pos").collect()]
    assert r[5] is None and r[7] == "rpc chain mismatch" and all(x for i, x in enumerate(r) if i != 5)
    assert "internal" in r[0] and "initializer" in r[1] and "admin gate" in r[2] and "user method" in r[3] and "helper" in r[4] and "absent" in r[6]


def test_components_chain_and_hub(spark):
    n = 3000
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    hub = spark.range(2000).select((F.col("id") + 10_000).alias("src"), F.lit(9_999).cast("long").alias("dst"))
    nodes = spark.range(n).unionByName(hub.select(F.col("src").alias("id"))).unionByName(spark.createDataFrame([(9_999,), (50_000,)], "id long"))
    r = graph.components(nodes, chain.unionByName(hub)).groupBy("component").count().orderBy("component").collect()
    assert [(x.component, x["count"]) for x in r] == [(0, n), (9_999, 2001), (50_000, 1)]


def test_reach_depth_bound_and_cycle(spark):
    e = spark.createDataFrame([(1, f"f{i}", f"f{i + 1}") for i in range(12)] + [(1, "f3", "f0")], "target_id long, src string, dst string")
    s = spark.createDataFrame([(1, "f0")], "target_id long, node string")
    r = graph.reach(s, e)
    assert r.count() == 9 and r.agg(F.max("depth")).first()[0] == 8
    p = {x.node: x.path for x in graph.shortest_paths(s, e).collect()}
    assert p["f2"] == ["f0", "f1", "f2"]


def _special(spark, key, neg=False):
    d = spark.createDataFrame([(1, "ethereum", "a.sol", 0, SPECIAL_TWINS[key][1 if neg else 0])], FILE)
    p = parse(d)
    return d, p, functions(p)


def test_special_rules_fire_and_stay_silent(spark):
    names = lambda df: {r.function for r in df.collect()}
    none = spark.createDataFrame([], "target_id long, function string")
    assert names(gr.solvency_check(_special(spark, "solvency_check")[2])) == {"donateCash"}
    assert names(gr.reentrancy_interprocedural(_special(spark, "reentrancy")[2], none)) == {"borrowFresh"}
    assert names(gr.reentrancy_interprocedural(_special(spark, "reentrancy", True)[2], none)) == set()
    d, _, f = _special(spark, "flashloan_governance")
    assert gr.flashloan_governance(d, f).count() == 1
    from lodegrid.operators.facts import call_edges

    f = _special(spark, "pausability_bypass")[2]
    assert names(gr.pausability_bypass(f, call_edges(f))) == {"executeNow"}
    _, p, f = _special(spark, "weird_hunt_taint_value_flow")
    fl = flows(enrich(f), state_vars(p))
    assert names(gr.taint_value_flow(fl)) == {"releaseTo"}
    assert fl.where("entrypoint = 'startRelease' AND function = 'releaseTo' AND source = 'amount'").first().path == ["startRelease", "releaseTo"]
    _, p, f = _special(spark, "zk_verifier")
    e = enrich(f)
    assert names(gr.proof_value_flow(flows(e, state_vars(p)), e)) == {"proveExitTo"}


def test_state_vars_and_slots(spark):
    src = "contract A {\n uint256 public cap;\n address immutable boss;\n mapping(address => uint256) public balances;\n function f() public { uint256 tmp; cap = 1; }\n}"
    p = parse(spark.createDataFrame([(1, "ethereum", "src/A.sol", 0, src)], FILE))
    sv = state_vars(p)
    assert {(r.name, r.type) for r in sv.collect()} == {("cap", "uint256"), ("boss", "address"), ("balances", "mapping")}
    none = sv.limit(0)
    m = none.select("target_id", F.col("name").alias("var"), *[F.array().cast("array<string>").alias(c) for c in ("read_by", "written_by", "entrypoint_writers")])
    exact = spark.createDataFrame([(1, "balances", 7)], "target_id long, label string, slot long")
    r = {x.name: (x.slot, x.slot_exact, x.family) for x in storage.assign_slots(sv, exact, m).collect()}
    assert r["balances"] == (7, True, "accounting") and r["boss"][0] is None and r["cap"][:2] == (0, False)


def test_companion_selection(spark):
    rows = [(f"k{i}", f"0x{i:040x}", role, f"l{i}", "s", 0.5) for i, role in enumerate(["amm_pair", "oracle", "asset", "router", "hook", "vault"], 1)]
    m = spark.createDataFrame(rows, "mkey string, address string, role string, label string, source string, confidence double")
    known = spark.createDataFrame([(f"0x{4:040x}",)], "address string")
    assert [r.role for r in protocol.select_companions(m, known, 2).collect()] == ["oracle", "amm_pair"]


def test_target_list(spark):
    a, b = "0x" + "Ab" * 20, "0x" + "cd" * 20
    d = spark.createDataFrame([(0, f"{a}, first"), (1, a.lower() + " second"), (2, "junk"), (3, ""), (4, f"{b}\tx y")], "line_no int, value string")
    assert {(r.address_lc, r.label) for r in targets.parse_target_list(d).collect()} == {(a.lower(), "first"), (b, "x y")}


def test_watch_batch_baseline(spark):
    o = spark.createDataFrame([("w", "2024-01-01 00:00:00", "0xa", "h", "0x1", ""), ("w", "2024-01-01 00:01:00", "", "h", "", "0x9"), ("w", "2024-01-01 00:02:00", "0xB", "h2", "0x1", ""),
                               ("w", "2024-01-01 00:03:00", "0xb", "h3", "0x2", "0x8")], "address string, ts string, implementation string, codehash string, admin string, owner string").withColumn("ts", F.to_timestamp("ts"))
    r = [(x.kind, x.old, x.new) for x in watch.watch_batch(o).orderBy("ts", "kind").collect()]
    assert r == [("upgrade", "0xa", "0xB"), ("admin_change", "0x1", "0x2"), ("owner_change", "0x9", "0x8")]


def test_new_deploys_cap_and_offset(spark):
    c = spark.createDataFrame([("d", f"0x{i}", i * 10) for i in range(6)], "deployer string, address string, block long")
    known = spark.createDataFrame([("0X1",)], "address string")
    w = spark.createDataFrame([("d", 0)], "deployer string, last_block_checked long")
    take, off = watch.new_deploys(c, known, w, cap=2)
    assert {r.address for r in take.collect()} == {"0x0", "0x2"} and off.first().next_block == 20


def test_role_inference(spark):
    d = spark.createDataFrame([("priceOracle", "IOracle"), ("owner", "address"), ("zzz", "uint256"), ("cUsdToken", "address")], "n string, t string")
    r = [x.r for x in d.select(protocol.infer_role(F.col("n"), F.col("t")).alias("r")).collect()]
    assert (r[0].role, r[0].confidence) == ("oracle", 0.96) and r[1].role == "authority" and r[2] is None and (r[3].role, r[3].confidence) == ("lending_market", 0.9)


def test_triage_with_graph_rules(spark):
    from lodegrid.plans.pipeline import triage

    d = spark.createDataFrame([(1, "ethereum", "a.sol", 0, SPECIAL_TWINS["solvency_check"][0]), (2, "ethereum", "b.sol", 0, SPECIAL_TWINS["reentrancy"][0])], FILE)
    r = {(x.target_id, x.detector, x.functions[0]) for x in triage(d, "deep").where("NOT suppressed").collect()}
    assert (1, "solvency_check", "donateCash") in r and (2, "reentrancy", "borrowFresh") in r


def test_triage_with_chain_reads(spark):
    from lodegrid.plans.pipeline import triage

    text = ("contract C { function upgradeTo(address a) external onlyOwner { impl = a; } function transferOwnership(address a) external onlyOwner { owner = a; }"
            " function upgradeToAndCall(address a) external { impl = a; } function initialize(address a) external { owner = a; } }")
    d = spark.createDataFrame([(i, "ethereum", "a.sol", 0, text) for i in range(7)], FILE)
    reads = [(0, True, False, "0x60", False, "eoa"), (1, True, False, "0x60", True, "timelock"), (2, True, True, "0x60", None, "eoa"), (3, True, None, "0x", None, None), (4, False, True, "0x", None, None), (5, None, None, None, None, None)]
    known = {"chain": spark.createDataFrame(reads, "target_id long, rpc_ok boolean, chain_mismatch boolean, code string, live_initialized boolean, admin_kind string")}
    rows = triage(d, "deep", known=known).cache()
    up = {(r.target_id, r.functions[0]): r for r in rows.where("detector = 'proxy_upgrade'").collect()}
    marks = {"governance_controlled", "documented_centralization"}
    assert up[0, "upgradeTo"].title.startswith("Upgrade function controlled by a single EOA admin") and not marks & set(up[0, "upgradeTo"].ev_flags) and "has_access_control" in up[0, "upgradeTo"].ev_flags
    assert all(marks <= set(up[i, "upgradeTo"].ev_flags) for i in (1, 3, 4, 5, 6)) and marks <= set(up[0, "transferOwnership"].ev_flags)
    assert up[0, "upgradeTo"].conf == 6.0 and up[1, "upgradeTo"].conf == 2.0 and up[0, "transferOwnership"].conf == 2.0
    why = lambda i: {r.suppressed_reason for r in rows.where(f"target_id = {i}").collect()}
    assert why(2) == {"rpc chain mismatch"} and why(3) == {"no contract code on this chain"} and "target is already initialized" in why(1)
    assert all(not why(i) & {"rpc chain mismatch", "no contract code on this chain", "target is already initialized"} for i in (0, 4, 5, 6))


def test_stored_reads_reach_the_gates(spark):
    from lodegrid.plans.corpus import contract_files, stored_reads
    from lodegrid.plans.pipeline import triage

    sf = "/root/testdata/sf0.001"
    rows = triage(contract_files(spark, sf), "deep", known=stored_reads(spark, sf)).cache()
    why = {r[0] for r in rows.select("suppressed_reason").distinct().collect()}
    assert {"rpc chain mismatch", "no contract code on this chain", "target is already initialized"} <= why


def test_triage_with_value_context_and_liveness(spark):
    from lodegrid.plans.pipeline import triage, value_context

    quiet = "contract C { function initialize(address a) external { owner = a; } }"
    texts = [quiet, quiet, quiet, quiet + " // token.transferFrom(msg.sender, b, 1)", quiet + " // strategy", None]
    files = spark.createDataFrame([(i, "ethereum", "a.sol", 0, t) for i, t in enumerate(texts)], FILE)
    zero = "0x" + "0" * 40
    reads = [(0, "balance", "0"), (0, "owner()", zero), (1, "balance", "12"), (1, "owner()", zero), (2, "owner()", zero), (3, "balance", "0"), (3, "owner()", "0x" + "1" * 40), (4, "totalSupply()", "0x0")]
    known = {"reads": spark.createDataFrame(reads, "target_id long, method string, value string"),
             "references": spark.createDataFrame([(1, 9), (4, 9), (4, 9)], "target_id long, by long"),
             "chain": spark.createDataFrame([(i, i != 2, False, "0x60", False, None) for i in range(5)], "target_id long, rpc_ok boolean, chain_mismatch boolean, code string, live_initialized boolean, admin_kind string"),
             "targets": spark.createDataFrame([(i, f"0x{i}", "Coin") for i in range(6)], "target_id long, address string, contract_name string")}
    got = {r.target_id: tuple(r)[1:] for r in value_context(files, known).collect()}
    assert got == {0: ("no_value", "inert_unreferenced", "none"), 1: ("has_value", "self_holds_value", "present"), 2: ("unknown", "unknown", "none"),
                   3: ("no_value", "value_flows_through", "none"), 4: ("no_value", "value_in_dependents", "present"), 5: ("unknown", "unknown", "none")}
    alone = {r.target_id: (r.value_signal, r.reference_state) for r in value_context(files, {k: known[k] for k in ("reads", "chain")}).collect()}
    assert alone[0] == ("unknown", "unknown") and alone[4] == ("value_in_dependents", "unknown")
    rows = [r for r in triage(files, "deep", known=known).collect() if r.detector == "unprotected_initializer"]
    by = {r.target_id: r for r in rows}
    assert set(by) == {0, 1, 2, 3, 4} and all(by[i].value_state == got[i][0] for i in by)
    assert {i for i in by if "never_initialized" in by[i].ev_flags} == {0, 1}
    assert by[0].impact_score <= 4.0 < by[1].impact_score
