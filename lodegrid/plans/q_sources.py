"""Registered queries: target lists, explorer snapshots, tool outputs, chain reads and build artefacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..rules import graph_rules
from ..operators import protocol
from ..sources import chain, explorer, layouts, targets, tools
from .registry import query, table

HEX = "lower(lpad(hex({0}), 40, '0'))"
DHEX = "lpad(lower(to_hex({0})), 40, '0')"


def _addr(c):
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 40, "0"))


LIST = f"""SELECT c_custkey AS line_no, c_custkey % 400 AS k, CASE c_custkey % 7 WHEN 0 THEN 'bad' WHEN 1 THEN '' ELSE 'ok' END AS st, c_custkey % 4 AS sep, c_mktsegment AS lab, '0x' || {DHEX.format('(c_custkey % 400) + 10')} AS a FROM customer"""


def _lines(spark, sf):
    c = table(spark, sf, "customer")
    k, st, sep = F.col("c_custkey") % 400, F.col("c_custkey") % 7, F.col("c_custkey") % 4
    a = _addr(k + 10)
    seps = F.when(sep == 0, ",").when(sep == 1, " ").when(sep == 2, "\t").otherwise(", ")
    v = F.when(st == 0, "0xnothex,zzz").when(st == 1, "   ").otherwise(F.concat(F.lit("  "), F.when(sep == 1, F.concat(F.lit("0x"), F.upper(F.substring(a, 3, 40)))).otherwise(a), seps, "c_mktsegment"))
    return c.select(F.col("c_custkey").alias("line_no"), v.alias("value"))


@query("scan_target_list", f"WITH l AS ({LIST}), v AS (SELECT * FROM l WHERE st = 'ok') SELECT a AS address_lc, min(line_no) AS line_no, arg_min(lab, line_no) AS label FROM v GROUP BY 1")
def scan_target_list(spark, sf):
    return targets.parse_target_list(_lines(spark, sf)).select("address_lc", "line_no", "label")


@query("scan_target_client", f"WITH l AS ({LIST}), v AS (SELECT * FROM l WHERE st = 'ok' AND sep IN (0, 3)) SELECT a AS address_lc, min(line_no) AS line_no, arg_min(lab, line_no) AS label FROM v GROUP BY 1")
def scan_target_client(spark, sf):
    return targets.parse_client_list(_lines(spark, sf)).select("address_lc", "line_no", "label")


@query("source_decode", """SELECT 'a' || doc_id AS address, p.path, md5(CASE p.path WHEN 'lib/B.sol' THEN lang ELSE text END) AS h FROM documents,
 LATERAL (SELECT unnest(CASE doc_id % 4 WHEN 0 THEN ['src/A.sol', 'lib/B.sol'] WHEN 1 THEN ['src/A.sol', 'lib/B.sol'] WHEN 2 THEN ['src/A.sol'] ELSE ['Main.sol'] END) AS path) p""")
def source_decode(spark, sf):
    d = table(spark, sf, "documents")
    obj = lambda c: F.struct(c.alias("content"))
    m = F.create_map(F.lit("/src/./A.sol"), obj(F.col("text")), F.lit("lib\\B"), obj(F.col("lang")))
    std = F.to_json(F.struct(F.lit("Solidity").alias("language"), m.alias("sources")))
    k = F.col("doc_id") % 4
    code = (F.when(k == 0, F.concat(F.lit("{"), std, F.lit("}"))).when(k == 1, F.to_json(m))
            .when(k == 2, F.to_json(F.create_map(F.lit("src/A.sol"), F.col("text")))).otherwise(F.col("text")))
    rows = d.select(F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("address"), code.alias("source_code"), F.lit("Main").alias("contract_name"))
    return explorer.decode_sources(rows).select("address", "path", F.md5("text").alias("h"))


def _abi(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    arr = lambda *t: F.array(*[F.struct(F.lit(f"x{i}").alias("name"), F.lit(v).alias("type")) for i, v in enumerate(t)])
    none = F.array().cast("array<struct<name:string,type:string>>")
    item = lambda ty, n, i, o: F.struct(F.lit(ty).alias("type"), n.alias("name"), i.alias("inputs"), o.alias("outputs"), F.lit("view").alias("stateMutability"))
    n = lambda s: F.concat(F.lit(s), (k % 5).cast("string"))
    js = F.to_json(F.array(item("function", n("get"), none, arr("address")), item("function", n("put"), arr("uint256", "address"), none), item("event", n("Ev"), none, none),
                           item("function", n("both"), none, F.when(k % 2 == 0, arr("address")).otherwise(arr("address", "bool")))))
    return explorer.parse_abi(p.select(k.alias("target_id"), F.when(k % 3 == 0, F.concat(F.lit('{"abi":'), js, F.lit("}"))).otherwise(js).alias("abi")))


@query("abi_projection", """SELECT p_partkey AS target_id, n || (p_partkey % 5) AS name, n = 'get' OR (n = 'both' AND p_partkey % 2 = 0) AS is_getter FROM part, (VALUES ('get'), ('put'), ('both')) v(n)""")
def abi_projection(spark, sf):
    i = _abi(spark, sf)
    g = explorer.abi_address_getters(i).withColumn("is_getter", F.lit(True))
    return explorer.abi_functions(i).join(g, ["target_id", "name"], "left").select("target_id", "name", F.coalesce("is_getter", F.lit(False)).alias("is_getter"))


@query("abi_union", "SELECT p_partkey AS target_id, CASE p_partkey % 2 WHEN 0 THEN 5 ELSE 6 END AS n FROM part")
def abi_union(spark, sf):
    i = _abi(spark, sf)
    alt = i.withColumn("inputs", F.when((F.col("name").startswith("put")) & (F.col("target_id") % 2 == 1), F.array_repeat(F.get("inputs", F.lit(0)), 3)).otherwise(F.col("inputs")))
    alt = alt.withColumn("name", F.when(F.col("name").startswith("Ev"), F.lit("Other")).otherwise(F.col("name")))
    return explorer.combine_abis(i, alt).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


@query("mirror_fallback", """SELECT 'x' || c_custkey AS address, CASE WHEN own THEN v ELSE coalesce(mv, v) END AS verified, CASE WHEN own OR NOT coalesce(mv, false) THEN n ELSE 2 END AS files, p OR (NOT own AND coalesce(mv, false)) AS is_proxy,
 CASE WHEN c_custkey % 5 = 0 THEN 'impl' WHEN NOT own AND coalesce(mv, false) THEN 'mirror' END AS implementation
FROM (SELECT *, v AND n > 0 AS own FROM (SELECT c_custkey, c_custkey % 3 = 0 AS v, c_custkey % 4 AS n, c_custkey % 7 = 0 AS p FROM customer) LEFT JOIN (SELECT s_suppkey, s_suppkey % 2 = 0 AS mv FROM supplier) ON s_suppkey = c_custkey)""")
def mirror_fallback(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    k = F.col("c_custkey")
    prim = c.select(F.concat(F.lit("x"), k.cast("string")).alias("address"), (k % 3 == 0).alias("verified"), F.slice(F.array(*[F.lit(f"f{i}") for i in range(3)]), F.lit(1), (k % 4).cast("int")).alias("files"),
                    (k % 7 == 0).alias("is_proxy"), F.when(k % 5 == 0, "impl").alias("implementation"))
    mir = s.select(F.concat(F.lit("x"), F.col("s_suppkey").cast("string")).alias("address"), (F.col("s_suppkey") % 2 == 0).alias("verified"), F.array(F.lit("a"), F.lit("b")).alias("files"),
                   F.lit(True).alias("is_proxy"), F.lit("mirror").alias("implementation"))
    d = explorer.with_fallback(prim, mir)
    return d.withColumn("verified", F.col("verified")).select("address", "verified", F.size("files").cast("long").alias("files"), "is_proxy", "implementation")


@query("library_exclusion_fallback", """WITH f AS (SELECT source AS t, CASE WHEN doc_id % 3 = 0 OR source IN ('src3', 'src7') THEN 'lib/solmate/' ELSE 'src/' END || doc_id AS path, doc_id % 3 = 0 OR source IN ('src3', 'src7') AS lib FROM documents)
SELECT t AS target_id, path FROM f WHERE NOT lib OR t IN (SELECT t FROM f GROUP BY t HAVING bool_and(lib))""")
def library_exclusion_fallback(spark, sf):
    d = table(spark, sf, "documents")
    lib = (F.col("doc_id") % 3 == 0) | F.col("source").isin("src3", "src7")
    return explorer.drop_libraries(d.select(F.col("source").alias("target_id"), F.concat(F.when(lib, "Lib/Solmate/").otherwise("src/"), F.col("doc_id").cast("string")).alias("path"))).select(
        "target_id", F.replace("path", F.lit("Lib/Solmate/"), F.lit("lib/solmate/")).alias("path"))


@query("main_source", """WITH f AS (SELECT source AS target_id, CASE WHEN doc_id % 4 = 0 THEN '_implementation/' ELSE 'src/' END || 'F' || (doc_id % 9) || '_' || doc_id || '.sol' AS path, length(text) AS n, doc_id, CASE WHEN doc_id % 11 = 5 THEN 1 ELSE 0 END AS hit FROM documents)
SELECT target_id, CASE WHEN hit = 1 THEN 'src/Target.sol' || doc_id ELSE path END AS path FROM f QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN path LIKE '%\\_implementation/%' ESCAPE '\\' AND hit = 0 THEN 1 ELSE 0 END, n DESC, CASE WHEN hit = 1 THEN 'src/Target.sol' || doc_id ELSE path END) = 1""".replace("\\\\", "\\"))
def main_source(spark, sf):
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    path = F.when(k % 11 == 5, F.concat(F.lit("src/Target.sol"), k.cast("string"))).otherwise(
        F.concat(F.when(k % 4 == 0, "_implementation/").otherwise("src/"), F.lit("F"), (k % 9).cast("string"), F.lit("_"), k.cast("string"), F.lit(".sol")))
    f = d.select(F.col("source").alias("target_id"), path.alias("path"), "text")
    return explorer.main_source(f, f.select("target_id").distinct().withColumn("contract_name", F.lit("Nobody")))


@query("deployer_creations", f"""WITH d AS (SELECT 'd' || (o_custkey % 30) AS deployer, '0x' || {DHEX.format('o_orderkey % 3000')} AS address, o_orderkey AS block, 0 AS src FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3000 <> 0),
i AS (SELECT 'd' || (l_suppkey % 30) AS deployer, '0x' || {DHEX.format('l_orderkey % 3000')} AS address, l_orderkey AS block, 1 AS src FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey % 3000 <> 0)
SELECT deployer, address, block FROM (SELECT * FROM d UNION ALL SELECT * FROM i) QUALIFY row_number() OVER (PARTITION BY deployer, address ORDER BY src, block DESC) = 1""")
def deployer_creations(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    d = o.select(F.concat(F.lit("d"), (F.col("o_custkey") % 30).cast("string")).alias("deployer"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("0xsome").alias("to"),
                 _addr(F.col("o_orderkey") % 3000).alias("contract_address"), F.col("o_orderkey").alias("block"))
    i = li.select(F.concat(F.lit("d"), (F.col("l_suppkey") % 30).cast("string")).alias("deployer"), F.when(F.col("l_returnflag") == "R", "create2").otherwise("call").alias("type"),
                  _addr(F.col("l_orderkey") % 3000).alias("contract_address"), F.col("l_orderkey").alias("block"))
    return explorer.creations(d, i)


@query("module_expansion", f"""WITH m AS (SELECT o_orderkey AS target_id, g, k, '0x' || {DHEX.format('a')} AS module FROM (
 SELECT o_orderkey, 0 AS g, k, (o_custkey + k) % 50 + 1 AS a FROM orders, (VALUES (0), (1), (2)) v(k)
 UNION ALL SELECT o_orderkey, 1, k, (o_custkey * k) % 50 + 1 FROM orders, (VALUES (2), (500000)) v(k))),
f AS (SELECT target_id, module, min(struct_pack(g := g, k := k)) AS o FROM m WHERE module <> '0x' || {DHEX.format('7')} GROUP BY 1, 2),
s AS (SELECT DISTINCT '0x' || {DHEX.format('p_partkey')} AS module FROM part WHERE p_partkey % 2 = 0),
r AS (SELECT f.*, row_number() OVER (PARTITION BY target_id ORDER BY o) AS rn FROM f SEMI JOIN s USING (module))
SELECT target_id, '_modules/' || module || '/M.sol' AS path FROM r WHERE rn <= 2""")
def module_expansion(spark, sf):
    o = table(spark, sf, "orders")
    w = lambda c: F.lpad(F.lower(F.hex(c)), 64, "0")
    arr = F.concat(F.lit("0x"), w(F.lit(32)), w(F.lit(3)), *[w((F.col("o_custkey") + i) % 50 + 1) for i in range(3)])
    facets = o.select(F.col("o_orderkey").alias("target_id"), F.lit("facetAddresses()").alias("method"), F.lit(None).cast("string").alias("arg"), arr.alias("value"))
    mods = o.select(F.col("o_orderkey").alias("target_id"), F.lit("moduleIdToImplementation(uint256)").alias("method"), F.explode(F.array(F.lit("2"), F.lit("500000"))).alias("arg"), "o_custkey").withColumn(
        "value", F.concat(F.lit("0x"), w((F.col("o_custkey") * F.col("arg").cast("long")) % 50 + 1))).drop("o_custkey")
    t = o.select(F.col("o_orderkey").alias("target_id"), _addr(F.lit(7)).alias("address"))
    m = explorer.module_addresses(facets.unionByName(mods), t)
    src = table(spark, sf, "part").where("p_partkey % 2 = 0").select(_addr(F.col("p_partkey")).alias("address"), F.lit("M.sol").alias("path"), F.col("p_name").alias("text"))
    return explorer.expand_modules(m, src, 2).select("target_id", "path")


@query("source_union", """SELECT target_id, path, arg_max(v, src) AS v FROM (SELECT p_partkey AS target_id, 'A.sol' AS path, 'p' AS v, 0 AS src FROM part UNION ALL SELECT p_partkey, '_implementation/A.sol', 'i', 1 FROM part WHERE p_partkey % 2 = 0
 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'A.sol' ELSE '_modules/x/A.sol' END, 'm', 2 FROM part) GROUP BY 1, 2""")
def source_union(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("target_id"))
    a = p.select("target_id", F.lit("A.sol").alias("path"), F.lit("p").alias("text"))
    i = p.where("target_id % 2 = 0").select("target_id", F.lit("A.sol").alias("path"), F.lit("i").alias("text"))
    m = p.select("target_id", F.when(F.col("target_id") % 3 == 0, "A.sol").otherwise("_modules/x/A.sol").alias("path"), F.lit("m").alias("text"))
    return explorer.merge_sources(a, i, m).select("target_id", "path", F.col("text").alias("v"))


@query("repository_context", """WITH f AS (SELECT source AS target_id, 'f' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS path, length(text) AS n FROM documents),
k AS (SELECT *, row_number() OVER w AS rn, coalesce(sum(n) OVER (PARTITION BY target_id ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM f WINDOW w AS (PARTITION BY target_id ORDER BY path))
SELECT target_id, path, least(n, 60000 - used)::BIGINT AS kept FROM k WHERE rn <= 40 AND used < 60000""")
def repository_context(spark, sf):
    f = table(spark, sf, "documents").select(F.col("source").alias("target_id"), F.concat(F.lit("f"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("path"), "text")
    return explorer.repository_context(f).select("target_id", "path", F.length("text").cast("long").alias("kept"))


def _reads(spark, sf):
    """Wide chain reads of every customer; NULL where a read failed."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    word = lambda v: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(v)), 64, "0"))
    w = c.select(
        k.alias("target_id"), F.when(k % 5 == 0, word(k + 1)).alias("impl_slot"), F.when(k % 2 == 0, word(k + 2)).alias("admin_slot"), F.when(k % 7 == 0, word(k + 3)).alias("beacon_slot"),
        F.when(k % 11 == 0, word(k + 4)).otherwise(word(F.lit(0))).alias("legacy_slot"), F.when(k % 3 == 0, _addr(k + 5)).alias("beacon_implementation"),
        F.when(k % 13 == 0, F.concat(F.lit("0x363d3d373d3d3d363d73"), F.substring(_addr(k + 6), 3, 40), F.lit("5af4"))).when(k % 17 == 0, "0x").when(k % 19 != 0, "0x6001").alias("code"),
        F.when(k % 23 == 0, _addr(k + 7)).alias("implementation()"), F.lit(None).cast("string").alias("getImplementation()"), F.lit(None).cast("string").alias("masterCopy()"),
        F.when(k % 4 == 1, _addr(k + 8)).alias("admin()"), F.lit(None).cast("string").alias("proxyAdmin()"), F.lit(None).cast("string").alias("getProxyAdmin()"),
        F.when(k % 6 == 0, _addr(k + 9)).alias("owner()"), F.lit(None).cast("string").alias("admin_owner"), F.when(k % 10 == 1, "2").alias("getThreshold()"), F.when(k % 10 == 2, "3600").alias("getMinDelay()"),
        F.when(k % 3 == 1, "0").when(k % 3 == 2, "12").alias("balance"), F.when(k % 8 == 0, "0").alias("totalAssets()"), F.when(k % 9 == 0, "5").alias("totalSupply()"), F.lit(None).cast("string").alias("asset_balance"),
        F.when(k % 29 == 0, _addr(k + 10)).alias("explorer_impl"))
    return w


@query("proxy_resolution", """SELECT c_custkey AS target_id, CASE WHEN i THEN CASE WHEN a THEN 'eip1967-transparent' ELSE 'eip1967-uups' END WHEN b AND (bi OR l OR NOT m) THEN 'eip1967-beacon' WHEN l THEN 'legacy-zos' WHEN m THEN 'eip1167-minimal' WHEN g THEN 'abi-getter' WHEN e THEN 'explorer-reported' END AS proxy_type,
 '0x' || lpad(lower(to_hex(CASE WHEN i THEN c_custkey + 1 WHEN b AND bi THEN c_custkey + 5 WHEN l THEN c_custkey + 4 WHEN m THEN c_custkey + 6 WHEN g THEN c_custkey + 7 WHEN e THEN c_custkey + 10 END)), 40, '0') AS implementation, i OR b OR l OR m OR g OR e AS is_proxy
FROM (SELECT c_custkey, c_custkey % 5 = 0 AS i, c_custkey % 2 = 0 AS a, c_custkey % 7 = 0 AS b, c_custkey % 3 = 0 AS bi, c_custkey % 11 = 0 AS l, c_custkey % 13 = 0 AS m, c_custkey % 23 = 0 AS g, c_custkey % 29 = 0 AS e FROM customer)""")
def proxy_resolution(spark, sf):
    return chain.resolve_proxy(_reads(spark, sf)).select("target_id", "proxy_type", "implementation", "is_proxy")


@query("admin_class", """SELECT c_custkey AS target_id, CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AND c_custkey % 19 = 0 THEN 'unknown' WHEN c_custkey % 13 <> 0 AND c_custkey % 17 = 0 THEN 'eoa' WHEN c_custkey % 10 = 1 THEN 'gnosis_safe' WHEN c_custkey % 10 = 2 THEN 'timelock' ELSE 'contract' END AS kind FROM customer""")
def admin_class(spark, sf):
    return chain.classify_admin(_reads(spark, sf)).select("target_id", "kind")


@query("value_context", """WITH a AS (SELECT c_custkey AS k, c_custkey % 6 <> 0 AS ok, c_custkey % 3 AS b, c_custkey % 8 AS ta, c_custkey % 9 AS ts, c_custkey % 4 AS r FROM customer),
s AS (SELECT *, CASE WHEN NOT ok THEN 'unknown' WHEN b = 2 OR ts = 0 THEN 'has_value' WHEN b = 0 AND ta <> 0 AND ts <> 0 THEN 'unknown' ELSE 'no_value' END AS st FROM a)
SELECT k AS target_id, st AS value_state, CASE WHEN st = 'has_value' THEN 'self_holds_value' WHEN st = 'unknown' THEN 'unknown' WHEN k % 7 = 0 THEN 'value_flows_through' WHEN r = 1 THEN 'value_in_dependents' WHEN k % 5 = 0 AND r NOT IN (1, 2) THEN 'value_in_dependents' WHEN r = 2 THEN 'inert_unreferenced' ELSE 'unknown' END AS value_signal,
 CASE WHEN r = 1 THEN 'present' WHEN r = 2 THEN 'none' ELSE 'unknown' END AS reference_state FROM s""")
def value_context(spark, sf):
    k = F.col("target_id")
    w = _reads(spark, sf).withColumns({"rpc_ok": k % 6 != 0, "flow_hint": k % 7 == 0, "dependent_hint": k % 5 == 0, "referenced_by_count": F.when(k % 4 == 1, 3).when(k % 4 == 2, 0)})
    return chain.value_context(w)


@query("chain_reads_pivot", "SELECT l_orderkey AS target_id, max(CASE WHEN l_linenumber % 3 = 0 THEN l_partkey END)::VARCHAR AS balance, max(CASE WHEN l_linenumber % 3 = 1 THEN l_suppkey END)::VARCHAR AS code FROM lineitem GROUP BY 1")
def chain_reads_pivot(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber") % 3
    f = li.select(F.col("l_orderkey").alias("target_id"), F.when(n == 0, "balance").when(n == 1, "code").otherwise("other").alias("method"),
                  F.when(n == 0, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("value"))
    return chain.wide(f).select("target_id", F.col("balance").cast("string").alias("balance"), F.col("code").cast("string").alias("code"))


def _tool_json(spark, sf, kind):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = F.struct
    lit = F.lit
    if kind == "slither":
        el = lambda t, n, par: s(lit(t).alias("type"), n.alias("name"), s(lit("a.sol").alias("filename_short"), F.array(lit(1), lit(2)).alias("lines")).alias("source_mapping"),
                                 s(s(lit("function").alias("type"), par.alias("name")).alias("parent")).alias("type_specific_fields"))
        els = F.when(c % 3 == 0, F.array(el("node", lit("n"), lit("outer")))).when(c % 3 == 1, F.array(el("node", lit("n"), lit("outer")), el("function", lit("inner"), lit("")))).otherwise(F.slice(F.array(el("x", lit("n"), lit("outer"))), 1, 0))
        d = s(F.when(k % 5 == 0, "suicidal").otherwise(F.concat(lit("check-"), (k % 4).cast("string"))).alias("check"), F.when(c % 4 == 0, "High").when(c % 4 == 1, "Medium").otherwise("Low").alias("impact"), lit("Medium").alias("confidence"), F.col("o_orderpriority").alias("description"), els.alias("elements"))
        body = F.to_json(s(s(F.array(d).alias("detectors")).alias("results"), lit(True).alias("success")))
    elif kind == "semgrep":
        r = s(F.concat(lit("rule."), (k % 4).cast("string")).alias("check_id"), lit("b.sol").alias("path"), s((c % 90).alias("line")).alias("start"),
              s(lit("ERROR").alias("severity"), F.col("o_orderpriority").alias("message"), s(lit("HIGH").alias("confidence")).alias("metadata")).alias("extra"))
        body = F.to_json(s(F.array_repeat(r, (c % 3).cast("int")).alias("results")))
    elif kind == "mythril":
        i = s(F.when(k % 2 == 0, "Unchecked Call").otherwise("").alias("title"), F.concat(lit("SWC-"), (k % 9).cast("string")).alias("swc-id"), lit("High").alias("severity"), F.col("o_orderpriority").alias("description"), lit("m.sol").alias("filename"), (c % 7).alias("lineno"))
        body = F.to_json(s(F.array(i).alias("issues"), lit(True).alias("success")))
    elif kind == "aderyn":
        i = s(lit("Big Thing").alias("title"), F.when(k % 3 == 0, "A big thing here").otherwise("plain").alias("description"), F.when(k % 2 == 0, "det-x").otherwise("").alias("detector_name"), F.array(s(lit("c.sol").alias("contract_path"), (c % 5).alias("line_no"))).alias("instances"))
        body = F.to_json(s(s(F.array(i).alias("issues")).alias("high_issues"), s(F.array_repeat(i, (c % 2).cast("int")).alias("issues")).alias("low_issues"), s(lit(1).alias("total")).alias("files_summary")))
    else:
        t = lambda ok: s(ok.alias("success"))
        st = lambda v: s(lit(v).alias("status"))
        m = F.create_map(lit("t1"), s(F.when(k % 2 == 0, "Success").otherwise("Failure").alias("status")), lit("t2"), s(lit("Success").alias("status")))
        body = F.when(k % 4 == 3, lit("compiler failed")).otherwise(F.concat(lit("Compiling...\n"), F.to_json(F.create_map(lit("A.t.sol:A"), s(m.alias("test_results"))))))
    return o.select(k.alias("target_id"), body.alias("body"))


@query("tool_slither", """SELECT o_orderkey AS target_id, CASE WHEN o_orderkey % 5 = 0 THEN 'suicidal' ELSE 'check-' || (o_orderkey % 4) END AS "check", CASE o_custkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact,
 CASE WHEN o_custkey % 3 = 2 THEN '' ELSE 'a.sol:[1,2]' END AS location, CASE o_custkey % 3 WHEN 0 THEN 'outer' WHEN 1 THEN 'inner' ELSE '' END AS function, o_orderkey % 5 = 0 AS high_value FROM orders WHERE o_custkey % 4 < 2 OR o_orderkey % 5 = 0""")
def tool_slither(spark, sf):
    return tools.slither(_tool_json(spark, sf, "slither")).select("target_id", "check", "impact", "location", "function", "high_value")


@query("tool_semgrep", """SELECT o_orderkey AS target_id, 'rule.' || (o_orderkey % 4) AS "check", 'error' AS impact, 'HIGH' AS confidence, o_orderpriority AS description, 'b.sol:' || (o_custkey % 90) AS location FROM orders, range(0, o_custkey % 3) r""")
def tool_semgrep(spark, sf):
    return tools.semgrep(_tool_json(spark, sf, "semgrep")).select("target_id", "check", "impact", "confidence", "description", "location")


@query("tool_mythril", """SELECT o_orderkey AS target_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Unchecked Call' ELSE 'SWC-' || (o_orderkey % 9) END AS "check", 'high' AS impact, 'm.sol:' || (o_custkey % 7) AS location, o_orderkey % 2 = 0 AS high_value FROM orders""")
def tool_mythril(spark, sf):
    return tools.mythril(_tool_json(spark, sf, "mythril")).select("target_id", "check", "impact", "location", "high_value")


@query("tool_aderyn", """SELECT o_orderkey AS target_id, CASE WHEN o_orderkey % 2 = 0 THEN 'det-x' ELSE 'big-thing' END AS "check", sev AS impact, CASE WHEN o_orderkey % 3 = 0 THEN 'A big thing here' ELSE 'Big Thing. plain' END AS description, 'c.sol:' || (o_custkey % 5) AS location
 FROM orders, (VALUES ('high'), ('low')) v(sev) WHERE sev = 'high' OR o_custkey % 2 = 1""")
def tool_aderyn(spark, sf):
    return tools.aderyn(_tool_json(spark, sf, "aderyn")).select("target_id", "check", "impact", "description", "location")


@query("tool_forge", "SELECT o_orderkey AS target_id, CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 2 END AS tests_run, CASE WHEN o_orderkey % 4 = 3 THEN 0 WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS tests_passed FROM orders")
def tool_forge(spark, sf):
    return tools.forge_counts(_tool_json(spark, sf, "forge"))


@query("analyzer_findings", """SELECT o_orderkey AS target_id, 'slither:' || CASE WHEN o_orderkey % 5 = 0 THEN 'suicidal' ELSE 'check-' || (o_orderkey % 4) END AS detector,
 '[slither] ' || CASE WHEN o_orderkey % 5 = 0 THEN 'suicidal' ELSE 'check-' || (o_orderkey % 4) END || CASE o_custkey % 3 WHEN 0 THEN ': outer' WHEN 1 THEN ': inner' ELSE '' END AS title,
 CASE WHEN o_orderkey % 5 = 0 THEN 9 WHEN o_custkey % 4 = 0 THEN 8 ELSE 6 END::DOUBLE AS impact, 5.0::DOUBLE AS conf FROM orders WHERE o_custkey % 4 < 2 OR o_orderkey % 5 = 0""")
def analyzer_findings(spark, sf):
    return graph_rules.analyzer_findings(tools.slither(_tool_json(spark, sf, "slither"))).select("target_id", "detector", "title", "impact", "conf")


@query("exact_layouts", """SELECT p_partkey AS target_id, CASE WHEN p_partkey % 3 = 2 THEN 'big' ELSE 'Main' END AS contract_name, e.label, e.slot FROM part, LATERAL (SELECT unnest(CASE WHEN p_partkey % 3 = 2 THEN ['x', 'y', 'z'] ELSE ['owner', 'supply'] END) AS label,
 unnest(CASE WHEN p_partkey % 3 = 2 THEN [0, 16, 2] ELSE [0, p_partkey % 10] END)::BIGINT AS slot) e""")
def exact_layouts(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    e = lambda l, s: F.struct(F.lit(l).alias("label"), s.alias("slot"), F.lit("0").alias("offset"), F.lit("t_uint256").alias("type"))
    small = F.struct(F.array(e("owner", F.lit("0")), e("supply", (k % 10).cast("string"))).alias("storage"))
    big = F.struct(F.array(e("x", F.lit("0")), e("y", F.lit("0x10")), e("z", F.lit("2"))).alias("storage"))
    doc = F.when(k % 3 == 0, F.to_json(F.struct(F.lit("Main").alias("contractName"), small.alias("storageLayout")))).otherwise(
        F.to_json(F.struct(F.struct(F.create_map(F.lit("src/M.sol"), F.create_map(F.lit("Main"), F.struct(small.alias("storageLayout")), F.lit("big"), F.struct(big.alias("storageLayout")))).alias("contracts")).alias("output"))))
    docs = p.select(k.alias("target_id"), F.lit("build-info/a.json").alias("artifact"), doc.alias("body"))
    names = p.select(k.alias("target_id"), F.when(k % 3 == 2, "nobody").otherwise("main").alias("contract_name"))
    files = p.select(k.alias("target_id"), F.lit("other/Z.sol").alias("path"))
    sel = layouts.select_layout(layouts.layouts(docs), names, files)
    return layouts.entries(sel).join(sel.select("target_id", "contract_name"), "target_id").select("target_id", "contract_name", "label", "slot")


ROLES = "SELECT l_orderkey AS target_id, CASE l_linenumber % 5 WHEN 0 THEN 'DEFAULT_ADMIN_ROLE' WHEN 1 THEN 'TIMELOCK_ADMIN_ROLE' WHEN 2 THEN 'PROPOSER_ROLE' WHEN 3 THEN 'CANCELLER_ROLE' ELSE 'EXECUTOR_ROLE' END AS role, bool_or(l_partkey % 9 = 0) AS o FROM lineitem GROUP BY 1, 2"


def _roles(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.col("l_linenumber") % 5
    role = F.when(n == 0, "DEFAULT_ADMIN_ROLE").when(n == 1, "TIMELOCK_ADMIN_ROLE").when(n == 2, "PROPOSER_ROLE").when(n == 3, "CANCELLER_ROLE").otherwise("EXECUTOR_ROLE")
    return li.groupBy(F.col("l_orderkey").alias("target_id"), role.alias("role")).agg(F.bool_or(F.col("l_partkey") % 9 == 0).alias("zero_has")).withColumn("dead_has", F.lit(None).cast("boolean"))


@query("timelock_roles", f"""WITH r AS ({ROLES}), o AS (SELECT * FROM r WHERE o), p AS (SELECT target_id FROM o WHERE role = 'PROPOSER_ROLE')
SELECT target_id, role AS function, CASE role WHEN 'DEFAULT_ADMIN_ROLE' THEN 10 WHEN 'CANCELLER_ROLE' THEN 7 WHEN 'EXECUTOR_ROLE' THEN CASE WHEN target_id IN (SELECT target_id FROM p) THEN 5 ELSE 4 END ELSE 9 END::DOUBLE AS impact,
 CASE WHEN role = 'EXECUTOR_ROLE' AND target_id NOT IN (SELECT target_id FROM p) THEN 5 ELSE 7 END::DOUBLE AS conf FROM o
UNION ALL SELECT o_orderkey, NULL, 2.0, 4.0 FROM orders WHERE o_custkey % 2 = 0 AND o_orderkey NOT IN (SELECT target_id FROM o)""")
def timelock_roles(spark, sf):
    delays = table(spark, sf, "orders").select(F.col("o_orderkey").alias("target_id"), F.when(F.col("o_custkey") % 2 == 0, 3600).alias("min_delay"))
    return graph_rules.timelock_roles(_roles(spark, sf), delays).select("target_id", "function", "impact", "conf")


@query("governance_blast_radius", f"""WITH r AS ({ROLES}), o AS (SELECT target_id, bool_or(role IN ('DEFAULT_ADMIN_ROLE', 'TIMELOCK_ADMIN_ROLE', 'PROPOSER_ROLE')) AS crit FROM r WHERE o GROUP BY 1),
f AS (SELECT o_orderkey AS target_id, o_custkey % 4 = 0 AS unguarded FROM orders WHERE o_custkey % 4 < 2 UNION ALL SELECT o_orderkey, false FROM orders WHERE o_custkey % 5 = 0), t AS (SELECT target_id, bool_or(unguarded) AS u FROM f GROUP BY 1), d AS (SELECT t.*, o.crit FROM t LEFT JOIN o USING (target_id))
SELECT target_id, 'unguarded' AS variant, 9.0::DOUBLE AS impact, 6.0::DOUBLE AS conf FROM d WHERE u UNION ALL SELECT target_id, 'open_role', CASE WHEN crit THEN 9 ELSE 6 END, CASE WHEN crit THEN 7 ELSE 5 END FROM d WHERE crit IS NOT NULL
UNION ALL SELECT target_id, 'by_design', 8.0, 2.0 FROM d WHERE NOT u AND crit IS NULL""")
def governance_blast_radius(spark, sf):
    o = table(spark, sf, "orders")
    c = F.col("o_custkey") % 4
    fns = o.select(F.col("o_orderkey").alias("target_id"), F.when(c < 2, "pause").otherwise("peek").alias("name"), F.when(c == 0, "external").otherwise("external onlyOwner").alias("tail"))
    abi = o.where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("target_id"), F.lit("diamondCut").alias("name"))
    return graph_rules.governance_blast_radius(fns, abi, _roles(spark, sf)).select("target_id", "variant", "impact", "conf")


@query("companion_select", f"""WITH n AS (SELECT l_orderkey % 300 AS target_id, CASE l_partkey % 4 WHEN 0 THEN 'oracle' WHEN 1 THEN 'router' WHEN 2 THEN 'asset' ELSE 'strategy' END AS role, 'n' || (l_suppkey % 40) AS label, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE '0x' || {DHEX.format('l_suppkey % 40 + 1')} END AS address FROM lineitem),
c AS (SELECT target_id, lower(coalesce(address, role || ':' || label || ':s')) AS k, min(role || label) AS id FROM n WHERE role <> 'asset' AND (address IS NULL OR address <> '0x' || {DHEX.format('target_id % 40 + 1')}) GROUP BY 1, 2),
m AS (SELECT coalesce(address, '0x' || {DHEX.format('x.target_id % 40 + 1')} || ':' || role || ':' || label) AS mk, x.target_id, role || label AS id, address, role, label FROM (SELECT DISTINCT n.* FROM n JOIN c ON c.target_id = n.target_id AND c.k = lower(coalesce(n.address, n.role || ':' || n.label || ':s')) AND c.id = n.role || n.label) x),
g AS (SELECT mk, arg_min(struct_pack(address := address, role := role, label := label), struct_pack(t := target_id, i := id)) AS c FROM m GROUP BY 1)
SELECT c.address, c.role, c.label FROM g WHERE c.address IS NOT NULL AND c.address NOT IN (SELECT '0x' || {DHEX.format('s_suppkey')} FROM supplier WHERE s_suppkey % 2 = 0)
ORDER BY CASE c.role WHEN 'oracle' THEN 0 WHEN 'router' THEN 5 ELSE 8 END, c.label, c.address LIMIT 8""")
def companion_select(spark, sf):
    li = table(spark, sf, "lineitem")
    k = F.col("l_partkey")
    role = F.when(k % 4 == 0, "oracle").when(k % 4 == 1, "router").when(k % 4 == 2, "asset").otherwise("strategy")
    lab = F.concat(F.lit("n"), (F.col("l_suppkey") % 40).cast("string"))
    n = li.select((F.col("l_orderkey") % 300).alias("target_id"), F.concat(role, lab).alias("id"), role.alias("role"), lab.alias("label"), F.when(k % 3 != 0, _addr(F.col("l_suppkey") % 40 + 1)).alias("address"),
                  F.lit("s").alias("source"), F.lit(0.5).alias("confidence")).distinct()
    t = n.select("target_id").distinct().withColumn("address", _addr(F.col("target_id") % 40 + 1))
    known = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").select(_addr(F.col("s_suppkey")).alias("address"))
    merged = protocol.merge_companions(protocol.companions(n, t), t)
    return protocol.select_companions(merged, known, protocol.expansion_cap(None)).select("address", "role", "label")
