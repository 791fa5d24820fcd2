"""Registered queries: candidate passes (keys, suppression, corroboration, collapse, score, priority, guardrails)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import dedup, gates, scoring
from ..operators.ordering import ranked
from ..functions import scalars as sc
from .derived import CANDIDATES, POS, candidates, rel
from .registry import query, table

C = f"c AS ({CANDIDATES})"
NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '0x[0-9a-fA-F]{{4,}}', '0x', 'g'), '\b\d+\b', 'n', 'g'), '\s+', ' ', 'g'))"
NT = NORM.format("title")
BASE = "list_extract(string_split(file, '/'), -1)"
SQ = r"regexp_replace(snippet, '\s+', '', 'g')"
CKEY = f"concat_ws('|', detector, lower(fn), coalesce(rule_id, {NT}), CASE WHEN {SQ} <> '' THEN substring(sha1({SQ}), 1, 12) ELSE '' END)"


@query("candidate_fingerprint", f"WITH {C} SELECT target_id, pos, sha1(concat_ws('|', detector, fn, {NT}, {BASE})) AS fingerprint, "
       f"concat('pat:', sha1(concat_ws('|', detector, lower(fn), coalesce(rule_id, bug_class), bug_class, CASE WHEN contains(lower({SQ}), 'onlyowner') THEN 'onlyowner' ELSE '' END))) AS pattern_fingerprint, "
       f"{CKEY} AS content_key FROM c")
def candidate_fingerprint(spark, sf):
    return dedup.with_keys(candidates(spark, sf)).select("target_id", "pos", "fingerprint", "pattern_fingerprint", "content_key")


SUPP = ("SELECT sha1(concat_ws('|', 'k', CAST(o_orderkey % 40 AS VARCHAR(9)))) AS fingerprint, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('0xA', CAST(o_custkey % 60 AS VARCHAR(9))) END AS address, "
        "concat('why ', o_orderpriority) AS reason FROM orders ")
SUBJ = (f"SELECT l_orderkey AS target_id, {POS} AS pos, sha1(concat_ws('|', 'k', CAST(l_partkey % 400 AS VARCHAR(9)))) AS fingerprint, concat('0xa', CAST(l_suppkey % 90 AS VARCHAR(9))) AS address, "
        "sha1(concat_ws('|', 'k', CAST(l_suppkey % 200 AS VARCHAR(9)))) AS pattern_fingerprint FROM lineitem ")


@query("suppression_list", f"WITH s AS ({SUPP}) SELECT fingerprint, address, reason, row_number() OVER (ORDER BY fingerprint NULLS FIRST, address NULLS FIRST, reason NULLS FIRST) AS rank_no FROM s")
def suppression_list(spark, sf):
    """All suppressions; the table carries no time, so they are ordered by key."""
    return ranked(rel(spark, sf, SUPP).select("fingerprint", "address", "reason"), "fingerprint", "address", "reason")


@query("rule_lookup", f"""WITH {C}, m AS (SELECT rule_id, arg_min(title, struct_pack(t := target_id, p := pos)) AS title, count(*) AS raw_hits, array_to_string(list_sort(list(DISTINCT target_id))[1:3], ',') AS examples FROM c WHERE rule_id IS NOT NULL GROUP BY 1)
SELECT c.target_id, c.pos, c.rule_id, m.title AS rule_title, m.raw_hits, m.examples FROM c LEFT JOIN m USING (rule_id)""")
def rule_lookup(spark, sf):
    """Candidates with what is known of their rule; the lookup has a row for each rule."""
    c = candidates(spark, sf).select("target_id", "pos", "rule_id", "title")
    m = agg.rule_lookup(c).select("rule_id", F.col("title").alias("rule_title"), "raw_hits", F.array_join(F.col("examples").cast("array<string>"), ",").alias("examples"))
    return c.drop("title").join(m, "rule_id", "left").select("target_id", "pos", "rule_id", "rule_title", "raw_hits", "examples")


@query("suppress_null_global", f"""
WITH s AS ({SUPP}), c AS ({SUBJ}),
g AS (SELECT fingerprint, min(reason) AS r FROM s WHERE address IS NULL GROUP BY 1),
a AS (SELECT fingerprint, lower(address) AS al, min(reason) AS r FROM s WHERE address IS NOT NULL GROUP BY 1, 2)
SELECT c.target_id, c.pos, (g.r IS NOT NULL OR a.r IS NOT NULL) AS suppressed, coalesce(g.r, a.r) AS suppressed_reason,
  CASE WHEN g.r IS NULL AND a.r IS NULL THEN p.r END AS prior_refutation
FROM c LEFT JOIN g ON g.fingerprint = c.fingerprint LEFT JOIN a ON a.fingerprint = c.fingerprint AND a.al = lower(c.address)
LEFT JOIN g p ON p.fingerprint = c.pattern_fingerprint""")
def suppress_null_global(spark, sf):
    c = rel(spark, sf, SUBJ).withColumns({"suppressed": F.lit(False), "suppressed_reason": F.lit(None).cast("string")})
    return dedup.suppress(c, rel(spark, sf, SUPP)).select("target_id", "pos", "suppressed", "suppressed_reason", "prior_refutation")


@query("corroborate", f"""
WITH {C}, live AS (SELECT * FROM c WHERE NOT suppressed),
k AS (SELECT target_id, fn, list_sort(list(DISTINCT detector)) AS ds FROM live GROUP BY 1, 2 HAVING count(DISTINCT detector) >= 2)
SELECT c.target_id, c.pos, c.detector, k.ds IS NOT NULL AS corroborated, array_to_string(list_filter(k.ds, lambda d: d <> c.detector), ',') AS by_detectors
FROM c LEFT JOIN k ON k.target_id = c.target_id AND k.fn = c.fn AND NOT c.suppressed""")
def corroborate(spark, sf):
    d = scoring.corroborate(candidates(spark, sf).drop("corroborated", "corroborated_by"), ["target_id"])
    return d.select("target_id", "pos", "detector", "corroborated", F.array_join("corroborated_by", ",").alias("by_detectors"))


@query("collapse_dups", f"""
WITH {C}, k AS (SELECT *, {CKEY} AS content_key FROM c)
SELECT bug_class, content_key, arg_min(fn, target_id * 1000000000 + pos) AS fn, max(impact) AS impact, max(conf) AS conf, count(*) AS dup_count,
  arg_min(target_id, target_id * 1000000000 + pos) AS target_id FROM k GROUP BY 1, 2""")
def collapse_dups(spark, sf):
    c = dedup.with_keys(candidates(spark, sf)).withColumn("pos", F.col("target_id") * 1000000000 + F.col("pos"))
    return dedup.collapse_duplicates(c, ["bug_class"]).select("bug_class", "content_key", "fn", "impact", "conf", "dup_count", "target_id")


@query("duplicate_files", f"""
WITH {C}, k AS (SELECT *, {CKEY} AS content_key, target_id * 1000000000 + pos AS p FROM c),
m AS (SELECT bug_class, content_key, arg_min(file, p) AS main_file FROM k GROUP BY 1, 2)
SELECT k.bug_class, k.content_key, k.file AS also_in_file, min(p) AS first_pos FROM k JOIN m USING (bug_class, content_key) WHERE k.file <> m.main_file GROUP BY 1, 2, 3""")
def duplicate_files(spark, sf):
    c = dedup.with_keys(candidates(spark, sf)).withColumn("pos", F.col("target_id") * 1000000000 + F.col("pos"))
    return dedup.duplicate_files(c, ["bug_class"])


LADDER = f"""
WITH {C}, a AS (SELECT *, coalesce(value_state, '') AS vs, greatest(0, least(10, impact)) AS i0, conf AS c0,
    detector IN ('reentrancy', 'access_control') OR coalesce(tier, '') = 'confirmable' AS structural,
    lead_only OR coalesce(tier, '') = 'lead_only' AS is_lead FROM c),
b AS (SELECT *, vs = 'no_value' AND value_signal = 'inert_unreferenced' AS inert FROM a),
b2 AS (SELECT *, NOT inert AND f_never_initialized AND vs = 'no_value' AND reference_state = 'none' AS dead FROM b),
d AS (SELECT *, CASE WHEN inert THEN least(i0, 4) WHEN dead THEN least(i0, 5) ELSE i0 END AS i1,
    CASE WHEN inert THEN least(c0, 2) WHEN dead THEN least(c0, 3) ELSE c0 END
    + CASE WHEN tool_agree THEN 2 ELSE 0 END - CASE WHEN f_governance_controlled THEN 3 ELSE 0 END - CASE WHEN f_documented_centralization THEN 3 ELSE 0 END
    + CASE WHEN f_open_roles THEN 1 ELSE 0 END + CASE WHEN f_poc_passed THEN 2 ELSE 0 END + CASE WHEN f_critical_slots THEN 0.5 ELSE 0 END AS c1 FROM b2),
e AS (SELECT *, CASE WHEN f_refuted AND structural AND NOT suppressed AND {{ultra}} THEN 4 WHEN f_refuted THEN least(c1, 2)
    WHEN f_refutation_attempted AND f_refutation_is_real AND NOT f_poc_passed THEN c1 + 1 ELSE c1 END AS c2 FROM d),
f AS (SELECT *, CASE WHEN NOT (NOT f_has_access_control OR f_open_roles OR f_unguarded OR f_poc_passed) AND i1 >= 7 AND NOT f_poc_passed THEN least(c2, 4) ELSE c2 END AS c3 FROM e),
g AS (SELECT *, greatest(0, least(10, CASE WHEN suppressed THEN 0 WHEN is_lead AND NOT f_refuted AND i1 >= 7 THEN greatest(c3, 3) ELSE c3 END)) AS c4 FROM f),
h AS (SELECT *, CASE WHEN suppressed THEN 'FALSE_POSITIVE' WHEN i1 >= 9 AND c4 >= 8 THEN 'CONFIRMED_CRITICAL' WHEN i1 >= 9 AND c4 >= 5 THEN 'LIKELY_CRITICAL_NEEDS_POC'
    WHEN i1 >= 7 AND c4 >= 3 THEN 'NEEDS_MORE_INVESTIGATION' ELSE 'LOW_OR_INFO' END AS k0,
    f_poc_passed OR ((f_value_at_risk OR vs = 'has_value') AND (f_value_to OR coalesce(destination_control, '') = 'attacker_controlled')
      AND (f_attacker_controls OR f_open_roles OR f_unguarded)) AS vpath FROM g),
j AS (SELECT *, k0 IN ('CONFIRMED_CRITICAL', 'LIKELY_CRITICAL_NEEDS_POC') AND vs = 'no_value' AND NOT vpath AS gated FROM h),
l AS (SELECT *, CASE WHEN gated THEN least(c4, 6) ELSE c4 END AS c5, CASE WHEN gated THEN 'NEEDS_MORE_INVESTIGATION' ELSE k0 END AS k1 FROM j),
m AS (SELECT *, CASE WHEN is_lead AND NOT suppressed AND NOT f_refuted AND ((i1 >= 7 AND k1 = 'LOW_OR_INFO')
    OR (NOT f_poc_passed AND k1 IN ('CONFIRMED_CRITICAL', 'LIKELY_CRITICAL_NEEDS_POC'))) THEN 'NEEDS_MORE_INVESTIGATION' ELSE k1 END AS k2 FROM l)"""
SCORE_OUT = """ SELECT target_id, pos, detector, i1 AS impact_score, c5::DOUBLE AS confidence_score, k2 AS classification,
  CASE WHEN i1 >= 9 THEN 'critical' WHEN i1 >= 7 THEN 'high' WHEN i1 >= 4 THEN 'medium' WHEN i1 >= 2 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN c5 >= 8 THEN 'high' WHEN c5 >= 4 THEN 'medium' ELSE 'low' END AS confidence_before_ai FROM m"""
_SCORED = ["target_id", "pos", "detector", "impact_score", "confidence_score", "classification", "severity", "confidence_before_ai"]


@query("score_ladder", LADDER.replace("{ultra}", "false") + SCORE_OUT)
def score_ladder(spark, sf):
    return scoring.score(candidates(spark, sf), "deep").select(*_SCORED)


@query("score_ladder_ultra", LADDER.replace("{ultra}", "true") + SCORE_OUT)
def score_ladder_ultra(spark, sf):
    return scoring.score(candidates(spark, sf), "ultra-deep-v2").select(*_SCORED)


@query("classification_report", LADDER.replace("{ultra}", "false") + " SELECT file, k2 AS classification, count(*) AS n, max(i1) AS max_impact FROM m GROUP BY 1, 2")
def classification_report(spark, sf):
    return scoring.score(candidates(spark, sf), "deep").groupBy("file", "classification").agg(F.count(F.lit(1)).alias("n"), F.max("impact_score").alias("max_impact"))


PRIO = """impact * 10 + conf * 4 + CASE WHEN impact >= 9 THEN 18 WHEN impact >= 7 THEN 12 WHEN impact >= 4 THEN 6 WHEN impact >= 2 THEN 1 ELSE 0 END
 + CASE WHEN f_unprivileged THEN 8 ELSE 0 END + CASE WHEN f_economic_leverage THEN 4 ELSE 0 END + 1.5 + 1
 - CASE WHEN suppressed OR f_refuted THEN 40 ELSE 0 END - CASE WHEN f_informational THEN 20 ELSE 0 END"""


def _prioritised(spark, sf):
    c = candidates(spark, sf).withColumns({"severity": sc.severity(F.col("impact")), "next_tests": F.array(F.lit("t"))})
    return c.withColumn("priority", scoring.priority())


@query("priority_topk", f"WITH {C} SELECT target_id, pos, detector, ({PRIO})::DOUBLE AS priority, row_number() OVER (ORDER BY ({PRIO})::DOUBLE DESC, target_id, pos, detector) AS rank_no FROM c")
def priority_topk(spark, sf):
    return ranked(_prioritised(spark, sf).select("target_id", "pos", "detector", "priority"), F.desc("priority"), "target_id", "pos", "detector")


@query("budget_per_target", f"WITH {C}, p AS (SELECT target_id, pos, ({PRIO})::DOUBLE AS priority FROM c) SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY priority DESC, pos) AS rank_no FROM p QUALIFY rank_no <= 3")
def budget_per_target(spark, sf):
    return dedup.top_per_key(_prioritised(spark, sf).select("target_id", "pos", "priority"), ["target_id"], 3, F.desc("priority"), F.col("pos"))


VERDICT = "CASE l_suppkey % 6 WHEN 0 THEN 'false positive' WHEN 1 THEN 'LOW_OR_INFO' WHEN 2 THEN 'confirmed_critical' WHEN 3 THEN 'rubbish' WHEN 4 THEN 'NEEDS_MORE_INVESTIGATION' ELSE NULL END"


@query("verdict_guardrails", LADDER.replace("{ultra}", "false").replace("l_partkey % 37 = 5 AS suppressed", f"l_partkey % 37 = 5 AS suppressed, {VERDICT} AS verdict, CASE WHEN l_partkey % 19 = 0 THEN 'timeout' END AS verdict_error, l_partkey % 23 = 1 AS binding_refuted") + """
, v AS (SELECT *, CASE WHEN upper(replace(trim(coalesce(verdict, '')), ' ', '_')) IN ('FALSE_POSITIVE', 'LOW_OR_INFO', 'CONFIRMED_CRITICAL', 'NEEDS_MORE_INVESTIGATION', 'LIKELY_CRITICAL_NEEDS_POC')
    THEN upper(replace(trim(verdict), ' ', '_')) ELSE 'NEEDS_MORE_INVESTIGATION' END AS vv,
    lead_only OR coalesce(tier, '') IN ('lead_only', 'confirmable') OR (i1 >= 8 AND c5 >= 4 AND k2 IN ('NEEDS_MORE_INVESTIGATION', 'LIKELY_CRITICAL_NEEDS_POC', 'CONFIRMED_CRITICAL')) AS hs,
    verdict IS NOT NULL AND verdict_error IS NULL AS has FROM m),
w AS (SELECT *, vv = 'CONFIRMED_CRITICAL' AND NOT (f_poc_passed OR f_open_roles OR f_unguarded) AS over_,
    vv IN ('FALSE_POSITIVE', 'LOW_OR_INFO') AND hs AND NOT (suppressed OR f_refuted_concrete) AND NOT binding_refuted AS buried FROM v)
SELECT target_id, pos, has AND (over_ OR buried) AS enforced_downgrade, CASE WHEN NOT has THEN k2 WHEN over_ THEN 'LIKELY_CRITICAL_NEEDS_POC' WHEN buried THEN 'NEEDS_MORE_INVESTIGATION' ELSE vv END AS final_class FROM w""")
def verdict_guardrails(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("target_id"), F.expr(POS).alias("pos"), F.expr(VERDICT).alias("verdict"),
                                             F.expr("CASE WHEN l_partkey % 19 = 0 THEN 'timeout' END").alias("verdict_error"), F.expr("l_partkey % 23 = 1").alias("binding_refuted")).distinct()
    c = scoring.score(candidates(spark, sf), "deep").join(li, ["target_id", "pos"])
    return scoring.guardrails(c).select("target_id", "pos", "enforced_downgrade", "final_class")


@query("eligibility_filters", LADDER.replace("{ultra}", "false") + """ SELECT target_id, pos,
 detector IN ('proxy_upgrade', 'arbitrary_call', 'governance_blast_radius') AND NOT f_governance_controlled AND NOT f_has_access_control AND i1 >= 7 AND c5 >= 4 AS poc,
 NOT f_informational AND NOT f_refuted AND (impact >= 7 OR coalesce(tier, '') = 'confirmable' OR f_poc_passed) AS invariant, vpath AS value_path FROM m""")
def eligibility_filters(spark, sf):
    c = scoring.score(candidates(spark, sf), "deep")
    c = c.withColumn("severity", F.lit("x"))
    return c.select("target_id", "pos", scoring.poc_eligible(["proxy_upgrade", "arbitrary_call", "governance_blast_radius"]).alias("poc"),
                    scoring.invariant_eligible().alias("invariant"), scoring.value_path().alias("value_path"))


@query("invariant_selection", f"""WITH {C} SELECT target_id, pos, detector, row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN impact >= 9 THEN 0 ELSE 1 END, impact DESC, conf DESC, detector, pos) AS rank_no
 FROM c WHERE NOT f_informational AND NOT f_refuted AND (impact >= 7 OR coalesce(tier, '') = 'confirmable' OR f_poc_passed) QUALIFY rank_no <= 8""")
def invariant_selection(spark, sf):
    c = candidates(spark, sf).withColumn("severity", sc.severity(F.col("impact"))).where(scoring.invariant_eligible())
    return dedup.top_per_key(c.select("target_id", "pos", "detector", "impact", "conf", "severity"), ["target_id"], 8, F.when(F.col("severity") == "critical", 0).otherwise(1),
                             F.desc("impact"), F.desc("conf"), F.col("detector"), F.col("pos")).select("target_id", "pos", "detector", "rank_no")


TOOLROWS = ("SELECT o_orderkey AS target_id, o_orderpriority AS \"check\", CASE o_orderkey % 5 WHEN 0 THEN 'owner can upgrade' WHEN 1 THEN 'permit reuse' WHEN 2 THEN 'controlled-delegatecall here' WHEN 3 THEN 'nothing' ELSE 'Arbitrary write' END AS description FROM orders ")


@query("tool_agreement", f"""WITH {C}, t AS ({TOOLROWS}),
k(detector, word) AS (VALUES ('proxy_upgrade','upgrade'), ('proxy_upgrade','unprotected-upgrade'), ('proxy_upgrade','initialize'), ('proxy_upgrade','uninitialized'),
 ('arbitrary_call','delegatecall'), ('arbitrary_call','controlled-delegatecall'), ('arbitrary_call','arbitrary-send'), ('arbitrary_call','arbitrary'), ('arbitrary_call','low level call'),
 ('arbitrary_call','unchecked'), ('permit_misuse','permit'), ('permit_misuse','signature'), ('permit_misuse','ecrecover'))
SELECT target_id, pos, detector, EXISTS (SELECT 1 FROM t JOIN k ON contains(lower(t."check" || ' ' || t.description), k.word) WHERE t.target_id = c.target_id AND k.detector = c.detector) AS tool_agree FROM c""")
def tool_agreement(spark, sf):
    t = rel(spark, sf, TOOLROWS.replace('"check"', "`check`"))
    return scoring.tool_agreement(candidates(spark, sf).drop("tool_agree"), t, ["target_id"]).select("target_id", "pos", "detector", "tool_agree")


@query("candidate_function", """SELECT o_orderkey AS target_id, CASE WHEN o_orderkey % 3 = 0 THEN 'run' || (o_custkey % 5) WHEN o_orderkey % 3 = 1 THEN 'go' || (o_custkey % 7) ELSE 'tail' || (o_orderkey % 4) END AS fn FROM orders""")
def candidate_function(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 3
    d = o.select(F.col("o_orderkey").alias("target_id"), F.concat(F.lit("Something odd: tail"), (F.col("o_orderkey") % 4).cast("string")).alias("title"),
                 F.when(k == 0, F.array(F.lit("?"), F.lit(" "), F.concat(F.lit("run"), (F.col("o_custkey") % 5).cast("string"), F.lit("(uint256)")))).otherwise(F.array().cast("array<string>")).alias("functions"),
                 F.when(k == 1, F.concat(F.lit("go"), (F.col("o_custkey") % 7).cast("string"))).alias("function"))
    return d.select("target_id", gates.candidate_function().alias("fn"))


@query("binding_refutation", f"""WITH c AS (SELECT l_orderkey AS cand_id, {POS} AS pos, 'v' || (l_partkey % 5) AS variable, l_partkey % 4 AS kind, l_suppkey % 3 AS ap FROM lineitem),
r AS (SELECT *, CASE WHEN kind = 0 THEN 'constant' WHEN kind = 1 THEN 'self-bound' WHEN kind = 2 AND ap = 0 THEN 'caller-bound' END AS reason FROM c)
SELECT cand_id, arg_min(variable, pos) AS variable, arg_min(reason, pos) AS reason FROM r WHERE reason IS NOT NULL GROUP BY 1""")
def binding_refutation(spark, sf):
    li = table(spark, sf, "lineitem")
    v = F.concat(F.lit("v"), (F.col("l_partkey") % 5).cast("string"))
    k = F.col("l_partkey") % 4
    code = (F.when(k == 0, F.concat(F.lit("uint256 immutable "), v, F.lit(";"))).when(k == 1, F.concat(v, F.lit(" = address(this);")))
            .when(k == 2, F.concat(v, F.lit(" = msg.sender; coin.transferFrom("), v, F.lit(", x, 1);"))).otherwise(F.concat(F.lit("use("), v, F.lit(");"))))
    c = li.select(F.col("l_orderkey").alias("cand_id"), F.expr(POS).alias("pos"), v.alias("variable"), F.lit("").alias("role"), code.alias("code"),
                  F.when(F.col("l_suppkey") % 3 == 0, "allowance drain").otherwise("other thing").alias("blob"))
    return gates.binding_refutation(c)


@query("attribution_gate", """SELECT o_orderkey AS target_id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 THEN 'rpc chain mismatch' ELSE 'no contract code on this chain' END AS attribution
 FROM orders WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 7 = 0 OR o_custkey % 6 = 0)""")
def attribution_gate(spark, sf):
    o = table(spark, sf, "orders")
    t = o.select(F.col("o_orderkey").alias("target_id"), (F.col("o_orderkey") % 5 != 0).alias("rpc_ok"),
                 F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 7 == 0).when(F.col("o_orderkey") % 7 == 0, True).alias("chain_mismatch"),
                 F.when(F.col("o_custkey") % 6 == 0, "0x").when(F.col("o_custkey") % 6 == 1, "0x6001").alias("code"))
    return gates.attribution_reason(t)


@query("liveness_evidence", """WITH f AS (SELECT l_orderkey AS target_id, CASE l_linenumber % 4 WHEN 0 THEN 'owner()' WHEN 1 THEN 'factory()' WHEN 2 THEN 'asset()' ELSE 'name()' END AS method, l_partkey % 3 AS z FROM lineitem),
r AS (SELECT target_id, bool_or(z = 0) AS zero_seen, count(*) AS n FROM f WHERE method <> 'name()' AND z <> 2 GROUP BY 1)
SELECT o_orderkey AS target_id, r.n AS liveness_reads, coalesce(o_custkey % 3 = 0 AND r.zero_seen, false) AS never_initialized FROM orders LEFT JOIN r ON r.target_id = o_orderkey""")
def liveness_evidence(spark, sf):
    m = F.element_at(F.array(F.lit("owner()"), F.lit("factory()"), F.lit("asset()"), F.lit("name()")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    z = F.col("l_partkey") % 3
    f = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("target_id"), m.alias("method"), F.when(z == 0, "0x" + "0" * 40).when(z == 1, "0x" + "1" * 40).alias("value"))
    o = table(spark, sf, "orders")
    c = o.select(F.col("o_orderkey").alias("target_id"), F.lit("x").alias("detector"), F.lit("t").alias("title"), F.lit("d").alias("description"))
    n = o.select(F.col("o_orderkey").alias("target_id"), F.when(F.col("o_custkey") % 3 == 0, "MyVault").otherwise("Plain").alias("contract_name"))
    return gates.liveness(c, f, n).select("target_id", "liveness_reads", "never_initialized")
