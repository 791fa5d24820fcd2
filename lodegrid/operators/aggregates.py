"""Dashboards, summaries, coverage and report checks over finding tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CONFIRMED, FALSE_POSITIVE, LIKELY, LOW, NEEDS, REPORTABLE
from ..session import cut, stored
from .dedup import keep_first, keep_last

DONE = ("completed", "failed", "skipped")
# Surface -> (text hints, detectors that examine it).
SURFACE_HINTS = {
    "share_accounting": (("deposit", "withdraw", "redeem", "totalassets", "convertto", "pricepershare"), ("invariant_reasoner",)),
    "settlement_proof_binding": (("executebatch", "verifybatch", "commitbatch", "onchainoperations", "provewithdraw", "finalizewithdraw"),
                                 ("invariant_reasoner", "bridge_accounting")),
    "bridge_messaging": (("relaymessage", "finalizemessage", "l1tol2", "l2tol1", "outbox", "inbox"), ("bridge_accounting",)),
    "access_control": (("onlyowner", "onlyrole", "requiresauth", "accesscontrol", "hasrole"),
                       ("timelock_roles", "governance_blast_radius", "access_control")),
    "proxy_upgrade": (("upgradeto", "_authorizeupgrade", "implementation", "initialize"), ("proxy_upgrade",)),
    "signatures_permit": (("permit", "ecrecover", "eip712", "domainseparator"), ("permit_misuse",)),
    "zk_verifier": (("verifyproof", "snark", "groth16", "plonk", "verifier.verify", "desert"), ("zk_verifier", "invariant_reasoner")),
    "swap_oracle": (("getrate", "latestanswer", "swap", "slippage", "minout", "oracle"), ("invariant_reasoner",)),
}
# Name parts of value-moving functions.
VALUE_HINTS = ("deposit", "withdraw", "redeem", "mint", "burn", "claim", "exit", "swap", "transfer", "finalize", "execute", "settle", "liquidate",
               "borrow", "repay", "stake", "unstake", "rebalance", "harvest", "collect", "fulfill", "process", "provedesert", "performdesert",
               "relaymessage", "unshield", "perform")


def class_counts(classification: str = "classification") -> list[Column]:
    """Four buckets; both critical classes share one, everything unknown counts as low."""
    c = F.col(classification)
    return [F.count_if(c.isin(*REPORTABLE)).alias("critical"), F.count_if(c == NEEDS).alias("needs"),
            F.count_if(c == FALSE_POSITIVE).alias("false_positive"),
            F.count_if(c.isNotNull() & ~c.isin(*REPORTABLE, NEEDS, FALSE_POSITIVE)).alias("low")]


def dashboard(scans: DataFrame) -> DataFrame:
    return scans.agg(F.count(F.lit(1)).alias("total_scans"), F.count_if(F.col("status") == "running").alias("running_scans"),
                     F.sum("total_targets").alias("total_targets"), F.sum("critical_count").alias("critical"),
                     F.sum("needs_investigation_count").alias("needs"), F.sum("low_info_count").alias("low"))


def done_count(targets: DataFrame) -> DataFrame:
    return targets.groupBy("scan_id").agg(F.count_if(F.col("status").isin(*DONE)).alias("done"), F.count(F.lit(1)).alias("total"))


def target_summary(targets: DataFrame, findings: DataFrame) -> DataFrame:
    """Per target: count, maxima, class buckets and the most frequent detector (earliest first on ties); zeros without findings."""
    per = findings.groupBy("target_id", "detector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("impact_score").alias("mi"),
                                                        F.max("confidence_score").alias("mc"), *class_counts())
    g = per.groupBy("target_id").agg(F.sum("n").alias("total"), F.max("mi").alias("max_impact"), F.max("mc").alias("max_confidence"),
                                     *[F.sum(k).alias(k) for k in ("critical", "needs", "false_positive", "low")],
                                     F.max_by("detector", F.struct("n", (-F.col("first_id")).alias("o"))).alias("top_detector"))
    d = targets.select(F.col("id").alias("target_id")).join(g, "target_id", "left")
    return d.select("target_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in ("total", "critical", "needs", "false_positive", "low")],
                    *[F.coalesce(k, F.lit(0.0)).alias(k) for k in ("max_impact", "max_confidence")], "top_detector")


def detector_breakdown(findings: DataFrame, k: int = 6) -> DataFrame:
    return findings.groupBy("detector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(k)


def filter_findings(findings: DataFrame, targets: DataFrame, *, target_id=None, detector=None, classification=None, status=None,
                    hide_false_positives: bool = False, query: str = "") -> DataFrame:
    """Four equality filters, the hide switch and a free-text OR over eight columns."""
    d = findings.join(targets.select(F.col("id").alias("target_id"), "address", "contract_name", "label"), "target_id", "left")
    for c, v in (("target_id", target_id), ("detector", detector), ("classification", classification), ("status", status)):
        if v is not None:
            d = d.where(F.col(c) == v)
    if hide_false_positives:
        d = d.where(F.col("classification") != FALSE_POSITIVE)
    if query.strip():
        q = query.strip().lower()
        cols = [F.col(c) for c in ("address", "contract_name", "label", "detector", "title", "classification", "status")] + [F.get("next_tests", F.lit(0))]
        hit = F.lit(False)
        for c in cols:
            hit = hit | F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(q))
        d = d.where(hit)
    return d


def coverage(files: DataFrame, detectors_run: list[str]) -> DataFrame:
    """Surfaces with at least two hints in a target's text, examined or without a running detector."""
    hints = sorted({h for hs, _ in SURFACE_HINTS.values() for h in hs})
    low = F.lower("raw")
    flags = files.groupBy("target_id").agg(*[F.bool_or(F.contains(low, F.lit(h))).alias(f"h{i}") for i, h in enumerate(hints)])
    n = lambda hs: sum((F.col(f"h{hints.index(h)}").cast("int") for h in hs), F.lit(0))
    rows = [F.when(n(hs) >= 2, F.struct(F.lit(s).alias("surface"), n(hs).alias("hints"), F.lit(bool(set(det) & set(detectors_run))).alias("examined")))
            for s, (hs, det) in SURFACE_HINTS.items()]
    return flags.select("target_id", F.explode(F.array_compact(F.array(*rows))).alias("s")).select("target_id", "s.*")


def value_functions(fns: DataFrame, acc: DataFrame, k: int = 8) -> DataFrame:
    """The k most value-moving state-changing externals per target (a bounded review list)."""
    from .dedup import top_per_key

    low = F.lower("name")
    hits = sum((F.contains(low, F.lit(h)).cast("int") for h in VALUE_HINTS), F.lit(0))
    touch = acc.select("target_id", "path", "name").distinct().withColumn("touches", F.lit(1))
    vis = F.regexp_extract("tail", r"\b(public|external|internal|private)\b", 1)
    d = fns.where(vis.isin("", "public", "external") & ~F.lower("tail").rlike("view|pure")).join(touch, ["target_id", "path", "name"], "left")
    d = d.withColumn("score", hits + F.coalesce("touches", F.lit(0))).where("score > 0")
    return top_per_key(d, ["target_id"], k, F.desc("score"), F.desc("name"), F.col("path"), F.col("start"))


def hypotheses_to_candidates(h: DataFrame) -> DataFrame:
    """Stored reasoner hypotheses as candidates: word scores, confidence cap 6, lead mark on binding classes."""
    sev = F.lower(F.coalesce("severity", F.lit("medium")))
    imp = F.when(sev == "critical", 9.0).when(sev == "high", 7.5).when(sev == "low", 3.0).otherwise(5.0)
    bug = F.coalesce("bug_class", F.lit("other"))
    lead = F.lower(bug).rlike("settlement|binding|boundary|proof|replay")
    return h.select("target_id", F.lit("invariant_reasoner").alias("detector"), F.left(F.coalesce("title", F.lit("Invariant hypothesis")), F.lit(200)).alias("title"),
                    imp.alias("impact"), F.least(F.coalesce(F.col("confidence").try_cast("double"), F.lit(4.0)), F.lit(6.0)).alias("conf"), bug.alias("bug_class"),
                    F.nullif("function", F.lit("")).alias("function"), F.coalesce("unprivileged", F.lit(False)).alias("unprivileged"),
                    (~F.coalesce("unprivileged", F.lit(True))).alias("governance_controlled"), lead.alias("lead_only"),
                    F.when(lead, "lead_only").alias("tier"))


def latest_target(targets: DataFrame) -> DataFrame:
    """Newest target per (chain, address)."""
    return keep_last(targets.withColumn("address_lc", F.lower("address")), ["chain", "address_lc"], F.col("id"))


def benchmark_report(cases: DataFrame, targets: DataFrame, findings: DataFrame, tool_runs: DataFrame) -> DataFrame:
    """Recall cases against stored findings: missing detectors, critical count, invariant run; one row per case.

    cases(case_id, chain, address, expected_detectors, min_critical, requires_invariants)
    """
    t = latest_target(targets)
    c = cases.withColumn("address_lc", F.lower("address")).join(t.select("chain", "address_lc", F.col("id").alias("target_id"), "status"), ["chain", "address_lc"], "left")
    f = findings.groupBy("target_id").agg(F.collect_set("detector").alias("present"), F.count_if(F.col("classification").isin(*REPORTABLE)).alias("critical"))
    inv = keep_last(tool_runs.where("tool_name = 'fuzz-invariants'").select("target_id", "id", F.col("status").alias("inv_status"), "summary"), ["target_id"], F.col("id")).drop("id")
    d = c.join(f, "target_id", "left").join(inv, "target_id", "left")
    none = F.array().cast("array<string>")
    missing = F.array_except("expected_detectors", F.coalesce("present", none))
    ok = (F.col("target_id").isNotNull() & (F.col("status") == "completed") & (F.size(missing) == 0)
          & (F.coalesce("critical", F.lit(0)) >= F.col("min_critical")) & (~F.col("requires_invariants") | (F.coalesce("inv_status", F.lit("")) == "ok")))
    return d.select("case_id", "target_id", missing.alias("missing_detectors"), F.coalesce("critical", F.lit(0)).alias("critical"), F.coalesce(ok, F.lit(False)).alias("passed"))


def precision_report(cases: DataFrame, targets: DataFrame, findings: DataFrame) -> DataFrame:
    """Known-safe cases: a reportable finding is a failure unless the case allows it."""
    t = latest_target(targets)
    c = cases.withColumn("address_lc", F.lower("address")).join(t.select("chain", "address_lc", F.col("id").alias("target_id")), ["chain", "address_lc"], "left")
    f = findings.groupBy("target_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("classification").isin(*REPORTABLE)).alias("reportable"))
    d = c.join(f, "target_id", "left")
    return d.select("case_id", F.coalesce("candidates", F.lit(0)).alias("candidates"), F.coalesce("reportable", F.lit(0)).alias("reportable"),
                    (F.col("allow_reportable") | (F.coalesce("reportable", F.lit(0)) == 0)).alias("passed"))


def report_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("cases"), F.count_if("passed").alias("passed_cases"), F.count_if(~F.col("passed")).alias("failed_cases"),
                       F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))


def load_precision_corpus(rows: DataFrame) -> DataFrame:
    """JSON corpus rows with the defaulting chain."""
    s = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c])
    return rows.select(s("id", "address").alias("case_id"), s("name", "id", "address").alias("name"), F.coalesce(F.nullif("chain", F.lit("")), F.lit("ethereum")).alias("chain"),
                       F.coalesce(s("reason", "label"), F.lit("must stay silent")).alias("reason"), F.coalesce("address", F.lit("")).alias("address"),
                       F.coalesce("allow_reportable", F.lit(False)).alias("allow_reportable"))


#: Sets of one side that may hold a token which is common in the other side too, for pairs to be counted token by token.
COMMON_SETS = 1000


def overlaps(a: DataFrame, b: DataFrame, a_key: str, b_key: str, least: int = 2) -> DataFrame:
    """(a_key, b_key, overlap): pairs of token sets with at least `least` tokens in common, exactly.

    a(a_key, tokens), b(b_key, tokens), tokens without repeats; b is read twice, so the smaller side. Pairs are counted token by token, each
    text of `a` read once, unless a token stands in more than ``COMMON_SETS`` sets of both sides: its pairs would be too many.
    """
    w, _ = stored(_words(b, b_key))
    much = lambda d: d.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") > COMMON_SETS).select("token")
    common = cut(much(w))
    if not common.isEmpty() and not much(_words(a, a_key).join(common, "token", "left_semi")).isEmpty():
        return _overlaps_by_prefix(a, b, a_key, b_key, least)
    both = _words(a, a_key).toDF("l", "l_row", "token").join(w.toDF("r", "r_row", "token"), "token")
    n = both.groupBy("l", "l_row", "r", "r_row").agg(F.count(F.lit(1)).alias("overlap")).where(F.col("overlap") >= least)
    return n.select(F.col("l").alias(a_key), F.col("r").alias(b_key), "overlap")


def _words(sets: DataFrame, key: str) -> DataFrame:
    """(id, row, token) of token sets; the row tells sets of one key apart."""
    rows = sets.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), "tokens")
    # outer: for an inner one the optimizer would make the tokens a second time, to filter
    return rows.select("id", "row", F.explode_outer("tokens").alias("token")).where("id IS NOT NULL AND token IS NOT NULL")


def _overlaps_by_prefix(a: DataFrame, b: DataFrame, a_key: str, b_key: str, least: int) -> DataFrame:
    """``overlaps`` where tokens are common in both sides.

    Prefix filter: tokens are ordered by the number of sets that hold them. Of a set of n tokens only the n - least + 1 rarest are join
    keys, since two sets with `least` tokens in common share one among these; so the tokens that every set holds never become a key.
    Pairs that met are then counted over their whole sets.
    """
    sides = [df.select(F.col(k).alias("id"), "tokens").where(F.size("tokens") >= least) for df, k in ((a, a_key), (b, b_key))]
    words = [s.select("id", F.explode("tokens").alias("token")) for s in sides]
    often = words[0].unionByName(words[1]).groupBy("token").agg(F.count(F.lit(1)).alias("often"))

    def prefixes(w: DataFrame) -> DataFrame:
        lists = w.join(often, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("t"))  # one set's tokens
        return lists.select("id", F.explode(F.slice("t", F.lit(1), F.size("t") - (least - 1))).alias("k")).select("id", F.col("k.token").alias("token"))

    met = prefixes(words[0]).withColumnRenamed("id", "l").join(prefixes(words[1]).withColumnRenamed("id", "r"), "token").select("l", "r").distinct()
    full = met.join(sides[0].toDF("l", "lt"), "l").join(sides[1].toDF("r", "rt"), "r")
    full = full.select(F.col("l").alias(a_key), F.col("r").alias(b_key), F.size(F.array_intersect("lt", "rt")).cast("long").alias("overlap"))
    return full.where(F.col("overlap") >= least)


def knowledge_matches(cand: DataFrame, corpus: DataFrame, key: str = "cand_id", k: int = 4) -> DataFrame:
    """Closest corpus entries per candidate: at least two shared tokens, +1 critical, +1 detector named; top four.

    cand(cand_id, detector, tokens), corpus(entry_id, entry_pos, severity, keywords); keys are unique.
    """
    from .dedup import top_per_key

    m = overlaps(cand.select(key, F.array_distinct("tokens").alias("tokens")), corpus.select("entry_id", F.array_distinct("keywords").alias("tokens")), key, "entry_id")
    e = corpus.select("entry_id", "entry_pos", "severity", F.array_join("keywords", "").alias("joined"))
    m = m.join(cand.select(key, "detector"), key).join(e, "entry_id")
    score = F.col("overlap") + (F.upper("severity") == "CRITICAL").cast("int") + F.contains("joined", F.replace("detector", F.lit("_"), F.lit(""))).cast("int")
    return top_per_key(m.withColumn("relevance", score), [key], k, F.desc("relevance"), F.desc("overlap"), F.col("entry_pos")).drop("joined")


def recover_interrupted(scans: DataFrame) -> DataFrame:
    """After a restart: running scans failed, queued scans start again."""
    return scans.withColumns({"next_action": F.when(F.col("status") == "queued", "restart").when(F.col("status") == "running", "mark_failed"),
                              "status": F.when(F.col("status") == "running", "failed").otherwise(F.col("status"))})


def rule_lookup(cand: DataFrame, examples: int = 3) -> DataFrame:
    """(rule_id, title, raw_hits, examples) over all candidates: the first hit's title and the first few targets as examples."""
    from .dedup import top_per_key

    c = cand.where("rule_id IS NOT NULL")
    first = c.groupBy("rule_id").agg(F.min_by("title", F.struct("target_id", "pos")).alias("title"), F.count(F.lit(1)).alias("raw_hits"))
    ex = top_per_key(c.select("rule_id", "target_id").distinct(), ["rule_id"], examples, F.col("target_id"))
    ex = ex.groupBy("rule_id").agg(F.array_sort(F.collect_list("target_id")).alias("examples"))
    return first.join(ex, "rule_id")
