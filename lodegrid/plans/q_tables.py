"""Registered queries: findings-model aggregates, joins, ordering, set operations, exports and watch detection."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import aggregates as agg
from ..operators import bundle, dedup, places, sinks
from ..operators.ordering import ranked
from ..streaming import watch, windows
from .derived import FINDINGS, POS, REVIEWS, SCANS, TARGETS, findings, rel
from ..session import shared_folder, stored
from .registry import query, spread, table

S, T, FI, RV = f"s AS ({SCANS})", f"t AS ({TARGETS})", f"f AS ({FINDINGS})", f"r AS ({REVIEWS})"
CRIT = "('CONFIRMED_CRITICAL', 'LIKELY_CRITICAL_NEEDS_POC')"
BUCKETS = (f"count(*) FILTER (classification IN {CRIT}) AS critical, count(*) FILTER (classification = 'NEEDS_MORE_INVESTIGATION') AS needs, "
           "count(*) FILTER (classification = 'FALSE_POSITIVE') AS false_positive, count(*) FILTER (classification = 'LOW_OR_INFO') AS low")


@query("dashboard", f"WITH {S} SELECT count(*) AS total_scans, count(*) FILTER (status = 'running') AS running_scans, sum(total_targets)::BIGINT AS total_targets, sum(critical_count)::BIGINT AS critical, sum(needs_investigation_count)::BIGINT AS needs, sum(low_info_count)::BIGINT AS low FROM s")
def dashboard(spark, sf):
    return agg.dashboard(rel(spark, sf, SCANS))


@query("newest_scans", f"WITH {S} SELECT id, name, status FROM s ORDER BY id DESC LIMIT 10")
def newest_scans(spark, sf):
    return rel(spark, sf, SCANS).select("id", "name", "status").orderBy(F.desc("id")).limit(10)


@query("scan_list", f"WITH {S} SELECT id, name, status, chain, row_number() OVER (ORDER BY id DESC) AS rank_no FROM s")
def scan_list(spark, sf):
    """All scans, newest first."""
    return ranked(rel(spark, sf, SCANS).select("id", "name", "status", "chain"), F.desc("id"))


@query("watch_list", "SELECT user_id AS watch_id, max(ts) AS last_seen, count(*) AS observations, row_number() OVER (ORDER BY max(ts) DESC NULLS LAST, user_id NULLS FIRST) AS rank_no FROM events GROUP BY 1")
def watch_list(spark, sf):
    """All watches, the one seen last first."""
    w = table(spark, sf, "events").groupBy(F.col("user_id").alias("watch_id")).agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("observations"))
    return ranked(w, F.desc("last_seen"), "watch_id")


@query("scan_counts", f"WITH {T}, {FI} SELECT t.scan_id, count(*) AS findings, {BUCKETS} FROM f JOIN t ON t.id = f.target_id GROUP BY 1")
def scan_counts(spark, sf):
    t = rel(spark, sf, TARGETS).select(F.col("id").alias("target_id"), "scan_id")
    # classes are counted per target before the join, so a target's many findings shuffle as one row
    per = rel(spark, sf, FINDINGS).groupBy("target_id").agg(F.count(F.lit(1)).alias("findings"), *agg.class_counts())
    cols = ["findings", "critical", "needs", "false_positive", "low"]
    return per.join(t, "target_id").groupBy("scan_id").agg(*[F.sum(c).alias(c) for c in cols])


@query("done_count", f"WITH {T} SELECT scan_id, count(*) FILTER (status IN ('completed', 'failed', 'skipped')) AS done, count(*) AS total FROM t GROUP BY 1")
def done_count(spark, sf):
    return agg.done_count(rel(spark, sf, TARGETS))


@query("target_summary", f"""WITH {T}, {FI}, g AS (SELECT target_id, count(*) AS total, max(impact_score) AS max_impact, max(confidence_score) AS max_confidence, {BUCKETS} FROM f GROUP BY 1),
d AS (SELECT target_id, detector, count(*) AS n, min(id) AS fid FROM f GROUP BY 1, 2),
m AS (SELECT target_id, detector FROM d QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY n DESC, fid) = 1)
SELECT t.id AS target_id, coalesce(total, 0) AS total, coalesce(critical, 0) AS critical, coalesce(needs, 0) AS needs, coalesce(false_positive, 0) AS false_positive, coalesce(low, 0) AS low,
 coalesce(max_impact, 0) AS max_impact, coalesce(max_confidence, 0) AS max_confidence, m.detector AS top_detector
FROM t LEFT JOIN g ON g.target_id = t.id LEFT JOIN m ON m.target_id = t.id""")
def target_summary(spark, sf):
    return agg.target_summary(rel(spark, sf, TARGETS), rel(spark, sf, FINDINGS))


@query("findings_per_target", f"WITH {FI} SELECT target_id, count(*) AS n FROM f GROUP BY 1")
def findings_per_target(spark, sf):
    return rel(spark, sf, FINDINGS).groupBy("target_id").agg(F.count(F.lit(1)).alias("n"))


FILT = "f.detector = 'reentrancy' AND f.classification <> 'FALSE_POSITIVE' AND (contains(lower(t.address), 'xa12') OR contains(lower(f.title), 'xa12') OR contains(lower(coalesce(f.next_test, '')), 'xa12'))"


@query("filtered_findings", f"WITH {T}, {FI} SELECT f.id, f.target_id, t.address, f.title FROM f LEFT JOIN t ON t.id = f.target_id WHERE {FILT}")
def filtered_findings(spark, sf):
    d = agg.filter_findings(findings(spark, sf), rel(spark, sf, TARGETS), detector="reentrancy", hide_false_positives=True, query="xA12")
    return d.select("id", "target_id", "address", "title")


@query("filtered_summary", f"WITH {T}, {FI} SELECT count(*) AS total, max(impact_score) AS max_impact, max(confidence_score) AS max_confidence, {BUCKETS} FROM f LEFT JOIN t ON t.id = f.target_id WHERE {FILT}")
def filtered_summary(spark, sf):
    d = agg.filter_findings(findings(spark, sf), rel(spark, sf, TARGETS), detector="reentrancy", hide_false_positives=True, query="xA12")
    return d.agg(F.count(F.lit(1)).alias("total"), F.max("impact_score").alias("max_impact"), F.max("confidence_score").alias("max_confidence"), *agg.class_counts())


@query("detector_breakdown", f"WITH {FI} SELECT detector, count(*) AS n, min(id) AS first_id FROM f GROUP BY 1 ORDER BY n DESC, first_id LIMIT 6")
def detector_breakdown(spark, sf):
    return agg.detector_breakdown(rel(spark, sf, FINDINGS))


@query("distinct_options", f"WITH {FI}, {S} SELECT 'detector' AS kind, detector AS val FROM f UNION SELECT 'class', classification FROM f UNION SELECT 'chain', chain FROM s UNION SELECT 'profile', scan_profile FROM s UNION SELECT 'status', status FROM s")
def distinct_options(spark, sf):
    f, s = rel(spark, sf, FINDINGS), rel(spark, sf, SCANS)
    d = lambda df, c, k: df.select(F.lit(k).alias("kind"), F.col(c).alias("val")).distinct()
    return d(f, "detector", "detector").unionByName(d(f, "classification", "class")).unionByName(d(s, "chain", "chain")).unionByName(
        d(s, "scan_profile", "profile")).unionByName(d(s, "status", "status"))


@query("filtered_scans", f"WITH {S} SELECT id, name, status, chain FROM s WHERE status = 'completed' AND scan_profile = 'deep' AND (contains(CAST(id AS VARCHAR), '12') OR contains(lower(name), '12') OR contains(lower(chain), '12'))")
def filtered_scans(spark, sf):
    hit = F.contains(F.col("id").cast("string"), F.lit("12")) | F.contains(F.lower("name"), F.lit("12")) | F.contains(F.lower("chain"), F.lit("12"))
    return rel(spark, sf, SCANS).where((F.col("status") == "completed") & (F.col("scan_profile") == "deep") & hit).select("id", "name", "status", "chain")


@query("findings_order", f"WITH {FI} SELECT id, impact_score, confidence_score, row_number() OVER (ORDER BY impact_score DESC NULLS LAST, confidence_score DESC NULLS LAST, id) AS rank_no FROM f")
def findings_order(spark, sf):
    return ranked(rel(spark, sf, FINDINGS).select("id", "impact_score", "confidence_score"), F.desc("impact_score"), F.desc("confidence_score"), "id")


@query("locale_sort", f"WITH {S} SELECT id, name, row_number() OVER (ORDER BY name, id DESC) AS rank_no FROM s")
def locale_sort(spark, sf):
    return ranked(rel(spark, sf, SCANS).select("id", "name"), F.collate("name", "UNICODE"), F.desc("id"))


@query("finding_details", f"WITH {T}, {FI}, {RV} SELECT f.id, f.detector, t.address, t.scan_id, r.rationale AS ai_rationale FROM f JOIN t ON t.id = f.target_id LEFT JOIN r ON r.id = f.ai_review_id")
def finding_details(spark, sf):
    return sinks.finding_details(findings(spark, sf), rel(spark, sf, TARGETS), rel(spark, sf, REVIEWS)).select("id", "detector", "address", "scan_id", "ai_rationale")


@query("scan_findings_semi", f"WITH {T}, {FI} SELECT id, detector FROM f WHERE target_id IN (SELECT id FROM t WHERE scan_id % 10 = 3)")
def scan_findings_semi(spark, sf):
    t = rel(spark, sf, TARGETS).where("scan_id % 10 = 3").select(F.col("id").alias("target_id"))
    return rel(spark, sf, FINDINGS).join(t, "target_id", "left_semi").select("id", "detector")


@query("target_children", f"WITH {T}, {FI} SELECT t.id AS target_id, t.status, f.id AS finding_id, f.impact_score, f.confidence_score FROM t LEFT JOIN f ON f.target_id = t.id")
def target_children(spark, sf):
    """Children stay rows (no list grows with a target); readers order them by (target, impact, confidence, id)."""
    f = rel(spark, sf, FINDINGS).select("target_id", F.col("id").alias("finding_id"), "impact_score", "confidence_score")
    d = rel(spark, sf, TARGETS).select(F.col("id").alias("target_id"), "status").join(f, "target_id", "left")
    return d.orderBy("target_id", F.desc("impact_score"), F.desc("confidence_score"), "finding_id")


@query("watch_events_join", "SELECT user_id AS watch_id, event_id, event_type AS kind FROM events")
def watch_events_join(spark, sf):
    e = table(spark, sf, "events")
    w = e.select(F.col("user_id").alias("watch_id")).distinct()
    d = w.join(e, F.col("watch_id") == F.col("user_id")).orderBy("watch_id", F.desc("ts"), "event_id")
    return d.select("watch_id", "event_id", F.col("event_type").alias("kind"))


@query("positional_join", f"""WITH a AS (SELECT l_orderkey AS k, l_partkey AS a_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {POS}) AS rn FROM lineitem WHERE l_returnflag = 'R'),
b AS (SELECT l_orderkey AS k, l_suppkey AS b_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {POS}) AS rn FROM lineitem WHERE l_linestatus = 'F') SELECT a.k, a_id, b_id FROM a LEFT JOIN b USING (k, rn)""")
def positional_join(spark, sf):
    """k-th row meets k-th row inside one order (facts and bodies of one file and name in the scanned design)."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy("k").orderBy("p"))
    li = table(spark, sf, "lineitem").withColumns({"k": F.col("l_orderkey"), "p": F.expr(POS)})
    a = li.where("l_returnflag = 'R'").select("k", F.col("l_partkey").alias("a_id"), rn.alias("rn"))
    b = li.where("l_linestatus = 'F'").select("k", F.col("l_suppkey").alias("b_id"), rn.alias("rn"))
    return a.join(b, ["k", "rn"], "left").select("k", "a_id", "b_id")


@query("anti_known", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_known(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id")).join(o, "id", "left_anti")


@query("set_ops", """SELECT 'both' AS op, k FROM (SELECT o_custkey % 100 AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)
UNION ALL SELECT 'only', k FROM (SELECT s_suppkey AS k FROM supplier EXCEPT SELECT o_custkey % 100 FROM orders WHERE o_custkey % 3 = 0)""")
def set_ops(spark, sf):
    o = table(spark, sf, "orders")
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    both = o.select((F.col("o_custkey") % 100).alias("k")).intersect(s.where("k % 2 = 0"))
    only = s.subtract(o.where("o_custkey % 3 = 0").select((F.col("o_custkey") % 100).alias("k")))
    return both.select(F.lit("both").alias("op"), "k").unionByName(only.select(F.lit("only").alias("op"), "k"))


@query("scan_first_wins", "SELECT k, arg_min(doc_id, doc_id) AS doc_id FROM (SELECT sha1(lower(source || '|' || lang)) AS k, doc_id FROM documents) GROUP BY 1")
def scan_first_wins(spark, sf):
    d = table(spark, sf, "documents").select(F.sha1(F.lower(F.concat_ws("|", "source", "lang"))).alias("k"), "doc_id", F.col("doc_id").alias("o"))
    return dedup.keep_first(d, ["k"], F.col("o")).select("k", "doc_id")


@query("last_wins", f"WITH {FI} SELECT target_id, detector, arg_max(title, id) AS title, max(id) AS id FROM f GROUP BY 1, 2")
def last_wins(spark, sf):
    return dedup.keep_last(rel(spark, sf, FINDINGS).select("target_id", "detector", "title", "id"), ["target_id", "detector"], F.col("id"))


@query("best_confidence", f"WITH {FI} SELECT target_id, title, id, confidence_score FROM f QUALIFY row_number() OVER (PARTITION BY target_id, title ORDER BY confidence_score DESC, id) = 1")
def best_confidence(spark, sf):
    return dedup.best_per_key(rel(spark, sf, FINDINGS).select("target_id", "title", "id", "confidence_score"), ["target_id", "title"], F.col("confidence_score"), F.col("id"))


@query("rescan_copy", f"WITH {T}, {S} SELECT t.address, t.label, s.id AS scan_id FROM t JOIN s ON s.id = t.scan_id WHERE s.status IN ('failed', 'cancelled')")
def rescan_copy(spark, sf):
    s = rel(spark, sf, SCANS).where("status IN ('failed', 'cancelled')").select(F.col("id").alias("scan_id"))
    return rel(spark, sf, TARGETS).join(s, "scan_id").select("address", "label", "scan_id")


@query("benchmark_report", f"""WITH {T}, {FI}, lt AS (SELECT chain, lower(address) AS al, max(id) AS id, arg_max(status, id) AS status FROM t GROUP BY 1, 2),
c AS (SELECT 'case' || o_orderkey AS case_id, o_orderpriority AS chain, '0xa' || o_orderkey AS al, CASE o_custkey % 3 WHEN 0 THEN ['reentrancy'] WHEN 1 THEN ['token_logic', 'permit_misuse'] ELSE ['access_control'] END AS exp, o_custkey % 2 AS mc, o_custkey % 5 = 0 AS ri FROM orders),
p AS (SELECT target_id, list(DISTINCT detector) AS present, count(*) FILTER (classification IN {CRIT}) AS critical FROM f GROUP BY 1),
d AS (SELECT c.*, lt.id AS target_id, lt.status, coalesce(p.present, []) AS present, coalesce(p.critical, 0) AS critical FROM c LEFT JOIN lt ON lt.chain = c.chain AND lt.al = c.al LEFT JOIN p ON p.target_id = lt.id)
SELECT case_id, target_id, array_to_string(list_filter(exp, lambda x: NOT list_contains(present, x)), ',') AS missing, critical,
 target_id IS NOT NULL AND status = 'completed' AND len(list_filter(exp, lambda x: NOT list_contains(present, x))) = 0 AND critical >= mc AND (NOT ri OR target_id % 4 = 3) AS passed FROM d""")
def benchmark_report(spark, sf):
    o = table(spark, sf, "orders")
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    k = F.col("o_custkey") % 3
    cases = o.select(F.concat(F.lit("case"), F.col("o_orderkey").cast("string")).alias("case_id"), F.col("o_orderpriority").alias("chain"), F.concat(F.lit("0xA"), F.col("o_orderkey").cast("string")).alias("address"),
                     F.when(k == 0, a("reentrancy")).when(k == 1, a("token_logic", "permit_misuse")).otherwise(a("access_control")).alias("expected_detectors"),
                     (F.col("o_custkey") % 2).alias("min_critical"), (F.col("o_custkey") % 5 == 0).alias("requires_invariants"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("target_id"), F.col("o_orderkey").alias("id"), F.lit("fuzz-invariants").alias("tool_name"),
                                             F.when(F.col("o_orderkey") % 4 == 3, "ok").otherwise("failed").alias("status"), F.lit("").alias("summary"))
    d = agg.benchmark_report(cases, rel(spark, sf, TARGETS), rel(spark, sf, FINDINGS), runs)
    return d.select("case_id", "target_id", F.array_join("missing_detectors", ",").alias("missing"), "critical", "passed")


@query("precision_report", f"""WITH {T}, {FI}, p AS (SELECT target_id, count(*) AS n, count(*) FILTER (classification IN {CRIT}) AS rep FROM f GROUP BY 1),
c AS (SELECT 'p' || o_orderkey AS case_id, coalesce(p.rep, 0) AS rep, o_custkey % 7 = 0 AS allow FROM orders LEFT JOIN p ON p.target_id = o_orderkey)
SELECT count(*) AS cases, count(*) FILTER (allow OR rep = 0) AS passed_cases, count(*) FILTER (NOT (allow OR rep = 0)) AS failed_cases, bool_and(allow OR rep = 0) AS all_passed FROM c""")
def precision_report(spark, sf):
    o = table(spark, sf, "orders")
    cases = o.select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("case_id"), F.col("o_orderpriority").alias("chain"),
                     F.concat(F.lit("0xA"), F.col("o_orderkey").cast("string")).alias("address"), (F.col("o_custkey") % 7 == 0).alias("allow_reportable"))
    return agg.report_totals(agg.precision_report(cases, rel(spark, sf, TARGETS), rel(spark, sf, FINDINGS)))


@query("precision_corpus", """SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '0x' || c_custkey END AS case_id, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '0x' || c_custkey END AS name,
 CASE WHEN c_custkey % 2 = 0 THEN 'base' ELSE 'ethereum' END AS chain, CASE WHEN c_custkey % 5 = 0 THEN 'safe' ELSE 'must stay silent' END AS reason, '0x' || c_custkey AS address, c_custkey % 4 = 0 AS allow_reportable FROM customer""")
def precision_corpus(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    n = F.lit(None).cast("string")
    rows = c.select(F.when(k % 3 == 0, F.col("c_name")).alias("id"), n.alias("name"), F.when(k % 2 == 0, "base").alias("chain"), n.alias("reason"), F.when(k % 5 == 0, "safe").alias("label"),
                    F.concat(F.lit("0x"), k.cast("string")).alias("address"), F.when(k % 4 == 0, True).alias("allow_reportable"))
    return agg.load_precision_corpus(rows)


@query("csv_export", f"""WITH {T}, {FI} SELECT t.address, f.detector, f.title, CAST(CAST(round_even(f.impact_score, 0) AS INT) AS VARCHAR) AS impact, CAST(CAST(round_even(f.confidence_score, 0) AS INT) AS VARCHAR) AS confidence,
 f.classification, f.status, coalesce(f.next_test, '') AS next_test FROM f JOIN t ON t.id = f.target_id""")
def csv_export(spark, sf):
    return sinks.csv_rows(sinks.finding_details(findings(spark, sf), rel(spark, sf, TARGETS), rel(spark, sf, REVIEWS)))


@query("nested_export", f"""WITH {T}, {FI} SELECT DISTINCT t.scan_id, f.target_id, t.address, t.contract_name, NULL::BIGINT AS finding_id, '' AS doc FROM f JOIN t ON t.id = f.target_id
UNION ALL SELECT t.scan_id, f.target_id, t.address, t.contract_name, f.id, f.id || ':' || f.detector || ':' || f.classification FROM f JOIN t ON t.id = f.target_id""")
def nested_export(spark, sf):
    d = sinks.document_rows(sinks.finding_details(findings(spark, sf), rel(spark, sf, TARGETS), rel(spark, sf, REVIEWS)), ["detector", "classification"])
    doc = F.concat_ws(":", F.col("finding.id").cast("string"), "finding.detector", "finding.classification")
    return d.select("scan_id", "target_id", "address", "contract_name", F.col("finding.id").cast("long").alias("finding_id"), doc.alias("doc"))


@query("markdown_export", f"""WITH {T}, {FI}, {RV}, d AS (SELECT t.scan_id, f.target_id, t.address, t.contract_name, f.*, r.rationale FROM f JOIN t ON t.id = f.target_id LEFT JOIN r ON r.id = f.ai_review_id WHERE classification IN {CRIT})
SELECT scan_id, target_id, -1::BIGINT AS line_no, max('## Target `' || address || '` (' || contract_name || ')') AS line FROM d GROUP BY 1, 2
UNION ALL SELECT scan_id, target_id, id, '### ' || title || chr(10) || '- Severity: high  Class: ' || classification || chr(10) || '- Impact ' || CAST(round_even(impact_score, 0) AS INT) || ' / confidence ' || CAST(round_even(confidence_score, 0) AS INT)
 || chr(10) || '- Detector: ' || detector || chr(10) || coalesce(rationale, 'about ' || title) FROM d""")
def markdown_export(spark, sf):
    f = findings(spark, sf).withColumns({"severity_candidate": F.lit("high"), "description": F.concat(F.lit("about "), "title")})
    return sinks.markdown_lines(sinks.finding_details(f, rel(spark, sf, TARGETS), rel(spark, sf, REVIEWS)))


@query("evidence_sink", f"WITH {FI} SELECT target_id, substring(regexp_replace(detector || '_' || id || '_' || title, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 120) AS name, '{{\"detector\":\"' || detector || '\",\"functions\":[\"' || title || '\"],\"pos\":' || id || ',\"target_id\":' || target_id || '}}' AS body FROM f")
def evidence_sink(spark, sf):
    c = rel(spark, sf, FINDINGS).select("target_id", "detector", F.col("id").alias("pos"), F.array("title").alias("functions"))
    return sinks.evidence_rows(c)


@query("upsert_view", "SELECT user_id, arg_max(event_type, ts) AS event_type, max(event_id) AS n FROM events GROUP BY 1")
def upsert_view(spark, sf):
    e = table(spark, sf, "events")
    last = sinks.upsert_view(e.select("user_id", "event_type", "ts"), ["user_id"], "ts")
    return last.join(e.groupBy("user_id").agg(F.max("event_id").alias("n")), "user_id").select("user_id", "event_type", "n")


OBS = ("SELECT concat('0x', CAST(user_id AS VARCHAR(20))) AS address, ts, CASE WHEN event_type = 'click' THEN concat('0xI', CAST(event_id % 3 AS VARCHAR(20))) ELSE '' END AS implementation, "
       "concat('h', CAST(event_id % 2 AS VARCHAR(20))) AS codehash, CASE WHEN event_type = 'view' THEN concat('0xa', CAST(event_id % 2 AS VARCHAR(20))) ELSE '' END AS admin, "
       "CASE WHEN event_type = 'error' THEN '' ELSE concat('0xO', CAST(event_id % 4 AS VARCHAR(20))) END AS owner FROM events ")


def _obs_sql():
    per = lambda c, extra="": (f"SELECT address, ts, '{ {'implementation': 'upgrade', 'codehash': 'codehash_change', 'admin': 'admin_change', 'owner': 'owner_change'}[c] }' AS kind, old_{c} AS old, {c} AS new, "
                               f"'{'critical' if c in ('implementation', 'codehash') else 'high'}' AS severity, {str(c in ('implementation', 'codehash')).lower()} AS rescan FROM d WHERE n > 1 AND lower(old_{c}) <> lower({c}){extra}")
    cols = ("implementation", "codehash", "admin", "owner")
    nn = ", ".join(f"nullif({c}, '') AS {c}" for c in cols)
    old = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY address ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old_{c}" for c in cols)
    return (f"WITH o AS ({OBS}), e AS (SELECT address, ts, {nn} FROM o), d AS (SELECT *, {old}, row_number() OVER (PARTITION BY address ORDER BY ts) AS n FROM e) "
            + " UNION ALL ".join(per(c, " AND implementation IS NULL" if c == "codehash" else "") for c in cols))


@query("change_detect", _obs_sql())
def change_detect(spark, sf):
    return watch.watch_batch(rel(spark, sf, OBS))


@query("due_check", """WITH w AS (SELECT user_id AS id, max(ts) AS last, user_id % 4 AS g FROM events GROUP BY 1)
SELECT id, g FROM w WHERE g <> 3 AND (g = 0 OR date_diff('second', date_trunc('second', last), TIMESTAMP '2024-01-30 23:00:00') >= CASE WHEN g = 1 THEN 3600 ELSE 300 END)""")
def due_check(spark, sf):
    w = table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last"))
    w = w.withColumn("g", F.col("id") % 4).withColumns({"enabled": F.col("g") != 3, "last_checked_at": F.when(F.col("g") != 0, F.col("last")),
                                                        "interval_seconds": F.when(F.col("g") == 1, 3600)})
    return watch.due_rows(w, "2024-01-30 23:00:00").select("id", "g")


CREATED = ("SELECT concat('d', CAST(o_custkey % 20 AS VARCHAR(9))) AS deployer, concat('0x', CAST(o_orderkey AS VARCHAR(9))) AS address, o_orderkey * 3 AS block FROM orders ")


@query("deployer_watch", f"""WITH c AS ({CREATED}), k AS (SELECT '0x' || l_orderkey AS address FROM lineitem WHERE l_linenumber = 1),
w AS (SELECT DISTINCT deployer, CASE WHEN deployer = 'd3' THEN NULL ELSE 600 END AS lb FROM c), e AS (SELECT c.* FROM c JOIN w USING (deployer) WHERE block >= coalesce(lb, 0)),
t AS (SELECT * FROM e WHERE address NOT IN (SELECT address FROM k) QUALIFY row_number() OVER (PARTITION BY deployer ORDER BY block, address) <= 25),
s AS (SELECT deployer, max(block) AS ls FROM e GROUP BY 1), g AS (SELECT deployer, max(block) AS lt, count(*) AS n FROM t GROUP BY 1)
SELECT w.deployer, coalesce(lt, ls, lb) AS next_block, coalesce(n, 0) AS onboarded FROM w LEFT JOIN s USING (deployer) LEFT JOIN g USING (deployer)""")
def deployer_watch(spark, sf):
    c = rel(spark, sf, CREATED)
    known = table(spark, sf, "lineitem").where("l_linenumber = 1").select(F.concat(F.lit("0x"), F.col("l_orderkey").cast("string")).alias("address"))
    w = c.select("deployer").distinct().withColumn("last_block_checked", F.when(F.col("deployer") != "d3", 600).cast("long"))
    return watch.new_deploys(c, known, w)[1]


@query("text_normalise_fingerprint", r"SELECT doc_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '0x[0-9a-fA-F]{4,}', '0x', 'g'), '\b[0-9]+\b', 'n', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g'))) AS fp FROM documents")
def text_normalise_fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1(sc.norm_title(F.col("text"))).alias("fp"))


@query("scalar_ladders", """SELECT l_orderkey AS k, CASE WHEN l_quantity / 5 >= 9 THEN 'critical' WHEN l_quantity / 5 >= 7 THEN 'high' WHEN l_quantity / 5 >= 4 THEN 'medium' WHEN l_quantity / 5 >= 2 THEN 'low' ELSE 'info' END AS severity,
 CASE WHEN l_discount * 100 >= 8 THEN 'high' WHEN l_discount * 100 >= 4 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def scalar_ladders(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("k"), sc.severity(F.col("l_quantity") / 5).alias("severity"), sc.confidence_label(F.col("l_discount") * 100).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("scalar_strings", r"""SELECT p_partkey AS id, CASE WHEN length(p_name) <= 16 THEN '***' ELSE left(p_name, 12) || '...' || right(p_name, 4) END AS masked,
 substring(regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9_.-]', '_', 'g'), 1, 20) AS slug, substring(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS check_slug,
 CASE p_partkey % 4 WHEN 0 THEN 8453 WHEN 1 THEN 42161 ELSE 1 END AS chain_id, p_partkey % 3 = 0 OR p_partkey % 3 = 2 AS flag, 'a/' || p_partkey || '.sol' AS path FROM part""")
def scalar_strings(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    chain = F.when(k % 4 == 0, "BASE").when(k % 4 == 1, "arbitrum").otherwise("nowhere")
    tog = F.when(k % 3 == 0, F.create_map(F.lit("x"), F.lit("true"))).when(k % 3 == 1, F.create_map(F.lit("x"), F.lit("false"))).otherwise(F.create_map(F.lit("y"), F.lit("false")))
    return p.select(k.alias("id"), sc.mask(F.col("p_name")).alias("masked"), sc.file_slug(F.concat_ws("/", "p_name", "p_type"), 20).alias("slug"), sc.check_slug(F.col("p_type")).alias("check_slug"),
                    sc.chain_id(chain).alias("chain_id"), sc.toggle(tog, "x", True).alias("flag"), sc.safe_relpath(F.concat(F.lit("/./a/../"), k.cast("string"))).alias("path"))


@query("json_from_chat", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CAST(props->>'$.k' AS INT) END AS k FROM events""")
def json_from_chat(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id") % 4
    chat = (F.when(i == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nbye"))).when(i == 1, F.concat(F.lit("answer "), "props", F.lit(" end")))
            .when(i == 2, F.col("props")).otherwise(F.lit("no {json here")))
    return e.select("event_id", F.get_json_object(sc.json_from_text(chat), "$.k").cast("int").alias("k"))


@query("invariant_summary", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE o_custkey % 9 END AS probes, CASE WHEN o_orderkey % 3 = 2 THEN 0 ELSE o_custkey % 5 END AS stateful, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 4 ELSE 0 END AS assets FROM orders""")
def invariant_summary(spark, sf):
    o = table(spark, sf, "orders")
    n = lambda m: (F.col("o_custkey") % m).cast("string")
    head = F.concat(F.lit("done: "), n(9), F.lit(" probe(s) + "), n(5), F.lit(" stateful scenario(s)"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(head, F.lit(" + "), n(4), F.lit(" asset probe(s) + 1 accounting probe(s)"))).when(F.col("o_orderkey") % 3 == 1, head).otherwise("nothing")
    s = sc.invariant_summary(text)
    return o.select(F.col("o_orderkey").alias("id"), s["probes"].cast("long").alias("probes"), s["stateful"].cast("long").alias("stateful"), s["assets"].cast("long").alias("assets"))


@query("trim_projection", """SELECT doc_id, CASE WHEN length(text) <= 1500 THEN md5(text) ELSE md5(substring(text, 1, 1500) || ' …[truncated]') END AS t, least(12, len(string_split(text, chr(10)))) AS n FROM documents""")
def trim_projection(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(sc.trim_text(F.col("text"))).alias("t"), F.size(sc.trim_list(F.split("text", "\n"))).cast("long").alias("n"))


@query("regexp_counts", r"SELECT doc_id, len(regexp_extract_all(text, '[^a-z]the[^a-z]')) AS n_the, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{5}'))) AS distinct_five FROM documents")
def regexp_counts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit(r"[^a-z]the[^a-z]")).cast("long").alias("n_the"),
                    F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([a-z]{5})"), F.lit(1)))).cast("long").alias("distinct_five"))


STOPS = ", ".join(f"'{w}'" for w in sc.STOP_WORDS)
TOK = rf"list_filter(list_distinct(regexp_extract_all(lower(text), '([a-z][a-z0-9_]{{3,}})', 1)), lambda w: w NOT IN ({STOPS}))"


@query("tokens", f"SELECT doc_id, len({TOK}) AS n, md5(array_to_string(list_sort({TOK}), ' ')) AS h FROM documents")
def tokens(spark, sf):
    d = table(spark, sf, "documents").withColumn("t", sc.tokens(F.col("text")))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("h"))


@query("corpus_match", f"""WITH a AS (SELECT doc_id, unnest({TOK}) AS w FROM documents), b AS (SELECT item_id, unnest({TOK}) AS w FROM benchmark),
m AS (SELECT doc_id, item_id, count(*) AS overlap FROM a JOIN b USING (w) GROUP BY 1, 2 HAVING count(*) >= 2), s AS (SELECT *, overlap + CASE WHEN item_id % 3 = 0 THEN 1 ELSE 0 END AS relevance FROM m)
SELECT doc_id AS cand_id, item_id AS entry_id, overlap, relevance FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, overlap DESC, item_id) <= 4""")
def corpus_match(spark, sf):
    c = spread(table(spark, sf, "documents")).select(F.col("doc_id").alias("cand_id"), F.lit("no_such_rule").alias("detector"), sc.tokens(F.col("text")).alias("tokens"))
    k = table(spark, sf, "benchmark").select(F.col("item_id").alias("entry_id"), F.col("item_id").alias("entry_pos"), F.when(F.col("item_id") % 3 == 0, "critical").otherwise("low").alias("severity"), sc.tokens(F.col("text")).alias("keywords"))
    return agg.knowledge_matches(c, k).select("cand_id", "entry_id", "overlap", "relevance")


@query("reasoner_hypotheses", """SELECT o_orderkey AS target_id, 'invariant_reasoner' AS detector, CASE o_orderkey % 5 WHEN 0 THEN 9.0 WHEN 1 THEN 7.5 WHEN 2 THEN 3.0 ELSE 5.0 END::DOUBLE AS impact, least(CASE WHEN o_custkey % 4 = 0 THEN 4.0 ELSE o_custkey % 11 END, 6.0)::DOUBLE AS conf,
 o_orderpriority || CASE WHEN o_custkey % 3 = 0 THEN ' replay' ELSE '' END AS bug_class, o_custkey % 3 = 0 AS lead_only, o_custkey % 2 <> 0 AS governance_controlled FROM orders""")
def reasoner_hypotheses(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey") % 5, F.col("o_custkey")
    h = o.select(F.col("o_orderkey").alias("target_id"), F.lit("t").alias("title"), F.when(k == 0, "CRITICAL").when(k == 1, "high").when(k == 2, "low").otherwise("odd").alias("severity"),
                 F.when(c % 4 == 0, "n/a").otherwise((c % 11).cast("string")).alias("confidence"), F.concat("o_orderpriority", F.when(c % 3 == 0, " replay").otherwise("")).alias("bug_class"), F.lit("f").alias("function"),
                 (c % 2 == 0).alias("unprivileged"))
    return agg.hypotheses_to_candidates(h).select("target_id", "detector", "impact", "conf", "bug_class", "lead_only", "governance_controlled")


@query("stream_watch", _obs_sql())
def stream_watch(spark, sf):
    """The stateful twin over the events files as a stream, run to completion."""
    import uuid

    src = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parquet*")
    src.createOrReplaceTempView("events_stream")
    obs = spark.sql(OBS.replace("VARCHAR(20)", "STRING").replace("FROM events ", "FROM events_stream ")).withColumn("ts", F.col("ts").cast("timestamp"))
    base, name = shared_folder(spark), f"watch-{uuid.uuid4().hex}"
    # transformWithState keeps its state in RocksDB
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = watch.watch_stream(obs).writeStream.format("parquet").option("path", f"{base}/{name}/out").option("checkpointLocation", f"{base}/{name}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/{name}/out")


@query("restart_recovery", f"WITH {S} SELECT id, CASE WHEN status = 'running' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' THEN 'mark_failed' END AS next_action FROM s")
def restart_recovery(spark, sf):
    return agg.recover_interrupted(rel(spark, sf, SCANS)).select("id", "status", "next_action")


def events_stream(spark, sf):
    """The events files as a stream."""
    return spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)"
SUMS = "count(*) AS n, sum(CAST(value AS DECIMAL(18, 2)))::DOUBLE AS total, max(value) AS top"


def _sums():
    return [F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"), F.max("value").alias("top")]


@query("stream_tumbling", f"""WITH s AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start FROM events)
SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, {SUMS} FROM s GROUP BY ALL HAVING window_end <= {CLOSED}""")
def stream_tumbling(spark, sf):
    return windows.drained(windows.windowed(events_stream(spark, sf), ["event_type"], _sums(), "10 minutes", "1 hour"))


@query("stream_sliding", f"""WITH s AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 15 MINUTE AS window_start FROM events, range(4) r(k))
SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, {SUMS} FROM s GROUP BY ALL HAVING window_end <= {CLOSED}""")
def stream_sliding(spark, sf):
    return windows.drained(windows.windowed(events_stream(spark, sf), ["event_type"], _sums(), "10 minutes", "1 hour", "15 minutes"))


@query("stream_sessions", f"""WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, {SUMS} FROM s GROUP BY user_id, k HAVING session_end <= {CLOSED}""")
def stream_sessions(spark, sf):
    return windows.drained(windows.sessions(events_stream(spark, sf), ["user_id"], _sums(), "10 minutes", "30 minutes"))


@query("stream_first_seen", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf):
    """A delay longer than the table's time, so each key comes once."""
    return windows.drained(windows.first_seen(events_stream(spark, sf), ["user_id", "event_type"], "3650 days").select("user_id", "event_type"))


@query("stream_upserts", "SELECT user_id, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_upserts(spark, sf):
    """The latest event of each user, merged trigger by trigger into a partitioned table."""
    import uuid

    at = f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex}"
    rows = events_stream(spark, sf).select("user_id", "event_id", "ts", F.pmod(F.xxhash64("user_id"), F.lit(8)).cast("int").alias("part"))
    merge = sinks.Upserts(f"{at}/table", ["user_id"], ["ts", "event_id"], "part")
    q = rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return merge.read(spark).select("user_id", "event_id", "ts")


OFFSETS = [f"(doc_id * {a} + {b}) % (length(text) + 1)" for a, b in ((7919, 11), (104729, 5), (31, 0))]


@query("hit_lines", f"""WITH o AS (SELECT DISTINCT doc_id, text, unnest([{', '.join(OFFSETS)}]) AS start FROM documents),
l AS (SELECT *, length(substring(text, 1, start)) - length(replace(substring(text, 1, start), chr(10), '')) AS ln, string_split(text, chr(10)) AS a FROM o),
w AS (SELECT *, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS b FROM l)
SELECT doc_id, start, (ln + 1)::INT AS line, md5(array_to_string(b[greatest(0, ln - 1) + 1:least(len(b), ln + 8)], chr(10))) AS window_md5 FROM w""")
def hit_lines(spark, sf):
    """Line and surrounding lines of three offsets in every document."""
    d = table(spark, sf, "documents", heavy=True).select("doc_id", "text")
    o = d.select("doc_id", F.explode(F.array(*[F.expr(e).cast("long") for e in OFFSETS])).alias("start")).distinct()
    return places.with_lines(o, d, ("doc_id",), "text").select("doc_id", "start", "line", F.md5("window").alias("window_md5"))


VOLUME = 40
ENTRIES = f"""s AS ({SCANS}), t AS ({TARGETS}), f AS ({FINDINGS}), d AS (SELECT t.scan_id, f.*, t.address FROM f JOIN t ON t.id = f.target_id),
e AS (SELECT scan_id, 'evidence/' || target_id || '/' || detector || '_' || id AS entry, 0 AS line_no, detector || ' ' || title || ' ' || classification AS line FROM d
 UNION ALL SELECT scan_id, 'findings.csv', id, address || ',' || detector || ',' || title || ',' || CAST(round_even(impact_score, 0) AS INT) || ',' || CAST(round_even(confidence_score, 0) AS INT) || ',' || classification || ',' || status || ',' || coalesce(next_test, '') FROM d
 UNION ALL SELECT DISTINCT scan_id, 'findings.csv', -1, 'address,detector,title,impact,confidence,classification,status,next_test' FROM d)"""


@query("export_archives", f"""WITH {ENTRIES}, n AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY entry, line_no, line) - 1 AS k FROM e)
SELECT scan_id, (k // {VOLUME})::INT AS volume, count(DISTINCT entry)::INT AS n_entries, count(*) AS n_rows, md5(string_agg(line || chr(10), '' ORDER BY k)) AS content_md5 FROM n GROUP BY 1, 2""")
def export_archives(spark, sf):
    """Flat findings and evidence of every scan as zip volumes; the digest is that of the lines read back from the archive."""
    d = sinks.finding_details(findings(spark, sf), rel(spark, sf, TARGETS), rel(spark, sf, REVIEWS))
    # joined once: three branches read it, each for drawing the ranges and for the sort
    d, _ = stored(d.select("scan_id", "target_id", "address", "id", "detector", "title", "classification", "impact_score", "confidence_score", "status", "next_tests"))
    ev = d.select("scan_id", F.concat(F.lit("evidence/"), F.concat_ws("/", F.col("target_id").cast("string"), F.concat_ws("_", "detector", F.col("id").cast("string")))).alias("entry"),
                  F.lit(0).cast("long").alias("line_no"), F.concat_ws(" ", "detector", "title", "classification").alias("line"))
    e = ev.unionByName(sinks.csv_lines(d).select("scan_id", F.lit("findings.csv").alias("entry"), "line_no", "line")).withColumn("section", F.lit(None).cast("long"))
    return bundle.archives(e, VOLUME).select("scan_id", "volume", "n_entries", "n_rows", F.md5(bundle.archive_text("archive")).alias("content_md5"))


@query("empty_reports", f"WITH {T}, {FI} SELECT id AS scan_id, '{sinks.NOTHING}' AS line FROM t WHERE id NOT IN (SELECT target_id FROM f WHERE classification IN {CRIT})")
def empty_reports(spark, sf):
    """The report line of scans without anything to report, each target taken as a scan of its own."""
    f = findings(spark, sf).withColumns({"severity_candidate": F.lit("high"), "description": F.lit("")})
    t = rel(spark, sf, TARGETS).withColumn("scan_id", F.col("id"))
    d = sinks.finding_details(f, t, rel(spark, sf, REVIEWS))
    return sinks.empty_report(t.select("scan_id"), sinks.markdown_lines(d)).select("scan_id", "line")


@query("bundle_manifest", f"WITH {T}, {FI} SELECT 'findings' AS part, count(*) AS n_rows, count(*) AS n_read FROM f UNION ALL SELECT 'targets', count(*), count(*) FROM t UNION ALL SELECT 'chains', count(DISTINCT chain), count(DISTINCT chain) FROM t")
def bundle_manifest(spark, sf):
    """Artefact tables written as one bundle: rows of each part by its manifest and as read back."""
    t = rel(spark, sf, TARGETS)
    path = f"{shared_folder(spark)}/bundles-{uuid.uuid4().hex}"
    bundle.write_bundle({"findings": rel(spark, sf, FINDINGS), "targets": t, "chains": t.select("chain").distinct()}, path)
    read = [d.agg(F.count(F.lit(1)).alias("n_read")).withColumn("part", F.lit(n)) for n, d in bundle.read_bundle(spark, path).items()]
    m = bundle.manifest(spark, path).select("part", "n_rows")
    return m.join(reduce(DataFrame.unionByName, read), "part").select("part", "n_rows", "n_read")
