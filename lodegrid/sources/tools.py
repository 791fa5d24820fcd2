"""Stored tool outputs (JSON) as finding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import check_slug

# Checks and titles that are kept or marked whatever their impact.
HIGH_VALUE_CHECKS = ("unprotected-upgrade", "controlled-delegatecall", "arbitrary-send-eth", "arbitrary-send-erc20", "reentrancy-eth",
                     "reentrancy-no-eth", "unchecked-transfer", "unchecked-lowlevel", "tx-origin", "suicidal", "uninitialized-state",
                     "uninitialized-storage", "shadowing-state", "incorrect-equality", "delegatecall-loop")
HIGH_VALUE_TITLES = ("delegatecall", "selfdestruct", "suicide", "unchecked", "arbitrary", "ether", "reentran", "authorization",
                     "write to an arbitrary storage")
SLITHER = ("struct<results:struct<detectors:array<struct<check:string,impact:string,confidence:string,description:string,elements:array<struct<"
           "type:string,name:string,source_mapping:struct<filename_short:string,lines:string>,type_specific_fields:struct<parent:struct<type:string,name:string>>>>>>>>")
SEMGREP = ("struct<results:array<struct<check_id:string,path:string,start:struct<line:string>,extra:struct<severity:string,message:string,"
           "metadata:struct<confidence:string>>>>>")
MYTHRIL = ("struct<issues:array<struct<title:string,`swc-id`:string,severity:string,description:string,filename:string,lineno:string>>>")
ADERYN_ISSUES = ("map<string,struct<issues:array<struct<title:string,description:string,detector_name:string,instances:array<struct<contract_path:string,line_no:string>>>>>>")
_n = lambda c: F.coalesce(c, F.lit(""))


def slither(rows: DataFrame) -> DataFrame:
    """rows(target_id, body) -> High/Medium detectors and the high-value checks."""
    d = rows.select("target_id", F.explode(F.from_json("body", SLITHER)["results"]["detectors"]).alias("d"))
    el = F.col("d.elements")
    fn = F.get(F.filter(el, lambda e: (e["type"] == "function") & (_n(e["name"]) != "")), F.lit(0))["name"]
    par = F.get(F.filter(el, lambda e: (e["type_specific_fields"]["parent"]["type"] == "function") & (_n(e["type_specific_fields"]["parent"]["name"]) != "")), F.lit(0))["type_specific_fields"]["parent"]["name"]
    sm = F.get(el, F.lit(0))["source_mapping"]
    impact = F.lower(_n(F.col("d.impact")))
    check = _n(F.col("d.check"))
    return d.where(impact.isin("high", "medium") | check.isin(*HIGH_VALUE_CHECKS)).select(
        "target_id", F.lit("slither").alias("tool"), check.alias("check"), impact.alias("impact"), F.lower(_n(F.col("d.confidence"))).alias("confidence"),
        F.left(F.trim(_n(F.col("d.description"))), F.lit(2000)).alias("description"),
        F.when(F.size(el) > 0, F.concat_ws(":", _n(sm["filename_short"]), _n(sm["lines"]))).otherwise("").alias("location"),
        F.coalesce(fn, par, F.lit("")).alias("function"), check.isin(*HIGH_VALUE_CHECKS).alias("high_value"))


def semgrep(rows: DataFrame) -> DataFrame:
    d = rows.select("target_id", F.explode(F.from_json("body", SEMGREP)["results"]).alias("r"))
    return d.select("target_id", F.lit("semgrep").alias("tool"), _n(F.col("r.check_id")).alias("check"), F.lower(_n(F.col("r.extra.severity"))).alias("impact"),
                    _n(F.col("r.extra.metadata.confidence")).alias("confidence"), F.left(F.trim(_n(F.col("r.extra.message"))), F.lit(2000)).alias("description"),
                    F.concat_ws(":", _n(F.col("r.path")), _n(F.col("r.start.line"))).alias("location"), F.lit("").alias("function"), F.lit(False).alias("high_value"))


def mythril(rows: DataFrame) -> DataFrame:
    d = rows.select("target_id", F.explode(F.from_json("body", MYTHRIL)["issues"]).alias("i"))
    title = F.coalesce(F.nullif(F.col("i.title"), F.lit("")), F.col("i.swc-id"), F.lit(""))
    hv = F.exists(F.array(*[F.lit(t) for t in HIGH_VALUE_TITLES]), lambda t: F.contains(F.lower(title), t))
    return d.select("target_id", F.lit("mythril").alias("tool"), title.alias("check"), F.lower(_n(F.col("i.severity"))).alias("impact"), F.lit("").alias("confidence"),
                    F.left(F.trim(_n(F.col("i.description"))), F.lit(2000)).alias("description"), F.concat_ws(":", _n(F.col("i.filename")), _n(F.col("i.lineno"))).alias("location"),
                    F.lit("").alias("function"), hv.alias("high_value"))


def aderyn(rows: DataFrame) -> DataFrame:
    """Every top-level ``<severity>_issues`` object; other keys are ignored."""
    m = F.map_filter(F.from_json("body", ADERYN_ISSUES), lambda k, v: F.endswith(k, F.lit("_issues")) & v["issues"].isNotNull())
    d = rows.select("target_id", F.explode(m).alias("k", "v")).select("target_id", F.lower(F.regexp_replace("k", "_issues$", "")).alias("sev"), F.explode("v.issues").alias("i"))
    title, desc = F.trim(F.coalesce(F.nullif(F.col("i.title"), F.lit("")), F.col("i.detector_name"), F.lit(""))), F.trim(_n(F.col("i.description")))
    body = F.when((title != "") & ~F.contains(F.lower(desc), F.lower(title)), F.trim(F.concat(title, F.lit(". "), desc))).otherwise(desc)
    inst = F.get("i.instances", F.lit(0))
    return d.select("target_id", F.lit("aderyn").alias("tool"), F.coalesce(F.nullif(F.col("i.detector_name"), F.lit("")), check_slug(title)).alias("check"), F.col("sev").alias("impact"),
                    F.lit("").alias("confidence"), F.left(body, F.lit(2000)).alias("description"),
                    F.when(F.size("i.instances") > 0, F.concat_ws(":", _n(inst["contract_path"]), _n(inst["line_no"]))).otherwise("").alias("location"),
                    F.lit("").alias("function"), F.lit(False).alias("high_value"))


def forge_counts(rows: DataFrame) -> DataFrame:
    """(target_id, tests_run, tests_passed) from suite-keyed test JSON, text before the object ignored."""
    js = F.regexp_extract("body", r"(?s)(\{.*)", 1)
    suites = F.from_json(js, "map<string,struct<test_results:map<string,struct<status:string,success:boolean>>>>")
    t = F.flatten(F.transform(F.map_values(suites), lambda s: F.coalesce(F.map_values(s["test_results"]), F.array().cast("array<struct<status:string,success:boolean>>"))))
    ok = F.filter(t, lambda x: F.coalesce(x["success"], F.lower(_n(x["status"])) == "success"))
    return rows.select("target_id", F.coalesce(F.size(t), F.lit(0)).alias("tests_run"), F.coalesce(F.size(ok), F.lit(0)).alias("tests_passed")).select(
        "target_id", F.greatest("tests_run", F.lit(0)).alias("tests_run"), F.greatest("tests_passed", F.lit(0)).alias("tests_passed"))
