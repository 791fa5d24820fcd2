"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontam, langid, negatives, packing, periodic, quality, secrets, sharding, simhash, substring, tokencount, urls
from .common import fold, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@register("op1_jump_sharding")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return sharding.manifest(docs).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@register("op2_zstd_secrets")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    put = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return secrets.scan(docs).select(
        "doc_id", *[F.size(kind(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(put(F.filter("spans", lambda s: s["kind"] != "novel")).cast("binary"), 256).alias("base_sha256"), put("spans").alias("spans"), F.size(kind("novel")).cast("long").alias("n_novel"),
    )


#: The rules of the contract: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words in a host's name that put its pages on the list of blocked canonical URLs.
LISTED_HOSTS = "casino|pills|bets|ads-track"


@register("op8_bloom_urls", sql=f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^({urls.TRACKING})=')) AS kept FROM u),
c AS (SELECT page_id, host, path, CASE WHEN host = '' THEN '' ELSE regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM h),
listed AS (SELECT DISTINCT canonical FROM c WHERE canonical <> '' AND regexp_matches(host, '{LISTED_HOSTS}')),
rules(rh, rp, decided) AS (VALUES {", ".join(map(str, RULES))}),
best AS (SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(decided, length(rh || rp)) AS decided
  FROM c JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, b.rule, coalesce(b.decided, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, l.canonical IS NOT NULL AS listed
FROM c LEFT JOIN best b USING (page_id) LEFT JOIN listed l ON c.canonical = l.canonical""")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages").select("page_id", "url")
    host, _ = urls.host_path(F.col("url"))
    listed = pages.where(host.rlike(LISTED_HOSTS)).select(urls.canonical(F.col("url")).alias("canonical"))
    rules = spark.createDataFrame([*RULES], "host string, path string, verdict string")
    return urls.filter_pages(pages, rules, listed, sorted({len(p) for _, p, _ in RULES}))


@register("op10_binary_packing")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


@register("op7_simhash")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.groups(load(spark, sf, "documents").select("doc_id", "text"))


@register("op9_count_min_substrings")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return substring.dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op3_projection_forest")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(load(spark, sf, "embeddings").select("vec_id", "embedding"))


@register("op4_random_indexing_quality")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    model = quality.train(docs, load(spark, sf, "labels"))
    return quality.score(docs, model, ["doc_id"]).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted")
    )


@register("op6_family_svm_language")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, fold("doc_id", 4) != 2)
    return langid.predict(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@register("op5_seeded_decontamination")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.matches(load(spark, sf, "documents").select("doc_id", "text"), load(spark, sf, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"), "start", "end")


@register("op11_residue_negatives", sql="""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.c, b.c)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3""")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label))


@register("op12_whole_token_counts")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return tokencount.counts(load(spark, sf, "documents").select("doc_id", "text"))


def with_tail(docs: DataFrame) -> DataFrame:
    """The documents of op13: a tenth of them, by crc32 of the id, end in a stretch of their own words that repeats."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(crc / 10)
    words = F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    picked = docs.withColumn("w", F.when(crc % 10 == 0, words)).withColumn("n", F.size("w").cast("long"))
    picked = picked.withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    picked = picked.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    tail, rest = F.expr("slice(w, CAST(a + 1 AS INT), CAST(p AS INT))"), F.col("n") - F.col("a")
    repeated = F.slice(F.flatten(F.array_repeat(tail, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest.cast("int"))
    edited = F.array_join(F.concat(F.expr("slice(w, 1, CAST(a AS INT))"), repeated), " ")
    return picked.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


@register("op13_frequency_split_runs")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic.detect(with_tail(load(spark, sf, "documents").select("doc_id", "text")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"), sha(lines).alias("runs_sha256"), sha(F.col("kept")).alias("collapsed_sha256"),
    )
