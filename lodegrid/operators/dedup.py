"""Ordered de-duplication, duplicate collapse and suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_key, fingerprint, pattern_signature


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key in the given order; partial aggregation before the shuffle, no per-key sort."""
    payload = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("p"))
    return agg.select(*keys, "p.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Last row per key: later definitions overwrite earlier ones."""
    payload = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("p"))
    return agg.select(*keys, "p.*").select(*df.columns)


def best_per_key(df: DataFrame, keys: list[str], score: Column, *order: Column) -> DataFrame:
    """Highest score per key; the earliest row wins a tie."""
    return keep_first(df, keys, -score, *order)


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """Budgeted rows per key (WindowGroupLimit prunes before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank_no", F.row_number().over(w)).where(F.col("rank_no") <= k)


def with_keys(cand: DataFrame) -> DataFrame:
    """Fingerprint, pattern signature and content key of candidate rows."""
    return cand.withColumns({
        "fingerprint": fingerprint(F.col("detector"), F.col("functions"), F.col("title"), F.col("file")),
        "pattern_fingerprint": pattern_signature(F.col("detector"), F.col("functions"), F.col("title"), F.col("rule_id"), F.col("bug_class"),
                                                 F.col("pattern_class"), F.col("snippet")),
        "content_key": content_key(F.col("detector"), F.col("functions"), F.col("title"), F.col("rule_id"), F.col("snippet"),
                                   F.col("body_key") if "body_key" in cand.columns else None),
    })


def collapse_duplicates(cand: DataFrame, scope: list[str]) -> DataFrame:
    """One representative per content key with the strongest scores and the number of copies.

    All aggregates are partial: of a hot group of copies, one representative, two maxima and the
    count per map task reach the reducer. The files of the copies stay a relation of their own
    (``duplicate_files``), so no array grows with the group.
    """
    keys = [*scope, "content_key"]
    rest = [c for c in cand.columns if c not in keys + ["impact", "conf"]]
    g = cand.groupBy(*keys).agg(F.min_by(F.struct(*rest), "pos").alias("rep"), F.max("impact").alias("impact"), F.max("conf").alias("conf"),
                                F.count(F.lit(1)).alias("dup_count"))
    return g.select(*keys, "rep.*", "impact", "conf", "dup_count")


def duplicate_files(cand: DataFrame, scope: list[str]) -> DataFrame:
    """Files other than the representative's in which a content key occurs, in order of appearance."""
    keys = [*scope, "content_key"]
    files = cand.groupBy(*keys, "file").agg(F.min("pos").alias("first_pos"))
    first = cand.groupBy(*keys).agg(F.min_by("file", "pos").alias("main_file"))
    return files.join(first, keys).where("file <> main_file").select(*keys, F.col("file").alias("also_in_file"), "first_pos")


def suppress(cand: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Mark candidates whose fingerprint was marked false-positive, globally or for their address.

    suppressions(fingerprint, address NULL = global, reason). Pattern priors only annotate.
    """
    glob = suppressions.where("address IS NULL").groupBy("fingerprint").agg(F.min("reason").alias("global_reason"))
    scoped = (suppressions.where("address IS NOT NULL").groupBy("fingerprint", F.lower("address").alias("address_lc"))
              .agg(F.min("reason").alias("scoped_reason")))
    prior = glob.select(F.col("fingerprint").alias("pattern_fingerprint"), F.col("global_reason").alias("prior_reason"))
    out = (cand.withColumn("address_lc", F.lower("address")).join(glob, "fingerprint", "left")
           .join(scoped, ["fingerprint", "address_lc"], "left").join(prior, "pattern_fingerprint", "left"))
    hit = F.col("global_reason").isNotNull() | F.col("scoped_reason").isNotNull()
    return out.withColumns({
        "suppressed": F.coalesce(F.col("suppressed"), F.lit(False)) | hit,
        "suppressed_reason": F.coalesce(F.col("suppressed_reason"), "global_reason", "scoped_reason"),
        "prior_refutation": F.when(~hit, F.col("prior_reason")),
    }).drop("address_lc", "global_reason", "scoped_reason", "prior_reason")
