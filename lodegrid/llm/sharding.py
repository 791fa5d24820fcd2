"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

The shard of a row follows from its key and the shard count alone: no ring table, and with one shard more a row either stays or moves
into the new shard. The key is hashed as the first eight bytes of the MD5 of its text form, so any key type works and any engine can
repeat it.

Defined results: a null key hashes as the empty text; a null text has size 1 and CRC 0; repeated rows are kept, each with a slot of its
own; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import parts, text_of


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of uint64 keys; a key needs about ln(shards) + 1 steps, shards at most."""
    key = keys.astype(np.uint64)
    at, step = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = step[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step[live] = ((at[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
        live = live[step[live] < shards]
    return at


def shard_of(key: Column, *counts: int) -> Column:
    """An array with the shard for each of the given shard counts."""

    @F.pandas_udf("array<int>")
    def places(digest: pd.Series) -> pd.Series:
        keys = np.frombuffer(b"".join(digest), ">u8").reshape(-1, 2)[:, 0]
        return pd.Series(list(np.stack([jump(keys, n) for n in counts], 1).astype(np.int32)))

    return places(F.unhex(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))))


def place(docs: DataFrame, key: str = "doc_id", shards: int = 16) -> DataFrame:
    """Every row with its shard (and its shard if there were one more); no shuffle. Existing columns of these names are replaced."""
    both = shard_of(F.col(key), shards, shards + 1)
    return docs.withColumn("shard", both).withColumn("grown_shard", F.col("shard")[1]).withColumn("shard", F.col("shard")[0])


def manifest(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """One row per document: key, size, text_crc32, shard, grown_shard and slot, gapless from 0 within a shard in key order.

    Only these narrow columns are shuffled. They are range-partitioned by (shard, key, ...) with the row's own number as the last sort
    key, so that neither a large shard nor an often repeated key ends in one task, and are written once; a slot is then the place in the
    partition plus the rows of the shard in earlier partitions, of which a partition holds few.
    """
    content = text_of(docs, text)
    both = shard_of(docs[key], shards, shards + 1)
    narrow = docs.select(
        docs[key].alias("key"), (F.octet_length(content) + F.lit(1)).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("crc"), both.alias("both"), F.monotonically_increasing_id().alias("rid")
    ).withColumns({"shard": F.col("both")[0], "grown": F.col("both")[1]}).drop("both")
    order = ["shard", "key", "size", "crc", "rid"]
    laid = narrow.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    laid = cut(laid.select("key", "size", "crc", "shard", "grown", F.monotonically_increasing_id().alias("at")))
    laid = laid.withColumn("part", F.shiftright("at", 33))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = laid.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return laid.join(runs, ["part", "shard"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", F.col("grown").alias("grown_shard"), (F.col("at") - F.col("first") + F.col("base")).alias("slot")
    )
