"""Target lists: text blobs, files and the client-side variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import keep_first

ADDRESS = r"^0x[0-9a-fA-F]{40}$"


def parse_target_list(lines: DataFrame) -> DataFrame:
    """lines(line_no, value) -> valid targets, first occurrence of an address kept with its label.

    A line is cut once at the first run of comma, tab or blank. The de-dup key is the lower-cased
    address: checksummed spellings of one address are one target.
    """
    v = F.trim("value")
    d = lines.select("line_no", F.regexp_extract(v, r"^([^,\t ]+)", 1).alias("address"), F.trim(F.regexp_extract(v, r"^[^,\t ]+[,\t ]+(.*)$", 1)).alias("label"))
    d = d.where(F.col("address").rlike(ADDRESS)).withColumn("address_lc", F.lower("address"))
    return keep_first(d, ["address_lc"], F.col("line_no"))


def parse_client_list(lines: DataFrame) -> DataFrame:
    """The comma-only variant: address, label from the rest; lower-cased de-dup key."""
    v = F.trim("value")
    d = lines.select("line_no", F.trim(F.substring_index(v, ",", 1)).alias("address"),
                     F.trim(F.regexp_extract(v, r"^[^,]*,(.*)$", 1)).alias("label"))
    d = d.where(F.col("address").rlike(ADDRESS)).withColumn("address_lc", F.lower("address"))
    return keep_first(d, ["address_lc"], F.col("line_no"))


def read_target_file(spark: SparkSession, path: str) -> DataFrame:
    """Plain list file: blank lines dropped, nothing validated, nothing de-duplicated."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").alias("address"))
