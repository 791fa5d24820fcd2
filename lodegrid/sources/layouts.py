"""Compiler-emitted storage layouts inside build artefacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import keep_first

MAX_BYTES = 6_000_000
_LAYOUT = "struct<storage:array<struct<label:string,slot:string,offset:string,type:string,contract:string>>,types:map<string,struct<label:string,numberOfBytes:string>>>"
_DOC = (f"struct<contractName:string,sourceName:string,storageLayout:{_LAYOUT},output:struct<storageLayout:{_LAYOUT},"
        f"contracts:map<string,map<string,struct<storageLayout:{_LAYOUT}>>>>,contracts:map<string,map<string,struct<storageLayout:{_LAYOUT}>>>,"
        "settings:struct<compilationTarget:map<string,string>>>")


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """Build artefacts below a folder: (artifact, size, body, skipped).

    Files over the size limit are listed with the reason in `skipped` and a null body; their bytes are not read.
    """
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    low = F.lower("path")
    d = d.where(low.rlike(r"/(build-info|artifacts|out|cache|sources?)/") | low.rlike(r"[^/]*(metadata|artifact)[^/]*$"))
    none = F.lit(None).cast("string")
    small = d.where(F.col("length") <= MAX_BYTES).select(F.col("path").alias("artifact"), F.col("length").alias("size"), F.col("content").cast("string").alias("body"), none.alias("skipped"))
    large = d.where(F.col("length") > MAX_BYTES).select(F.col("path").alias("artifact"), F.col("length").alias("size"), none.alias("body"), F.lit(f"over {MAX_BYTES} bytes").alias("skipped"))
    return small.unionByName(large)


def layouts(docs: DataFrame) -> DataFrame:
    """docs(target_id, artifact, body) -> one row per contract layout with at least one entry."""
    d = docs.withColumn("d", F.from_json("body", _DOC))
    ct = F.col("d.settings.compilationTarget")
    one = lambda lay, c, s: F.array(F.struct(c.alias("contract_name"), s.alias("source_path"), lay.alias("layout")))
    nested = lambda m: F.flatten(F.transform(F.map_entries(m), lambda e: F.transform(F.map_entries(e["value"]), lambda c: F.struct(
        c["key"].alias("contract_name"), e["key"].alias("source_path"), c["value"]["storageLayout"].alias("layout")))))
    empty = F.from_json(F.lit("[]"), f"array<struct<contract_name:string,source_path:string,layout:{_LAYOUT}>>")
    allf = F.concat(one(F.col("d.storageLayout"), F.col("d.contractName"), F.col("d.sourceName")),
                    one(F.col("d.output.storageLayout"), F.get(F.map_values(ct), F.lit(0)), F.get(F.map_keys(ct), F.lit(0))),
                    F.coalesce(nested(F.coalesce("d.output.contracts", "d.contracts")), empty))
    e = d.select("target_id", "artifact", F.posexplode(allf).alias("k", "l")).select("target_id", "artifact", "k", "l.*")
    return e.where("size(layout.storage) > 0")


def select_layout(lay: DataFrame, names: DataFrame, files: DataFrame) -> DataFrame:
    """The target's layout: by contract name, else by source file name, else the largest."""
    base = lambda c: F.lower(F.substring_index(F.coalesce(c, F.lit("")), "/", -1))
    own = files.select("target_id", base(F.col("path")).alias("fname")).distinct().withColumn("src_hit", F.lit(0))
    d = lay.join(names.select("target_id", F.lower("contract_name").alias("want")), "target_id", "left").withColumn("fname", base(F.col("source_path")))
    d = d.join(own, ["target_id", "fname"], "left")
    by_name = F.when(F.lower(F.coalesce("contract_name", F.lit(""))) == F.col("want"), 0).otherwise(1)
    return keep_first(d, ["target_id"], by_name, F.coalesce("src_hit", F.lit(1)), -F.size("layout.storage"), F.col("artifact"), F.col("k"))


def entries(sel: DataFrame) -> DataFrame:
    """Exact slots: (target_id, label, slot, slot_offset, type, type_label, bytes)."""
    e = sel.select("target_id", "layout.types", F.explode("layout.storage").alias("s"))
    t = F.try_element_at("types", F.col("s.type"))
    num = lambda c: F.coalesce(c.try_cast("long"), F.conv(F.regexp_extract(F.lower(c), "^0x([0-9a-f]+)$", 1), 16, 10).try_cast("long"))
    return e.select("target_id", F.col("s.label").alias("label"), num(F.col("s.slot")).alias("slot"), num(F.col("s.offset")).alias("slot_offset"),
                    F.col("s.type").alias("type"), t["label"].alias("type_label"), t["numberOfBytes"].try_cast("int").alias("bytes"))
