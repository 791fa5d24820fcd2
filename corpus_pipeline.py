"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing.

Each stage works on what its predecessor kept. All but the last return the columns of `documents`; null texts pass as null until they are
packed as empty ones. The stages can't be said in SQL (models, alignments, compression), so they are tested against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.llm import decontam, packing, quality, secrets, simhash
from lodegrid.llm.common import load
from lodegrid.session import discard, shared_folder, ship

#: Documents below this probability of good quality are rejected.
LEAST_QUALITY = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier rejects go."""
    ship(spark)
    model = quality.train(docs, load(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies stays."""
    ship(spark)
    return simhash.first_of_group(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item, whole or edited, go."""
    ship(spark)
    return decontam.clean(docs, load(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: secrets are replaced in the texts; n_chars follows."""
    ship(spark)
    clean = secrets.redact(docs)
    if "n_chars" in clean.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of power-of-two lengths."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality classifier", good_quality), ("near duplicates", one_of_each_group), ("benchmark decontamination", without_benchmarks), ("secret scan", without_secrets), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the results between them are Parquet tables in the shared folder, each deleted when the next is there."""
    docs, folder = load(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        if k:
            discard(spark, f"{folder}/{k - 1}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
