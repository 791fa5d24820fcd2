"""Exports: nested JSON, flat CSV, Markdown, evidence files and the dispatch over formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import REPORTABLE, file_slug
from ..session import discard, stored
from .dedup import keep_last


NOTHING = "_No CONFIRMED_CRITICAL or LIKELY_CRITICAL_NEEDS_POC findings to report._"


def finding_details(findings: DataFrame, targets: DataFrame, reviews: DataFrame) -> DataFrame:
    """findings with their target and, where present, the review rationale."""
    t = targets.select(F.col("id").alias("target_id"), "scan_id", "address", "chain", "contract_name")
    r = reviews.select(F.col("id").alias("ai_review_id"), F.col("rationale").alias("ai_rationale"))
    return findings.join(t, "target_id").join(r, "ai_review_id", "left")


def document_rows(details: DataFrame, fields: list[str], order: str = "id") -> DataFrame:
    """A head row for each target (no finding) and one row for each of its findings; a reader nests them by target.

    No row gathers a group, whatever a target's number of findings.
    """
    head = ["scan_id", "target_id", "address", "contract_name"]
    f = F.struct(F.col(order).alias("id"), *[c for c in fields if c != order])
    rows = details.select(*head, f.alias("finding"))
    return rows.select(*head).distinct().withColumn("finding", F.lit(None).cast(rows.schema["finding"].dataType)).unionByName(rows)


def csv_rows(details: DataFrame, *keys: Column | str) -> DataFrame:
    """Eight flat columns after the keys; scores rounded half-even to whole numbers; first suggested test or empty."""
    whole = lambda c: F.bround(c, 0).cast("int").cast("string")
    return details.select(*keys, "address", "detector", "title", whole("impact_score").alias("impact"), whole("confidence_score").alias("confidence"),
                          "classification", "status", F.coalesce(F.get("next_tests", F.lit(0)), F.lit("")).alias("next_test"))


def csv_lines(details: DataFrame) -> DataFrame:
    """(scan_id, line_no, line): the flat columns as lines of a file, quoted where needed, by finding id; line -1 of each scan is the head."""
    flat = csv_rows(details, "scan_id", F.col("id").cast("long").alias("line_no"))
    cols = flat.columns[2:]
    text = F.to_csv(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in cols]), {"emptyValue": "", "escape": '"'})
    rows = flat.select("scan_id", "line_no", text.alias("line"))
    return rows.select("scan_id").distinct().select("scan_id", F.lit(-1).cast("long").alias("line_no"), F.lit(",".join(cols)).alias("line")).unionByName(rows)


def empty_report(scans: DataFrame, lines: DataFrame) -> DataFrame:
    """The one line of the report of scans(scan_id) that have nothing to report."""
    return scans.join(lines.select("scan_id").distinct(), "scan_id", "left_anti").select(
        "scan_id", F.lit(None).cast("long").alias("target_id"), F.lit(0).cast("long").alias("line_no"), F.lit(NOTHING).alias("line"))


def markdown_lines(details: DataFrame) -> DataFrame:
    """Report lines of reportable findings: (scan_id, target_id, line_no, line), a section head per target."""
    rep = details.where(F.col("classification").isin(*REPORTABLE))
    head = rep.groupBy("scan_id", "target_id").agg(F.max(F.concat(F.lit("## Target `"), "address", F.lit("` ("), F.coalesce("contract_name", F.lit("unknown")), F.lit(")"))).alias("line")).withColumn("line_no", F.lit(-1).cast("long"))
    whole = lambda c: F.bround(c, 0).cast("int").cast("string")
    body = F.concat_ws("\n", F.concat(F.lit("### "), "title"), F.concat(F.lit("- Severity: "), "severity_candidate", F.lit("  Class: "), "classification"),
                       F.concat(F.lit("- Impact "), whole("impact_score"), F.lit(" / confidence "), whole("confidence_score")),
                       F.concat(F.lit("- Detector: "), "detector"), F.coalesce("ai_rationale", "description", F.lit("")))
    rows = rep.select("scan_id", "target_id", body.alias("line"), F.col("id").cast("long").alias("line_no"))
    return head.select("scan_id", "target_id", "line_no", "line").unionByName(rows.select("scan_id", "target_id", "line_no", "line"))


def evidence_rows(cand: DataFrame) -> DataFrame:
    """One JSON text per candidate with a file-safe name, keys in alphabetical order."""
    cols = sorted(cand.columns)
    name = file_slug(F.concat_ws("_", "detector", F.col("pos").cast("string"), F.coalesce(F.get("functions", F.lit(0)), F.lit("x"))), 120)
    return cand.select("target_id", name.alias("name"), F.to_json(F.struct(*cols)).alias("body"))


WRITERS = {"json": lambda d, p: d.write.mode("errorifexists").json(p), "csv": lambda d, p: d.write.mode("errorifexists").option("header", True).csv(p),
           "md": lambda d, p: d.write.mode("errorifexists").text(p), "parquet": lambda d, p: d.write.mode("errorifexists").parquet(p)}


def export(details: DataFrame, fmt: str, path: str) -> None:
    """Write one scan's export in a format; unknown formats fail before any job runs."""
    if fmt not in WRITERS:
        raise ValueError(f"unknown export format: {fmt}")
    if fmt == "csv":
        details = csv_rows(details)
    elif fmt == "json":
        details = document_rows(details, ["detector", "title", "classification", "impact_score", "confidence_score", "status", "ai_rationale"])
    elif fmt == "md":
        details = markdown_lines(details).repartitionByRange("scan_id", "target_id", "line_no").sortWithinPartitions("scan_id", "target_id", "line_no").select("line")
    WRITERS[fmt](details, path)


def write_sources(files: DataFrame, path: str) -> None:
    files.write.mode("errorifexists").partitionBy("chain").parquet(path)


def upsert_view(appended: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write per key over an append-only table."""
    return keep_last(appended, keys, F.col(version))


class Upserts:
    """Merge of a stream's triggers into a partitioned table: of the rows of a key the one that is last by `order` stays.

    Only the partitions that a trigger touches are read and rewritten. A trigger that comes again (after a failure between the write and
    the stream's own note) is left out by the ledger; were the ledger lost, merging it again would change nothing either. `partition` is a
    column that follows from the key, so that all rows of a key are in one partition. For ``foreachBatch``.
    """

    def __init__(self, path: str, keys: list[str], order: list[str], partition: str):
        self.path, self.keys, self.order, self.partition = path, keys, order, partition

    def _there(self, spark: SparkSession, path: str) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/rows")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = f"{self.path}/ledger/batch={batch_id}"
        if self._there(spark, done):
            return
        touched, _ = stored(batch)
        rows = touched
        if self._there(spark, f"{self.path}/rows"):
            parts = touched.select(self.partition).distinct()
            rows = rows.unionByName(self.read(spark).select(*batch.columns).join(parts, self.partition, "left_semi").select(*batch.columns))
        last = keep_last(rows, self.keys, *[F.col(c) for c in self.order]).select(*batch.columns)
        merged, path = stored(last)  # the table is read above, so the result is kept apart before it is overwritten
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition).parquet(f"{self.path}/rows")
        discard(spark, path)
        spark.range(1).write.mode("overwrite").parquet(done)
