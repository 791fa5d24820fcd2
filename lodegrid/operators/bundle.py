"""Artefacts of scans that appear together or not at all, and archives of a scan's export."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, discard
from .ordering import ranked

#: Rows an archive holds at most; a larger scan goes into several volumes.
VOLUME_ROWS = 20_000
#: Lines of a scan that one task sorts; a larger scan's volumes are spread over tasks.
LARGE_SCAN = 1_000_000
#: Counters that the scans share when their lines are counted.
COUNTERS = 1 << 16
#: Characters from which a member is deflated; shorter ones would grow or save nothing.
DEFLATE_FROM = 200
#: Archives go out together up to these bounds.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
_STAMP = (1980, 1, 1, 0, 0, 0)  # the format's earliest time: equal contents give equal archives
MANIFEST = "bundle string, part string, n_rows long, columns array<string>, written_at timestamp"
ARCHIVES = "scan_id long, volume int, n_entries int, n_rows long, archive binary"


def write_bundle(parts: dict[str, DataFrame], path: str) -> str:
    """Write named tables as one bundle and return its name.

    Each part is a Parquet table of its own under the bundle's name, which no reader knows yet. The bundle is there once the manifest has
    a row for each part with its row count, and these rows come as one file by Spark's own committer: a failure before that leaves nothing
    that a reader sees, and what was written is deleted. Parts keep their partitions and never pass through the driver.
    """
    if not parts:
        raise ValueError("a bundle needs at least one part")
    spark = next(iter(parts.values())).sparkSession
    name = uuid.uuid4().hex
    rows = []
    try:
        for part, df in parts.items():
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{path}/parts/{name}/{part}")
            rows.append((name, part, seen.get["n"], df.columns))
    except BaseException:
        discard(spark, f"{path}/parts/{name}")
        raise
    manifest = spark.createDataFrame(rows, "bundle string, part string, n_rows long, columns array<string>").withColumn("written_at", F.current_timestamp())
    manifest.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return name


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The parts of all finished bundles."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str, name: str | None = None) -> dict[str, DataFrame]:
    """The parts of a bundle, by default the one finished last; a bundle without manifest rows does not exist."""
    m = manifest(spark, path)
    if name is None:
        name = m.agg(F.max_by("bundle", F.struct("written_at", "bundle")).alias("b")).first()["b"]
    names = [r["part"] for r in m.where(F.col("bundle") == name).select("part").collect()]  # one short row for each named part
    if not names:
        raise ValueError(f"no finished bundle {name!r} in {path}")
    return {p: spark.read.parquet(f"{path}/parts/{name}/{p}") for p in names}


def export_entries(details: DataFrame, evidence: DataFrame, scans: DataFrame) -> DataFrame:
    """Lines of a scan's archive: (scan_id, entry, line_no, line).

    summary.json has one line for each finding, report.md the report (or that there is nothing to report), findings.csv eight columns,
    evidence/ one text for each row of evidence(scan_id, target_id, name, body). Line -1 is a head where an entry has one.
    """
    from .sinks import csv_lines, empty_report, markdown_lines

    j = details.select("scan_id", F.lit("summary.json").alias("entry"), F.col("id").cast("long").alias("line_no"), F.to_json(
        F.struct("target_id", "address", "id", "detector", "title", "classification", "impact_score", "confidence_score", "status")).alias("line"))
    md = markdown_lines(details)
    # a report has all heads and findings of a target together: the entry's order is target, head, findings
    report = md.select("scan_id", F.lit("report.md").alias("entry"), F.col("target_id").alias("__t"), "line_no", "line")
    csv = csv_lines(details).select("scan_id", F.lit("findings.csv").alias("entry"), "line_no", "line")
    ev = evidence.select("scan_id", F.concat(F.lit("evidence/"), F.col("target_id").cast("string"), F.lit("/"), "name").alias("entry"), F.lit(0).cast("long").alias("line_no"), F.col("body").alias("line"))
    head = scans.select(F.col("id").alias("scan_id"))
    none = empty_report(head, md).select("scan_id", F.lit("report.md").alias("entry"), F.lit(None).cast("long").alias("__t"), "line_no", "line")
    flat = lambda d: d.withColumn("__t", F.lit(None).cast("long")).select("scan_id", "entry", "__t", "line_no", "line")
    cols = [F.col(c) for c in ("scan_id", "entry", "__t", "line_no", "line")]
    out = flat(j).unionByName(report.select(*cols)).unionByName(flat(csv)).unionByName(flat(ev)).unionByName(none.select(*cols))
    return out.select("scan_id", "entry", F.col("__t").alias("section"), "line_no", "line")


def _zip(members: dict[str, list[str]]) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, lines in members.items():
            text = "\n".join(lines) + "\n"
            z.writestr(zipfile.ZipInfo(name, _STAMP), text, zipfile.ZIP_DEFLATED if len(text) >= DEFLATE_FROM else zipfile.ZIP_STORED)
    return buf.getvalue()


def _volumes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (scan_id, volume, rank_no, entry, line, part) in the order of the first three -> archives; one volume is held at a time."""
    now, n, goes_on, members, done, size = None, 0, None, {}, [], 0

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["scan_id", "volume", "n_entries", "n_rows", "archive"])

    for b in batches:
        for scan, volume, _, entry, line, part in zip(*(c.to_pylist() for c in b.columns)):
            if (scan, volume) != now:
                if n:
                    done.append((*now, len(members), n, _zip(members)))
                    size += len(done[-1][-1])
                    if size >= BATCH_BYTES or len(done) >= BATCH_ROWS:
                        yield packed()
                        done, size = [], 0
                now, n, goes_on, members = (scan, volume), 0, None, {}
            if part is not None:  # the note of an entry that goes on here stands before the volume's lines
                goes_on = (entry, f"{entry}.{part}")
                continue
            name = goes_on[1] if goes_on and goes_on[0] == entry else entry
            members.setdefault(name, []).append(line or "")
            n += 1
    if n:
        done.append((*now, len(members), n, _zip(members)))
    if done:
        yield packed()


def _numbered(volume_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (scan_id, entry, line) of whole scans in order -> rows of ``_volumes``, the note of an entry that goes on ahead of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, k, last, began = None, 0, None, 0  # k: the scan's lines so far; began: the volume in which the entry `last` begins
        for b in batches:
            out: list[tuple] = []
            for s, entry, line in zip(*(c.to_pylist() for c in b.columns)):
                if s != scan:
                    scan, k, last = s, 0, None
                volume = k // volume_rows
                k += 1
                if entry is None:
                    continue
                if entry != last:
                    last, began = entry, volume
                elif volume > began and (k - 1) % volume_rows == 0:
                    out.append((s, volume, 0, entry, None, volume - began))
                out.append((s, volume, k, entry, line, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _LINES)], ["scan_id", "volume", "rank_no", "entry", "line", "part"])

    return run


_LINES = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int32())


def archives(entries: DataFrame, volume_rows: int = VOLUME_ROWS) -> DataFrame:
    """entries(scan_id, entry, section, line_no, line) -> (scan_id, volume, n_entries, n_rows, archive), the archive a zip file.

    The lines of a scan stand in one order (entry, section, line) and are cut every `volume_rows` lines. A scan's lines are sorted in one
    task that holds one volume at a time, so they cross the network once; larger scans (``LARGE_SCAN``) are ranked and spread over tasks.
    An entry that goes on in a later volume is named `entry.1`, `entry.2` and so on there; put together in this order they give the entry.
    A null line is an empty one; lines that tie stand in the order of their text.
    """
    # scans share counters, so the counts stay few; a scan that shares one with a large scan goes the large one's way
    slot = F.pmod(F.xxhash64("scan_id"), F.lit(COUNTERS)).alias("__slot")
    large = cut(entries.groupBy(slot).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE_SCAN).select("__slot"))
    if large.isEmpty():
        return _archives_in_task(entries, volume_rows)
    part = lambda how: entries.select("*", slot).join(large, "__slot", how).drop("__slot")
    return _archives_in_task(part("left_anti"), volume_rows).unionByName(_archives_by_rank(part("left_semi"), volume_rows))


def _archives_in_task(entries: DataFrame, volume_rows: int) -> DataFrame:
    # a fixed number of tasks: packing takes far longer than reading
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = entries.where("scan_id IS NOT NULL").withColumn("scan_id", F.col("scan_id").cast("long")).repartition(n, "scan_id")
    rows = rows.sortWithinPartitions("scan_id", "entry", "section", "line_no", "line").select("scan_id", "entry", "line")
    numbered = _numbered(volume_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _volumes(numbered(batches))

    return rows.mapInArrow(run, ARCHIVES)


def _archives_by_rank(entries: DataFrame, volume_rows: int) -> DataFrame:
    """``archives`` for scans of any size: all lines are ranked, and each volume finds its task."""
    r = ranked(entries, "scan_id", "entry", "section", "line_no", "line")
    scans = r.groupBy("scan_id").agg(F.min("rank_no").alias("first_of_scan"))
    volume = lambda c: F.floor((F.col(c) - F.col("first_of_scan")) / volume_rows).cast("int")
    lines = r.where("entry IS NOT NULL").join(scans, "scan_id").select("scan_id", volume("rank_no").alias("volume"), "rank_no", "entry", "line", F.lit(None).cast("int").alias("part"))
    # few entries go on in another volume: one note for each such volume, ahead of its lines, instead of a join of all lines
    spans = r.groupBy("scan_id", "entry").agg(F.min("rank_no").alias("lo"), F.max("rank_no").alias("hi")).where("hi > lo AND entry IS NOT NULL").join(scans, "scan_id")
    spans = spans.select("scan_id", "entry", volume("lo").alias("first"), volume("hi").alias("last")).where("last > first")
    notes = spans.select("scan_id", "entry", "first", F.explode(F.sequence(F.col("first") + 1, "last")).alias("volume")).select(
        "scan_id", "volume", F.lit(0).cast("long").alias("rank_no"), "entry", F.lit(None).cast("string").alias("line"), (F.col("volume") - F.col("first")).alias("part"))
    rows = lines.unionByName(notes).withColumn("scan_id", F.col("scan_id").cast("long"))
    return rows.repartition("scan_id", "volume").sortWithinPartitions("scan_id", "volume", "rank_no").mapInArrow(_volumes, ARCHIVES)


@F.pandas_udf(T.StringType())
def archive_text(archive: pd.Series) -> pd.Series:
    """All members of an archive in their order, one after the other."""
    return archive.map(lambda b: "".join(z.read(n).decode() for z in [zipfile.ZipFile(io.BytesIO(b))] for n in z.namelist()))
