"""Event-time operators over a stream of events: windows, sessions and first occurrences under a watermark.

Each takes and returns a streaming DataFrame; a row is given out once the watermark has passed its window. A window or session is a
partial aggregate before the shuffle, so a busy key is summed map-side first; state goes when the watermark passes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def windowed(events: DataFrame, by: list[str], aggregates: list[Column], delay: str, length: str, slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Tumbling windows of `length`, or sliding ones that begin every `slide`: keys, window_start, window_end and the aggregates."""
    at = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = events.withWatermark(ts, delay).groupBy(at.alias("w"), *by).agg(*aggregates)
    return out.select(*by, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in out.columns if c != "w" and c not in by])


def sessions(events: DataFrame, by: list[str], aggregates: list[Column], delay: str, gap: str | Column, ts: str = "ts") -> DataFrame:
    """Sessions of a key that end `gap` after their last event: keys, session_start, session_end and the aggregates."""
    out = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(*aggregates)
    return out.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in out.columns if c != "w" and c not in by])


def first_seen(events: DataFrame, by: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """Rows whose key did not occur within the delay before: repeats that come late, too, are left out."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(by)


def drained(stream: DataFrame, **options: str) -> DataFrame:
    """What a stream gives out until its source is read to the end, as a table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").options(**options).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
