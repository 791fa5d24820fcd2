"""Keyed change detection: a stateful stream and its batch twin."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KINDS = (("implementation", "upgrade", "critical"), ("codehash", "codehash_change", "critical"), ("admin", "admin_change", "high"),
         ("owner", "owner_change", "high"))
EVENT = "address string, ts timestamp, kind string, old string, new string, severity string, rescan boolean"
STATE = "implementation string, codehash string, admin string, owner string, last long"
READING = "at long, implementation string, codehash string, admin string, owner string"
NAMES = [c for c, _, _ in KINDS]


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


def _changed(old, new) -> bool:
    return bool(old) and bool(new) and old.lower() != new.lower()


class WatchProcessor(StatefulProcessor):
    """Per address: baseline of four values and the time of the last reading. The first reading is silent, an empty reading keeps the
    old value, and a code-hash change counts only while no implementation is read.

    At once: the readings of a trigger are taken in the order of their time, over all chunks they come in; one that is older than the
    last reading of an earlier trigger changes nothing and is reported as ``late_reading``. Buffered: readings wait in state until the
    watermark has passed them, so triggers may bring them in any order within the watermark's delay.
    """

    def __init__(self, buffered: bool = False):
        self.buffered = buffered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("baseline", STATE)
        if self.buffered:
            self.waiting = handle.getListState("waiting", READING)

    def take(self, key, readings: list[tuple]) -> Iterator[pd.DataFrame]:
        """readings: (microseconds, four values), in any order."""
        base = self.state.get() if self.state.exists() else None
        out = []
        for at, *values in sorted(readings, key=lambda r: r[0]):
            now = dict(zip(NAMES, (v or None for v in values)))
            if base is not None and at < base[4]:
                out.append((key[0], _stamp(at), "late_reading", None, None, "info", False))
                continue
            if base is not None:
                for i, (c, kind, sev) in enumerate(KINDS):
                    if _changed(base[i], now[c]) and not (c == "codehash" and now["implementation"]):
                        out.append((key[0], _stamp(at), kind, base[i], now[c], sev, sev == "critical"))
            base = (*(now[c] or (base and base[i]) for i, c in enumerate(NAMES)), at)
        self.state.update(base)
        if out:
            yield pd.DataFrame(out, columns=["address", "ts", "kind", "old", "new", "severity", "rescan"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        readings = [(pd.Timestamp(r.ts).value // 1000, *(getattr(r, c) or None for c in NAMES)) for pdf in rows for r in pdf.itertuples(index=False)]
        if not self.buffered:
            yield from self.take(key, readings)
            return
        self.waiting.appendList(readings)
        for at in {min(r[0] for r in readings), max(r[0] for r in readings)}:
            self.handle.registerTimer(-(-at // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = timerValues.getCurrentWatermarkInMs() * 1000
        readings = list(self.waiting.get()) if self.waiting.exists() else []
        ready, rest = [tuple(r) for r in readings if r[0] <= seen], [tuple(r) for r in readings if r[0] > seen]
        if not ready:
            return
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield from self.take(key, ready)

    def close(self) -> None:
        pass


def watch_stream(observations: DataFrame, delay: str | None = None) -> DataFrame:
    """observations(address, ts, implementation, codehash, admin, owner), streaming -> change events.

    delay: how far behind a reading may be (as "1 hour"); changes are then given out once the watermark has passed them. Without it they
    are given out at once. A trigger's readings of one address are held by one task: bound what a trigger reads by the source's options.
    """
    mode = "None" if delay is None else "EventTime"
    timed = observations if delay is None else observations.withWatermark("ts", delay)
    return timed.groupBy("address").transformWithStateInPandas(WatchProcessor(delay is not None), EVENT, "Append", mode)


def watch_batch(observations: DataFrame, bucket: str = "day") -> DataFrame:
    """The same events from a stored history: last non-empty value before each reading.

    Two levels, so that no task holds the whole history of a busy address: readings are ordered inside
    (address, time bucket); what earlier buckets leave behind is carried in from one row per bucket.
    """
    cols = [c for c, _, _ in KINDS]
    d = observations.withColumns({**{c: F.nullif(F.col(c), F.lit("")) for c in cols}, "bucket": F.date_trunc(bucket, "ts")})
    per = d.groupBy("address", "bucket").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("ts"))).alias(f"in_{c}") for c in cols], F.count(F.lit(1)).alias("rows"))
    w = Window.partitionBy("address").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("address", "bucket", *[F.last(f"in_{c}", ignorenulls=True).over(w).alias(f"in_{c}") for c in cols],
                       F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("seen"))
    inside = Window.partitionBy("address", "bucket").orderBy("ts")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(carry, ["address", "bucket"]).withColumns(
        {"n": F.col("seen") + F.row_number().over(inside), **{f"old_{c}": F.coalesce(F.last(c, ignorenulls=True).over(before), F.col(f"in_{c}")) for c in cols}})
    ev = []
    for c, kind, sev in KINDS:
        ch = F.lower(f"old_{c}") != F.lower(c)
        if c == "codehash":
            ch = ch & F.col("implementation").isNull()
        ev.append(F.when((F.col("n") > 1) & ch, F.struct(F.lit(kind).alias("kind"), F.col(f"old_{c}").alias("old"), F.col(c).alias("new"),
                                                        F.lit(sev).alias("severity"), F.lit(sev == "critical").alias("rescan"))))
    return d.select("address", "ts", F.explode(F.array_compact(F.array(*ev))).alias("e")).select("address", "ts", "e.*")


def due_rows(watches: DataFrame, now, default_interval: int = 300) -> DataFrame:
    """Enabled watches never checked or past their interval."""
    from ..functions.scalars import due

    return watches.where(F.col("enabled") & due(F.col("last_checked_at"), F.coalesce("interval_seconds", F.lit(default_interval)), F.lit(now).cast("timestamp")))


def poll_interval(interval: int) -> str:
    """Trigger interval of the polling loop, clamped to 15..60 seconds."""
    return f"{max(15, min(interval, 60))} seconds"


def new_deploys(creations: DataFrame, known: DataFrame, watches: DataFrame, cap: int = 25) -> tuple[DataFrame, DataFrame]:
    """Creations of watched deployers to onboard now, and every deployer's next block offset.

    Up to ``cap`` new contracts per deployer and cycle, in block order; the rest stay for the next cycle
    because the offset only advances to the last onboarded block. Nothing is lost.
    """
    c = creations.join(watches.select("deployer", "last_block_checked"), "deployer").where("block >= coalesce(last_block_checked, 0)")
    fresh = c.join(known.select(F.lower("address").alias("address")).distinct(), "address", "left_anti")
    w = Window.partitionBy("deployer").orderBy("block", "address")
    take = fresh.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).drop("n")
    seen = c.groupBy("deployer").agg(F.max("block").alias("last_seen"))
    got = take.groupBy("deployer").agg(F.max("block").alias("last_taken"), F.count(F.lit(1)).alias("onboarded"))
    off = watches.join(seen, "deployer", "left").join(got, "deployer", "left").select(
        "deployer", F.coalesce("last_taken", "last_seen", "last_block_checked").alias("next_block"), F.coalesce("onboarded", F.lit(0)).alias("onboarded"))
    return take.drop("last_block_checked"), off


def alerts(events: DataFrame, checkpoint: str, sink) -> object:
    """Deliver change events batch-wise; ``sink(batch_df, batch_id)`` must be idempotent per batch."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
