"""Query registry: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str, heavy: bool = False) -> DataFrame:
    """A driver table; zone-less timestamps become instants (session zone is UTC)."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    df = spread(df) if heavy else df
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampNTZType):
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def spread(df: DataFrame, always: bool = False) -> DataFrame:
    """Deal rows to ``spark.lodegrid.spread.tasks`` tasks before CPU-heavy work; without that setting the input's splits stay.

    It is for small inputs in one file (local sessions set it); a large input has splits enough and is left as it is, since dealing it
    would write all of it to disk. ``always`` is for texts, of which one
    row group, and so one task, may hold very many: without the setting they go to as many tasks as a shuffle has.
    """
    n = df.sparkSession.conf.get("spark.lodegrid.spread.tasks", None)
    if n is None and always:
        n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if n and not always and _size(df) >= int(n) * df.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    return df.repartition(int(n)) if n else df


def _size(df: DataFrame) -> int:
    """Bytes of the files that a plain read stands for."""
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def shared(spark: SparkSession, sf: str, sql: str, *tables: str, heavy: bool = False) -> DataFrame:
    """Run a SELECT both engines understand; tables are named by their plain names."""
    text = sql
    frames = {}
    for t in tables:
        text = text.replace(f" {t} ", f" {{{t}}} ")
        frames[t] = table(spark, sf, t, heavy)
    return spark.sql(text, **frames)
