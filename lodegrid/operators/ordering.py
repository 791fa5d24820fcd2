"""Ranks of a whole report order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

_ROW_BITS = 33  # of ``monotonically_increasing_id``: the task's number stands above, the row's place in its task below


def ranked(rows: DataFrame, *order: Column | str, name: str = "rank_no") -> DataFrame:
    """The rows with their place in the order, from 1 and without gaps.

    The rows are cut into key ranges and sorted inside each, one shuffle; a range's offset is the number of rows in the ranges before it,
    so only one number a task comes together. Ranges are drawn by sampling, hence the sorted rows are stored before they are counted.
    Rows that tie on every column of `order` are numbered in no fixed order: complete it where that would show. An empty input gives no
    rows, nulls go where the sort puts them.
    """
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    kept, _ = stored(sorted_rows)
    kept = kept.withColumn("__task", F.shiftright("__at", _ROW_BITS))
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("__task").agg(F.count(F.lit(1)).alias("n")).select("__task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    # one row for each task of the sort, so its size follows the number of tasks, not the rows
    return kept.join(F.broadcast(sizes), "__task").withColumn(name, place.cast("long")).select(*rows.columns, name)
