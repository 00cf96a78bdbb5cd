"""Ranks of all rows of a table in a total order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.llm.common import stored

_BITS = 33


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its rows numbered from 1 in the given order.

    Spark sorts by range; the written table remembers each row's task and its place
    there, and the rows of earlier tasks, one number a task, are added. Rows
    that are equal in all of ``order`` get numbers in any order.
    """
    at = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", _BITS).alias("_task")
    counts = at.groupBy(task).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_task")) - F.col("_rows")
    starts = counts.select("_task", before.alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _BITS) - 1))
    return (
        at.withColumn("_task", F.shiftright("_at", _BITS))
        .join(F.broadcast(starts), "_task")  # a row for each task of the sort
        .select(*df.columns, (F.col("_before") + place + 1).alias(name))
    )
