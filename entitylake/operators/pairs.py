"""Pairs of items that occur under the same key, such as entities in one article.

Rows are first folded to one row per (key, item) with a weight, the number of
rows behind it, so a pair of items is formed once per key and stands for the
product of the weights. A key with very many items is cut into a grid of cells
that are joined in different tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.operators.hot_keys import CHUNK_ROWS, hot_grid, with_cells

# Compressed bytes of a shuffle that a task reads. Folded rows shrink well and pairs grow from them, so Spark's
# 64 MB are much more in the memory of joins and sums.
PARTITION_SETTING, PARTITION_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", 16 << 20


def small_partitions(spark: SparkSession) -> None:
    """Smaller partitions after shuffles, unless the session's own are small."""
    given = spark.conf.get(PARTITION_SETTING)
    if given.strip().lower() in ("67108864b", "67108864", "64mb", "64m"):
        spark.conf.set(PARTITION_SETTING, f"{PARTITION_BYTES}b")


def fold(df: DataFrame, key: str, item: str, *extra: str | Column) -> DataFrame:
    """One row per (key, item, extra...) with ``weight`` = number of rows."""
    return (
        df.where(F.col(key).isNotNull() & F.col(item).isNotNull())
        .groupBy(F.col(key).alias("key"), F.col(item).alias("item"), *extra)
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def in_keys(folded: DataFrame, least: int) -> DataFrame:
    """The rows of items that are under ``least`` keys or more."""
    if least <= 1:
        return folded
    # Without further columns a row is a key: counted where it lies, not shuffled to be told apart.
    keys = F.count(F.lit(1)) if set(folded.columns) <= {"key", "item", "weight"} else F.count_distinct("key")
    often = folded.groupBy("item").agg(keys.alias("keys")).where(F.col("keys") >= least)
    return folded.join(often.select("item"), "item", "left_semi")


def pairs_under_key(
    left: DataFrame,
    right: DataFrame,
    condition: Column | None = None,
    also_equal: Sequence[str] = (),
    loads: DataFrame | None = None,
    weighted: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Join two folded frames on ``key``, item of the left < item of the right.

    The sides come out under the aliases ``one`` and ``two``; ``condition`` may
    refer to them, ``also_equal`` names further columns to join on. Keys are
    sized by the items of ``loads``, a folded frame, by default the left one.
    Say ``weighted=False`` if the weights are not used afterwards: the fold then
    has the same columns for sizing and joining, and its shuffle is done once.
    """
    small_partitions(left.sparkSession)
    grid = hot_grid(
        left if loads is None else loads,
        None,
        "key",
        counted=F.when(F.col("weight") > 0, F.lit(1)) if weighted else None,
        chunk_rows=chunk_rows,
    )
    one, two = with_cells(left, right, grid, "key", "item")
    on = F.col("one.item") < F.col("two.item")
    for name in ("key", "cell", *also_equal):
        on = on & (F.col(f"one.{name}") == F.col(f"two.{name}"))
    if condition is not None:
        on = on & condition
    # Not to be broadcast on the size estimate: the pairs are worth spreading out.
    return one.alias("one").join(two.hint("shuffle_hash").alias("two"), on)


def item_pairs(folded: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(one, two): a row for each key and pair of its items, ``one.item`` < ``two.item``, of rows with different (key, item).

    The items of a key come in a list, so rows are shuffled to their keys once and not for both sides of a join;
    keys of more than ``chunk_rows`` items meet in cells as in :func:`pairs_under_key`.
    """
    small_partitions(folded.sparkSession)
    hot = hot_grid(folded, None, "key", chunk_rows=chunk_rows).select("key")
    lists = (
        folded.join(hot, "key", "left_anti")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
        .where(F.size("items") > 1)
    )
    listed = lists.select("items", F.posexplode("items").alias("at", "one")).select(
        "one", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("two")
    )
    cut = folded.join(hot, "key", "left_semi")
    met = pairs_under_key(cut, cut, weighted=False, chunk_rows=chunk_rows).select(
        F.col("one.item").alias("one"), F.col("two.item").alias("two")
    )
    return listed.unionByName(met).select(*[F.struct(F.col(side).alias("item")).alias(side) for side in ("one", "two")])


def pair_weight() -> Column:
    """Number of row pairs behind a joined pair."""
    return F.col("one.weight") * F.col("two.weight")
