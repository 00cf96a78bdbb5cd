"""Splitting the heavy keys of a join that pairs up the rows under a key.

Such a join does work in proportion to the product of a key's rows on both
sides, so a key can be far too much for one task long before its bytes make
the adaptive skew join act. Heavy keys are cut into a grid: the left rows into
``l`` chunks, the right rows into ``r``; every left chunk meets every right
chunk in a cell of its own, and each pair of rows meets in exactly one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows per chunk.
CHUNK_ROWS = 4000


def hot_grid(
    left: DataFrame,
    right: DataFrame | None,
    key: str,
    counted: Column | None = None,
    chunk_rows: int | Column = CHUNK_ROWS,
) -> DataFrame:
    """(key, l, r): chunks per side of the keys worth cutting. No ``right`` means both sides alike.

    Every such key is in it: at most one for each ``chunk_rows`` rows.

    ``chunk_rows`` may be a column of the key, ``left_rows`` and ``right_rows``.

    ``counted`` is what is counted per row, a column that is never null. Naming
    one that the sides carry anyway lets their shuffle be read again here.
    """
    one = F.lit(1) if counted is None else counted

    def loads(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.count(one).alias(name))

    if right is None:
        sizes = loads(left, "left_rows").withColumn("right_rows", F.col("left_rows"))
    else:
        sizes = loads(left, "left_rows").join(loads(right, "right_rows"), key)
    return (
        sizes.where(F.greatest("left_rows", "right_rows") > chunk_rows)
        .select(
            key,
            *[F.ceil(F.col(f"{side}_rows") / chunk_rows).cast("int").alias(side[0]) for side in ("left", "right")],
        )
    )


def with_cells(
    left: DataFrame, right: DataFrame, grid: DataFrame, key: str, item: str, half: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Both sides with the column ``cell`` to join on besides ``key``.

    ``half`` is for a frame with itself, cut alike on both sides: only cells of
    a chunk with itself or a later one are made, and ``diagonal`` tells the former,
    in which rows meet in both orders.
    """
    l, r = F.coalesce("l", F.lit(1)), F.coalesce("r", F.lit(1))

    def cells(df: DataFrame, own: Column, others, cell) -> DataFrame:
        gridded = df.join(grid, key, "left")
        chunk = F.pmod(F.xxhash64(item), own).cast("int")
        each = F.transform(others(chunk), lambda o: F.struct(cell(chunk, o).alias("cell"), (chunk == o).alias("diagonal")))
        out = gridded.withColumn("_cell", F.explode(each)).drop("l", "r")
        named = out.withColumn("cell", F.col("_cell.cell"))
        return (named.withColumn("diagonal", F.col("_cell.diagonal")) if half else named).drop("_cell")

    zero = F.lit(0)
    return (
        cells(left, l, lambda c: F.sequence(c if half else zero, r - 1), lambda chunk, o: chunk * r + o),
        cells(right, r, lambda c: F.sequence(zero, c if half else l - 1), lambda chunk, o: o * r + chunk),
    )
