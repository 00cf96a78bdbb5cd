"""The most correlated pairs of items, from a value of each item under each of a few keys.

Where most items are under most keys, every pair of items meets under every key, and rows of pairs per key are
far more than the pairs asked for. Blocks of items are paired up in cells instead: a task has all values of
two blocks, measures all their pairs by matrix products, and passes on the best of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Share of (item, key) combinations with a value from which cells are taken.
DENSE = 0.05
# Items and values of a block, at most; blocks to aim at, and items of a block they need.
BLOCK_ITEMS, BLOCK_VALUES = 16_000, 4_000_000
BLOCKS, FEWEST_ITEMS = 16, 250
TILE = 1 << 20  # pairs that are measured at once
# Sums of products may be off by this much where the exact coefficient decides.
TOLERANCE = 1e-6

PAIRS = "one string, two string, common long, r double"


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Correlation of rows where both have a value (no NaN); NaN where a side does not vary."""
    both = ~(np.isnan(x) | np.isnan(y))
    n = np.maximum(both.sum(axis=1), 1)
    first = both.argmax(axis=1)[:, None]

    def centred(values: np.ndarray) -> np.ndarray:
        # From a value of the row, so that equal values are exactly zero.
        moved = np.where(both, values - np.take_along_axis(values, first, axis=1), 0.0)
        return np.where(both, moved - (moved.sum(axis=1) / n)[:, None], 0.0)

    x, y = centred(x), centred(y)
    spread = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(spread > 0, (x * y).sum(axis=1) / spread, np.nan)


def _rough(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Size of all correlations between two sets of rows by matrix products; infinite where rounding could decide."""
    has_x, has_y = (~np.isnan(v) * 1.0 for v in (x, y))

    def scaled(values: np.ndarray, has: np.ndarray) -> np.ndarray:
        mean = np.nansum(values, axis=1) / np.maximum(has.sum(axis=1), 1)
        values = np.where(has > 0, values - mean[:, None], 0.0)
        return values / np.maximum(np.abs(values).max(axis=1, initial=0.0), 1e-300)[:, None]

    x, y = scaled(x, has_x), scaled(y, has_y)
    n = np.maximum(has_x @ has_y.T, 1)
    sum_x, sum_y = x @ has_y.T, has_x @ y.T
    var_x = (x * x) @ has_y.T - sum_x * sum_x / n
    var_y = has_x @ (y * y).T - sum_y * sum_y / n
    unsure = (var_x < 1e-6) | (var_y < 1e-6)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(unsure, np.inf, np.abs(x @ y.T - sum_x * sum_y / n) / np.sqrt(var_x * var_y))


def _matrix(rows: pa.Table, keys: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items in order, whether each is under each key, and the values (NaN for none)."""
    names = rows.column("item").to_pylist()
    items = sorted(set(names))
    place = {item: i for i, item in enumerate(items)}
    at = np.array([place[i] for i in names], dtype=np.int64), np.array([keys[k] for k in rows.column("key").to_pylist()], dtype=np.int64)
    under, values = np.zeros((len(items), len(keys))), np.full((len(items), len(keys)), np.nan)
    under[at] = 1
    values[at] = rows.column("value").to_numpy(zero_copy_only=False).astype(np.float64)
    return np.array(items, dtype=object), under, values


def best_of_cell(least: int, best: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of the rows (cell, own, item, key, value) of two blocks to the best pairs between them."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[str, str, int, float]] = []
        if len(left) and len(right):
            same = left.column("own")[0].as_py() == right.column("own")[0].as_py()
            keys = {k: i for i, k in enumerate({*left.column("key").to_pylist(), *right.column("key").to_pylist()})}
            (names, under, values), (others, under_others, theirs) = (_matrix(t, keys) for t in (left, right))
            step = max(1, TILE // len(others))
            for a in range(0, len(names), step):
                common = under[a : a + step] @ under_others.T
                rough = np.where(common >= least, _rough(values[a : a + step], theirs), -1.0)
                if same:
                    rough[np.arange(a, a + len(rough))[:, None] >= np.arange(len(others))[None]] = -1.0
                sure = rough[(rough >= 0) & (rough < np.inf)]
                # What is below the best of the tile, or of all tiles so far, is out.
                bar = max(
                    np.partition(sure, len(sure) - best)[len(sure) - best] if len(sure) >= best else 0.0,
                    abs(rows[-1][3]) if len(rows) == best else 0.0,
                ) - 2 * TOLERANCE
                i, j = np.nonzero((rough >= 0) & (rough >= bar))
                part = max(1, 4_000_000 // max(1, len(keys)))
                for k in range(0, len(i), part):
                    p, q = i[k : k + part], j[k : k + part]
                    r = exact(values[a + p], theirs[q])
                    keep = np.flatnonzero(np.abs(r) >= max(bar, abs(rows[-1][3]) if len(rows) == best else 0.0))
                    for m in keep:
                        pair = sorted((names[a + p[m]], others[q[m]]))
                        rows.append((pair[0], pair[1], int(common[p[m], q[m]]), float(r[m])))
                    rows = sorted(rows, key=lambda x: (-abs(x[3]), -x[2], x[0], x[1]))[:best]
        types = (pa.string(), pa.string(), pa.int64(), pa.float64())
        columns = list(zip(*rows)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["one", "two", "common", "r"])

    return run


def is_dense(sizes: tuple[int, int, int]) -> bool:
    items, keys, rows = sizes
    return rows >= DENSE * items * keys


def sizes_of(values: DataFrame) -> tuple[int, int, int]:
    """Items, keys and rows."""
    return tuple(values.agg(F.count_distinct("item"), F.count_distinct("key"), F.count(F.lit(1))).first())


def most_correlated(values: DataFrame, least: int, best: int, sizes: tuple[int, int, int]) -> DataFrame:
    """``PAIRS`` of (item, key, value) rows, one per item and key, that hold the ``best`` pairs under ``least`` keys or more.

    Order is by size of the coefficient, keys in common, names. Every cell gives its best, so there are more rows than asked for.
    """
    items, keys, _ = sizes
    blocks = max(
        -(-items // BLOCK_ITEMS), -(-items * keys // BLOCK_VALUES), min(BLOCKS, -(-items // FEWEST_ITEMS)), 1
    )
    own = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    rows = values.select(own.alias("own"), "item", "key", F.col("value").cast("double").alias("value"))
    tasks = blocks * (blocks + 1) // 2
    others = (F.sequence(F.col("own"), F.lit(blocks - 1)), F.sequence(F.lit(0), F.col("own")))
    cells = (F.col("own") * blocks + F.col("other"), F.col("other") * blocks + F.col("own"))
    one, two = (
        rows.withColumn("other", F.explode(other))
        .select(cell.alias("cell"), F.col("own").alias("own"), *[F.col(c).alias(c) for c in ("item", "key", "value")])
        .repartition(tasks, "cell")
        .groupBy("cell")
        for other, cell in zip(others, cells)
    )
    return one.cogroup(two).applyInArrow(best_of_cell(least, best), PAIRS)
