"""Strong pairs under common keys without forming all pairs.

A pair of items stands for the sum, over their common keys, of a load of the left row
times a weight of the right row. It cannot come to more than its weaker item could with
the heaviest partner of each of its keys, which is one aggregate for each side. So
items whose bound is below what a report asks for leave before any pair is formed.

For the ``n`` strongest pairs the bar is found first: pairs among the few items with
the highest bounds are formed, and the n-th best of them is a bar that every pair of
the result reaches. That is exact: a pair is lost only if it is below ``n`` others. Where
all items are alike nothing can be left out and the few pairs are what it costs.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _enough(n: int) -> int:
    """Items, of each group, among which the bar is looked for: about four times as many pairs as are wanted."""
    return 2 * (isqrt(2 * n) + 1)


def pair_bounds(df: DataFrame, others: DataFrame | None, load: Column, weight: Column, within: Sequence[str] = ()) -> DataFrame:
    """(item, within..., bound): the most a pair with an item of ``df`` can come to.

    ``load`` is a column of ``df``, ``weight`` one of ``others``; none stands for partners of weight 1.
    """
    if others is not None:
        # An item may have several rows under a key, such as one for each of its types.
        partners = others.groupBy("key", "item").agg(F.sum(weight).alias("most"))
        df = df.join(partners.groupBy("key").agg(F.max("most").alias("most")), "key")
        load = load * F.col("most")
    return df.groupBy("item", *within).agg(F.sum(load).alias("bound"))


def _among(df: DataFrame, items: DataFrame, within: Sequence[str]) -> DataFrame:
    """Rows of some items. Their list is without repeats, so this is an inner join: a semi-join would be moved below
    the fold and the fold be done anew for every use, while its shuffle can be read again.
    """
    return df.join(items, ["item", *within]).select(df.columns)


def _head(bounds: DataFrame, heads: int, within: Sequence[str]) -> DataFrame:
    best = (F.desc("bound"), "item")
    if not within:
        return bounds.orderBy(*best).limit(heads).drop("bound")
    place = F.row_number().over(Window.partitionBy(*within).orderBy(*best))
    return bounds.withColumn("place", place).where(F.col("place") <= heads).drop("place", "bound")


def bar_of_best(
    left: DataFrame,
    right: DataFrame,
    total: Column,
    n: int,
    bounds: tuple[DataFrame, DataFrame],
    condition: Column | None = None,
    within: Sequence[str] = (),
    heads: int | None = None,
) -> DataFrame:
    """(within..., bar): what the n-th best pair of the items with the highest bounds comes to.

    Null, or no row, where there are fewer than ``n``. ``total`` is added up over the joined rows.
    """
    heads = heads or _enough(n)
    chosen = _head(bounds[0], heads, within).unionByName(_head(bounds[1], heads, within)).distinct()
    one, two = [_among(df, F.broadcast(chosen) if not within else chosen, within) for df in (left, right)]
    on = F.col("one.item") < F.col("two.item")
    for name in ("key", *within):
        on = on & (F.col(f"one.{name}") == F.col(f"two.{name}"))
    # At most ``heads`` items of a side under a key (and group): no key is hot here.
    pairs = one.alias("one").join(two.alias("two"), on if condition is None else on & condition)
    names = [F.col(f"one.{name}").alias(name) for name in within]
    totals = pairs.groupBy(F.col("one.item").alias("a"), F.col("two.item").alias("b"), *names).agg(total.alias("total"))
    if not within:
        best = totals.orderBy(F.desc("total")).limit(n)
    else:
        place = F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("total")))
        best = totals.withColumn("place", place).where(F.col("place") <= n)
    return best.groupBy(*within).agg(F.when(F.count(F.lit(1)) >= n, F.min("total")).alias("bar"))


def reaching(
    df: DataFrame, bounds: DataFrame, least: int, bar: DataFrame | None = None, within: Sequence[str] = ()
) -> DataFrame:
    """The rows of items that may be in a pair that comes to ``least`` and to the bar of its group."""
    if bar is not None and within:
        bounds = bounds.join(bar, list(within), "left").where(F.col("bound") >= F.greatest(F.lit(least), "bar")).drop("bar")
    elif bar is not None:
        bounds = bounds.where(F.col("bound") >= F.greatest(F.lit(least), bar.scalar()))
    else:
        bounds = bounds.where(F.col("bound") >= least)
    return _among(df, bounds.drop("bound"), [c for c in bounds.columns if c not in ("item", "bound")])


def strong_sides(
    left: DataFrame,
    right: DataFrame | None = None,
    load: Column | None = None,
    weight: Column | None = None,
    least: int = 1,
    best: int | None = None,
    condition: Column | None = None,
    within: Sequence[str] = (),
    left_within: Sequence[str] = (),
    heads: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Both sides without the items that are in no pair of the result.

    The result is the pairs that come to ``least``, or the ``best`` of them (ties with the last
    kept) for each value of ``within``, columns that both sides must share. Pairs are
    counted for each value of ``left_within``, columns of the left side. No ``right`` stands for the left
    side again, every row counting 1; else a pair counts ``load`` of ``one`` times ``weight`` of ``two``.
    """
    if left_within and best is not None:
        raise ValueError("the best pairs are looked for in groups that both sides have")
    if right is None:
        right = left
        bounds = pair_bounds(left, None, F.lit(1), F.lit(1), within)
        both, total = (bounds, bounds), F.count(F.lit(1))
    else:
        both = (
            pair_bounds(left, right, load, weight, [*within, *left_within]),
            pair_bounds(right, left.withColumn("_load", load), weight, F.col("_load"), within),
        )
        total = F.sum(F.col("one._load") * F.col("two._weight"))
    bar = None
    if best is not None:
        one, two = (left, right) if load is None else (left.withColumn("_load", load), right.withColumn("_weight", weight))
        bar = bar_of_best(one, two, total, best, both, condition, within, heads)
    return (
        reaching(left, both[0], least, bar, within),
        reaching(right, both[1], least, bar, within),
    )
