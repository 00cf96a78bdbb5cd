import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from entitylake.operators.pairs import fold, in_keys, item_pairs, pair_weight, pairs_under_key


def expected(rows):
    counts = Counter()
    for (k1, i1), (k2, i2) in product(rows, rows):
        if k1 is not None and k1 == k2 and i1 < i2:
            counts[i1, i2] += 1
    return dict(counts)


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 3}, {"chunk_rows": 1}])
def test_row_pairs_with_a_hot_key(spark, options):
    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 6)}", f"e{rng.randint(0, 8)}") for _ in range(80)]
    rows += [("hot", f"e{i}") for i in range(30)] * 2 + [(None, "e1")]
    items = fold(spark.createDataFrame(rows, "k string, e string"), "k", "e")
    pairs = pairs_under_key(items, items, **options)
    got = {
        (r.a, r.b): r.n
        for r in pairs.groupBy(F.col("one.item").alias("a"), F.col("two.item").alias("b"))
        .agg(F.sum(pair_weight()).alias("n"))
        .collect()
    }
    assert got == expected(rows)


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 3}, {"chunk_rows": 1}])
def test_pairs_from_lists_with_a_hot_key(spark, options):
    rng = random.Random(4)
    rows = {(f"k{rng.randint(0, 6)}", f"e{rng.randint(0, 8)}") for _ in range(60)}
    rows |= {("hot", f"e{i}") for i in range(30)} | {("one", "e1")}
    items = fold(spark.createDataFrame(sorted(rows) * 2, "k string, e string"), "k", "e")
    pairs = item_pairs(items, **options)
    got = pairs.groupBy(F.col("one.item").alias("a"), F.col("two.item").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert {(r.a, r.b): r.n for r in got} == expected(rows)


def test_items_in_few_keys_are_left_out_without_a_shuffle_of_all_rows(spark):
    rows = [("k1", "a"), ("k1", "a"), ("k1", "b"), ("k2", "b")]
    often = in_keys(fold(spark.createDataFrame(rows, "k string, e string"), "k", "e"), 2)
    assert sorted((r.key, r.item) for r in often.collect()) == [("k1", "b"), ("k2", "b")]
    assert "distinct" not in often._jdf.queryExecution().analyzed().toString().lower()


def test_many_rows_of_few_items_are_not_cut(spark):
    """A heavy key of two items is two folded rows, however many rows it had."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.concat(F.lit("e"), F.col("id") % 2).alias("e"))
    items = fold(df, "k", "e")
    assert items.count() == 2
    rows = pairs_under_key(items, items).select(pair_weight().alias("w")).collect()
    assert [r.w for r in rows] == [10_000 * 10_000]


def test_pairs_are_made_in_small_partitions_but_a_given_size_is_kept(spark):
    from entitylake.operators import pairs as operator

    items = operator.fold(spark.createDataFrame([("k", "a"), ("k", "b")], "key string, item string"), "key", "item")
    before = spark.conf.get(operator.PARTITION_SETTING)
    try:
        spark.conf.unset(operator.PARTITION_SETTING)
        assert operator.pairs_under_key(items, items).count() == 1
        assert spark.conf.get(operator.PARTITION_SETTING) == f"{16 << 20}b"
        spark.conf.set(operator.PARTITION_SETTING, "1m")
        operator.pairs_under_key(items, items)
        assert spark.conf.get(operator.PARTITION_SETTING) == "1m"
    finally:
        spark.conf.set(operator.PARTITION_SETTING, before)
