"""Pruned sides give the same strong pairs as all pairs do."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle.parameters import REPORT_PARAMETERS
from entitylake.operators.pairs import fold, pair_weight, pairs_under_key
from entitylake.operators.top_pairs import strong_sides
from entitylake.plans import star
from entitylake.plans.reports import REPORTS


def zipf_rows(seed=1, keys=300, items=400, groups=1):
    """(key, item, group) where few items are under most keys."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(items)]
    rows = []
    for k in range(keys):
        rows += [(f"k{k}", f"e{i:03d}", f"g{k % groups}") for i in rng.choices(range(items), weights, k=12)]
    return rows


def totals(rows):
    """Row pairs of two items under a key, for each group."""
    by_key = defaultdict(Counter)
    for key, item, group in rows:
        by_key[key, group][item] += 1
    found = Counter()
    for (_, group), n in by_key.items():
        names = sorted(n)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                found[group, a, b] += n[a] * n[b]
    return found


def best(counts, n, least=1):
    """The n best and ties with the last."""
    kept = sorted((c for c in counts.values() if c >= least), reverse=True)[:n]
    return {pair: c for pair, c in counts.items() if kept and c >= kept[-1]}


def joined(one, two, total, **options):
    pairs = pairs_under_key(one, two, **options).groupBy(F.col("one.item").alias("a"), F.col("two.item").alias("b"))
    return {("g0", r.a, r.b): r.n for r in pairs.agg(total.alias("n")).collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, e string, g string")


@pytest.mark.parametrize("n,least", [(5, 1), (50, 1), (10, 9), (5, 10_000), (10**6, 1)])
def test_best_pairs_by_row_pairs(spark, n, least):
    rows = zipf_rows()
    left = fold(frame(spark, rows), "k", "e")
    one, two = strong_sides(left, left, F.col("weight"), F.col("weight"), least, n)
    assert best(joined(one, two, F.sum(pair_weight())), n, least) == best(totals(rows), n, least)


def test_far_fewer_pairs_are_formed(spark):
    rows = list(dict.fromkeys(zipf_rows(keys=600, items=2000)))
    items = fold(frame(spark, rows), "k", "e")
    one, two = strong_sides(items, best=10, heads=16)
    formed = pairs_under_key(one, two, weighted=False).count()
    everything = pairs_under_key(items, items, weighted=False).count()
    assert formed < 0.6 * everything
    assert best(joined(one, two, F.count(F.lit(1)), weighted=False), 10) == best(totals(rows), 10)


@pytest.mark.parametrize("n", [1, 4, 200])
def test_best_pairs_of_each_group(spark, n):
    rows = list(dict.fromkeys(zipf_rows(seed=5, keys=120, items=60, groups=4)))
    items = fold(frame(spark, rows), "k", "e", "g")
    one, two = strong_sides(items, best=n, within=("g",), heads=8)
    pairs = pairs_under_key(one, two, also_equal=("g",), weighted=False)
    names = [F.col("one.g").alias("g"), F.col("one.item").alias("a"), F.col("two.item").alias("b")]
    got = {(r.g, r.a, r.b): r.n for r in pairs.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}
    want = totals(rows)
    for g in {"g0", "g1", "g2", "g3"}:
        of = lambda counts: {p: c for p, c in counts.items() if p[0] == g}  # noqa: B023, E731
        assert best(of(got), n) == best(of(want), n)


def test_counts_for_each_value_of_a_left_column(spark):
    """An item stays on the left only in the groups in which it can come to enough."""
    rows = [("k1", "a", "g0"), ("k1", "b", "g0"), ("k2", "a", "g1"), ("k2", "b", "g1"), ("k3", "a", "g1"), ("k3", "b", "g1")]
    left, right = fold(frame(spark, rows), "k", "e", "g"), fold(frame(spark, rows), "k", "e")
    one, two = strong_sides(left, right, F.col("weight"), F.col("weight"), least=2, left_within=("g",))
    assert {(r.key, r.item) for r in one.collect()} == {("k2", "a"), ("k2", "b"), ("k3", "a"), ("k3", "b")}
    assert {r.item for r in two.collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        strong_sides(left, right, F.col("weight"), F.col("weight"), best=1, left_within=("g",))


def test_a_condition_binds_the_bar(spark):
    """The bar comes from pairs that the report wants, not from stronger ones it does not."""
    rows = [(f"k{i}", item, "g0") for i in range(9) for item in ("a", "b")] + [("k0", "z", "g0"), ("k1", "z", "g0")]
    items = fold(frame(spark, rows), "k", "e")
    wanted = F.col("two.item") == "z"
    one, two = strong_sides(items, best=1, condition=wanted)
    assert joined(one, two, F.count(F.lit(1)), condition=wanted, weighted=False) == {("g0", "a", "z"): 2, ("g0", "b", "z"): 2}


def test_items_of_several_types_under_a_key(spark):
    """Rows of an item that differ in another column count together."""
    rows = [("k", "a", "x"), ("k", "b", "x"), ("k", "b", "y"), ("k", "c", "x")]
    sides = fold(frame(spark, rows), "k", "e", "g")
    one, two = strong_sides(sides, sides, F.col("weight"), F.col("weight"), least=2, best=1)
    got = joined(one, two, F.sum(pair_weight()))
    assert {p: n for p, n in got.items() if n >= 2} == {("g0", "a", "b"): 2, ("g0", "b", "c"): 2}


def test_empty_sides(spark):
    items = fold(frame(spark, []), "k", "e")
    one, two = strong_sides(items, items, F.col("weight"), F.col("weight"), 2, 5)
    assert one.count() == two.count() == 0


PAIR_REPORTS = (
    "related_entities pair_mention_trends pair_sentiment relationships_by_sentiment sentiment_network pair_sentiment_change"
).split()


@pytest.mark.parametrize("name", PAIR_REPORTS)
def test_reports_are_the_same_with_prune(spark, name):
    tables = star.StarTables(spark, "/root/testdata/sf0.001")
    rows = [entry._comparable(REPORTS[name](tables, **REPORT_PARAMETERS[name], prune=p)).collect() for p in (False, True)]
    assert rows[0] and rows[0] == rows[1]
