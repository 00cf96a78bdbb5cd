import random

import pytest
from pyspark.sql import functions as F

from entitylake.operators.fuzzy_join import fuzzy_join, fuzzy_self_join, similar_texts
from tests.brute import matches

SHORT = ["", "a", "b", "ac", "aec", "aa", "aaa", "aaaa", "ab", "ba", "é😀", "é😀x"]


def texts(seed: int, longest: int = 14) -> list[str]:
    """Random texts and near copies of them, over small and larger alphabets."""
    rng = random.Random(seed)
    result = list(SHORT)
    for alphabet in ("ab", "abcd", "abcdefghijklmnop"):
        for _ in range(12):
            base = [rng.choice(alphabet) for _ in range(rng.randint(0, longest))]
            result.append("".join(base))
            for _ in range(2):
                copy = list(base)
                for _ in range(rng.randint(0, 4)):
                    place = rng.randint(0, len(copy))
                    if copy and rng.random() < 0.5:
                        copy.pop(place - 1)
                    else:
                        copy.insert(place, rng.choice("abcx"))
                result.append("".join(copy))
    return sorted(set(result))


def frame(spark, values):
    return spark.createDataFrame([(v,) for v in values] + [(None,)], "t string")


def pairs(df):
    rows = df.collect()
    result = {(r.left_text, r.right_text): r.score for r in rows}
    assert len(result) == len(rows), "a pair came out twice"
    return result


@pytest.mark.parametrize(
    ("threshold", "options"),
    [
        (80, {}),
        (80, {"hot_rows": 3}),  # nearly every token is hot
        (80, {"hot_rows": 1, "chunk_rows": 2}),  # and every key is cut
        (90, {"hot_rows": 5, "chunk_rows": 3}),
        (100, {}),
        (70, {"hot_rows": 5}),
        (60, {"hot_rows": 10, "chunk_rows": 5}),
    ],
)
def test_two_tables_against_all_pairs(spark, threshold, options):
    left, right = texts(1), texts(2)
    got = pairs(similar_texts(frame(spark, left), frame(spark, right), "t", threshold, **options))
    assert got == matches(left, right, threshold)


@pytest.mark.parametrize(
    ("threshold", "options"), [(80, {}), (80, {"hot_rows": 2, "chunk_rows": 2}), (70, {"hot_rows": 4})]
)
def test_one_table_against_all_pairs(spark, threshold, options):
    values = texts(3)
    got = pairs(similar_texts(frame(spark, values), None, "t", threshold, **options))
    assert got == matches(values, values, threshold)


def test_long_texts(spark):
    values = texts(4, longest=150)
    got = pairs(similar_texts(frame(spark, values), None, "t", 80, hot_rows=20))
    assert got == matches(values, values, 80)


@pytest.mark.parametrize(
    ("threshold", "options"),
    [
        (80, {"hot_rows": 4, "chunk_rows": 3}),  # the bands of lengths are cut into many cells
        (90, {}),
        (72, {"chunk_rows": 6}),
        (60, {}),
        (100, {}),
    ],
)
def test_long_and_short_texts_of_two_tables(spark, threshold, options):
    left, right = texts(5, longest=110) + ["x" * 64, "x" * 65], texts(6, longest=110) + ["x" * 63, "x" * 66]
    got = pairs(similar_texts(frame(spark, left), frame(spark, right), "t", threshold, **options))
    assert got == matches(left, right, threshold)


def shuffled_rows(df):
    """Rows that the shuffles of a collected frame wrote, those that are read again once."""
    written = {}

    def walk(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        if kind == "ReusedExchangeExec":
            return walk(plan.child())
        if kind == "ShuffleExchangeExec":
            written[plan.id()] = plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return sum(written.values())


def test_texts_of_the_larger_side_are_shuffled_once_to_be_different_and_once_to_their_cell(spark):
    rng = random.Random(8)

    def some(count, length):
        return ["".join(rng.choice("abcdefghijkl") for _ in range(length)) for _ in range(count)]

    left = some(4, 100)
    right = [*left, *some(500, 105), *some(500, 300), *some(500, 20), ""]  # 1,001 of them have no partner of their length
    found = similar_texts(frame(spark, left), frame(spark, right), "t")
    assert pairs(found) == {(t, t): 100.0 for t in left}
    assert 2 * 504 <= shuffled_rows(found) < 2 * 504 + 200


def test_equal_texts_of_all_lengths(spark):
    left = ["", "a", "b" * 64, "b" * 65, "c" * 5000, "d" * 40]
    right = ["", "", "a", "b" * 64, "b" * 66, "c" * 5000, "e" * 40, "f" * 9000]
    got = pairs(similar_texts(frame(spark, left), frame(spark, right), "t"))
    assert got.keys() == {(t, t) for t in ("", "a", "b" * 64, "c" * 5000)} | {
        ("b" * n, "b" * m) for n, m in ((64, 66), (65, 64), (65, 66))
    }
    assert all(score == 100.0 for (a, b), score in got.items() if a == b)
    assert pairs(similar_texts(frame(spark, left), frame(spark, []), "t")) == {}
    assert pairs(similar_texts(frame(spark, []), frame(spark, right), "t")) == {}


def test_long_texts_without_rare_tokens(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefghijkl") for _ in range(100)) for _ in range(120)]
    near = ["".join(c for c in t if rng.random() > 0.1) + "z" * rng.randint(0, 9) for t in base]
    got = pairs(similar_texts(frame(spark, base + near), None, "t", 80, chunk_rows=50))
    assert got == matches(base + near, base + near, 80)
    assert len(got) >= 2 * 240


def test_one_text_on_most_rows(spark):
    """A third of all rows and more share one text; each row pair comes out once."""
    left = spark.createDataFrame([(f"k{i}", "Apple Inc") for i in range(40)] + [("x", "Zebra")], "uri string, t string")
    right = spark.createDataFrame(
        [(f"a{i}", "Apple Inc.") for i in range(50)] + [("b", "Apple Inc"), ("c", None)], "uri string, t string"
    )
    rows = fuzzy_join(left, right, "t", "uri", chunk_rows=2).collect()
    assert len(rows) == 40 * 51
    assert {r.match_string for r in rows} == {"Apple Inc == Apple Inc.", "Apple Inc == Apple Inc"}
    assert all(r.match for r in rows)


def test_a_text_on_many_keys_gives_its_rows_from_many_tasks(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("uri"), F.lit("Apple Inc").alias("t"))
    got = fuzzy_self_join(df, "t", "uri")
    tasks = got.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 2000 * 1999
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 0.7 * 2000 * 1999


def test_self_join_keeps_both_orders_and_drops_equal_keys(spark):
    df = spark.createDataFrame(
        [("1", "Apple Inc"), ("2", "Apple Inc."), ("2", "Apple Inc"), ("3", "Zebra")], "uri string, t string"
    )
    got = sorted((r.left_key, r.right_key, r.match_string) for r in fuzzy_self_join(df, "t", "uri").collect())
    assert got == [
        ("1", "2", "Apple Inc == Apple Inc"),
        ("1", "2", "Apple Inc == Apple Inc."),
        ("2", "1", "Apple Inc == Apple Inc"),
        ("2", "1", "Apple Inc. == Apple Inc"),
    ]


def test_no_match_gives_an_empty_table(spark):
    df = spark.createDataFrame([("1", "abc"), ("2", "xyz")], "uri string, t string")
    assert fuzzy_self_join(df, "t", "uri").collect() == []


@pytest.mark.parametrize("threshold", [0, 101])
def test_bad_threshold(spark, threshold):
    with pytest.raises(ValueError):
        similar_texts(frame(spark, ["a"]), None, "t", threshold)
