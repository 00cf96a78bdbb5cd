import random

import pytest
from pyspark.sql import functions as F

from entitylake.functions.keys import composite_key
from entitylake.functions.similarity import fuzzy_match, indel_ratio, lcs_length
from tests.brute import lcs, ratio


@pytest.mark.parametrize(
    ("left", "right", "threshold", "match", "text", "score"),
    [
        ("Apple Inc.", "Apple Inc.", 80, True, "Apple Inc. == Apple Inc.", 100.0),
        ("Apple Inc", "Apple Inc.", 80, True, "Apple Inc == Apple Inc.", 94.7368),
        ("Apple Inc.", "Microsoft Corporation", 80, False, None, 12.9032),
        ("New York City", "New York", 90, False, None, 76.1905),
        ("New York City", "New York", 70, True, "New York City == New York", 76.1905),
        ("", "", 80, True, " == ", 100.0),
        ("", "a", 80, False, None, 0.0),
        (None, "a", 80, False, None, 0.0),
        ("ac", "aec", 80, True, "ac == aec", 80.0),
        ("Paris", "paris", 80, True, "Paris == paris", 80.0),
    ],
)
def test_fuzzy_match(spark, left, right, threshold, match, text, score):
    df = spark.createDataFrame([(left, right)], "a string, b string")
    row = df.select(fuzzy_match(F.col("a"), F.col("b"), threshold).alias("m")).first().m
    assert (row.match, row.match_string) == (match, text)
    assert row.score == pytest.approx(score, abs=1e-4)


def test_ratio_against_plain_python(spark):
    rng = random.Random(5)

    def text(alphabet, longest):
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest)))

    rows = [
        (text(alphabet, longest), text(alphabet, longest))
        for alphabet, longest in (("ab", 12), ("abcdef", 30), ("aé😀b", 70), ("abc", 200))
        for _ in range(150)
    ]
    rows += [("a" * n, "a" * m) for n, m in ((61, 62), (62, 63), (63, 124), (124, 125), (186, 187))]
    df = spark.createDataFrame(rows, "a string, b string").repartition(8)
    got = df.select(
        "a", "b", lcs_length(F.col("a"), F.col("b")).alias("l"), indel_ratio(F.col("a"), F.col("b")).alias("r")
    ).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.l == lcs(row.a, row.b)
        assert row.r == ratio(row.a, row.b)


def test_composite_key(spark):
    import hashlib

    df = spark.createDataFrame([("ab", "c", None), ("a", "bc", None)], "x string, y string, z string")
    rows = df.select(composite_key("x", "y").alias("k"), composite_key("x", "z").alias("n")).collect()
    assert rows[0].k == rows[1].k == hashlib.sha256(b"abc").hexdigest()
    assert rows[0].n == hashlib.sha256(b"abNone").hexdigest()
    with pytest.raises(ValueError):
        composite_key()
