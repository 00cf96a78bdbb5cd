import pandas as pd
import pytest
from pyspark.sql import functions as F

from entitylake.functions.text import first_words, word_count
from entitylake.operators.mentions import extract_mentions, extract_with_model
from entitylake.operators.sentiment import normal_label, score_sentiment, score_with_model

GAZETTEER = [
    ("Tim Cook", "PERSON"),
    ("Apple Inc.", "ORG"),
    ("Apple", "ORG"),
    ("New York", "GPE"),
    ("New York City", "GPE"),
    ("York", "PERSON"),
    ("City Hall", "ORG"),
    ("!!", "ORG"),
]

TEXTS = [
    ("1", "Tim Cook is the CEO of Apple Inc. today", None),
    ("2", "New York City is large; Tim  Cook, of New York.", "York"),
    ("3", "", None),
    ("4", None, None),
    ("5", "new york is not a match, nor is Yorkshire", ""),
    ("6", "New York City Hall", "New York City Hall"),
]

EXPECTED = {
    ("1", "Tim Cook", "PERSON"),
    ("1", "Apple Inc.", "ORG"),
    ("2", "New York City", "LOC"),
    ("2", "New York", "LOC"),
    ("2", "Tim Cook", "PERSON"),
    ("2", "York", "PERSON"),
    ("6", "New York City", "LOC"),
    ("6", "City Hall", "ORG"),
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "uri string, title string, content string")


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_dictionary_mentions(spark, texts, limit):
    """Both join paths; the longer of nested matches counts, overlapping ones both do."""
    gazetteer = spark.createDataFrame(GAZETTEER, "phrase string, type string")
    got = extract_mentions(texts, "uri", ["title", "content"], gazetteer, broadcast_bytes=limit).collect()
    assert len(got) == len(EXPECTED)
    assert {tuple(r) for r in got} == EXPECTED


def test_one_phrase_of_two_types_and_copied_rows(spark, texts):
    gazetteer = spark.createDataFrame([("Apple", "ORG"), ("Apple", "GPE")], "phrase string, type string")
    copies = texts.unionByName(texts).unionByName(texts)
    got = extract_mentions(copies, "uri", ["title"], gazetteer).collect()
    assert sorted(tuple(r) for r in got) == [("1", "Apple", "LOC"), ("1", "Apple", "ORG")]


def test_model_mentions(texts):
    def load():
        def extract(batch):
            assert all(batch), "empty texts never reach the model"
            return [[(w, "GPE") for w in text.split() if w == "York"] + [("x", "DATE")] for text in batch]

        return extract

    got = extract_with_model(texts, "uri", ["title", "content"], load).collect()
    assert sorted(tuple(r) for r in got) == [("2", "York", "LOC"), ("6", "York", "LOC")]


def test_words(spark):
    df = spark.createDataFrame(
        [("  a  b\tc\n",), ("",), (" ",), ("a b",), (" ".join(["w"] * 6),), (None,)], "t string"
    )
    rows = df.select(word_count(F.col("t")).alias("n"), first_words(F.col("t"), 3).alias("s")).collect()
    assert [r.n for r in rows] == [3, 0, 0, 2, 6, None]
    # A text within the limit stays untouched, a longer one is joined by single blanks.
    assert [r.s for r in rows] == ["  a  b\tc\n", "", " ", "a b", "w w w", None]


POSITIVE, NEGATIVE = ["good", "love"], ["bad"]


def test_word_list_sentiment(spark):
    rows = [
        ("I LOVE this good product!", "POSITIVE", 1.0),
        ("good, bad and bad", "NEGATIVE", 1 / 3),
        ("good bad", "NEUTRAL", 0.0),
        ("nothing here", "NEUTRAL", 0.0),
        ("", "NEUTRAL", 0.0),
        (None, "NEUTRAL", 0.0),
        (" ".join(["x"] * 5000) + " bad", "NEGATIVE", 1.0),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").coalesce(1)
    got = score_sentiment(df, "t", POSITIVE, NEGATIVE).orderBy("i").collect()
    assert [r.sentiment_label for r in got] == [r[1] for r in rows]
    assert [r.sentiment_score for r in got] == pytest.approx([r[2] for r in rows], abs=1e-6)


def test_model_sentiment(spark):
    rows = ["great", "awful", "fail", "", None, " ".join(["w"] * 600)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")

    def load():
        def score(texts):
            if any(t == "fail" for t in texts):
                raise RuntimeError("cannot score")
            assert all(texts) and max(len(t.split()) for t in texts) <= 512
            return [(0.95, "Very Positive") if t == "great" else (0.85, "Negative") for t in texts]

        return score

    got = score_with_model(df, "t", load).orderBy("i").collect()
    assert [r.sentiment_label for r in got] == [
        "POSITIVE", "NEGATIVE", "NEUTRAL", "NEUTRAL", "NEUTRAL", "NEGATIVE"
    ]
    assert [r.sentiment_score for r in got] == pytest.approx([0.95, 0.85, 0, 0, 0, 0.85], abs=1e-6)
    assert got[0].t == "great"


def test_labels(spark):
    df = spark.createDataFrame([("Very Positive",), ("negative",), ("VERY NEGATIVE",), ("Neutral",)], "l string")
    got = [r[0] for r in df.select(normal_label(F.col("l"))).collect()]
    assert got == ["POSITIVE", "NEGATIVE", "NEGATIVE", "NEUTRAL"]
    assert pd.__version__


def test_models_get_bounded_batches(spark):
    def load():
        return lambda texts: [(float(len(texts)), "NEUTRAL")] * len(texts)

    df = spark.range(2500, numPartitions=1).select("id", F.lit("some words").alias("t"))
    assert score_with_model(df, "t", load).agg(F.max("sentiment_score")).first()[0] <= 1000
    long = spark.range(400, numPartitions=1).select("id", F.repeat(F.lit("long "), 20_000).alias("t"))
    assert score_with_model(long, "t", load, max_words=None).agg(F.max("sentiment_score")).first()[0] < 400
