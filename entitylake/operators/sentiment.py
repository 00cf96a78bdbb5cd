"""Sentiment of texts: word lists, or a model applied in batches."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entitylake.functions.similarity import bind
from entitylake.functions.text import first_words, name_tokens

MAX_WORDS = 512  # words a model takes of a text; word lists read all of it

# Rows and bytes that a task hands to a model at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

Scorer = Callable[[Sequence[str]], Sequence[tuple[float, str]]]


def bounded_batches(spark: SparkSession) -> None:
    """Batches of Python functions bounded in rows and bytes, whatever a partition holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def normal_label(label: Column) -> Column:
    """Model labels in the three-valued vocabulary of the reports."""
    name = F.upper(F.trim(label))
    return (
        F.when(name == "VERY POSITIVE", "POSITIVE").when(name == "VERY NEGATIVE", "NEGATIVE").otherwise(name)
    )


def sentiment(text: Column, positive: Collection[str], negative: Collection[str]) -> Column:
    """Struct ``(score float, label)`` from the words of both lists found in the whole text.

    The label is the side with more words, the score its lead over the other in
    relation to all words found. No words, or no text, is (0, NEUTRAL). Plain
    row-local expression: the lists become hash sets in the plan.
    """

    def hits(tokens: Column, wanted: Collection[str]) -> Column:
        return F.size(F.filter(tokens, lambda t: t.isin(*sorted(wanted)))).cast("double")

    def rate(tokens: Column) -> Column:
        return bind(
            F.struct(hits(tokens, positive).alias("p"), hits(tokens, negative).alias("n")),
            lambda h: F.struct(
                F.coalesce(F.try_divide(F.abs(h["p"] - h["n"]), h["p"] + h["n"]), F.lit(0.0))
                .cast("float")
                .alias("score"),
                F.when(h["p"] > h["n"], "POSITIVE")
                .when(h["p"] < h["n"], "NEGATIVE")
                .otherwise("NEUTRAL")
                .alias("label"),
            ),
        )

    return bind(name_tokens(F.lower(F.coalesce(text, F.lit("")))), rate)


def score_sentiment(
    df: DataFrame, text: str, positive: Collection[str], negative: Collection[str]
) -> DataFrame:
    """The rows with ``sentiment_score`` and ``sentiment_label`` added; no shuffle."""
    rated = df.withColumn("_sentiment", sentiment(F.col(text), positive, negative))
    return rated.select(
        *df.columns,
        F.col("_sentiment.score").alias("sentiment_score"),
        F.col("_sentiment.label").alias("sentiment_label"),
    )


def score_with_model(
    df: DataFrame, text: str, load: Callable[[], Scorer], max_words: int | None = MAX_WORDS
) -> DataFrame:
    """As :func:`score_sentiment`, with a model.

    ``load`` is called once per task and returns a function that scores a batch
    of texts. Texts are shortened in the JVM to what the model takes (``max_words``, or
    None for all of it); empty ones and texts the model fails on are (0, NEUTRAL).
    """
    schema = T.StructType(
        [f for f in df.schema.fields]
        + [T.StructField("sentiment_score", T.FloatType()), T.StructField("sentiment_label", T.StringType())]
    )
    neutral = (0.0, "NEUTRAL")

    def rate(score: Scorer, texts: list[str]) -> list[tuple[float, str]]:
        try:
            return list(score(texts))
        except Exception:  # noqa: BLE001 - a text the model cannot take is neutral
            if len(texts) == 1:
                return [neutral]
            return [rate(score, [one])[0] for one in texts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            texts = batch.pop("_text")
            usable = texts.notna() & (texts != "")
            results = iter(rate(score, texts[usable].tolist()) if usable.any() else [])
            rated = [next(results) if ok else neutral for ok in usable]
            yield batch.assign(
                sentiment_score=[float(s) for s, _ in rated], sentiment_label=[name for _, name in rated]
            )

    bounded_batches(df.sparkSession)
    given = F.col(text) if max_words is None else first_words(F.col(text), max_words)
    scored = df.withColumn("_text", given).mapInPandas(run, schema)
    return scored.withColumn("sentiment_label", normal_label(F.col("sentiment_label")))
