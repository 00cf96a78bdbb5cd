"""Layer tables derived from a text corpus.

Documents play the articles, benchmark passages the descriptions of known
entities, and the capitalised words of those passages (alone and with the word
after them) the dictionary of names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.functions.keys import composite_key
from entitylake.operators.mentions import Extractor, extract_mentions
from entitylake.operators.sentiment import Scorer, score_sentiment
from entitylake.plans.star import table

# Fixed words for scoring the corpus.
POSITIVE = ("best", "with", "this", "les")
NEGATIVE = ("worthless", "idiot", "stupid", "disgusting", "was", "der")

CAPITALISED = r"\p{Lu}\p{L}+"
CAPITALISED_AND_NEXT = r"\p{Lu}\p{L}+ \p{L}+"


def _kind(text: Column) -> Column:
    kind = F.length(text) % 3
    return F.when(kind == 0, "PERSON").when(kind == 1, "ORG").otherwise("GPE")


def _found(text: str, pattern: str) -> Column:
    return F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))


def articles(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, folder, "documents").select(
        composite_key("doc_id").alias("uri"),
        "doc_id",
        F.col("source").alias("title"),
        none.alias("description"),
        F.col("text").alias("content"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("source_name"),
        F.lit(None).cast("timestamp").alias("published_at"),
    )


def known_entities(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    return (
        table(spark, folder, "benchmark")
        .select(name.alias("entity_name"), F.col("text").alias("entity_description"))
        .withColumn("entity_type", F.lit("ORG"))
        .select(
            composite_key("entity_name", "entity_type").alias("uri"),
            "entity_name",
            "entity_type",
            "entity_description",
        )
    )


def gazetteer(spark: SparkSession, folder: str) -> DataFrame:
    phrases = F.concat(_found("text", CAPITALISED), _found("text", CAPITALISED_AND_NEXT))
    return (
        table(spark, folder, "benchmark")
        .select(F.explode(phrases).alias("phrase"))
        .distinct()
        .withColumn("type", _kind(F.col("phrase")))
    )


def known_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return extract_mentions(
        known_entities(spark, folder), "uri", ["entity_description"], gazetteer(spark, folder)
    )


def article_mentions(spark: SparkSession, folder: str, **options: int) -> DataFrame:
    return extract_mentions(
        articles(spark, folder), "uri", ["title", "description", "content"], gazetteer(spark, folder), **options
    )


def capitalised_words(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return table(spark, folder, name).select(F.explode(_found("text", CAPITALISED)).alias("word"))


def document_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.explode(_found("text", CAPITALISED)).alias("word"))


def scored_articles(spark: SparkSession, folder: str) -> DataFrame:
    return score_sentiment(articles(spark, folder), "content", POSITIVE, NEGATIVE)


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Labels read as expected counts: quality for persons, toxic for organisations, both for places."""
    return table(spark, folder, "labels").select(
        composite_key("doc_id").alias("uid"),
        F.col("quality").alias("persons"),
        F.col("toxic").alias("org"),
        (F.col("quality") + F.col("toxic")).alias("loc"),
    )


def spelled_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels in the spellings of a model: quality for the side, toxic for its strength."""
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    spelled = (
        F.when(good & toxic, " positive")
        .when(good, "Very Positive")
        .when(toxic, "VERY NEGATIVE")
        .otherwise("neutral")
    )
    return table(spark, folder, "labels").select("doc_id", spelled.alias("spelled"))


def long_word_model() -> Extractor:
    """Stands for an extraction model: words of a capital and eight or more small letters."""
    word = re.compile("[A-Z][a-z]{8,}")
    kinds = ("PERSON", "ORG", "GPE", "DATE")

    def extract(texts: Sequence[str]) -> list[list[tuple[str, str]]]:
        return [[(w, kinds[len(w) % 4]) for w in text.split(" ") if word.fullmatch(w)] for text in texts]

    return extract


def exclamation_model() -> Scorer:
    """Stands for a sentiment model: exclamation marks are negative, many of them very much so."""

    def rate(text: str) -> tuple[float, str]:
        marks = text.count("!")
        if not marks:
            return 0.5, "Very Positive"
        return (1.0, "Very Negative") if marks > 8 else (marks / 8, "negative")

    return lambda texts: [rate(text) for text in texts]


def landed_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Events in the form of API responses: the user is the entity, the event the article."""
    key = F.col("event_id").cast("string")
    article = F.struct(
        F.col("event_type").alias("title"),
        F.col("props").alias("description"),
        F.lit(None).cast("string").alias("content"),
        F.concat(F.lit("event/"), key).alias("url"),
        F.lit(None).cast("string").alias("author"),
        # Errors carry a date no parser takes.
        F.when(F.col("event_type") == "error", "yesterday")
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("publishedAt"),
        F.when(F.col("value") > 5, F.struct(F.col("event_type").alias("name"))).alias("source"),
    )
    user = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    return table(spark, folder, "events").select(
        composite_key(user).alias("entity_uri"),
        user.alias("entity_name"),
        F.lit("en").alias("language"),
        # Every article lands twice, as with overlapping look-back windows.
        F.array(article, article).alias("articles"),
    )


def lines(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All lines of a table's texts as rows (text)."""
    return table(spark, folder, name).select(F.explode(F.split("text", "\n", -1)).alias("text"))
