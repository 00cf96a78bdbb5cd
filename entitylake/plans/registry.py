"""Registered queries other than the reports: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.functions.keys import composite_key
from entitylake.functions.similarity import fuzzy_match
from entitylake.functions.text import first_words, word_count
from entitylake.operators import evaluation
from entitylake.operators.distinct_states import day_states, distinct_counts
from entitylake.operators.fuzzy_join import fuzzy_join, similar_texts
from entitylake.operators.mentions import extract_with_model
from entitylake.operators.pairs import fold, pairs_under_key
from entitylake.operators.sentiment import normal_label, score_with_model
from entitylake.operators.top_pairs import strong_sides
from entitylake.plans import corpus, layers, star
from entitylake.sources.articles import flatten_responses, in_window, one_per_key

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def composite_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Surrogate keys over strings, numbers and missing values."""
    customers = star.table(spark, folder, "customer")
    segment = F.when(F.col("c_nationkey") > 4, F.col("c_mktsegment"))
    return customers.select(
        "c_custkey",
        composite_key("c_name").alias("name_key"),
        composite_key("c_name", "c_nationkey", segment).alias("full_key"),
    )


@query
def keyed_known_entities(spark: SparkSession, folder: str) -> DataFrame:
    return star.known_entities(spark, folder)


@query
def article_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Responses to articles: flatten, seven-day window, one per key."""
    flat = flatten_responses(corpus.landed_responses(spark, folder), datetime(2024, 1, 31))
    return one_per_key(in_window(flat, date(2024, 1, 30), days_back=7))


@query
def known_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.known_mentions(spark, folder)


@query
def article_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.article_mentions(spark, folder)


@query
def article_mentions_large_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The same mentions on the path for dictionaries too large to broadcast."""
    return corpus.article_mentions(spark, folder, broadcast_bytes=0)


@query
def article_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.scored_articles(spark, folder).select("uri", "title", "sentiment_score", "sentiment_label")


@query
def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words of each text, and the text as shortened for scoring."""
    text = F.col("text")
    short = first_words(text, 512)
    return star.table(spark, folder, "documents").select(
        "doc_id",
        word_count(text).alias("words"),
        word_count(short).alias("kept_words"),
        F.sha2(short, 256).alias("kept_text"),
    )


@query
def similar_words(spark: SparkSession, folder: str) -> DataFrame:
    """Capitalised words of the passages against those of all documents."""
    return similar_texts(
        corpus.capitalised_words(spark, folder, "benchmark"),
        corpus.capitalised_words(spark, folder, "documents"),
        "word",
    )


@query
def similar_words_within(spark: SparkSession, folder: str) -> DataFrame:
    """Capitalised words of all documents against each other."""
    return similar_texts(corpus.capitalised_words(spark, folder, "documents"), None, "word")


@query
def similar_words_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The passages' words at a lower threshold."""
    return similar_texts(
        corpus.capitalised_words(spark, folder, "benchmark"),
        corpus.capitalised_words(spark, folder, "documents"),
        "word",
        threshold=70,
    )


@query
def similar_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Whole passages, most of them long, against the lines of all documents."""
    return similar_texts(
        star.table(spark, folder, "benchmark").select("text"), corpus.lines(spark, folder, "documents"), "text"
    )


@query
def frequent_word_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty pairs of capitalised words that are together in most documents, without forming all pairs."""
    items, others = strong_sides(fold(corpus.document_words(spark, folder), "doc_id", "word"), least=2, best=50)
    return (
        pairs_under_key(items, others, weighted=False)
        .groupBy(F.col("one.item").alias("word1"), F.col("two.item").alias("word2"))
        .agg(F.count(F.lit(1)).alias("documents"))
        .where(F.col("documents") >= 2)
        .orderBy(F.desc("documents"), "word1", "word2")
        .limit(50)
    )


@query
def active_customers(spark: SparkSession, folder: str) -> DataFrame:
    """Different customers of each order priority by month, quarter and year, all from the same states of days."""
    states = day_states(star.table(spark, folder, "orders"), "o_orderdate", "o_custkey", ["o_orderpriority"])
    grains = [
        distinct_counts(states, grain, ["o_orderpriority"]).withColumn("grain", F.lit(grain))
        for grain in ("month", "quarter", "year")
    ]
    return reduce(DataFrame.unionByName, grains)


@query
def fuzzy_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Names of entities and their words matched with the words of part names, with the keys of both."""
    parts = (
        star.table(spark, folder, "part")
        .select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
        .select(F.col("p_partkey").cast("string").alias("key"), "word")
    )
    phrases = star.entity_mentions(spark, folder).select(
        F.col("uri").alias("key"), F.col("entity_text").alias("word")
    )
    return fuzzy_join(phrases, parts, "word", "key")


@query
def passage_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Each passage compared, whole, with the one after it."""
    passages = star.table(spark, folder, "benchmark")
    following = passages.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))
    found = fuzzy_match(F.col("text"), F.col("other"), threshold=52)
    return (
        passages.join(following, "item_id")
        .withColumn("found", found)
        .select("item_id", "found.match", "found.match_string", "found.score")
    )


@query
def normal_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels as models spell them, in the vocabulary of the reports."""
    return corpus.spelled_labels(spark, folder).select("doc_id", normal_label(F.col("spelled")).alias("label"))


@query
def model_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """The extraction hook with a batch function: long capitalised words."""
    return extract_with_model(corpus.articles(spark, folder), "uri", ["content"], corpus.long_word_model)


@query
def model_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    """The sentiment hook with a batch function: exclamation marks, on whole texts."""
    articles = corpus.articles(spark, folder).select("uri", "title", "content")
    rated = score_with_model(articles, "content", corpus.exclamation_model, max_words=None)
    return rated.select("uri", "title", "sentiment_score", "sentiment_label")


def _source_mapping(spark: SparkSession, folder: str) -> DataFrame:
    return layers.source_mapping(
        corpus.known_mentions(spark, folder), corpus.article_mentions(spark, folder)
    )


def _entity_mapping(spark: SparkSession, folder: str) -> DataFrame:
    return layers.entity_mapping(corpus.known_mentions(spark, folder))


@query
def source_mapping(spark: SparkSession, folder: str) -> DataFrame:
    return _source_mapping(spark, folder)


@query
def entity_mapping(spark: SparkSession, folder: str) -> DataFrame:
    return _entity_mapping(spark, folder)


@query
def gold_affiliations(spark: SparkSession, folder: str) -> DataFrame:
    entities = corpus.known_entities(spark, folder)
    return layers.entity_affiliations(_entity_mapping(spark, folder), entities)


@query
def gold_affiliations_complete(spark: SparkSession, folder: str) -> DataFrame:
    entities = corpus.known_entities(spark, folder)
    forward = layers.entity_affiliations(_entity_mapping(spark, folder), entities)
    return layers.complete_affiliations(forward)


@query
def gold_entity_articles(spark: SparkSession, folder: str) -> DataFrame:
    return layers.entity_articles(
        _source_mapping(spark, folder),
        corpus.known_entities(spark, folder),
        corpus.articles(spark, folder),
    )


@query
def gold_article_sentiment(spark: SparkSession, folder: str) -> DataFrame:
    return layers.article_sentiment(
        corpus.articles(spark, folder), corpus.scored_articles(spark, folder)
    )


def _predicted(spark: SparkSession, folder: str) -> DataFrame:
    return corpus.article_mentions(spark, folder).withColumnRenamed("uri", "uid")


@query
def predicted_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.predicted_counts(_predicted(spark, folder))


@query
def extraction_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.extraction_metrics(corpus.labelled_texts(spark, folder), _predicted(spark, folder))


@query
def extraction_averages(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.metric_averages(
        evaluation.extraction_metrics(corpus.labelled_texts(spark, folder), _predicted(spark, folder))
    )


@query
def extraction_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.text_accuracy(corpus.labelled_texts(spark, folder), _predicted(spark, folder))


@query
def extraction_average_counts(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.average_counts(corpus.labelled_texts(spark, folder), _predicted(spark, folder))
