"""The jobs of the lake: each reads tables from a store and writes tables to it.

A job writes a table and the next one reads it back, so lineage ends at every
table and a lost executor costs at most the job it was in.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.operators.mentions import extract_mentions
from entitylake.operators.sentiment import score_sentiment
from entitylake.plans import layers
from entitylake.plans.reports import ReportTables
from entitylake.sources.articles import ingest_articles, one_per_key
from entitylake.sources.entities import read_entity_files
from entitylake.sources.store import LayerStore

BRONZE_ENTITIES = "bronze.known_entities"
BRONZE_ARTICLES = "bronze.newsapi"
SILVER_ENTITIES = "silver.known_entities"
SILVER_ENTITY_MENTIONS = "silver.known_entities_entities"
SILVER_ARTICLES = "silver.newsapi"
SILVER_ARTICLE_MENTIONS = "silver.newsapi_entities"
SILVER_SENTIMENT = "silver.newsapi_sentiment"
SILVER_SOURCE_MAPPING = "silver.entity_to_source_mapping"
SILVER_ENTITY_MAPPING = "silver.entity_to_entity_mapping"
GOLD_FORWARD = "gold.entity_affiliations"
GOLD_AFFILIATIONS = "gold.entity_affiliations_complete"
GOLD_MENTIONS = "gold.entity_to_newsapi"
GOLD_SENTIMENT = "gold.entity_to_newsapi_sentiment"

ARTICLE_TEXTS = ("title", "description", "content")

# From a frame, its key column and its text columns to (uri, entity_text, entity_type).
Extraction = Callable[[DataFrame, str, Collection[str]], DataFrame]
# From articles (uri, title, content) to them with sentiment_score and sentiment_label.
Scoring = Callable[[DataFrame], DataFrame]


def load_known_entities(store: LayerStore, path: str | list[str]) -> None:
    rows = read_entity_files(store.spark, path)
    store.write(layers.keyed_entities(rows), BRONZE_ENTITIES)


def load_articles(
    store: LayerStore,
    path: str | list[str],
    as_of: date | datetime,
    days_back: int = 7,
    ingested_at: datetime | None = None,
) -> None:
    """Append the articles of the look-back window."""
    articles = ingest_articles(store.spark, path, as_of, days_back, ingested_at)
    store.write(articles, BRONZE_ARTICLES, mode="append")


def gazetteer_of(store: LayerStore) -> Extraction:
    """Extraction with the known entities' own names as the dictionary."""
    names = store.read(BRONZE_ENTITIES).select(
        F.col("entity_name").alias("phrase"), F.col("entity_type").alias("type")
    )
    return lambda df, key, columns: extract_mentions(df, key, list(columns), names)


def refine_entities(store: LayerStore, extract: Extraction | None = None) -> None:
    """Copy the dictionary and list the mentions in its descriptions."""
    extract = extract or gazetteer_of(store)
    entities = store.read(BRONZE_ENTITIES)
    store.write(entities, SILVER_ENTITIES, sources=[BRONZE_ENTITIES])
    store.write(extract(entities, "uri", ["entity_description"]), SILVER_ENTITY_MENTIONS, sources=[BRONZE_ENTITIES])


def refine_articles(
    store: LayerStore, extract: Extraction | None = None, dedupe_articles: bool = False
) -> None:
    """Copy the articles and list their mentions.

    Articles appended by several runs stay repeated unless ``dedupe_articles``.
    """
    extract = extract or gazetteer_of(store)
    articles = store.read(BRONZE_ARTICLES)
    made_from = [BRONZE_ARTICLES, BRONZE_ENTITIES]
    store.write(one_per_key(articles) if dedupe_articles else articles, SILVER_ARTICLES, sources=made_from)
    store.write(extract(articles, "uri", list(ARTICLE_TEXTS)), SILVER_ARTICLE_MENTIONS, sources=made_from)


def lexicon(positive: Collection[str], negative: Collection[str]) -> Scoring:
    return lambda articles: score_sentiment(articles, "content", positive, negative)


def score_articles(store: LayerStore, score: Scoring) -> None:
    """Sentiment of the article contents."""
    articles = store.read(SILVER_ARTICLES).select("uri", "title", "content")
    store.write(
        score(articles).select("uri", "title", "sentiment_score", "sentiment_label"),
        SILVER_SENTIMENT,
        sources=[SILVER_ARTICLES],
    )


def map_entities(store: LayerStore, threshold: float = 80) -> None:
    """Match mentions of known entities with article mentions and with each other."""
    known = store.read(SILVER_ENTITY_MENTIONS)
    articles = store.read(SILVER_ARTICLE_MENTIONS)
    store.write(
        layers.source_mapping(known, articles, threshold),
        SILVER_SOURCE_MAPPING,
        sources=[SILVER_ENTITY_MENTIONS, SILVER_ARTICLE_MENTIONS],
    )
    store.write(layers.entity_mapping(known, threshold), SILVER_ENTITY_MAPPING)


def publish_affiliations(store: LayerStore) -> None:
    forward = layers.entity_affiliations(store.read(SILVER_ENTITY_MAPPING), store.read(SILVER_ENTITIES))
    store.write(forward, GOLD_FORWARD)
    # From the written table, so the joins run once.
    store.write(layers.complete_affiliations(store.read(GOLD_FORWARD)), GOLD_AFFILIATIONS)


def publish_mentions(store: LayerStore) -> None:
    store.write(
        layers.entity_articles(
            store.read(SILVER_SOURCE_MAPPING), store.read(SILVER_ENTITIES), store.read(SILVER_ARTICLES)
        ),
        GOLD_MENTIONS,
        sources=[SILVER_SOURCE_MAPPING, SILVER_ENTITIES, SILVER_ARTICLES],
    )


def publish_sentiment(store: LayerStore) -> None:
    store.write(
        layers.article_sentiment(store.read(SILVER_ARTICLES), store.read(SILVER_SENTIMENT)),
        GOLD_SENTIMENT,
        sources=[SILVER_ARTICLES, SILVER_SENTIMENT],
    )


def report_tables(store: LayerStore) -> ReportTables:
    return ReportTables(
        affiliations=store.read(GOLD_AFFILIATIONS),
        mentions=store.read(GOLD_MENTIONS),
        sentiment=store.read(GOLD_SENTIMENT),
    )


@dataclass
class Refresh:
    """Inputs of a full refresh."""

    entity_files: str | list[str]
    landing: str | list[str]
    as_of: date | datetime
    score: Scoring
    days_back: int = 7
    threshold: float = 80
    extract: Extraction | None = None
    dedupe_articles: bool = False
    ingested_at: datetime | None = None


def refresh(store: LayerStore, inputs: Refresh) -> ReportTables:
    """All jobs in order, from the delivered files to the report tables."""
    load_known_entities(store, inputs.entity_files)
    load_articles(store, inputs.landing, inputs.as_of, inputs.days_back, inputs.ingested_at)
    refine_entities(store, inputs.extract)
    refine_articles(store, inputs.extract, inputs.dedupe_articles)
    score_articles(store, inputs.score)
    map_entities(store, inputs.threshold)
    publish_affiliations(store)
    publish_mentions(store)
    publish_sentiment(store)
    return report_tables(store)
