"""Articles from landed news API responses."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitylake.functions.keys import composite_key
from entitylake.schemas import ARTICLE_RESPONSE, ARTICLES

LANGUAGE = "en"


def _published(text: Column) -> Column:
    """Moment in the form 2024-01-31T12:00:00Z, null for anything else."""
    well_formed = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(well_formed, F.try_to_timestamp(text))


def flatten_responses(responses: DataFrame, ingested_at: datetime | Column) -> DataFrame:
    """One row per article, in the columns of the article table plus ``place`` in its response."""
    moment = ingested_at if isinstance(ingested_at, Column) else F.lit(ingested_at)
    article = responses.select(
        "entity_uri", "entity_name", "language", F.posexplode("articles").alias("place", "a")
    )
    return article.select(
        composite_key(F.col("a.url"), F.col("a.title"), F.col("entity_name")).alias("uri"),
        "entity_uri",
        "entity_name",
        F.col("a.title").alias("title"),
        F.col("a.description").alias("description"),
        F.col("a.content").alias("content"),
        F.col("a.url").alias("url"),
        F.when(F.col("a.source").isNull(), "").otherwise(F.col("a.source.name")).alias("source_name"),
        F.col("a.author").alias("author"),
        _published(F.col("a.publishedAt")).alias("published_at"),
        moment.cast("timestamp").alias("ingestion_timestamp"),
        "language",
        "place",
    )


def in_language() -> Column:
    return F.coalesce("language", F.lit(LANGUAGE)) == LANGUAGE


def in_window(articles: DataFrame, as_of: date | datetime | Column, days_back: int) -> DataFrame:
    """Articles in the wanted language from the days up to ``as_of``.

    An article without a readable date passes, as a search result is already
    dated by the service.
    """
    day = F.to_date(as_of if isinstance(as_of, Column) else F.lit(as_of))
    published = F.to_date("published_at")
    return articles.where(
        in_language()
        & (
            published.isNull()
            | ((published >= F.date_sub(day, days_back)) & (published <= day))
        )
    )


def most_relevant(articles: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` articles of each response, in the order the search gave them.

    A page size: a landed response has been cut by the service, so the ingest
    keeps all of it unless asked.
    """
    return articles.where(F.col("place") < limit)


def one_per_key(articles: DataFrame) -> DataFrame:
    """One article per key, always the same one: the newest, then the first by url and content.

    An aggregate, so copies fold together before the shuffle.
    """
    columns = ARTICLES.names
    rest = [c for c in columns if c not in ("uri", "ingestion_timestamp")]
    kept = F.max(F.struct("ingestion_timestamp", *rest))
    return (
        articles.groupBy("uri")
        .agg(kept.alias("row"))
        .select("uri", "row.*")
        .select(*columns)
    )


def read_responses(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.schema(ARTICLE_RESPONSE).json(path)


def ingest_articles(
    spark: SparkSession,
    path: str | list[str],
    as_of: date | datetime,
    days_back: int = 7,
    ingested_at: datetime | None = None,
    per_response: int | None = None,
) -> DataFrame:
    """Articles of the landed responses, ready to append to the article table."""
    moment = ingested_at or datetime.now()
    flat = flatten_responses(read_responses(spark, path), moment)
    if per_response is not None:
        flat = most_relevant(flat, per_response)
    return one_per_key(in_window(flat, as_of, days_back))
