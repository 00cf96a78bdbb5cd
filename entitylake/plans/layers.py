"""Table-to-table steps between the layers, as plain DataFrame functions.

The jobs in :mod:`entitylake.plans.jobs` read their inputs from a store, apply
these functions and write the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.functions.keys import composite_key
from entitylake.operators.fuzzy_join import fuzzy_join, fuzzy_self_join

ENTITY_COLUMNS = ("uri", "name", "type", "description")


def keyed_entities(rows: DataFrame) -> DataFrame:
    """Dictionary rows with their key."""
    return rows.select(
        composite_key("entity_name", "entity_type").alias("uri"),
        "entity_name",
        "entity_type",
        "entity_description",
    )


def source_mapping(known_mentions: DataFrame, article_mentions: DataFrame, threshold: float = 80) -> DataFrame:
    """Mentions of known entities matched with mentions in articles."""
    return mapping_rows(fuzzy_join(known_mentions, article_mentions, "entity_text", "uri", threshold))


def mapping_rows(matched: DataFrame) -> DataFrame:
    """Matched keys of known entities and articles under the mapping's names."""
    return matched.select(
        F.col("left_key").alias("known_uri"),
        "match",
        "match_string",
        F.col("right_key").alias("newsapi_uri"),
        "score",
    )


def entity_mapping(known_mentions: DataFrame, threshold: float = 80) -> DataFrame:
    """Mentions of known entities matched with those of other known entities, both ways."""
    return fuzzy_self_join(known_mentions, "entity_text", "uri", threshold).select(
        F.col("left_key").alias("known1_uri"),
        F.col("right_key").alias("known2_uri"),
        "match",
        "match_string",
        "score",
    )


def _entity(entities: DataFrame, prefix: str) -> DataFrame:
    """The dictionary under the column names ``{prefix}_uri``, ``{prefix}_name``..."""
    return entities.select(
        F.col("uri").alias(f"{prefix}_uri"),
        *[F.col(f"entity_{c}").alias(f"{prefix}_{c}") for c in ENTITY_COLUMNS[1:]],
    )


def _match() -> tuple[Column, Column]:
    return F.col("match_string").alias("match_details"), F.col("score").alias("match_score")


def entity_affiliations(mapping: DataFrame, entities: DataFrame) -> DataFrame:
    """Each mapping row with both entities spelled out."""
    return (
        mapping.withColumnRenamed("known1_uri", "entity_uri")
        .withColumnRenamed("known2_uri", "affiliated_entity_uri")
        .join(_entity(entities, "entity"), "entity_uri")
        .join(_entity(entities, "affiliated_entity"), "affiliated_entity_uri")
        .select(
            *[f"entity_{c}" for c in ENTITY_COLUMNS],
            *[f"affiliated_entity_{c}" for c in ENTITY_COLUMNS],
            *_match(),
        )
    )


def complete_affiliations(forward: DataFrame) -> DataFrame:
    """Every affiliation and its reverse, as a bag.

    Each row is turned into two, so the forward rows are computed once.
    """
    def direction(one: str, two: str) -> Column:
        return F.struct(
            *[F.col(f"{one}_{c}").alias(f"entity_{c}") for c in ENTITY_COLUMNS],
            *[F.col(f"{two}_{c}").alias(f"affiliated_entity_{c}") for c in ENTITY_COLUMNS],
        )

    both = F.array(direction("entity", "affiliated_entity"), direction("affiliated_entity", "entity"))
    return forward.select(F.explode(both).alias("row"), "match_details", "match_score").select(
        "row.*", "match_details", "match_score"
    )


def entity_articles(mapping: DataFrame, entities: DataFrame, articles: DataFrame) -> DataFrame:
    """Each mapping row with its entity and the article that mentions it."""
    sources = articles.select(
        F.col("uri").alias("source_uri"),
        F.col("title").alias("source_title"),
        F.col("description").alias("source_description"),
        F.col("url").alias("source_url"),
        "source_name",
        F.col("published_at").alias("source_published_at"),
    )
    return (
        mapping.withColumnRenamed("known_uri", "entity_uri")
        .withColumnRenamed("newsapi_uri", "source_uri")
        # The slim mapping meets the articles first; descriptions of entities join last.
        .join(sources, "source_uri")
        .join(_entity(entities, "entity"), "entity_uri")
        .select(
            *[f"entity_{c}" for c in ENTITY_COLUMNS],
            *[c for c in sources.columns],
            *_match(),
        )
    )


def article_sentiment(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """Sentiment of the articles on hand, distinct rows.

    Only the key and title of an article take part, made distinct before the
    join so that repeated articles do not multiply.
    """
    titles = articles.select("uri", "title").distinct()
    rated = scores.select("uri", "sentiment_score", "sentiment_label").distinct()
    return titles.join(rated, "uri")
