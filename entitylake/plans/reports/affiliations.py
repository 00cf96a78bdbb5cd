"""Reports on entities, their affiliations and the articles that mention them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.functions.measures import down, up
from entitylake.operators.pairs import fold, in_keys, item_pairs, pairs_under_key
from entitylake.operators.top_pairs import strong_sides
from entitylake.plans.reports.common import (
    ANY,
    Moment,
    ReportTables,
    is_one_of,
    keep,
    mentions_in,
    report,
)


@report
def entity_information(tables: ReportTables, *, entity_name: str) -> DataFrame:
    """Name, type and description of the entities whose name fits a LIKE pattern."""
    return (
        tables.affiliations.where(F.col("entity_name").like(entity_name))
        .select("entity_name", "entity_type", "entity_description")
        .distinct()
    )


@report
def entity_affiliations(
    tables: ReportTables, *, entity_name: str, entity_type: str = ANY
) -> DataFrame:
    return (
        keep(
            tables.affiliations,
            F.col("entity_name") == entity_name,
            is_one_of("affiliated_entity_type", entity_type),
        )
        .select(
            "affiliated_entity_name",
            "affiliated_entity_type",
            "affiliated_entity_description",
            "match_score",
        )
        .distinct()
        .orderBy(down("match_score"), up("affiliated_entity_name"))
    )


@report
def affiliations_by_type(tables: ReportTables, *, entity_name: str) -> DataFrame:
    return (
        tables.affiliations.where(F.col("entity_name") == entity_name)
        .groupBy("affiliated_entity_type")
        .agg(F.count("affiliated_entity_name").alias("total_affiliations"))
        .orderBy(down("total_affiliations"), up("affiliated_entity_type"))
    )


@report
def affiliations_over_time(tables: ReportTables, *, entity_name: str) -> DataFrame:
    """Mentions per month with their mean match score."""
    return (
        tables.mentions.where(
            (F.col("entity_name") == entity_name) & F.col("source_published_at").isNotNull()
        )
        .groupBy(F.date_trunc("month", "source_published_at").alias("month"))
        .agg(F.count(F.lit(1)).alias("total_mentions"), F.avg("match_score").alias("avg_match_score"))
        .orderBy(up("month"))
    )


@report
def entity_news_sources(
    tables: ReportTables, *, entity_name: str, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    return (
        mentions_in(tables, date_from, date_to, F.col("entity_name") == entity_name)
        .select(
            "source_name",
            "source_title",
            "source_description",
            "source_url",
            "source_published_at",
            "match_score",
        )
        .distinct()
        .orderBy(down("source_published_at"), up("source_url"), up("match_score"))
    )


@report
def top_entities_by_mentions(
    tables: ReportTables,
    *,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    """The twenty entities mentioned in most different articles."""
    return (
        mentions_in(tables, date_from, date_to, is_one_of("entity_type", entity_type))
        .groupBy("entity_name", "entity_type")
        .agg(F.count_distinct("source_uri").alias("mention_count"))
        .orderBy(down("mention_count"), up("entity_name"), up("entity_type"))
        .limit(20)
    )


@report
def relationship_network(tables: ReportTables, *, entity_name: str) -> DataFrame:
    """Affiliation edges that start or end at an entity."""
    return (
        tables.affiliations.where(
            (F.col("entity_name") == entity_name) | (F.col("affiliated_entity_name") == entity_name)
        )
        .select(
            F.col("entity_name").alias("source_entity"),
            F.col("entity_type").alias("source_type"),
            F.col("affiliated_entity_name").alias("target_entity"),
            F.col("affiliated_entity_type").alias("target_type"),
            F.col("match_score").alias("relationship_strength"),
        )
        .orderBy(down("relationship_strength"), up("source_entity"), up("target_entity"))
    )


@report
def news_relevance_over_time(
    tables: ReportTables, *, entity_name: str, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    """Mentions per week with their mean match score; articles without a date form a group."""
    return (
        mentions_in(tables, date_from, date_to, F.col("entity_name") == entity_name)
        .groupBy(F.date_trunc("week", "source_published_at").alias("week"))
        .agg(F.count(F.lit(1)).alias("mention_count"), F.avg("match_score").alias("avg_relevance"))
        .orderBy(up("week"))
    )


@report
def related_entities(tables: ReportTables, *, entity_type: str = ANY, prune: bool = False) -> DataFrame:
    """The twenty pairs of entities found together in most articles, in two at least."""
    mentions = keep(tables.mentions, is_one_of("entity_type", entity_type))
    items = fold(mentions, "source_uri", "entity_name")
    pairs = pairs_under_key(*strong_sides(items, least=2, best=20), weighted=False) if prune else item_pairs(in_keys(items, 2))
    return (
        pairs
        # One row per article and pair, so counting rows counts articles.
        .groupBy(F.col("one.item").alias("entity1"), F.col("two.item").alias("entity2"))
        .agg(F.count(F.lit(1)).alias("co_occurrence_count"))
        .where(F.col("co_occurrence_count") > 1)
        .orderBy(down("co_occurrence_count"), up("entity1"), up("entity2"))
        .limit(20)
    )


@report
def entity_type_distribution(tables: ReportTables) -> DataFrame:
    return (
        tables.affiliations.groupBy("entity_type")
        .agg(F.count_distinct("entity_name").alias("entity_count"))
        .orderBy(down("entity_count"), up("entity_type"))
    )
