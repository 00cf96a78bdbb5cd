"""Reports on match quality, sources and the shape of the affiliation network."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.functions.measures import down, up
from entitylake.plans.reports.common import (
    ANY,
    Moment,
    ReportTables,
    among_most_mentioned,
    is_one_of,
    keep,
    mentions_in,
    report,
)


@report
def match_quality_distribution(tables: ReportTables) -> DataFrame:
    score = F.col("match_score")
    quality = (
        F.when(score >= 95, "Excellent (95-100)")
        .when(score >= 90, "Very Good (90-94)")
        .when(score >= 85, "Good (85-89)")
        .when(score >= 80, "Acceptable (80-84)")
        .otherwise("Below Threshold (<80)")
    )
    return (
        tables.affiliations.groupBy(quality.alias("match_quality"))
        .agg(F.count(F.lit(1)).alias("match_count"), F.min("match_score").alias("lowest"))
        .orderBy(down("lowest"))
        .drop("lowest")
    )


@report
def news_source_timeline(
    tables: ReportTables, *, entity_name: str, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    return (
        mentions_in(tables, date_from, date_to, F.col("entity_name") == entity_name)
        .select("entity_name", "source_name", "source_title", "source_published_at", "match_score")
        .orderBy(up("source_published_at"), up("source_name"), up("source_title"))
    )


@report
def source_distribution_by_type(
    tables: ReportTables,
    *,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    return (
        mentions_in(tables, date_from, date_to, is_one_of("entity_type", entity_type))
        .groupBy("entity_type", "source_name")
        .agg(F.count(F.lit(1)).alias("mention_count"))
        .orderBy(up("entity_type"), down("mention_count"), up("source_name"))
    )


@report
def affiliation_network_metrics(tables: ReportTables, *, entity_type: str = ANY) -> DataFrame:
    """Degree and strength of the twenty best connected entities."""
    return (
        keep(tables.affiliations, is_one_of("entity_type", entity_type))
        .groupBy("entity_name")
        .agg(
            F.count_distinct("affiliated_entity_name").alias("connection_count"),
            F.avg("match_score").alias("avg_connection_strength"),
            F.max("match_score").alias("strongest_connection"),
            F.min("match_score").alias("weakest_connection"),
        )
        .where(F.col("connection_count") > 0)
        .orderBy(down("connection_count"), down("avg_connection_strength"), up("entity_name"))
        .limit(20)
    )


@report
def mention_frequency_over_time(
    tables: ReportTables,
    *,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    """Weekly mentions of the five most mentioned entities."""
    dated = mentions_in(tables, date_from, date_to, F.col("source_published_at").isNotNull())
    return (
        among_most_mentioned(dated, tables, entity_type, 5)
        .groupBy(F.date_trunc("week", "source_published_at").alias("week"), "entity_name")
        .agg(F.count(F.lit(1)).alias("mention_count"))
        .orderBy(up("week"), down("mention_count"), up("entity_name"))
    )


@report
def similar_entities(tables: ReportTables, *, entity_type: str = ANY) -> DataFrame:
    """Entities linked through a common affiliation, by mean match score.

    A row (entity, affiliated) is paired with every row of another entity that
    has the same affiliated one. The partners of a row differ only in number,
    so they are counted per affiliated entity and no pair is formed: linear in
    the table instead of quadratic in the rows of an affiliated entity.
    """
    wanted = is_one_of("entity_type", entity_type)
    chosen = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    links = (
        tables.affiliations.where(F.col("entity_name") != F.col("affiliated_entity_name"))
        .groupBy("entity_name", "affiliated_entity_name")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(chosen).alias("own_rows"),
            F.sum(F.when(chosen, F.col("match_score"))).alias("score_sum"),
            F.count(F.when(chosen, F.col("match_score"))).alias("scores"),
        )
    )
    partners = links.groupBy("affiliated_entity_name").agg(F.sum("rows").alias("all_rows"))
    return (
        links.where(F.col("own_rows") > 0)
        .join(partners, "affiliated_entity_name")
        .select(
            F.col("entity_name").alias("entity1"),
            F.col("affiliated_entity_name").alias("entity2"),
            F.try_divide("score_sum", "scores").alias("similarity_score"),
            (F.col("own_rows") * (F.col("all_rows") - F.col("rows"))).alias("common_affiliations"),
        )
        .where(F.col("common_affiliations") > 1)
        .orderBy(down("similarity_score"), down("common_affiliations"), up("entity1"), up("entity2"))
        .limit(20)
    )


@report
def source_influence(
    tables: ReportTables, *, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    """The twenty sources that cover most entities."""
    return (
        mentions_in(tables, date_from, date_to)
        .groupBy("source_name")
        .agg(
            F.count_distinct("entity_name").alias("entities_covered"),
            F.count(F.lit(1)).alias("total_mentions"),
            F.avg("match_score").alias("avg_match_quality"),
        )
        .orderBy(down("entities_covered"), down("total_mentions"), up("source_name"))
        .limit(20)
    )


@report
def affiliation_comparison(
    tables: ReportTables, *, entity_name_1: str, entity_name_2: str
) -> DataFrame:
    """Affiliations of two entities side by side, the shared ones first."""

    def side(name: str, score: str, type_: str) -> DataFrame:
        return tables.affiliations.where(F.col("entity_name") == name).select(
            F.col("affiliated_entity_name").alias("affiliated_entity"),
            F.col("affiliated_entity_type").alias(type_),
            F.col("match_score").alias(score),
        )

    first, second = F.col("entity1_match_score"), F.col("entity2_match_score")
    kind = (
        F.when(first.isNull(), f"Only with {entity_name_2}")
        .when(second.isNull(), f"Only with {entity_name_1}")
        .otherwise("With both entities")
    )
    place = (
        F.when(F.col("affiliation_type") == "With both entities", 1)
        .when(F.col("affiliation_type") == f"Only with {entity_name_1}", 2)
        .otherwise(3)
    )
    strength = F.coalesce(first, F.lit(0.0)) + F.coalesce(second, F.lit(0.0))
    return (
        side(entity_name_1, "entity1_match_score", "type1")
        .join(side(entity_name_2, "entity2_match_score", "type2"), "affiliated_entity", "full_outer")
        .select(
            "affiliated_entity",
            F.coalesce("type1", "type2").alias("affiliated_type"),
            "entity1_match_score",
            "entity2_match_score",
            kind.alias("affiliation_type"),
        )
        .orderBy(place, strength.desc(), up("affiliated_entity"))
    )


@report
def mention_context(
    tables: ReportTables, *, entity_name: str, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    """The fifty best matches of an entity with the texts that matched."""
    return (
        mentions_in(tables, date_from, date_to, F.col("entity_name") == entity_name)
        .select("entity_name", "source_title", "source_description", "match_details", "match_score")
        .orderBy(
            down("match_score"), up("source_title"), up("source_description"), up("match_details")
        )
        .limit(50)
    )


@report
def entity_type_correlation(tables: ReportTables) -> DataFrame:
    """How often an entity of one type is affiliated with another type.

    Counts the pairs of two affiliation rows of the same entity; per entity
    that is rows of a type times rows with an affiliated type.
    """
    named = tables.affiliations.where(F.col("entity_name").isNotNull())
    own = named.groupBy("entity_name", F.col("entity_type").alias("type1")).agg(
        F.count(F.lit(1)).alias("rows1")
    )
    other = named.groupBy("entity_name", F.col("affiliated_entity_type").alias("type2")).agg(
        F.count(F.lit(1)).alias("rows2")
    )
    return (
        own.join(other, "entity_name")
        .where(F.col("type1") != F.col("type2"))
        .groupBy("type1", "type2")
        .agg(F.sum(F.col("rows1") * F.col("rows2")).alias("correlation_strength"))
        .orderBy(down("correlation_strength"), up("type1"), up("type2"))
    )
