"""Reports on the sentiment of the articles that mention an entity."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitylake.functions.measures import down, percent, up
from entitylake.plans.reports.common import (
    ANY,
    Moment,
    ReportTables,
    is_one_of,
    keep,
    label_count,
    mentions_in,
    report,
    sentiment_summary,
    with_sentiment,
)


@report
def sentiment_overview(
    tables: ReportTables, *, entity_name: str, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    mentions = mentions_in(tables, date_from, date_to, F.col("entity_name") == entity_name)
    return sentiment_summary(with_sentiment(tables, mentions), "entity_name", "entity_type")


@report
def sentiment_over_time(
    tables: ReportTables, *, entity_name: str, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    """Weekly sentiment of an entity."""
    mentions = mentions_in(tables, date_from, date_to, F.col("entity_name") == entity_name)
    return sentiment_summary(
        with_sentiment(tables, mentions),
        F.date_trunc("week", "source_published_at").alias("week"),
        "entity_name",
        total="mention_count",
        shares=False,
    ).orderBy(up("week"))


def _top_by_label(
    label: str,
    tables: ReportTables,
    entity_type: str,
    min_mentions: int,
    date_from: Moment,
    date_to: Moment,
) -> DataFrame:
    mentions = mentions_in(tables, date_from, date_to, is_one_of("entity_type", entity_type))
    name = label.lower()
    return (
        with_sentiment(tables, mentions)
        .groupBy("entity_name", "entity_type")
        .agg(
            F.count(F.lit(1)).alias("total_mentions"),
            label_count(label).alias(f"{name}_mentions"),
        )
        .where(F.col("total_mentions") >= min_mentions)
        .withColumn(
            f"{name}_percentage", percent(F.col(f"{name}_mentions"), F.col("total_mentions"))
        )
        .orderBy(
            down(f"{name}_percentage"), down("total_mentions"), up("entity_name"), up("entity_type")
        )
        .limit(20)
    )


@report
def top_entities_by_positive_sentiment(
    tables: ReportTables,
    *,
    min_mentions: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    return _top_by_label("POSITIVE", tables, entity_type, min_mentions, date_from, date_to)


@report
def top_entities_by_negative_sentiment(
    tables: ReportTables,
    *,
    min_mentions: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    return _top_by_label("NEGATIVE", tables, entity_type, min_mentions, date_from, date_to)


@report
def source_sentiment(
    tables: ReportTables, *, min_articles: int, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    """Sentiment per news source."""
    return (
        sentiment_summary(
            with_sentiment(tables, mentions_in(tables, date_from, date_to)),
            "source_name",
            noun="articles",
        )
        .where(F.col("total_articles") >= min_articles)
        .orderBy(down("total_articles"), up("source_name"))
    )


@report
def sentiment_comparison(
    tables: ReportTables,
    *,
    entity_name_1: str,
    entity_name_2: str,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    """Sentiment of two entities, one row each; one pass over the tables for both."""
    name = F.col("entity_name")
    mentions = mentions_in(tables, date_from, date_to, name.isin(entity_name_1, entity_name_2))
    groups = F.array(
        *[
            F.when(name == wanted, F.lit(group))
            for group, wanted in (("Entity 1", entity_name_1), ("Entity 2", entity_name_2))
        ]
    )
    summary = sentiment_summary(with_sentiment(tables, mentions), "entity_name")
    return (
        # An entity compared with itself is in both groups.
        summary.withColumn("entity_group", F.explode(F.array_compact(groups)))
        .select("entity_group", *summary.columns)
        .orderBy("entity_group")
    )


@report
def sentiment_by_source(
    tables: ReportTables,
    *,
    entity_name: str,
    min_mentions: int,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    """Sentiment of an entity per news source."""
    mentions = mentions_in(tables, date_from, date_to, F.col("entity_name") == entity_name)
    return (
        sentiment_summary(with_sentiment(tables, mentions), "source_name")
        .where(F.col("total_mentions") >= min_mentions)
        .orderBy(down("total_mentions"), up("source_name"))
    )


@report
def entity_type_sentiment(
    tables: ReportTables, *, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    return sentiment_summary(
        with_sentiment(tables, mentions_in(tables, date_from, date_to)),
        "entity_type",
        extra=(F.count_distinct("entity_name").alias("unique_entities"),),
    ).orderBy(down("total_mentions"), up("entity_type"))


@report
def sentiment_trend(
    tables: ReportTables, *, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    """Monthly sentiment over all entities; articles without a date form a group."""
    return sentiment_summary(
        with_sentiment(tables, mentions_in(tables, date_from, date_to)),
        F.date_trunc("month", "source_published_at").alias("month"),
    ).orderBy(up("month"))


@report
def sentiment_articles(
    tables: ReportTables,
    *,
    entity_name: str,
    sentiment: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    """Articles of an entity, newest first, if wanted of one label only."""
    mentions = mentions_in(tables, date_from, date_to, F.col("entity_name") == entity_name)
    return (
        keep(with_sentiment(tables, mentions), is_one_of("sentiment_label", sentiment))
        .select(
            "entity_name",
            "source_title",
            "source_description",
            "source_url",
            "source_published_at",
            "sentiment_score",
            "sentiment_label",
            "match_score",
        )
        .orderBy(down("source_published_at"), down("sentiment_score"), up("source_url"))
    )
