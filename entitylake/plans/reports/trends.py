"""Reports on how mentions and relationships change over time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.functions.measures import down, month_name, percent_change, up
from entitylake.operators.pairs import fold, pairs_under_key
from entitylake.operators.top_pairs import strong_sides
from entitylake.plans.reports.common import (
    ANY,
    Moment,
    ReportTables,
    among_most_mentioned,
    is_one_of,
    keep,
    mentions_in,
    report,
    since,
    until,
)

PUBLISHED = "source_published_at"


def _dated(
    tables: ReportTables, date_from: Moment, date_to: Moment, *conditions: Column | None
) -> DataFrame:
    return mentions_in(tables, date_from, date_to, F.col(PUBLISHED).isNotNull(), *conditions)


def _month() -> Column:
    return F.date_trunc("month", PUBLISHED).alias("month")


@report
def mention_trends(
    tables: ReportTables,
    *,
    top_n_entities: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    """Daily mentions of the top entities, averaged over the last seven days with mentions."""
    last_seven = Window.partitionBy("entity_name").orderBy("day").rowsBetween(-6, 0)
    return (
        among_most_mentioned(_dated(tables, date_from, date_to), tables, entity_type, top_n_entities)
        .groupBy(F.date_trunc("day", PUBLISHED).alias("day"), "entity_name")
        .agg(F.count(F.lit(1)).alias("daily_mentions"))
        .withColumn("seven_day_moving_avg", F.avg("daily_mentions").over(last_seven))
        .orderBy(up("day"), up("entity_name"))
    )


@report
def type_popularity_over_time(
    tables: ReportTables, *, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    return (
        _dated(tables, date_from, date_to)
        .groupBy(_month(), "entity_type")
        .agg(
            F.count(F.lit(1)).alias("mention_count"),
            F.count_distinct("entity_name").alias("unique_entities"),
        )
        .orderBy(up("month"), down("mention_count"), up("entity_type"))
    )


@report
def match_score_trends(
    tables: ReportTables, *, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    """Mean, exact median, lowest and highest match score per month.

    Rows are first counted per month and score. A score is a ratio of two text
    lengths, so a month has few different ones however many rows it has, and
    the median comes from their running count.
    """
    counted = (
        _dated(tables, date_from, date_to)
        .groupBy(_month(), "match_score")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("match_score").alias("scores"))
    )
    by_month = Window.partitionBy("month")
    running = by_month.orderBy("match_score").rowsBetween(Window.unboundedPreceding, 0)
    score = F.col("match_score")
    reached, total = F.col("reached"), F.col("total")
    lower = F.min(F.when((F.col("scores") > 0) & (reached >= F.floor((total + 1) / 2)), score))
    upper = F.min(F.when((F.col("scores") > 0) & (reached >= F.floor(total / 2) + 1), score))
    return (
        counted.withColumn("reached", F.sum("scores").over(running))
        .withColumn("total", F.sum("scores").over(by_month))
        .groupBy("month")
        .agg(
            F.try_divide(F.sum(score * F.col("scores")), F.sum("scores")).alias("avg_match_score"),
            ((lower + upper) / 2).alias("median_match_score"),
            F.min("match_score").alias("min_match_score"),
            F.max("match_score").alias("max_match_score"),
        )
        .orderBy(up("month"))
    )


@report
def source_activity_trends(
    tables: ReportTables, *, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    return (
        _dated(tables, date_from, date_to)
        .groupBy(_month(), "source_name")
        .agg(
            F.count(F.lit(1)).alias("article_count"),
            F.count_distinct("entity_name").alias("entity_coverage"),
        )
        .orderBy(up("month"), down("article_count"), up("source_name"))
    )


@report
def relationship_growth(
    tables: ReportTables, *, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    """Entities by the month of their first mention, with a running total.

    The running total has one row per month, so its single window is small.
    """
    first = (
        tables.mentions.where(F.col(PUBLISHED).isNotNull())
        .groupBy("entity_name")
        .agg(F.min(PUBLISHED).alias("first_mention_date"))
    )
    return (
        keep(first, since(date_from, "first_mention_date"), until(date_to, "first_mention_date"))
        .groupBy(F.date_trunc("month", "first_mention_date").alias("month"))
        .agg(F.count(F.lit(1)).alias("new_entities"))
        .withColumn("cumulative_entities", F.sum("new_entities").over(Window.orderBy("month")))
        .orderBy(up("month"))
    )


@report
def pair_mention_trends(
    tables: ReportTables,
    *,
    entity_name: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
    prune: bool = False,
) -> DataFrame:
    """The ten most frequent pairs of each month (ties kept), by number of common articles."""
    items = fold(_dated(tables, date_from, date_to), "source_uri", "entity_name", _month())
    wanted = None
    if entity_name != ANY:
        wanted = (F.col("one.item") == entity_name) | (F.col("two.item") == entity_name)
        # Only articles that mention the entity can contribute a pair with it.
        articles = items.where(F.col("item") == entity_name).select("key", "month").distinct()
        items = items.join(articles, ["key", "month"], "left_semi")
    others = items
    if prune:
        items, others = strong_sides(items, best=10, condition=wanted, within=("month",))
    place = Window.partitionBy("month").orderBy(F.desc("co_mention_count"))
    return (
        pairs_under_key(items, others, wanted, also_equal=("month",), weighted=False)
        .groupBy(
            F.col("one.month").alias("month"),
            F.col("one.item").alias("entity1"),
            F.col("two.item").alias("entity2"),
        )
        # One row per article, month and pair.
        .agg(F.count(F.lit(1)).alias("co_mention_count"))
        .withColumn("rank", F.rank().over(place))
        .where(F.col("rank") <= 10)
        .withColumn("rank", F.col("rank").cast("bigint"))
        .orderBy(up("month"), down("co_mention_count"), up("entity1"), up("entity2"))
    )


@report
def seasonal_patterns(
    tables: ReportTables, *, entity_name: str, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    """Mentions of an entity per calendar month, all years together."""
    return (
        _dated(tables, date_from, date_to, F.col("entity_name") == entity_name)
        .groupBy(
            F.month(PUBLISHED).alias("month_number"),
            month_name(F.col(PUBLISHED)).alias("month_name"),
            "entity_name",
        )
        .agg(F.count(F.lit(1)).alias("mention_count"), F.avg("match_score").alias("avg_match_score"))
        .orderBy(up("month_number"))
    )


@report
def mention_velocity(
    tables: ReportTables,
    *,
    top_n_entities: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    """Change of the top entities' mentions against their last month with mentions."""
    by_month = Window.partitionBy("entity_name").orderBy("month")
    now, before = F.col("mention_count"), F.col("previous_month_count")
    return (
        # Filtered before counting: an entity's history does not depend on the others.
        among_most_mentioned(_dated(tables, date_from, date_to), tables, entity_type, top_n_entities)
        .groupBy(_month(), "entity_name")
        .agg(F.count(F.lit(1)).alias("mention_count"))
        .withColumn("previous_month_count", F.lag("mention_count").over(by_month))
        .select(
            "month",
            "entity_name",
            "mention_count",
            "previous_month_count",
            (now - F.coalesce(before, F.lit(0))).alias("absolute_change"),
            percent_change(now, before).alias("percentage_change"),
        )
        .orderBy(up("month"), down("mention_count"), up("entity_name"))
    )


@report
def affiliation_strength_evolution(
    tables: ReportTables, *, entity_name: str, date_from: Moment = None, date_to: Moment = None
) -> DataFrame:
    """An entity's five strongest affiliations in each quarter it was mentioned in.

    Every affiliation row meets every mention row of the entity, so both sides
    are aggregated first and only the aggregates are joined. The mean score
    does not depend on the quarter, and neither does the rank.
    """
    strongest = Window.partitionBy("entity_name").orderBy(down("avg_match_score"))
    affiliations = (
        tables.affiliations.where(F.col("entity_name") == entity_name)
        .groupBy("entity_name", "affiliated_entity_name")
        .agg(F.avg("match_score").alias("avg_match_score"), F.count(F.lit(1)).alias("links"))
        .withColumn("rank", F.rank().over(strongest))
        .where(F.col("rank") <= 5)
    )
    quarters = (
        _dated(tables, date_from, date_to, F.col("entity_name") == entity_name)
        .groupBy("entity_name", F.date_trunc("quarter", PUBLISHED).alias("quarter"))
        .agg(F.count(F.lit(1)).alias("mentions"))
    )
    return (
        quarters.join(affiliations, "entity_name")
        .select(
            "quarter",
            "entity_name",
            "affiliated_entity_name",
            "avg_match_score",
            (F.col("links") * F.col("mentions")).alias("co_mention_count"),
            F.col("rank").cast("bigint").alias("rank"),
        )
        .orderBy(up("quarter"), down("avg_match_score"), up("affiliated_entity_name"))
    )


@report
def emerging_relationships(
    tables: ReportTables,
    *,
    recent_period_days: int,
    historical_period_days: int,
    entity_type: str = ANY,
    as_of: str | date | None = None,
) -> DataFrame:
    """The twenty affiliations whose mentions grew most against the period before.

    Both periods are counted per entity in one pass and multiplied with the
    number of affiliation rows, instead of joining rows with rows.
    """
    if as_of is None:
        today = F.current_date()
    else:
        today = F.lit(date.fromisoformat(as_of) if isinstance(as_of, str) else as_of)
    published = F.col(PUBLISHED)
    recent_start = F.date_sub(today, recent_period_days)
    past_start = F.date_sub(today, historical_period_days)
    counts = (
        tables.mentions.where((published >= recent_start) | (published >= past_start))
        .groupBy("entity_name")
        .agg(
            F.count_if(published >= recent_start).alias("recent"),
            F.count_if((published < recent_start) & (published >= past_start)).alias("past"),
        )
        .where(F.col("recent") > 0)
    )
    links = tables.affiliations.groupBy("entity_name", "affiliated_entity_name").agg(
        F.count(F.lit(1)).alias("links")
    )
    wanted = is_one_of("entity_type", entity_type)
    if wanted is not None:
        named = tables.affiliations.where(wanted).select("entity_name").distinct()
        counts = counts.join(named, "entity_name", "left_semi")
    recent, past = F.col("recent_co_mentions"), F.col("historical_co_mentions")
    growth = F.when(past == 0, recent.cast("double")).otherwise(F.col("percentage_growth"))
    return (
        links.join(counts, "entity_name")
        .select(
            "entity_name",
            "affiliated_entity_name",
            (F.col("links") * F.col("recent")).alias("recent_co_mentions"),
            (F.col("links") * F.col("past")).alias("historical_co_mentions"),
        )
        .withColumn("absolute_growth", recent - past)
        .withColumn("percentage_growth", percent_change(recent, past))
        .orderBy(growth.desc_nulls_first(), up("entity_name"), up("affiliated_entity_name"))
        .limit(20)
    )
