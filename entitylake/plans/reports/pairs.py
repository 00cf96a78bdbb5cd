"""Reports on pairs of entities and on sentiment patterns across sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitylake.functions.measures import LABELS, dominant_label, down, pearson, up
from entitylake.operators.correlated_pairs import is_dense, most_correlated, sizes_of
from entitylake.operators.pairs import fold, in_keys, pair_weight, pairs_under_key
from entitylake.operators.top_pairs import strong_sides
from entitylake.plans.reports.common import (
    ANY,
    Moment,
    ReportTables,
    is_one_of,
    label_count,
    mentions_in,
    report,
    with_sentiment,
    with_shares,
)


def _scored_pairs(
    tables: ReportTables,
    entity_type: str,
    date_from: Moment,
    date_to: Moment,
    *extra: str | Column,
    typed: bool = False,
    prune: bool = False,
    least: int = 1,
    best: int | None = None,
) -> DataFrame:
    """Pairs of entities per article, with the article's sentiment on the left side.

    An article's sentiment rows are folded into sums first, then a pair stands
    for weight x sums. The period bounds the left mention only. Types are kept
    where the result or the type filter needs them. Articles that cannot give a
    pair, as they have no left mention or none of the wanted type, are left out
    before the right side is folded; with ``prune``, entities that cannot reach ``least`` common
    mentions (of a pair, and each value of ``extra``) or the ``best`` pairs, after it.
    """
    typed = typed or entity_type != ANY
    types = ("entity_type",) if typed else ()
    scores = tables.sentiment.groupBy(F.col("uri").alias("key")).agg(
        F.count(F.lit(1)).alias("scored_rows"),
        F.sum(F.col("sentiment_score").cast("double")).alias("score_sum"),
        F.count("sentiment_score").alias("scores"),
        *[label_count(label).alias(label.lower()) for label in LABELS],
    )
    one, two = mentions_in(tables, date_from, date_to), tables.mentions
    if entity_type != ANY:
        typed_articles = two.where(F.col("entity_type") == entity_type).select("source_uri").distinct()
        one = one.join(typed_articles, "source_uri", "left_semi")
        two = two.join(typed_articles, "source_uri", "left_semi")
    left = fold(one, "source_uri", "entity_name", *types, *extra)
    if date_from is not None or date_to is not None:
        two = two.join(left.select(F.col("key").alias("source_uri")).distinct(), "source_uri", "left_semi")
    right = fold(two, "source_uri", "entity_name", *types)
    condition = None
    if entity_type != ANY:
        condition = (F.col("one.entity_type") == entity_type) | (
            F.col("two.entity_type") == entity_type
        )
    scored = left.join(scores, "key")
    if prune:
        load = F.col("weight") * F.col("scored_rows")
        names = [c for c in left.columns if c not in ("key", "item", "weight", "entity_type")]
        scored, right = strong_sides(scored, right, load, F.col("weight"), least, best, condition, left_within=names)
        left = scored
    return pairs_under_key(scored, right, condition, loads=left)


def _pair_totals(pairs: DataFrame, *keys: Column) -> DataFrame:
    weight = pair_weight()

    def total(column: str) -> Column:
        return F.sum(weight * F.col(f"one.{column}"))

    return pairs.groupBy(
        F.col("one.item").alias("entity1"), F.col("two.item").alias("entity2"), *keys
    ).agg(
        total("scored_rows").alias("co_mentions"),
        F.try_divide(total("score_sum"), total("scores")).alias("avg_sentiment_score"),
        *[total(label.lower()).alias(f"{label.lower()}_mentions") for label in LABELS],
    )


def _dominant() -> Column:
    return dominant_label(*[F.col(f"{label.lower()}_mentions") for label in LABELS])


@report
def pair_sentiment(
    tables: ReportTables,
    *,
    min_co_mentions: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
    prune: bool = False,
) -> DataFrame:
    """Sentiment of the fifty most frequent pairs of entities."""
    top = (
        _pair_totals(_scored_pairs(tables, entity_type, date_from, date_to, prune=prune, least=min_co_mentions, best=50))
        .where(F.col("co_mentions") >= min_co_mentions)
        .orderBy(down("co_mentions"), down("avg_sentiment_score"), up("entity1"), up("entity2"))
        .limit(50)
    )
    return with_shares(top, "mentions", "co_mentions")


@report
def relationships_by_sentiment(
    tables: ReportTables,
    *,
    min_co_mentions: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
    prune: bool = False,
) -> DataFrame:
    """Pairs by the label most of their common mentions have."""
    totals = (
        _pair_totals(_scored_pairs(tables, entity_type, date_from, date_to, prune=prune, least=min_co_mentions))
        .where(F.col("co_mentions") >= min_co_mentions)
        .withColumn("dominant_sentiment", _dominant())
        .drop("avg_sentiment_score")
    )
    place = (
        F.when(F.col("dominant_sentiment") == "Positive", 1)
        .when(F.col("dominant_sentiment") == "Neutral", 2)
        .otherwise(3)
    )
    return with_shares(totals, "mentions", "co_mentions").orderBy(
        place, down("co_mentions"), up("entity1"), up("entity2")
    )


@report
def sentiment_network(
    tables: ReportTables,
    *,
    min_co_mentions: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
    prune: bool = False,
) -> DataFrame:
    """Edges between entities with strength, mean score and dominant label."""
    pairs = _scored_pairs(tables, entity_type, date_from, date_to, typed=True, prune=prune, least=min_co_mentions)
    types = (
        F.col("one.entity_type").alias("source_type"),
        F.col("two.entity_type").alias("target_type"),
    )
    return (
        _pair_totals(pairs, *types)
        .where(F.col("co_mentions") >= min_co_mentions)
        .select(
            F.col("entity1").alias("source"),
            "source_type",
            F.col("entity2").alias("target"),
            "target_type",
            "co_mentions",
            "avg_sentiment_score",
            _dominant().alias("dominant_sentiment"),
        )
        .orderBy(down("co_mentions"), down("avg_sentiment_score"), up("source"), up("target"))
    )


def _mean_per_source(
    tables: ReportTables, entity_type: str, date_from: Moment, date_to: Moment
) -> DataFrame:
    mentions = mentions_in(tables, date_from, date_to, is_one_of("entity_type", entity_type))
    return (
        with_sentiment(tables, mentions)
        .groupBy("entity_name", "source_name")
        .agg(F.avg("sentiment_score").alias("mean_score"))
    )


@report
def sentiment_correlation(
    tables: ReportTables,
    *,
    min_common_sources: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    """Pairs of entities whose mean score varies alike across sources; the fifty clearest."""
    means = _mean_per_source(tables, entity_type, date_from, date_to)
    # An entity of fewer sources cannot share enough of them.
    items = in_keys(fold(means, "source_name", "entity_name", "mean_score"), min_common_sources)
    r = F.col("sentiment_correlation")
    strength = (
        F.when(r >= 0.7, "Strong Positive")
        .when(r >= 0.3, "Moderate Positive")
        .when(r >= -0.3, "Weak/No Correlation")
        .when(r >= -0.7, "Moderate Negative")
        .otherwise("Strong Negative")
    )
    values = items.select("item", "key", F.col("mean_score").alias("value"))
    sizes = sizes_of(values)
    if is_dense(sizes):
        pairs = most_correlated(values, min_common_sources, 50, sizes).select(
            F.col("one").alias("entity1"), F.col("two").alias("entity2"), F.col("common").alias("common_sources"),
            F.col("r").alias("sentiment_correlation"),
        )
    else:
        pairs = (
            pairs_under_key(items, items, weighted=False)
            .groupBy(F.col("one.item").alias("entity1"), F.col("two.item").alias("entity2"))
            .agg(
                F.count(F.lit(1)).alias("common_sources"),
                pearson(F.col("one.mean_score"), F.col("two.mean_score")).alias("sentiment_correlation"),
            )
        )
    return (
        pairs.where((F.col("common_sources") >= min_common_sources) & r.isNotNull())
        .withColumn("correlation_strength", strength)
        .orderBy(F.abs(r).desc(), down("common_sources"), up("entity1"), up("entity2"))
        .limit(50)
    )


@report
def sentiment_contrast(
    tables: ReportTables,
    *,
    min_sources: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    """The twenty entities whose mean score differs most between sources."""
    return (
        _mean_per_source(tables, entity_type, date_from, date_to)
        .groupBy("entity_name")
        .agg(
            # One row per source, so counting names counts different ones.
            F.count("source_name").alias("source_count"),
            F.avg("mean_score").alias("overall_avg_sentiment"),
            F.stddev_samp("mean_score").alias("sentiment_stddev"),
            F.min("mean_score").alias("min_sentiment"),
            F.max("mean_score").alias("max_sentiment"),
            (F.max("mean_score") - F.min("mean_score")).alias("sentiment_range"),
        )
        .where(F.col("source_count") >= min_sources)
        .orderBy(down("sentiment_range"), down("sentiment_stddev"), up("entity_name"))
        .limit(20)
    )


@report
def pair_sentiment_change(
    tables: ReportTables,
    *,
    min_monthly_mentions: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
    prune: bool = False,
) -> DataFrame:
    """The hundred largest changes of a pair's monthly score against its month before."""
    month = F.date_trunc("month", "source_published_at").alias("month")
    by_month = Window.partitionBy("entity1", "entity2").orderBy(F.col("month").asc_nulls_last())
    now, before = F.col("avg_sentiment_score"), F.col("prev_sentiment_score")
    return (
        _pair_totals(
            _scored_pairs(tables, entity_type, date_from, date_to, month, prune=prune, least=min_monthly_mentions),
            F.col("one.month").alias("month"),
        )
        .where(F.col("co_mentions") >= min_monthly_mentions)
        .withColumn("prev_sentiment_score", F.lag("avg_sentiment_score").over(by_month))
        .where(before.isNotNull())
        .select(
            "entity1",
            "entity2",
            "month",
            "avg_sentiment_score",
            "prev_sentiment_score",
            (now - before).alias("sentiment_change"),
            "co_mentions",
        )
        .orderBy(
            F.abs("sentiment_change").desc_nulls_first(),
            down("month"),
            down("co_mentions"),
            up("entity1"),
            up("entity2"),
        )
        .limit(100)
    )


@report
def sentiment_clusters(
    tables: ReportTables,
    *,
    min_mentions: int,
    entity_type: str = ANY,
    date_from: Moment = None,
    date_to: Moment = None,
) -> DataFrame:
    """Entities grouped by mean score and share of labels.

    The two negative clusters ask for a negative mean score; they stay empty
    while scores are confidences between 0 and 1.
    """
    mentions = mentions_in(tables, date_from, date_to, is_one_of("entity_type", entity_type))
    score = F.col("avg_sentiment_score")
    positive, neutral, negative = [F.col(f"{label.lower()}_ratio") for label in LABELS]
    cluster = (
        F.when((score >= 0.5) & (positive >= 0.6), "Highly Positive")
        .when((score >= 0.2) & (positive >= 0.4), "Moderately Positive")
        .when((score <= -0.5) & (negative >= 0.6), "Highly Negative")
        .when((score <= -0.2) & (negative >= 0.4), "Moderately Negative")
        .when(neutral >= 0.6, "Predominantly Neutral")
        .otherwise("Mixed Sentiment")
    )
    # Fixed order of the clusters in the report.
    order = (
        "Highly Positive",
        "Moderately Positive",
        "Predominantly Neutral",
        "Mixed Sentiment",
        "Moderately Negative",
        "Highly Negative",
    )
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("sentiment_cluster"))
    rows = F.count(F.lit(1))
    return (
        with_sentiment(tables, mentions)
        .groupBy("entity_name", "entity_type")
        .agg(
            rows.alias("mention_count"),
            F.avg("sentiment_score").alias("avg_sentiment_score"),
            *[
                (label_count(label).cast("double") / rows).alias(f"{label.lower()}_ratio")
                for label in LABELS
            ],
        )
        .where(F.col("mention_count") >= min_mentions)
        .withColumn("sentiment_cluster", cluster)
        .orderBy(place, down("mention_count"), up("entity_name"), up("entity_type"))
    )
