"""What the reports share: their input tables, optional filters and summaries.

Reports on pairs take ``prune``: entities that cannot be in a pair of the result are left out before pairs
are formed. The rows are the same; it pays where few entities hold most mentions and costs time where all are alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitylake.functions.measures import LABELS, percent

ANY = "All"  # value of a type or sentiment filter that filters nothing

Moment = str | date | datetime | None


@dataclass
class ReportTables:
    """The three wide tables all reports read."""

    affiliations: DataFrame
    mentions: DataFrame
    sentiment: DataFrame


REPORTS: dict[str, Callable[..., DataFrame]] = {}


def report(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Enter a report in ``REPORTS`` under its function name."""
    REPORTS[build.__name__] = build
    return build


def keep(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Filter by the conditions that are set; unset ones leave no trace in the plan."""
    for condition in conditions:
        if condition is not None:
            df = df.where(condition)
    return df


def is_one_of(column: str, wanted: str | None) -> Column | None:
    return None if wanted in (None, ANY) else F.col(column) == wanted


def _literal(moment: Moment) -> Column:
    if isinstance(moment, str):
        moment = date.fromisoformat(moment) if len(moment) == 10 else datetime.fromisoformat(moment)
    return F.lit(moment)


def since(moment: Moment, column: str = "source_published_at") -> Column | None:
    return None if moment is None else F.col(column) >= _literal(moment)


def until(moment: Moment, column: str = "source_published_at") -> Column | None:
    return None if moment is None else F.col(column) <= _literal(moment)


def mentions_in(
    tables: ReportTables, date_from: Moment, date_to: Moment, *conditions: Column | None
) -> DataFrame:
    return keep(tables.mentions, since(date_from), until(date_to), *conditions)


def with_sentiment(tables: ReportTables, mentions: DataFrame) -> DataFrame:
    """Mentions with the sentiment of their article.

    An inner equi-join: an article that holds a large part of all mentions is
    split at run time by the adaptive skew join, as its sentiment is a few rows.
    """
    scores = tables.sentiment.select(
        F.col("uri").alias("source_uri"),
        F.col("sentiment_score").cast("double").alias("sentiment_score"),
        "sentiment_label",
    )
    return mentions.join(scores, "source_uri")


def label_count(label: str) -> Column:
    return F.count_if(F.col("sentiment_label") == label)


def sentiment_summary(
    df: DataFrame,
    *keys: str | Column,
    noun: str = "mentions",
    total: str | None = None,
    shares: bool = True,
    extra: tuple[Column, ...] = (),
) -> DataFrame:
    """Rows, mean score and count per label for each group, with percentages if asked."""
    total = total or f"total_{noun}"
    summary = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(total),
        *extra,
        F.avg("sentiment_score").alias("avg_sentiment_score"),
        *[label_count(label).alias(f"{label.lower()}_{noun}") for label in LABELS],
    )
    return with_shares(summary, noun, total) if shares else summary


def with_shares(df: DataFrame, noun: str, total: str) -> DataFrame:
    names = [label.lower() for label in LABELS]
    return df.select(
        "*",
        *[percent(F.col(f"{n}_{noun}"), F.col(total)).alias(f"{n}_percentage") for n in names],
    )


def most_mentioned(tables: ReportTables, entity_type: str | None, n: int) -> DataFrame:
    """The ``n`` entities with most mention rows; ties by name."""
    return (
        keep(tables.mentions, is_one_of("entity_type", entity_type))
        .groupBy("entity_name")
        .agg(F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("rows"), "entity_name")
        .limit(n)
        .select("entity_name")
    )


def among_most_mentioned(
    df: DataFrame, tables: ReportTables, entity_type: str | None, n: int
) -> DataFrame:
    """Rows of the most mentioned entities, a list of ``n`` names that Spark joins as it sees fit."""
    return df.join(most_mentioned(tables, entity_type, n), "entity_name", "left_semi")
