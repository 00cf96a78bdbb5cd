"""Aggregate and scalar expressions the reports have in common."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS = ("POSITIVE", "NEUTRAL", "NEGATIVE")


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, rounded to two decimals; null if the whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole) * 100, 2)


def percent_change(now: Column, before: Column) -> Column:
    """Relative change in percent; null if there was nothing before."""
    return F.when(
        F.coalesce(before, F.lit(0)) != 0,
        F.round(F.try_divide((now - before).cast("double"), before) * 100, 2),
    )


def pearson(x: Column, y: Column) -> Column:
    """Correlation that is null, instead of an error, where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def month_name(moment: Column) -> Column:
    """English month name, blank-padded to nine characters."""
    return F.rpad(F.date_format(moment, "MMMM"), 9, " ")


def dominant_label(positive: Column, neutral: Column, negative: Column) -> Column:
    """The label with strictly most mentions, else neutral."""
    return (
        F.when((positive > neutral) & (positive > negative), "Positive")
        .when((negative > neutral) & (negative > positive), "Negative")
        .otherwise("Neutral")
    )


def up(name: str) -> Column:
    """Ascending, nulls at the end."""
    return F.col(name).asc_nulls_last()


def down(name: str) -> Column:
    """Descending, nulls at the start."""
    return F.col(name).desc_nulls_first()
