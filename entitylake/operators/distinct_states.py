"""Distinct counts that can be added up: bit sets of integer ids for each day, rolled up exactly.

A day's state can be stored and never counted again: states of months, of years or of other groups are
the union of bit sets. A set is a word for 64 neighbouring ids, so a state is never larger than a few words per id, and
its size is fixed, so unions are made in place and spill by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Ids of a set as a power of two: the bits of a word.
_BITS = 6


def day_states(df: DataFrame, day: str, number: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., day, bucket, ids): the ids seen on each day; rows without an id count for nothing."""
    id_ = F.col(number).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), id_.bitwiseAND((1 << _BITS) - 1).cast("int"))
    return (
        df.where(id_.isNotNull())
        .groupBy(*groups, F.col(day).cast("date").alias("day"), F.shiftright(id_, _BITS).alias("bucket"))
        .agg(F.bit_or(bit).alias("ids"))
    )


def distinct_counts(states: DataFrame, grain: str, groups: Sequence[str] = ()) -> DataFrame:
    """(groups..., period, different) for each day, week, month, quarter or year, from states of days or unions of such."""
    period = F.date_trunc(grain, "day").cast("date").alias("period")
    merged = states.groupBy(*groups, period, "bucket").agg(F.bit_or("ids").alias("ids"))
    return merged.groupBy(*groups, "period").agg(F.sum(F.bit_count("ids")).alias("different"))
