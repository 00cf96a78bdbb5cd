"""How well extraction counts agree with labelled counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("PERSON", "ORG", "LOC")
# Labelled count column of each type.
TRUTH = {"PERSON": "persons", "ORG": "org", "LOC": "loc"}


def predicted_counts(mentions: DataFrame, key: str = "uid") -> DataFrame:
    """Mentions per text and type: one row per text, one column per type, zeros filled in."""
    return (
        mentions.groupBy(key)
        .pivot("entity_type", list(TYPES))
        .agg(F.count("entity_text"))
        .fillna(0, list(TYPES))
    )


def _whole(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("double")


def count_metrics(actual: Column, predicted: Column) -> dict[str, Column]:
    """Count-based scores of one type in one text.

    ``precision`` is predicted / max(predicted, 1): 1 wherever anything was
    predicted. ``precision_strict`` divides the agreeing count instead.
    """
    a, p = _whole(actual), _whole(predicted)
    some, zero = a > 0, F.lit(0.0)
    precision = F.when(some, p / F.greatest(p, F.lit(1.0))).otherwise(zero)
    recall = F.when(some, F.least(p, a) / F.greatest(a, F.lit(1.0))).otherwise(zero)
    f1 = F.when(
        precision + recall > 0,
        2 * precision * recall / F.greatest(precision + recall, F.lit(1.0)),
    ).otherwise(zero)
    strict = F.when(some, F.least(p, a) / F.greatest(p, F.lit(1.0))).otherwise(zero)
    return {"precision": precision, "recall": recall, "f1": f1, "precision_strict": strict}


def count_accuracy(actual: Column, predicted: Column) -> Column:
    """1 less the relative miscount, never below 0; without labels, 1 if nothing was predicted."""
    a, p = _whole(actual), _whole(predicted)
    return F.when(
        a > 0, F.greatest(F.lit(0.0), 1 - F.abs(a - p) / F.greatest(a, F.lit(1.0)))
    ).otherwise(F.when(p == 0, 1.0).otherwise(0.0))


def _with_predictions(truth: DataFrame, mentions: DataFrame, key: str, how: str) -> DataFrame:
    """Labelled texts with the columns ``predicted_{TYPE}``; column names ignore case."""
    counts = predicted_counts(mentions, key)
    return truth.join(counts.select(key, *[F.col(k).alias(f"predicted_{k}") for k in TYPES]), key, how)


def extraction_metrics(truth: DataFrame, mentions: DataFrame, key: str = "uid") -> DataFrame:
    """One row per labelled text with ``{TYPE}_{metric}`` columns.

    Texts without any mention are left out, so they do not lower the averages.

    ``truth`` has the key and the columns ``persons``, ``org``, ``loc``;
    ``mentions`` the key, ``entity_text`` and ``entity_type``.
    """
    columns = [
        value.alias(f"{kind}_{metric}")
        for kind in TYPES
        for metric, value in count_metrics(F.col(TRUTH[kind]), F.col(f"predicted_{kind}")).items()
    ]
    return _with_predictions(truth, mentions, key, "inner").select(key, *columns)


def text_accuracy(truth: DataFrame, mentions: DataFrame, key: str = "uid") -> DataFrame:
    """One row per labelled text with ``{TYPE}_accuracy``; texts without mentions count too."""
    return _with_predictions(truth, mentions, key, "left").select(
        key,
        *[
            count_accuracy(F.col(TRUTH[k]), F.col(f"predicted_{k}")).alias(f"{k}_accuracy")
            for k in TYPES
        ],
    )


def metric_averages(metrics: DataFrame) -> DataFrame:
    """Averages per type and over the three types: one row per type and one ``OVERALL``."""
    names = ("precision", "recall", "f1", "precision_strict")
    means = metrics.agg(*[F.avg(f"{k}_{m}").alias(f"{k}_{m}") for k in TYPES for m in names])
    rows = [
        F.struct(F.lit(k).alias("entity_type"), *[F.col(f"{k}_{m}").alias(m) for m in names]) for k in TYPES
    ]
    overall = F.struct(
        F.lit("OVERALL").alias("entity_type"),
        *[(sum((F.col(f"{k}_{m}") for k in TYPES), F.lit(0.0)) / len(TYPES)).alias(m) for m in names],
    )
    return means.select(F.explode(F.array(*rows, overall)).alias("row")).select("row.*")


def average_counts(truth: DataFrame, mentions: DataFrame, key: str = "uid") -> DataFrame:
    """Mean labelled and mean predicted count per type, each over its own texts."""
    labelled = truth.agg(*[F.avg(_whole(F.col(TRUTH[k]))).alias(f"labelled_{k}") for k in TYPES])
    predicted = predicted_counts(mentions, key).agg(*[F.avg(k).alias(f"predicted_{k}") for k in TYPES])
    rows = [
        F.struct(
            F.lit(k).alias("entity_type"),
            F.col(f"labelled_{k}").alias("labelled"),
            F.col(f"predicted_{k}").alias("predicted"),
        )
        for k in TYPES
    ]
    # One row each side.
    both = labelled.withColumn("one", F.lit(1)).join(predicted.withColumn("one", F.lit(1)), "one")
    return both.select(F.explode(F.array(*rows)).alias("row")).select("row.*")
