"""Surrogate keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def composite_key(*columns: str | Column) -> Column:
    """SHA-256 (hex) of the columns' text, joined without a separator.

    A missing value counts as the text ``None``, so keys stay equal to the ones
    computed outside Spark for the same strings.
    """
    if not columns:
        raise ValueError("a key needs at least one column")
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    text = F.concat(*[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.sha2(text, 256)
