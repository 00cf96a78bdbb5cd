"""Planning how a database table is read in parts of about equal rows.

Bounds come from the table itself: its least and greatest value, and rows counted in
bins of equal width between them. Each part is a predicate on the column, so a reader
that takes predicates reads each in a task of its own. Every row, with a null or not,
meets exactly one predicate, also one that was added outside the bounds since.
"""

from __future__ import annotations

from collections.abc import Sequence


def range_query(table: str, column: str) -> str:
    """The least and greatest value of an integer column."""
    return f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}"


def _width(low: int, high: int, bins: int) -> int:
    return -(-(high - low + 1) // bins)


def counts_query(table: str, column: str, low: int, high: int, bins: int) -> str:
    """Rows of each bin that has any: ``bin``, ``n``."""
    bin_of = f"CAST(FLOOR(({column} - ({low})) / {float(_width(low, high, bins))}) AS BIGINT)"
    return (
        f"SELECT bin, COUNT(*) AS n FROM (SELECT {bin_of} AS bin FROM {table} WHERE {column} IS NOT NULL) binned GROUP BY bin"
    )


def split_bounds(low: int, high: int, counts: Sequence[tuple[int, int]], bins: int, parts: int) -> list[int]:
    """Ascending bounds between parts, at edges of bins, so that each part has about as many rows.

    A bin is never cut: one with more rows than a part should have is a part alone, so there may be fewer parts.
    """
    if parts < 1 or bins < 1:
        raise ValueError("at least one part and one bin")
    width, total = _width(low, high, bins), sum(n for _, n in counts)
    bounds, before, held = [], 0, 0
    for number, n in sorted(counts):
        # A part ends before a bin that would take it further beyond its share than it now lacks.
        share = (total - before) / (parts - len(bounds))
        if held and len(bounds) < parts - 1 and held + n - share > share - held:
            bounds.append(low + number * width)
            before, held = before + held, 0
        held += n
    return bounds


def split_predicates(column: str, bounds: Sequence[int]) -> list[str]:
    """One predicate for each part; rows without a value belong to the first."""
    if not bounds:
        return [f"{column} IS NULL OR {column} IS NOT NULL"]
    between = [f"{column} >= {a} AND {column} < {z}" for a, z in zip(bounds, bounds[1:])]
    return [f"{column} < {bounds[0]} OR {column} IS NULL", *between, f"{column} >= {bounds[-1]}"]
