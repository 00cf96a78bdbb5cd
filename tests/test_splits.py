"""Parts of a table: every row in one of them, about equally many in each."""

import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from entitylake.sources.splits import counts_query, range_query, split_bounds, split_predicates


def planned(values, bins, parts):
    """Predicates, and the rows that each of them reads."""
    connection = duckdb.connect()
    connection.execute("CREATE TABLE t (k BIGINT)")
    if values:
        connection.executemany("INSERT INTO t VALUES (?)", [(v,) for v in values])
    low, high = connection.execute(range_query("t", "k")).fetchone()
    counts = [] if low is None else connection.execute(counts_query("t", "k", low, high, bins)).fetchall()
    bounds = [] if low is None else split_bounds(low, high, counts, bins, parts)
    predicates = split_predicates("k", bounds)
    return bounds, [connection.execute(f"SELECT COUNT(*) FROM t WHERE {p}").fetchone()[0] for p in predicates], counts


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.none() | st.integers(-50, 50) | st.integers(-(10**12), 10**12), max_size=40),
    st.integers(1, 30),
    st.integers(1, 9),
)
def test_every_row_is_read_once(values, bins, parts):
    bounds, rows, counts = planned(values, bins, parts)
    assert sum(rows) == len(values) and len(rows) <= parts
    assert bounds == sorted(set(bounds))
    assert sum(n for _, n in counts) == sum(v is not None for v in values)


def test_parts_of_skewed_keys_are_about_equal():
    rng = random.Random(1)
    values = [int(1e6 * rng.random() ** 4) for _ in range(4000)]
    _, rows, counts = planned(values, 1000, 8)
    heaviest = max(n for _, n in counts)
    assert len(rows) == 8 and max(rows) <= 4000 / 8 + heaviest


def test_one_key_with_most_rows_is_a_part_alone():
    values = [500] * 900 + list(range(1000))
    _, rows, _ = planned(values, 1000, 4)
    assert 901 in rows or 902 in rows
    assert sum(rows) == len(values)


def test_rows_outside_the_bounds_and_nulls():
    predicates = split_predicates("k", [10, 20])
    rows = duckdb.execute(
        "SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE {p})" for p in predicates)
        + " FROM (VALUES (-5), (NULL), (10), (19), (20), (99)) v(k)"
    ).fetchone()
    assert rows == (2, 2, 2)
    assert len(split_predicates("k", [])) == 1


def test_bad_numbers():
    with pytest.raises(ValueError):
        split_bounds(0, 9, [(0, 1)], 10, 0)
