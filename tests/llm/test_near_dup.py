import random

import pytest
from pyspark.sql import functions as F

from entitylake.llm import near_dup
from entitylake.llm.components import components
from tests.llm.tables import awkward_rows, bag, documents, lower, prose, words


def shingles(text, n):
    w = words(lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        name = (min(ids) if ids else None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), name, r[0] == name))
    return out


def changed(text, share, rng):
    return " ".join(f"new{rng.random()}" if rng.random() < share else w for w in text.split())


def near_copies():
    rng = random.Random(4)
    rows = []
    for group in range(12):
        base = prose(100 + group, rng.choice([8, 30, 90, 300]))
        for _ in range(rng.choice([2, 3, 9])):
            rows.append((len(rows), changed(base, rng.choice([0, 0.005, 0.02, 0.05]), rng), "en", "s", 1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words_", "percent"), [(3, 85), (5, 80)])
def test_against_all_pairs(spark, words_, percent):
    rows = awkward_rows() + [(1000 + r[0], *r[1:]) for r in near_copies()]
    df = documents(spark, rows).withColumn("kept", F.lit("x"))
    got = near_dup.near_duplicates(df, near_dup.plan(words_, percent)).drop("text_hash").collect()
    assert bag(got) == bag(plain(rows, words_, percent))


def test_large_buckets_are_exact(spark, monkeypatch):
    """Buckets of three and more go through pivots, and what these leave through the grid."""
    monkeypatch.setattr(near_dup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dup, "CELL", 4)
    rng = random.Random(9)
    base = prose(77, 150)
    rows = [(i, changed(base, 0.02, rng), "en", "s", 1) for i in range(60)] + near_copies()
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    got = near_dup.near_duplicates(documents(spark, rows), near_dup.plan(3, 85)).drop("text_hash").collect()
    assert bag(got) == bag(plain(rows, 3, 85))


def test_empty(spark):
    for rows in ([], [(1, None, None, None, None)], [(2, "", None, None, None), (None, " ", None, None, None)]):
        got = near_dup.near_duplicates(documents(spark, rows), near_dup.plan(3, 85)).drop("text_hash").collect()
        assert bag(got) == bag(plain(rows, 3, 85))


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_more_links_are_joined_to_the_components_found(spark, monkeypatch):
    """What goes into the next rounds are stars of components and new links, not all links once more."""
    from entitylake.llm import near_dup
    from entitylake.llm.components import components

    chain = [(i, i + 1) for i in range(40) if i != 20]
    comps = components(spark.createDataFrame(chain, "u long, v long")).localCheckpoint()
    given = []
    monkeypatch.setattr(near_dup, "components", lambda links: given.append(links.collect()) or components(links))
    got = near_dup._joined(comps, spark.createDataFrame([(20, 21), (50, 51)], "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {**{i: 0 for i in range(41)}, 50: 50, 51: 50}
    assert len(got) == 43 and len(given[0]) == 39 + 2 and {r.v for r in given[0]} == {0, 21, 51}
