import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from entitylake.llm.sharding import histogram_shards, shard_documents
from tests.llm.tables import awkward_rows, bag, documents, prose


def laws(rows, shards, largest):
    """Slots without gaps, and bytes within one row of their share at either end."""
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r)
    total = sum(r.size for r in rows)
    for shard, members in by_shard.items():
        assert 0 <= shard < shards
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert abs(sum(r.size for r in members) - total / shards) <= 2 * largest + 0.003 * total / shards + 1


def test_awkward_rows(spark):
    rows = shard_documents(documents(spark), 4).collect()
    expected = [
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in awkward_rows()
    ]
    assert bag((r.doc_id, r.size, r.text_crc32) for r in rows) == bag(expected)
    laws(rows, 4, max(e[1] for e in expected))
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_equal_shares_of_a_hot_text(spark):
    """A third of the rows share a text; doc_id parts them."""
    table = [(i, prose(1, 40) if i % 3 == 0 else prose(i, 5 + i % 60), "en", "s", 1) for i in range(3000)]
    rows = shard_documents(documents(spark, table)).collect()
    assert len(rows) == 3000 and len({r.shard for r in rows}) == 24
    laws(rows, 24, max(r.size for r in rows))
    key = {r.doc_id: (r.shard, r.slot) for r in rows}
    hot = [key[i] for i in range(0, 3000, 3)]
    # Equal texts are neighbours: they fill whole shards but for the first and the last.
    shards = sorted({s for s, _ in hot})
    assert shards == list(range(shards[0], shards[-1] + 1))
    again = {r.doc_id: (r.shard, r.slot) for r in shard_documents(documents(spark, table).repartition(7)).collect()}
    assert again == key


def test_equal_shares_of_repeated_rows(spark):
    """A third of the rows are equal in all columns; another third share an id."""
    hot = prose(1, 40)
    table = [(7 if i % 3 < 2 else i, hot if i % 3 == 0 else prose(i, 5 + i % 60), "en", "s", 1) for i in range(3000)]
    rows = shard_documents(documents(spark, table).repartition(5)).collect()
    assert bag((r.doc_id, r.text_crc32) for r in rows) == bag((i, zlib.crc32(t.encode())) for i, t, *_ in table)
    assert len({r.shard for r in rows}) == 24
    laws(rows, 24, max(r.size for r in rows))
    again = shard_documents(documents(spark, table).repartition(11)).collect()
    assert bag(again) == bag(rows)


def test_one_key(spark):
    df = spark.range(300).select(F.col("id").alias("i"), F.lit(3).cast("long").alias("size"))
    rows = histogram_shards(df, ["i"], "size", 3, buckets=6).collect()
    assert [(r.shard, r.slot) for r in sorted(rows, key=lambda r: r.i)] == [(i // 100, i % 100) for i in range(300)]


def test_empty_and_one(spark):
    assert shard_documents(documents(spark, [])).collect() == []
    rows = shard_documents(documents(spark, [(None, None, None, None, None)])).collect()
    assert [(r.doc_id, r.size, r.slot) for r in rows] == [(None, 8, 0)]


def test_other_keys_and_clashing_names(spark):
    df = spark.range(500).select(
        (F.col("id") % 7).alias("k"), F.col("id").alias("i"), (F.col("id") + 1).alias("size"), F.lit("x").alias("shard")
    )
    rows = histogram_shards(df, ["k", "i"], "size", 3, buckets=12).collect()
    assert bag((r.k, r.i, r.size) for r in rows) == bag((i % 7, i, i + 1) for i in range(500))
    laws(rows, 3, 500)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [(r.k, r.i) for r in ordered] == sorted((r.k, r.i) for r in rows)


@pytest.mark.parametrize("low", [-(1 << 63), (1 << 63) - 600])
def test_keys_at_the_ends_of_the_range(spark, low):
    table = [(low + i if i % 2 else i, 5) for i in range(400)]
    df = spark.createDataFrame([(a, a, s) for a, s in table], "k long, i long, size long")
    rows = histogram_shards(df, ["k", "i"], "size", 4, buckets=4).collect()
    laws(rows, 4, 5)
