import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entitylake.llm import resampling
from entitylake.llm.ordering import ranked
from tests.llm.tables import awkward_rows, bag, documents, lower, prose

ITEMS = [(1, prose(6, 40)), (2, prose(7, 90)), (2, "alpha1\nbeta2 Gamma3"), (3, None), (4, ""), (4, "..."), (None, "漢字 é one two")]


def features(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(rows, items, longest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for r in table for f in features(r[1], longest)[1]) for table in (rows, items))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in range(buckets)]
    scored = []
    for r in rows:
        n, found = features(r[1], longest)
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        scored.append((r[0], n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((x for x in scored if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    quota = 10 * len(eligible) // 100
    drawn = [(*x, i + 1 if i < quota else None) for i, x in enumerate(eligible)]
    return drawn + [(*x, None) for x in scored if x[1] < 20]


def rows_with_lines():
    rows = awkward_rows() + [(200 + i, prose(i, 30 + i) + "\nfooter line alpha1\n" + prose(i % 5, 8), "en", "s", 1) for i in range(80)]
    return rows + [(300, "a\nb\n\nc d\n-\ne " + "x y\n" * 30, "en", "s", 1)] * 12


@pytest.mark.parametrize(("longest", "buckets", "hot"), [(1, 10_000, 10_000), (3, 997, 10_000), (2, 50, 3)])
def test_against_features_of_whole_texts(spark, monkeypatch, longest, buckets, hot):
    monkeypatch.setattr(resampling, "HOT_SHARE", hot)
    rows = rows_with_lines()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = documents(spark, rows).withColumn("weight", F.lit("x")).withColumn("rank", F.lit("y"))
    got = resampling.resample(df, items, longest, buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert bag(got.collect()) == bag(plain(rows, ITEMS, longest, buckets))


def test_each_line_is_counted_once(spark):
    rows = [(i, "same line of words\n" + f"own{i}", "en", "s", 1) for i in range(50)]
    lines = resampling.line_features(documents(spark, rows).select("text"), 1, 100)
    assert lines.count() == 51 and lines.agg(F.max("occurrences")).first()[0] == 50


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(documents(spark, []), items).collect() == []
    assert bag(resampling.resample(documents(spark), items).collect()) == bag(plain(awkward_rows(), [], 1, 10_000))


def test_ranks_go_through_all_tasks(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("w"))
    got = ranked(df.repartition(9), [F.col("w").desc(), F.col("v")]).collect()
    assert sorted(r.rank for r in got) == list(range(1, 5001))
    assert [(r.w, r.v) for r in sorted(got, key=lambda r: r.rank)] == sorted(((r.w, r.v) for r in got), key=lambda x: (-x[0], x[1]))
