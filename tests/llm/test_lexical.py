import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from entitylake.llm import lexical
from tests.llm.tables import awkward_rows, bag, documents, lower, prose

ITEMS = [
    (1, prose(1, 40)), (2, "alpha1 beta2 nothing-like-this"), (3, "one"), (4, None), (5, ""), (6, "..."), (7, prose(3, 60)), (7, "a b c"),
    (8, "menu HOME"), (8, "menu HOME"), (None, prose(9, 30)), (10, "漢字 À é"), (11, " ".join(f"alpha{i} beta{i} mu{i}" for i in range(50))),
]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))


def plain(rows, items, k):
    held = [(r[0], Counter(terms(r[1]))) for r in rows if terms(r[1])]
    n_all, l_all = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scores = []
        for doc, c in held:
            m = 10 + 90 * sum(c.values()) * n_all // l_all
            score = sum(weight[t] * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) & set(c))
            scores += [(score, doc)] if score > 0 else []
        best = sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, i + 1, doc, score) for i, (score, doc) in enumerate(best)]
    return out


def rows_to_search():
    rows = awkward_rows() + [(500 + i, prose(i, 20 + i % 70), "en", "s", 1) for i in range(120)]
    return rows + [(900 + i % 3, prose(3, 60), "en", "s", 1) for i in range(15)]


@pytest.mark.parametrize(("k", "band"), [(10, 8), (3, 2), (1, 1.3)])
def test_against_all_documents(spark, monkeypatch, k, band):
    monkeypatch.setattr(lexical, "BAND", band)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = documents(spark, rows_to_search()).withColumn("score", F.lit("x")).withColumn("n", F.lit("y"))
    got = lexical.search(df, items, k=k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert bag(got.collect()) == bag(plain(rows_to_search(), ITEMS, k))


def test_accumulators_stop_early_and_survivors_are_finished(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BAND", 2)
    rare = " ".join(f"rare{i}" for i in range(6))
    rows = [(i, f"{rare} common other{i}", "", "", 1) for i in range(4)] + [(100 + i, "common words here", "", "", 1) for i in range(200)]
    items = spark.createDataFrame([(1, rare + " common words")], "item_id long, text string")
    docs = documents(spark, rows)
    asked, fit = lexical.stored_rows(lexical.query_terms(items), 40)
    index, known = lexical.banded_index(lexical.postings(docs, asked, fit))
    plan = lexical.stored(asked.join(known, "term").select("item", "item_id", "term", "band", "most"))
    partial = lexical.accumulate(index, plan, True, k=4).collect()
    assert {r.doc_id for r in partial} == {0, 1, 2, 3}
    assert max(r.until for r in partial) < max(r.band for r in plan.collect())
    assert bag(lexical.search(docs, items, k=4).collect()) == bag(plain(rows, [(1, rare + " common words")], 4))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(documents(spark, []), items).collect() == []
    assert lexical.search(documents(spark), none).collect() == []
