import hashlib
import re

import pytest
from pyspark.sql import functions as F

from entitylake.llm import decontamination
from tests.llm.tables import awkward_rows, bag, documents, lower, prose

ITEMS = [
    (1, prose(1, 40)), (2, "Short item, of: six-words"), (3, "one"), (4, None), (5, ""), (6, "..."), (7, prose(3, 200)[300:700]),
    (7, prose(50, 20)), (8, prose(60, 25)), (8, prose(60, 25)), (9, "a a a a a a a a a a a a a a a"), (None, prose(61, 30)), (10, "漢字 é"),
]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))


def plain(rows, items):
    windows = {}
    for item, text in items:
        w = terms(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for row in rows:
        w, hit, found = terms(row[1]), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        names = sorted(str(i) for i in found if i is not None)
        sha = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((row[0], len(w), len(hit), len(names), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def rows_with_passages():
    rows = awkward_rows()
    near = " ".join(terms(prose(60, 25)))
    rows += [
        (100, prose(70, 50) + " " + prose(60, 25).upper() + " " + prose(71, 40), "en", "s", 1),
        (101, near.replace(" ", "-"), "en", "s", 1), (102, " ".join(terms(near)[:12]), "en", "s", 1),
        (103, "x " + " ".join(terms(near)[3:16]) + " y", "en", "s", 1), (104, "short ITEM of six words", "en", "s", 1),
        (105, "a " * 40, "en", "s", 1), (106, "a " * 12, "en", "s", 1), (107, near + " " + near, "en", "s", 1),
        (108, prose(70, 2000) + " " + near, "en", "s", 1), (109, "only 漢字 É é", "en", "s", 1), (109, "漢字 é", "en", "s", 1),
        (110, " ".join(terms(near)[8:]), "en", "s", 1), (111, prose(61, 30), "en", "s", 1),
    ]
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = documents(spark, rows_with_passages()).withColumn("n_hit", F.lit("x"))
    found = decontamination.contamination(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()


def test_against_all_windows(judged):
    assert bag(judged) == bag(plain(rows_with_passages(), ITEMS))
    verdict = {r.doc_id: r.contaminated for r in judged}
    assert verdict[104] and verdict[107] and not verdict[102] and not verdict[108]


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(documents(spark, []), items).collect() == []
    rows = decontamination.contamination(documents(spark), items).collect()
    assert len(rows) == len(awkward_rows()) and not any(r.contaminated for r in rows)


def test_proximity(spark):
    docs = documents(spark, [(1, "red fish blue fish red", "", "", 1), (2, "red " + "x " * 30 + "fish", "", "", 1), (3, "red red", "", "", 1)])
    terms_ = spark.createDataFrame([("red",), ("fish",)], "w string").select(F.xxhash64("w").alias("term"))
    index = decontamination.positional_index(docs, terms_, True)
    got = {(r._doc, r.left_pos, r.right_pos) for r in decontamination.proximity_matches(index, "red", "fish", 3).collect()}
    assert got == {(1, 0, 1), (1, 0, 3), (1, 4, 1), (1, 4, 3)}
    same = {(r._doc, r.left_pos, r.right_pos) for r in decontamination.proximity_matches(index, "red", "red", 1).collect()}
    assert same == {(3, 0, 1), (3, 1, 0)}
