from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from entitylake.llm import line_dedup, ranking
from entitylake.llm.common import shared_folder
from tests.llm import test_decontamination, test_line_dedup, test_near_dup
from tests.llm.tables import DOCUMENTS, awkward_rows, bag, documents, prose


def rows_of_all_kinds():
    rows = awkward_rows() + [(1000 + r[0], *r[1:]) for r in test_near_dup.near_copies()]
    rows += [r for r in test_decontamination.rows_with_passages() if r[0] is not None and r[0] >= 100]
    rows += [(2000 + i, prose(i, 60).upper().replace(" ", "!! "), "en", "s1", 1) for i in range(60)]
    return [(*r[:4], None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="module")
def folder(spark):
    path = shared_folder(spark)
    rows = rows_of_all_kinds()
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 0 if r[0] >= 2000 else 1, 0) for r in rows if r[0] is not None and (r[0] >= 1000 or r[0] in (1, 2, 3, 10, -5))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(test_decontamination.ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def plain_stages(spark, folder, rows):
    """What each stage leaves, by the plain versions; the classifier's scores are the operator's."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = ranking.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = Counter((r.doc_id, r.text) for r in ranking.score(docs, model).collect() if r.predicted == 1)
    kept = [r for r in rows if good[r[0], r[1]]]
    yield kept
    lines = test_line_dedup.plain(kept, line_dedup.RATIO, 3)
    kept = [(i, text, r[2], r[3], None if text is None else len(text)) for r, (i, text, *_) in zip(kept, lines)]
    yield kept
    verdict = test_near_dup.plain(kept, 5, 80)
    left, seen = [], set()
    for r, (_, n, _, keep) in zip(kept, verdict):
        if keep and not (n and (r[0], r[1]) in seen):
            left.append(r)
            seen.add((r[0], r[1]))
    repeated = len(left) < sum(k for *_, k in verdict)
    if repeated:  # rows equal in id and text are one row from here on
        left = list({(r[0], r[1]): r for r in left}.values())
    yield left
    judged = test_decontamination.plain(left, test_decontamination.ITEMS)
    left = [r for r, j in zip(left, judged) if not j[-1]]
    yield left
    yield left


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier"
    for (name, stage), rows in zip(corpus_pipeline.STAGES, plain_stages(spark, folder, rows_of_all_kinds())):
        path = f"{shared_folder(spark)}/stage"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns[:5] == [c.split()[0] for c in DOCUMENTS.split(", ")], name
        # Languages and sources of equal rows may differ, so rows are named by id and text.
        assert bag((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == bag((r[0], r[1], r[4]) for r in rows), name
    assert docs.filter(~F.col("exact")).count() == 0
    assert bag(corpus_pipeline.run(spark, folder).select("doc_id", "text").collect()) == bag(docs.select("doc_id", "text").collect())


def test_near_copies_with_the_same_id_or_none(spark):
    """One row of each group stays, and repeated rows without words stay all, whatever else repeats."""
    text = [prose(50 + i, 200) for i in range(4)]
    rows = [(1, text[0]), (1, text[0] + " more"), (None, text[1]), (None, text[1] + " more"), (2, text[2]), (2, text[3])]
    rows += [(3, prose(70, 90)), (3, prose(70, 90)), (None, None), (None, None), (4, ""), (4, "")]
    docs = documents(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, "").collect()]
    assert Counter(i for i, t in got) == {1: 1, None: 3, 2: 2, 3: 1, 4: 2}
    assert got.count((None, None)) == 2 and got.count((4, "")) == 2


def test_empty_tables(spark):
    path = shared_folder(spark)
    documents(spark, []).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []
