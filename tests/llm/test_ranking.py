import zlib

import numpy as np
from pyspark.sql import functions as F

from entitylake.llm import ranking
from tests.llm.tables import awkward_rows, documents, prose


def labelled(spark, n=400):
    rows = [(i, prose(i, 30 + i % 90) if i % 4 else prose(i, 30 + i % 90).upper().replace(" ", "!! "), "en", "s", 1) for i in range(n)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(n)] + [(None, 1, 0), (5, None, 0), (10**6, 0, 0)]
    return documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_held_out_accuracy(spark):
    docs, labels, rows = labelled(spark)
    model = ranking.fit(docs, labels)
    scored = {r.doc_id: r for r in ranking.score(docs.withColumn("score", F.lit("x")), model).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40
    assert np.mean([scored[i].predicted == int(i % 4 > 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored.values())


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = labelled(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (ranking.fit(docs, x) for x in (labels, turned))
    assert np.array_equal(one.weights, two.weights) and one.cut == two.cut
    again = ranking.fit(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(one.weights, again.weights)


def test_repeated_ids_do_not_multiply_what_reaches_the_driver(spark, monkeypatch):
    docs, labels, rows = labelled(spark)
    hot = next(i for i in range(1, 400) if i % 4 and zlib.crc32(str(i).encode()) % 5)
    others = documents(spark, [(hot, prose(1000 + k, 40), "en", "s", 1) for k in range(3000)] + [rows[hot]] * 500)
    sizes = []
    monkeypatch.setattr(ranking, "fit_pairs", lambda good, bad, share: sizes.append((len(good), len(bad))))
    ranking.fit(docs, labels)
    ranking.fit(docs.union(others), labels.union(labels))
    (good, bad), (more, same) = sizes
    assert 0.5 * good < more < 1.5 * good and same == bad


def test_all_labelled_texts_are_fitted(spark):
    """Whatever few texts the steps start from: the model is that of all texts, and so is the threshold."""
    docs, labels, rows = labelled(spark, 600)
    whole, few = ranking.fit(docs, labels), ranking.fit(docs, labels, labelled=5)
    assert np.allclose(whole.weights, few.weights, atol=1e-4)
    assert np.array_equal(whole.mean, few.mean) and np.array_equal(whole.deviation, few.deviation)
    assert abs(whole.cut - few.cut) < 1e-3
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and r[0] != 5]
    raw = [r[1].encode() for r in known]
    x = ranking.features(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.allclose(x.mean(axis=0), few.mean, atol=0.02)


def test_threshold_of_many_scores(spark, monkeypatch):
    monkeypatch.setattr(ranking, "FEW_SCORES", 3)
    monkeypatch.setattr(ranking, "BINS", 7)
    random = np.random.default_rng(2)
    values = np.concatenate([random.normal(size=300), np.full(40, -0.7)])
    rows = spark.createDataFrame([([float(v)], int(v > 0.1)) for v in values], "x array<double>, quality int")
    n = {q: int(np.sum((values > 0.1) == q)) for q in (0, 1)}
    for share in (0.05, 0.3, 0.9):
        weight = np.where(values > 0.1, (1 - share) / n[1], share / n[0])
        order = np.argsort(values)
        found = values[order][np.searchsorted(np.cumsum(weight[order]), share * (1 - 1e-9))]
        above = values[values > found]
        got = ranking._cut(rows, lambda x: x[:, 0], n, share)
        assert got == (found + (above.min() if len(above) else found)) / 2


def test_bradley_terry_orders_pairs():
    random = np.random.default_rng(3)
    true = np.array([2.0, -1.0, 0.0])
    x = random.normal(size=(600, 3))
    good = x[x @ true > 0.5]
    bad = x[x @ true < -0.5]
    model = ranking.fit_pairs(good, bad, len(bad) / (len(good) + len(bad)))
    assert model.raw(good).min() > model.raw(bad).max()
    assert (model.score(good) >= 0.3).all() and (model.score(bad) < 0.3).all()


def test_awkward_rows_and_no_model(spark):
    docs, labels, _ = labelled(spark)
    rows = ranking.score(documents(spark), ranking.fit(docs, labels)).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r.score <= 1 for r in rows)
    only_good = labels.filter("quality = 1")
    assert ranking.fit(docs, only_good) is None
    assert {r.score for r in ranking.score(documents(spark), None).collect()} == {0.5}
    assert ranking.fit(documents(spark, []), labels) is None
    assert ranking.score(documents(spark, []), None).collect() == []


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [prose(1, 50), "", "A!! B!!", "é" * 50]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    together = ranking.features(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
    for k, x in enumerate(raw):
        alone = ranking.features(np.frombuffer(x, dtype=np.uint8), np.array([0, len(x)]))
        assert np.array_equal(alone[0], together[k])
