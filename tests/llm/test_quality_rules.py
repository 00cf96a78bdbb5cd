import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from entitylake.llm.quality_rules import STATISTICS, _cholesky, _distances, judge, with_statistics
from tests.llm.tables import awkward_rows, bag, documents, prose, words


def plain(text):
    w = words(text)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = set()
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    values = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))
    return (*values, values[0] < 50 or 100 * values[4] > 50 * values[0])


def test_statistics(spark):
    rows = with_statistics(documents(spark).withColumn("n_words", F.lit("x"))).collect()
    assert bag((r.doc_id, *(r[s] for s in STATISTICS), r.base_failed) for r in rows) == bag(
        (i, *plain(t)) for i, t, *_ in awkward_rows()
    )


def test_verdicts(spark):
    rows = judge(documents(spark)).collect()
    assert len(rows) == len(awkward_rows())
    assert not any(r.kept for r in rows if r.base_failed)
    assert all(r.distance is None for r in rows if r.base_failed)


def test_outliers_of_a_group_are_rejected(spark):
    """Clean texts stay though a tenth of their group is junk, in small and large groups alike."""
    clean = [(i, prose(i, 80 + i % 200), "en", "big" if i % 5 else f"s{i % 40}", 1) for i in range(1, 900)]
    junk = [(-i, re.sub(r" ", " *** $$$ %%% ", prose(i, 80 + i % 50)), "en", "big", 1) for i in range(1, 90)]
    rows = {r.doc_id: r for r in judge(documents(spark, clean + junk).withColumn("kept", F.lit(1))).collect()}
    assert not any(rows[-i].kept for i in range(1, 90))
    assert np.mean([rows[i].kept for i in range(1, 900)]) > 0.97


def test_nothing_to_fit(spark):
    assert judge(documents(spark, [])).collect() == []
    assert [r.kept for r in judge(documents(spark, [(1, None, None, None, None)])).collect()] == [False]


def test_distances_are_mahalanobis(spark):
    random = np.random.default_rng(1)
    a = random.normal(size=(5, 5))
    cov, mean, x = a @ a.T + np.eye(5), random.normal(size=5), random.normal(size=(20, 5))
    estimate = {f"_s{i}_{k}": float(cov[i, k]) for i in range(5) for k in range(i + 1)}
    estimate |= {f"_m{i}": float(mean[i]) for i in range(5)} | {"_group": "g"}
    rows = spark.createDataFrame([("g", k, *map(float, v)) for k, v in enumerate(x)], "_group string, k int, " + ", ".join(f"_x{i} double" for i in range(5)))
    got = {r.k: r._d2 for r in _distances(rows, _cholesky(spark.createDataFrame([estimate]))).collect()}
    for k, v in enumerate(x):
        assert np.isclose(got[k], (v - mean) @ np.linalg.inv(cov) @ (v - mean))
