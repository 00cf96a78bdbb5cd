import random

import numpy as np
import pyarrow as pa
import pytest

from entitylake.operators import short_texts
from entitylake.operators.fuzzy_join import similar_texts
from tests.brute import matches
from tests.test_fuzzy_join import frame, pairs


def words(seed, n, letters="abcdefghé\U0001f600", longest=20):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    return sorted({*base, *("".join(c for c in t if rng.random() > 0.1) + "z" * rng.randint(0, 2) for t in base)})


def side(texts):
    numbers = pa.array(texts).dictionary_encode().indices.to_numpy()
    return short_texts.Side(pa.array(texts, pa.string()), np.zeros(len(texts), dtype=np.int32), numbers)


@pytest.mark.parametrize("threshold", [60, 80, 100])
def test_pairs_of_a_cell_in_small_blocks(monkeypatch, threshold):
    monkeypatch.setattr(short_texts, "BLOCK_PAIRS", 7)
    monkeypatch.setattr(short_texts, "MEASURED_PAIRS", 5)
    texts = words(1, 60) + ["a" * 64, "b" + "a" * 63, "a" * 63]

    def most(total):
        bound = int(np.floor(total * (100 - threshold) / 100 + 1e-9))
        return bound - (bound + total) % 2

    one = side(texts)
    found = [
        (*sorted((one.texts[int(x)].as_py(), one.texts[int(y)].as_py())), int(d), total)
        for i, j, distance, total in short_texts.matches(one, one, 0, True, most)
        for x, y, d in zip(i, j, distance)
    ]
    wanted = {(a, b): r for (a, b), r in matches(texts, texts, threshold).items() if a < b}
    assert len(found) == len(wanted)
    assert all(abs(100 * (1 - d / total) - wanted[a, b]) < 1e-9 for a, b, d, total in found)


@pytest.mark.parametrize(("threshold", "options"), [(80, {}), (70, {"chunk_rows": 3}), (80, {"chunk_rows": 1})])
def test_join_in_cells_against_all_pairs(spark, threshold, options):
    left, right = words(2, 50), words(3, 40) + words(2, 50)[::3]
    assert pairs(similar_texts(frame(spark, left), None, "t", threshold, **options)) == matches(left, left, threshold)
    got = pairs(similar_texts(frame(spark, left), frame(spark, right), "t", threshold, **options))
    assert got == matches(left, right, threshold)


def test_short_texts_form_no_rows_per_token(spark):
    """Rows per pair of frequent tokens, 45 and more for a word, were most of what was sorted and compared."""
    plan = similar_texts(frame(spark, words(4, 5)), None, "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "levenshtein" not in plan
