import random

import numpy as np
import pytest

from entitylake.operators import long_texts
from entitylake.operators.long_texts import code_points, match_groups, matches
from tests.brute import ratio


def texts(seed, n, letters="abcde \u00e9\U0001f600"):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(n)]
    return base + ["".join(c for c in t if rng.random() > 0.15) + "zz" for t in base]


def test_distances_of_texts_that_share_most_bigrams():
    """Few letters: bigrams sort out nothing, so every pair is measured, across words of 63 bits."""
    xs, ys = texts(1, 15), texts(2, 15) + texts(1, 15)[::2]
    found = matches(
        [code_points(x) for x in xs], [code_points(y) for y in ys],
        lambda i, places: np.ones(len(places), dtype=bool),
        lambda total: np.floor(total * 0.4 + 1e-9).astype(np.int64),
        lambda total: np.full(len(total), -1.0),
    )
    got = {(i, j): 100 * (1 - d / (len(xs[i]) + len(ys[j]))) for i, j, d in found}
    wanted = {(i, j): r for i, x in enumerate(xs) for j, y in enumerate(ys) if (r := ratio(x, y)) >= 60}
    assert got.keys() == wanted.keys() and len(got) >= 30
    assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_an_empty_side_gives_no_rows():
    import pyarrow as pa

    empty = pa.table({"key": pa.array([], pa.int32()), "text": pa.array([], pa.string()), "band": pa.array([], pa.int32())})
    assert len(match_groups(80, 1e-9, 64, False)(empty, empty)) == 0


@pytest.mark.parametrize(
    ("threshold", "limits"),
    [
        (80, {}),
        (80, {"LANES": 64, "STATE_WORDS": 2}),  # many tables, and many groups of texts with each
        (60, {"CLASSES": 4, "TABLE_BYTES": 1 << 10}),  # characters share classes, so some pairs are found not to match
        (100, {"CLASSES": 2}),
    ],
)
def test_pairs_sorted_out_by_a_bit_each(monkeypatch, threshold, limits):
    for name, value in {"BOUND_PAIRS": 1, **limits}.items():
        monkeypatch.setattr(long_texts, name, value)
    xs, ys = texts(3, 12), texts(4, 20) + texts(3, 12)[::2] + ["", "x" * 70]

    def most(total):
        bound = np.floor(total * ((100 - threshold) / 100) + 1e-9).astype(np.int64)
        return bound - (bound + total) % 2

    sides = [[code_points(t) for t in side] for side in (xs, ys)]
    wanted = {(i, j): r for i, x in enumerate(xs) for j, y in enumerate(ys) if (r := ratio(x, y)) >= threshold}
    likely = [(i, int(j)) for i, places in long_texts.likely_pairs(*sides, most) for j in places]
    assert len(likely) == len(set(likely)) and set(likely) >= wanted.keys()
    assert limits.get("CLASSES") == 2 or len(likely) < len(xs) * len(ys) / 2
    found = list(matches(*sides, lambda i, places: places % 2 == 0, most, lambda total: np.full(len(total), -1.0)))
    got = {(i, j): 100 * (1 - d / (len(xs[i]) + len(ys[j]))) for i, j, d in found}
    wanted = {k: r for k, r in wanted.items() if k[1] % 2 == 0}
    assert len(found) == len(got) and got.keys() == wanted.keys() and len(got) >= 3
    assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_cells_with_and_without_the_bound_are_alike(monkeypatch):
    import pyarrow as pa

    def rows(values):
        return pa.table({"key": pa.array([0] * len(values), pa.int32()), "text": values, "band": pa.array([0] * len(values), pa.int32())})

    left, right = (rows([t for t in side if len(t) > 64]) for side in (texts(5, 30), texts(5, 30)[::2] + texts(6, 40)))
    for equal in (False, True):
        run, found = match_groups(70, 1e-9, 64, False, equal), []
        for least in (1, 1 << 60):
            monkeypatch.setattr(long_texts, "BOUND_PAIRS", least)
            found.append([sorted(map(str, run(*sides).to_pylist())) for sides in ((left, right), (right, left))])
        assert found[0] == found[1] and len(found[0][0]) == len(found[0][1]) >= 10
        same = sum(r["distance"] == 0 for r in run(left, right).to_pylist())
        assert same == equal * len({*left["text"].to_pylist()} & {*right["text"].to_pylist()})
