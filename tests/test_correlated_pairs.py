import numpy as np
import pytest

from entitylake.operators import correlated_pairs as operator


def plain(rows, least):
    by_item = {}
    for item, key, value in rows:
        by_item.setdefault(item, {})[key] = value
    found = []
    for a in by_item:
        for b in by_item:
            common = by_item[a].keys() & by_item[b].keys()
            both = [k for k in common if by_item[a][k] is not None and by_item[b][k] is not None]
            x, y = ([by_item[i][k] for k in both] for i in (a, b))
            if a < b and len(common) >= least and len(set(x)) > 1 and len(set(y)) > 1:
                found.append((a, b, len(common), float(np.corrcoef(x, y)[0, 1])))
    return sorted(found, key=lambda p: (-round(abs(p[3]), 9), -p[2], p[0], p[1]))


@pytest.mark.parametrize(("fewest", "tile"), [(250, 1 << 20), (7, 40)])
def test_best_pairs_come_without_a_row_per_pair_and_key(spark, monkeypatch, fewest, tile):
    monkeypatch.setattr(operator, "FEWEST_ITEMS", fewest)
    monkeypatch.setattr(operator, "TILE", tile)
    random = np.random.default_rng(1)
    rows = [
        (f"i{i:02}", f"k{k}", None if random.random() < 0.05 else 0.3 if i % 9 == 0 else round(float(random.normal()), 2))
        for i in range(45) for k in range(8) if random.random() < 0.8
    ]
    values = spark.createDataFrame(rows, "item string, key string, value double")
    got = operator.most_correlated(values, 4, 20, operator.sizes_of(values)).collect()
    got = sorted(got, key=lambda p: (-round(abs(p.r), 9), -p.common, p.one, p.two))[:20]
    wanted = plain(rows, 4)[:20]
    assert [(p.one, p.two, p.common) for p in got] == [p[:3] for p in wanted]
    assert np.allclose([p.r for p in got], [p[3] for p in wanted])


def test_a_side_that_does_not_vary_has_no_coefficient():
    x = np.array([[0.1, 0.1, 0.1, np.nan], [0.1, 0.2, 0.3, 1.0]])
    y = np.array([[0.3, 0.2, 0.7, 0.1], [0.2, 0.4, 0.6, 2.0]])
    assert np.isnan(operator.exact(x, y)[0]) and np.isclose(operator.exact(x, y)[1], 1.0)
