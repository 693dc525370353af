"""All neighbours within a radius, compressed, against all pairs."""

import brute
import numpy as np
import pytest
from test_density import as_points, scattered

import driftmap as dm
from driftmap.operators import neighbors, scale


@pytest.mark.parametrize("eps, small, hot", [(0.3, 256, False), (1.0, 4, False), (0.5, 16, True)])
def test_equals_all_pairs(spark, monkeypatch, eps, small, hot):
    monkeypatch.setattr(neighbors, "_SMALL", small)
    if hot:
        monkeypatch.setattr(scale, "HOT_ROWS", 15)
    xy = scattered(200)
    points = as_points(spark, xy)
    found = dm.eps_neighbors(points, eps)
    near = brute.distances(xy) <= eps
    np.fill_diagonal(near, False)
    assert {r.id: r.degree for r in found.degree.collect()} == dict(enumerate(near.sum(1).tolist()))
    rows = dm.expand_neighbors(points, found, eps).collect()
    assert len(rows) == near.sum() and {(r.id, r.other_id) for r in rows} == set(zip(*map(list, np.nonzero(near))))
    assert all(r.dist == brute.distances(xy[[r.id, r.other_id]])[0, 1] for r in rows[:50])


def test_rows_grow_with_cells_and_not_with_pairs(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate([np.repeat(rng.uniform(size=(4, 2)), 500, 0), rng.normal(size=(1000, 2)) * 0.02])
    found = dm.eps_neighbors(as_points(spark, xy), 1.0)
    pairs = sum(r.degree for r in found.degree.collect()) // 2
    assert pairs == (np.triu(brute.distances(xy) <= 1.0, 1)).sum()
    assert found.whole.count() + found.single.count() < 60 < 3000 < pairs


def test_no_usable_points(spark):
    df = spark.createDataFrame([(1, None, 0.0), (2, float("nan"), 1.0)], "id long, x double, y double")
    found = dm.eps_neighbors(df, 1.0)
    assert found.degree.count() == found.whole.count() == found.single.count() == dm.expand_neighbors(df, found, 1.0).count() == 0
