"""Density clustering against plain computations on all pairs."""

import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import driftmap as dm
from driftmap.operators import density, scale


def scattered(n: int = 300) -> np.ndarray:
    """Blobs of different density, background, and copies of one point."""
    rng = np.random.default_rng(0)
    size = n // 6
    middles = rng.normal(size=(4, 2)) * 2
    parts = [m + rng.normal(size=(size, 2)) * s for m, s in zip(middles, (0.05, 0.1, 0.3, 0.6))]
    parts += [rng.uniform(-4, 4, size=(size, 2))]
    xy = np.concatenate([*parts, np.repeat(parts[0][:1], size, 0)])
    rng.shuffle(xy)
    return xy


def as_points(spark, xy):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")


def labels(df):
    return [r.prediction for r in df.orderBy("id").collect()]


@pytest.fixture(params=["plain", "hot"])
def paths(request, monkeypatch):
    """The second run treats small cells as hot and splits all but the smallest pairs of cells."""
    if request.param == "hot":
        monkeypatch.setattr(scale, "HOT_ROWS", 15)
        monkeypatch.setattr(density, "_SMALL", 4)


@pytest.mark.parametrize("eps, min_samples", [(0.15, 5), (0.4, 12)])
def test_dbscan(spark, paths, eps, min_samples):
    xy = scattered()
    assert labels(dm.dbscan(as_points(spark, xy), eps, min_samples)) == brute.dbscan(xy, eps, min_samples)


def test_dbscan_without_clusters_or_coordinates(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0), (1, 9.0, 9.0), (2, None, 1.0), (3, float("nan"), 1.0)], "id long, x double, y double")
    assert labels(dm.dbscan(df, 0.5, 2)) == [-1] * 4


def test_neighbours_of_sparse_points(spark, paths):
    xy = scattered()
    near = brute.distances(xy) <= 0.3
    core = near.sum(1) >= 8
    flags = dm.core_points(as_points(spark, xy), 0.3, 8).orderBy("id").collect()
    assert [r.core for r in flags] == core.tolist()
    pairs = dm.sparse_neighbors(as_points(spark, xy), 0.3, 8).collect()
    expected = {(i, j) for i, j in zip(*np.nonzero(near)) if i != j and not core[i]}
    assert {(r.id, r.other_id) for r in pairs} == expected and len(pairs) == len(expected)


def test_levels_and_tree(spark, paths):
    xy = scattered()
    radii = [2 * 0.75**i for i in range(12)]
    points = as_points(spark, xy)
    rows = brute.levels(xy, radii, 5, 0.4)
    assert {tuple(r) for r in dm.density_levels(points, radii, 5, 0.4).select("g", "id", "component").collect()} == rows
    found = labels(dm.density_tree(points, 15, 5, 0.4, radii))
    assert found == brute.excess_of_mass(rows, radii, 15, len(xy))
    sizes = np.unique([p for p in found if p >= 0], return_counts=True)[1]
    assert len(sizes) > 1 and min(sizes) >= 15


@pytest.mark.parametrize("repeated", [0, 20])
def test_levels_look_for_neighbours_once(spark, monkeypatch, repeated):
    """Only ids that repeat are counted at every level."""
    xy, radii, calls = scattered(120), [2 * 0.75**i for i in range(6)], []
    flags, points = density._core_flags, as_points(spark, xy)
    monkeypatch.setattr(density, "_core_flags", lambda *a: calls.append(a) or flags(*a))
    found = dm.density_levels(points.union(points.filter(f"id < {repeated}")), radii, 5, 0.4).collect()
    assert len(calls) == (repeated > 0)
    assert repeated or {(r.g, r.id, r.component) for r in found} == brute.levels(xy, radii, 5, 0.4)


def test_keys_of_few_rows_are_not_counted(spark, monkeypatch):
    monkeypatch.setattr(scale, "HOT_ROWS", 15)
    df = spark.createDataFrame([(i % 3,) for i in range(60)], "k int")
    assert len(scale.hot_hashes(df, ["k"], at_most=60, most=20)) == 3
    assert scale.hot_hashes(df.select(F.raise_error(F.lit("counted")).alias("k")), ["k"], at_most=60, most=15) == []


def test_tree_chooses_its_own_levels(spark):
    found = labels(dm.density_tree(as_points(spark, scattered(600)), 20, 10, 0.4, levels=10))
    assert max(found) >= 1 and len(found) == 600


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(400, 430)]
    zigzag = [(i, 1000 + i) for i in range(20)] + [(i + 1, 1000 + i) for i in range(20)]
    edges = spark.createDataFrame(chain + star + zigzag + [(7777, 7777)], "a long, b long")
    found = {r.node: r.component for r in dm.connected_components(edges).collect()}
    assert {found[n] for n in range(100, 161)} == {100}
    assert {found[n] for n in [500, *range(400, 430)]} == {400}
    assert {found[n] for n in [*range(21), *range(1000, 1020)]} == {0}
    assert dm.connected_components(edges.filter("a = 7777")).count() == 0


def silhouette(xy, label):
    d, scores = brute.distances(xy), []
    for i, own in enumerate(label):
        same = label == own
        if same.sum() == 1:
            scores.append(0.0)
            continue
        inner = d[i][same].sum() / (same.sum() - 1)
        outer = min(d[i][label == c].mean() for c in set(label.tolist()) - {own})
        scores.append((outer - inner) / max(inner, outer))
    return float(np.mean(scores))


@pytest.mark.parametrize("block", [40, 4096])
def test_exact_silhouette(spark, block):
    xy = scattered()
    label = np.arange(len(xy)) % 5
    label[0] = 9
    rows = [(i, float(x), float(y), int(c)) for i, ((x, y), c) in enumerate(zip(xy, label))]
    noise = [(10_000, 0.0, 0.0, -1)]
    df = spark.createDataFrame(rows + noise, "id long, x double, y double, prediction int")
    row = dm.silhouette_exact(df, block).head()
    assert (row.n_rows, row.n_clusters) == (len(xy), 6)
    assert row.silhouette == pytest.approx(silhouette(xy, label), rel=1e-9)
    assert dm.silhouette_exact(df.filter("prediction = 1")).head().silhouette is None


def test_exact_silhouette_has_a_task_for_each_block(spark):
    xy = scattered()
    rows = [(i, float(x), float(y), i % 3) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, "id long, x double, y double, prediction int")
    plan = str(dm.silhouette_exact(df, 40)._jdf.queryExecution().optimizedPlan().toString())
    tasks = [int(n) for n in re.findall(r"RepartitionByExpression .*, (\d+)", plan)]
    assert tasks == [-(-len(xy) // 40)]


@pytest.mark.parametrize("scale", [1e-160, 1.0, 1e200])
def test_exact_silhouette_of_tiny_and_huge_coordinates(spark, scale):
    xy = scattered()[:90]
    label = np.arange(90) % 3
    rows = [(i, float(x * scale), float(y * scale), int(c)) for i, ((x, y), c) in enumerate(zip(xy, label))]
    df = spark.createDataFrame(rows, "id long, x double, y double, prediction int")
    assert dm.silhouette_exact(df, 40).head().silhouette == pytest.approx(silhouette(xy, label), rel=1e-9)
