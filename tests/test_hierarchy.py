"""The exact density hierarchy against all pairs."""

import brute
import numpy as np
import pytest
from test_density import as_points, labels, scattered

import driftmap as dm
from driftmap.operators import hierarchy


@pytest.fixture
def narrow(monkeypatch):
    """Nodes have few children, so there are more levels of them."""
    monkeypatch.setattr(hierarchy, "FAN", 3)


def lattice() -> np.ndarray:
    """Points at equal distances, so that nearly all lengths tie, and a dense corner."""
    grid = np.array([(i, j) for i in range(9) for j in range(9)], float)
    return np.concatenate([grid, grid[:40] / 8 + 20, np.repeat([[50.0, 50.0]], 30, 0), [[50.0, 50.5]]])


def spanning(reach: np.ndarray) -> list[float]:
    """Lengths of a shortest spanning tree, by Prim."""
    best, out, lengths = reach[0].copy(), np.ones(len(reach), bool), []
    out[0] = False
    while out.any():
        j = int(np.flatnonzero(out)[best[out].argmin()])
        lengths.append(best[j])
        out[j] = False
        best = np.minimum(best, reach[j])
    return sorted(lengths)


@pytest.mark.parametrize("block", [25, 512])
def test_core_distances(spark, block):
    xy = scattered()
    found = [r.core for r in dm.core_distances(as_points(spark, xy), 7, block).orderBy("id").collect()]
    assert found == brute.reachability(xy, 7, 1.0)[0].tolist()


def test_blocks_are_spread_over_files(spark):
    places, count = hierarchy._places(as_points(spark, scattered()))
    blocks, number = hierarchy._core_blocks(places, count, 7, 10)
    assert number > hierarchy._TOGETHER and 1 < len(blocks.inputFiles()) <= -(-number // hierarchy._TOGETHER)


def test_tree_of_links(spark, narrow):
    xy, alpha = scattered(180), 0.4
    places, links = dm.reachability_tree(as_points(spark, xy), 5, alpha, block=30)
    rows, ends = places.collect(), links.collect()
    core, reach = brute.reachability(xy, 5, alpha)
    spot = {(r.x, r.y): r for r in rows}
    assert len(ends) == len(rows) - 1 and sum(r.n for r in rows) == len(xy)
    assert all(spot[tuple(p)].core == c for p, c in zip(xy.tolist(), core))
    # Copies at a place are linked at its core distance.
    copies = [r.core for r in rows for _ in range(r.n - 1)]
    assert sorted([r.w for r in ends] + copies) == pytest.approx(spanning(reach), rel=1e-15)
    assert {p for r in ends for p in (r.lo, r.hi)} == {r.place for r in rows}


def test_clusters_equal_all_components(spark):
    xy, size, min_samples, alpha = scattered(500), 15, 5, 0.4
    found = labels(dm.density_hierarchy(as_points(spark, xy), size, min_samples, alpha, chunk=120))
    assert found == brute.hierarchy(xy, size, min_samples, alpha)
    assert max(found) >= 2 and min(found) == -1


def test_ties_and_copies(spark):
    xy = lattice()
    for size, min_samples, block in ((10, 3, 75), (25, 29, 512)):
        found = labels(dm.density_hierarchy(as_points(spark, xy), size, min_samples, 1.0, block, chunk=90))
        assert found == brute.hierarchy(xy, size, min_samples, 1.0), (size, min_samples)


def test_small_and_odd_tables(spark):
    schema = "id long, x double, y double"
    nan = float("nan")
    for rows in ([], [(1, 0.0, 0.0), (2, None, 1.0)], [(i, 2.0, 3.0) for i in range(30)], [(1, nan, 1.0)] * 2):
        found = dm.density_hierarchy(spark.createDataFrame(rows, schema), 3, 2).collect()
        assert [r.prediction for r in found] == [-1] * len(rows)
    far = [(i, 1e308 * (-1) ** i, float(i % 3)) for i in range(12)] + [(20, float("inf"), 0.0)]
    found = dict(dm.density_hierarchy(spark.createDataFrame(far, schema), 3, 2, 1.0).collect())
    assert found[20] == -1 and len(found) == 13
    two = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], schema)
    assert [r.core for r in dm.core_distances(two, 5).collect()] == [float("inf")] * 2
