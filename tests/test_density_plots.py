"""Smoothed and hexagonal densities against direct sums."""

import math

import numpy as np
import pytest

import driftmap as dm


@pytest.fixture(scope="module")
def plane(spark):
    draw = np.random.default_rng(5)
    rows = [(float(a), float(b)) for a, b in draw.normal(0, 2, (400, 2))]
    return rows, spark.createDataFrame(
        rows + [(None, 1.0), (1.0, None), (float("nan"), 1.0)], "x double, y double"
    )


def test_a_point_belongs_to_the_nearest_centre(plane):
    rows, df = plane
    size = 0.7
    found = {(r.q, r.r): r for r in dm.hexagons(df, "x", "y", size).collect()}
    want: dict = {}
    centres = {(q, r): (size * math.sqrt(3) * (q + r / 2), size * 1.5 * r) for q in range(-20, 21) for r in range(-15, 16)}
    for x, y in rows:
        cell = min(centres, key=lambda c: (centres[c][0] - x) ** 2 + (centres[c][1] - y) ** 2)
        want[cell] = want.get(cell, 0) + 1
    assert {c: r["count"] for c, r in found.items()} == want
    assert all((r.x, r.y) == pytest.approx(centres[c]) for c, r in found.items())


def test_kernel_is_the_direct_sum(plane):
    _, df = plane
    counts = {(r.binx, r.biny): r["count"] for r in dm.histogram_2d(df, "x", "y", 15, 12).collect()}
    kernel = {d: math.exp(-d * d / 2) for d in range(-4, 5)}
    total = sum(kernel.values())
    want: dict = {}
    for (cx, cy), n in counts.items():
        for dx, wx in kernel.items():
            for dy, wy in kernel.items():
                if 0 <= cx + dx < 15 and 0 <= cy + dy < 12:
                    cell = (cx + dx, cy + dy)
                    want[cell] = want.get(cell, 0) + n * wx * wy / total**2
    got = {(r.binx, r.biny): r.density for r in dm.kernel_density(df, "x", "y", 15, 12).collect()}
    assert got == pytest.approx(want)


def test_no_rows(plane):
    empty = plane[1].filter("x > 1e9")
    assert dm.hexagons(empty, "x", "y").count() == 0 and dm.kernel_density(empty, "x", "y").count() == 0
