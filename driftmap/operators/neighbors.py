"""All neighbours within a radius, without listing the pairs of dense places.

The result of the join ``distance <= eps`` of points with themselves grows with the square of the densest spot. Here it is
kept compressed: pairs of grid cells all of whose points are neighbours are one row, and only pairs at the rim, where two
cells are neither wholly within reach nor wholly out of it, are taken apart: into cells a quarter as wide, and so on,
until few enough points are left to be compared one by one. Rows grow with occupied cells; a spot with any number of
copies is a cell of no extent and always decided as a whole. ``expand`` gives the plain list back.

No cell gathers in one task: cells are summed up with partial sums, and points meet only cells small enough to compare.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.operators.density import CELL_WIDTH, usable_points
from driftmap.operators.scale import cut, cut_counting, lookup

#: Two cells with at most this many pairs of points are compared point by point; each split makes cells a quarter as wide.
_SMALL, _PARTS = 256, 4
_BOX = ["n", "x0", "x1", "y0", "y1"]


class Neighbors(NamedTuple):
    """``whole``: ``depth, ax, ay, bx, by, n_a, n_b``, cells of one depth (each pair once; a cell with itself too) whose points
    all are neighbours; ``single``: ``id, other_id, dist``, the other pairs, each once; ``degree``: ``id, degree``, the number
    of other points within reach of each."""

    whole: DataFrame
    single: DataFrame
    degree: DataFrame


def _cell(depth: int, eps: float) -> list[Column]:
    """Column and row of a point's cell."""
    side = eps * CELL_WIDTH / _PARTS**depth
    return [F.floor(F.col(c) / F.lit(side)).alias(f"c{c}") for c in ("x", "y")]


def _facts(points: DataFrame, depth: int, eps: float, within: DataFrame | None = None) -> DataFrame:
    """Occupied cells with their numbers of points and boxes; ``within`` names the cells of the depth before to look into."""
    placed = points.select("x", "y", *_cell(depth, eps), *[c.alias(n) for c, n in zip(_cell(depth - 1, eps), ("ux", "uy"))] if depth else [])
    up = ["ux", "uy"] if depth else []
    boxes = placed.groupBy(*up, "cx", "cy").agg(
        F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{c}{i}") for c in ("x", "y") for i, f in enumerate((F.min, F.max))]
    )
    return cut(boxes if within is None else boxes.join(within, up, "left_semi"))


def _side(cells: DataFrame, s: str, up: bool = False) -> DataFrame:
    keys = {"cx": f"{s}x", "cy": f"{s}y"} | ({"ux": f"u{s}x", "uy": f"u{s}y"} if up else {})
    return cells.select(*[F.col(c).alias(n) for c, n in keys.items()], F.struct(*_BOX).alias(s))


def _between(far: bool) -> Column:
    """Least or greatest distance between the boxes of two cells; rounding cannot put a pair of their points beyond it."""
    if far:
        span = lambda c: F.greatest(F.abs(F.col(f"b.{c}1") - F.col(f"a.{c}0")), F.abs(F.col(f"a.{c}1") - F.col(f"b.{c}0")))
    else:
        span = lambda c: F.greatest(F.lit(0.0), F.col(f"b.{c}0") - F.col(f"a.{c}1"), F.col(f"a.{c}0") - F.col(f"b.{c}1"))
    return F.sqrt(span("x") * span("x") + span("y") * span("y"))


_PAIR = ["ax", "ay", "bx", "by"]


def _compared(pairs: DataFrame, points: DataFrame, depth: int, eps: float) -> DataFrame:
    """Neighbours among the points of small pairs of cells."""
    ends = [pairs.select(F.col(f"{s}x").alias("cx"), F.col(f"{s}y").alias("cy")) for s in "ab"]
    wanted = ends[0].union(ends[1]).distinct().withColumn("_open", F.lit(True))
    # Cells of open pairs hold at most _SMALL points; the others, however full, stay where they are.
    few = cut(lookup(points.select("id", "x", "y", *_cell(depth, eps)), wanted, ["cx", "cy"], "inner"))
    at = lambda s: few.select(*[F.col(c).alias(f"{s}{c.removeprefix('c')}" if c[0] == "c" else f"{s}_{c}") for c in ("cx", "cy", "id", "x", "y")])
    met = pairs.select(*_PAIR).join(at("a"), ["ax", "ay"]).join(at("b"), ["bx", "by"])
    dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
    found = met.withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= eps)
    return found.select(F.col("a_id").alias("id"), F.col("b_id").alias("other_id"), "dist")


def eps_neighbors(points: DataFrame, eps: float) -> Neighbors:
    """All pairs of ``id, x, y`` within ``eps`` of each other, compressed; points without finite coordinates have none.

    Coordinates are at most 1e9 times ``eps``.
    """
    if not eps > 0:
        raise ValueError("eps must be positive")
    usable, seen = cut_counting(usable_points(points))
    cells = _facts(usable, 0, eps)
    # Cells up to two columns or rows away can be within reach; half of them, so that a pair appears once.
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(3) for j in range(-2, 3) if i or j >= 0]))
    ahead = _side(cells, "a").withColumn("s", steps)
    ahead = ahead.withColumns({"bx": F.col("ax") + F.col("s.i"), "by": F.col("ay") + F.col("s.j")}).drop("s")
    pairs = ahead.join(_side(cells, "b"), ["bx", "by"])
    depth, whole, single, depths = 0, [], [], []
    while True:
        own = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
        state = (
            F.when((own & F.lit(depth == 0)) | (_between(True) <= eps), "whole")
            .when(_between(False) > eps, "none")
            .when(F.col("a.n") * F.col("b.n") <= _SMALL, "small")
            .otherwise("large")
        )
        judged = pairs.withColumn("state", state).filter("state <> 'none'")
        judged, found = cut_counting(judged, **{s: F.col("state") == s for s in ("whole", "small", "large")})
        if found["whole"] or not depth:
            sure = judged.filter("state = 'whole'")
            whole.append(sure.select(F.lit(depth).alias("depth"), *_PAIR, F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")))
            depths.append(depth)
        if found["small"] or not depth:
            single.append(cut(_compared(judged.filter("state = 'small'"), usable, depth, eps)))
        if not found["large"]:
            break
        depth += 1
        rim = judged.filter("state = 'large'").select(*[F.col(c).alias(f"u{c}") for c in _PAIR])
        ends = [rim.select(F.col(f"u{s}x").alias("ux"), F.col(f"u{s}y").alias("uy")) for s in "ab"]
        parts = _facts(usable, depth, eps, ends[0].union(ends[1]).distinct())
        pairs = rim.join(_side(parts, "a", up=True), ["uax", "uay"]).join(_side(parts, "b", up=True), ["ubx", "uby"])
    pieces = []
    for rows in (whole, single):
        merged = rows[0]
        for more in rows[1:]:
            merged = merged.unionByName(more)
        pieces.append(merged)
    whole_rows, single_rows = cut(pieces[0]), pieces[1]

    apart = ~((F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")))
    gained = whole_rows.select("depth", F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.when(apart, F.col("n_b")).otherwise(F.col("n_b") - 1).alias("k"))
    gained = gained.union(whole_rows.filter(apart).select("depth", "bx", "by", "n_a"))
    gained = cut(gained.groupBy("depth", "cx", "cy").agg(F.sum("k").alias("k")))
    counted = usable.withColumn("degree", F.lit(0).cast("bigint"))
    for at in depths:
        sums = gained.filter(F.col("depth") == at).select("cx", "cy", "k")
        counted = lookup(counted.select("id", "x", "y", "degree", *_cell(at, eps)), sums, ["cx", "cy"], at_most=seen["rows"])
        counted = counted.withColumn("degree", F.col("degree") + F.coalesce("k", F.lit(0)))
    ones = single_rows.select("id").union(single_rows.select("other_id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    counted = counted.select("id", "degree").join(ones, "id", "left")
    degree = counted.select("id", (F.col("degree") + F.coalesce("k", F.lit(0))).alias("degree"))
    return Neighbors(whole_rows, single_rows, degree)


def expand_neighbors(points: DataFrame, found: Neighbors, eps: float) -> DataFrame:
    """``id, other_id, dist`` for both orders of every pair: the plain result of the join, as large as it is."""
    usable = cut(usable_points(points))
    listed = [found.single]
    for row in found.whole.select("depth").distinct().collect():  # one a split, as many as the grid has depths
        placed = usable.select("id", "x", "y", *_cell(row["depth"], eps))
        at = lambda s: placed.select(*[F.col(c).alias(n) for c, n in (("cx", f"{s}x"), ("cy", f"{s}y"), ("id", f"{s}_id"), ("x", f"{s}_x"), ("y", f"{s}_y"))])  # noqa: B023, E731
        met = found.whole.filter(F.col("depth") == row["depth"]).select(*_PAIR).join(at("a"), ["ax", "ay"]).join(at("b"), ["bx", "by"])
        own = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))
        met = met.filter(~own | (F.col("a_id") < F.col("b_id")))
        dx, dy = F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")
        listed.append(met.select(F.col("a_id").alias("id"), F.col("b_id").alias("other_id"), F.sqrt(dx * dx + dy * dy).alias("dist")))
    once = listed[0]
    for more in listed[1:]:
        once = once.unionByName(more)
    return once.unionByName(once.select(F.col("other_id").alias("id"), F.col("id").alias("other_id"), "dist"))
