"""Density clustering of 2-D points by joins on grid cells.

The grid cell has the diagonal ``eps``, so all points of one cell are neighbours. That keeps the work near linear:

* a cell with at least ``min_samples`` points makes all of them core points, without looking at pairs;
* only points of sparser cells are compared with the points around them, fewer than ``25 * min_samples`` per cell;
* the core points of a cell are one component from the start, so components are found on the graph of cells;
* two cells are linked if a few extreme points of each lie close enough, and apart if their bounding boxes are too
  far from each other; the few pairs of cells left over are split into finer cells, or compared point by point once
  they are small. No hot cell is ever paired with itself or gathered in one task.

Internal tables carry a level ``g``, so that one pass serves many radii at once; DBSCAN is the case of one level. For many
radii, a point's core distance, found once, says at which levels it is a core point.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.operators.cluster import NOISE
from driftmap.operators.components import connected_components
from driftmap.operators.scale import cut, cut_counting, global_rank, hot_hashes, lookup, split_hot

#: Cells are a little narrower than eps / sqrt(2), so that rounding does not put a cell's points out of reach; this
#: holds for coordinates up to 1e9 times eps.
CELL_WIDTH = (1 - 1e-6) / math.sqrt(2)
#: Two cells with at most this many pairs of points are compared point by point.
_SMALL = 1024
#: Parts into which the points of a hot cell are dealt; the few queries that reach it are copied to each.
_CELL_PARTS = 64

_CELL = ["g", "cx", "cy"]
_AREA = ["g", "lx", "ly"]


def _index(v: str | Column, side: Column) -> Column:
    return F.floor((F.col(v) if isinstance(v, str) else v) / side)


def _offsets(name: str) -> Column:
    return F.explode(F.sequence(F.lit(-2), F.lit(2))).alias(name)


def usable_points(points: DataFrame) -> DataFrame:
    """Points with two finite coordinates."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return points.select("id", F.col("x").cast("double"), F.col("y").cast("double")).filter(
        finite("x") & finite("y")
    )


def _cell_within_reach() -> Column:
    """Whether the cell ``cx, cy`` comes as close to the query as its radius, with room for rounding."""
    side, zero = F.col("r") * CELL_WIDTH, F.lit(0.0)
    gap = lambda c, q: F.greatest(F.col(c) * side - F.col(q), F.col(q) - (F.col(c) + 1) * side, zero)
    gx, gy = gap("cx", "qx"), gap("cy", "qy")
    return F.sqrt(gx * gx + gy * gy) <= F.col("r") * (1 + 1e-6)


def _near(queries: DataFrame, points: DataFrame, min_samples: int, at_most: int) -> DataFrame:
    """Pairs of a query (``g, qid, qx, qy, r, cx, cy``) and a point within its radius, with ``dist``.

    Queries come from cells with fewer than ``min_samples`` points, so fewer than ``25 * min_samples`` reach a cell.
    """
    reach = (
        queries.select("g", "qid", "qx", "qy", "r", "cx", "cy", _offsets("dx"))
        .select("*", _offsets("dy"))
        .withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")})
        .drop("dx", "dy")
        .filter(_cell_within_reach())
    )
    points = points.drop("r")
    hot = hot_hashes(points, _CELL, at_most=at_most)
    if hot:
        # Points of hot cells are dealt into parts, and the fewer than 25 * min_samples queries of a cell meet each part.
        hot_points, points = split_hot(points, _CELL, hot)
        hot_reach, reach = split_hot(reach, _CELL, hot)
        hot_points = hot_points.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(_CELL_PARTS)).cast("int"))
        hot_reach = hot_reach.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(_CELL_PARTS - 1))))
        in_hot = hot_points.join(hot_reach, [*_CELL, "_part"]).drop("_part")
        met = in_hot.unionByName(points.join(reach, _CELL))
    else:
        met = points.join(reach, _CELL)
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    return met.withColumn("dist", F.sqrt(dx * dx + dy * dy)).filter(F.col("dist") <= F.col("r"))


def _as_queries(points: DataFrame) -> DataFrame:
    return points.select(
        "g", F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("y").alias("qy"), "r", "cx", "cy"
    )


def _core_flags(points: DataFrame, min_samples: int) -> tuple[DataFrame, int]:
    """Add ``core`` to points with level ``g`` and radius ``r``: at least ``min_samples`` points, itself included.

    Returns the points, and how many there are.
    """
    side = F.col("r") * CELL_WIDTH
    rows = points.count()
    placed = points.withColumns({"cx": _index("x", side), "cy": _index("y", side)})
    cells = placed.groupBy(*_CELL).agg(F.count("*").alias("_n"))
    counted = cut(lookup(placed, cells, _CELL, "inner", at_most=rows))
    sparse = counted.filter(F.col("_n") < min_samples)
    found = (
        _near(_as_queries(sparse), counted.drop("_n"), min_samples, rows)
        .groupBy("g", "qid")
        .agg(F.count("*").alias("_found"))
        .filter(F.col("_found") >= min_samples)
        .select("g", F.col("qid").alias("id"), F.lit(True).alias("_core"))
    )
    decided = sparse.join(found, ["g", "id"], "left").withColumn("core", F.coalesce("_core", F.lit(False)))
    dense = counted.filter(F.col("_n") >= min_samples).withColumn("core", F.lit(True))
    return cut(dense.unionByName(decided.drop("_core")).drop("_n")), rows


def _extent(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per cell: number of points, smallest id, and its left-, right-, bottom- and topmost points."""
    return points.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.min("id").alias("rep"),
        F.min(F.struct("x", "y")).alias("w"),
        F.max(F.struct("x", "y")).alias("e"),
        F.min(F.struct("y", "x")).alias("s"),
        F.max(F.struct("y", "x")).alias("t"),
    )


def _gap(a: str, b: str) -> Column:
    """Least distance between the bounding boxes of two cells."""
    zero = F.lit(0.0)
    dx = F.greatest(F.col(f"{b}.w.x") - F.col(f"{a}.e.x"), F.col(f"{a}.w.x") - F.col(f"{b}.e.x"), zero)
    dy = F.greatest(F.col(f"{b}.s.y") - F.col(f"{a}.t.y"), F.col(f"{a}.s.y") - F.col(f"{b}.t.y"), zero)
    return F.sqrt(dx * dx + dy * dy)


def _ahead_within_reach() -> Column:
    """Whether the cell ``dx, dy`` ahead comes as close to the cell's points as its link, with room for rounding."""
    side, zero = F.col("link") * CELL_WIDTH, F.lit(0.0)
    low = lambda c: (F.col(f"l{c}") + F.col(f"d{c}")) * side
    gap = lambda c, first, last: F.greatest(low(c) - F.col(f"cell.{last}.{c}"), F.col(f"cell.{first}.{c}") - low(c) - side, zero)
    gx, gy = gap("x", "w", "e"), gap("y", "s", "t")
    return F.sqrt(gx * gx + gy * gy) <= F.col("link") * (1 + 1e-6)


def _closest_extremes(a: str, b: str) -> Column:
    """Least distance between the extreme points of two cells."""
    distances = []
    for p in "west":
        for q in "west":
            dx = F.col(f"{a}.{p}.x") - F.col(f"{b}.{q}.x")
            dy = F.col(f"{a}.{p}.y") - F.col(f"{b}.{q}.y")
            distances.append(F.sqrt(dx * dx + dy * dy))
    return F.least(*distances)


def _links(core: DataFrame, rows: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Cells of core points, and the pairs of cells with two points within ``link`` of each other, some more than once.

    Returns the cells as ``g, lx, ly, rep`` and the links as ``a, b``, structs of level and smallest id of a cell.
    """
    facts = _extent(core, [*_AREA, "link"])
    cells = cut(facts.withColumn("cell", F.struct("n", "w", "e", "s", "t")).drop("n", "w", "e", "s", "t"))

    # Half of the cells around each, so that a pair appears once.
    ahead = cells.select("*", _offsets("dx")).select("*", _offsets("dy"))
    ahead = ahead.filter((F.col("dx") > 0) | ((F.col("dx") == 0) & (F.col("dy") > 0))).filter(_ahead_within_reach())
    first = ahead.select(
        "g",
        "link",
        F.struct("g", "rep").alias("a"),
        F.struct("lx", "ly").alias("ka"),
        F.col("cell").alias("ca"),
        (F.col("lx") + F.col("dx")).alias("lx"),
        (F.col("ly") + F.col("dy")).alias("ly"),
    )
    second = cells.select(*_AREA, F.struct("g", "rep").alias("b"), F.col("cell").alias("cb"))
    pairs = first.join(second, _AREA).withColumn("kb", F.struct("lx", "ly")).drop("lx", "ly")
    linked, small, large, seen = _judge(pairs)
    links = [linked]
    depth = 0
    while seen["small"] or seen["large"]:
        if seen["small"]:
            links.append(_compare_points(small, core, depth, rows, most))
            large = large.join(links[-1], ["a", "b"], "left_anti")
        if not seen["large"]:
            break
        depth += 1
        linked, small, large, seen = _judge(_split(large, core, depth))
        links.append(linked)
        small, large = (d.join(linked, ["a", "b"], "left_anti") for d in (small, large))
    merged = links[0]
    for more in links[1:]:
        merged = merged.unionByName(more)
    return cells, merged


def _judge(pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int]]:
    """Pairs that are linked for sure, small and large pairs still open, and their numbers; the rest is out of reach."""
    linked, small = F.col("_linked"), F.col("ca.n") * F.col("cb.n") <= _SMALL
    judged, seen = cut_counting(
        pairs.filter(_gap("ca", "cb") <= F.col("link")).withColumn(
            "_linked", _closest_extremes("ca", "cb") <= F.col("link")
        ),
        small=~linked & small,
        large=~linked & ~small,
    )
    return (
        judged.filter(linked).select("a", "b"),
        judged.filter(~linked & small).drop("_linked"),
        judged.filter(~linked & ~small).drop("_linked"),
        seen,
    )


def _sub_index(v: str, depth: int) -> Column:
    return _index(v, F.col("link") * CELL_WIDTH / 4**depth)


def _at_depth(core: DataFrame, depth: int) -> DataFrame:
    """Core points with the key of their cell at ``depth``: each step splits a cell in 4 by 4."""
    if depth == 0:
        return core.withColumn("k", F.struct("lx", "ly"))
    return core.withColumn(
        "k", F.struct(_sub_index("x", depth).alias("lx"), _sub_index("y", depth).alias("ly"))
    )


def _split(pairs: DataFrame, core: DataFrame, depth: int) -> DataFrame:
    """Replace both cells of each pair by their parts at ``depth`` that hold points."""
    parts = _extent(
        _at_depth(core, depth - 1).withColumnRenamed("k", "up").transform(lambda d: _at_depth(d, depth)),
        ["g", "link", "up", "k"],
    ).select("g", "up", "k", F.struct("n", "w", "e", "s", "t").alias("cell"))
    touched = pairs.select("g", F.col("ka").alias("up")).union(pairs.select("g", F.col("kb").alias("up"))).distinct()
    parts = cut(parts.join(touched, ["g", "up"], "left_semi"))
    side = lambda s: parts.select(
        "g", F.col("up").alias(f"k{s}"), F.col("k").alias(f"_k{s}"), F.col("cell").alias(f"_c{s}")
    )
    split = pairs.select("g", "link", "a", "b", "ka", "kb").join(side("a"), ["g", "ka"]).join(side("b"), ["g", "kb"])
    return split.select(
        "g", "link", "a", "b",
        F.col("_ka").alias("ka"), F.col("_kb").alias("kb"), F.col("_ca").alias("ca"), F.col("_cb").alias("cb"),
    )


def _compare_points(pairs: DataFrame, core: DataFrame, depth: int, rows: int, most: int) -> DataFrame:
    """Links among small pairs, from their points; a pair brings at most ``_SMALL`` combinations."""
    # Only the cells of open pairs; none of them has more than _SMALL points, so the semi-join also keeps hot cells out.
    open_cells = pairs.select("g", F.col("ka").alias("k")).union(pairs.select("g", F.col("kb").alias("k"))).distinct()
    points = lookup(
        _at_depth(core, depth).select("g", "k", "x", "y"),
        open_cells.withColumn("_open", F.lit(True)),
        ["g", "k"],
        "inner",
        at_most=rows,
        most=most,
    ).drop("_open")
    at = lambda s: points.select(
        "g", F.col("k").alias(f"k{s}"), F.col("x").alias(f"x{s}"), F.col("y").alias(f"y{s}")
    )
    met = pairs.select("g", "link", "a", "b", "ka", "kb").join(at("a"), ["g", "ka"]).join(at("b"), ["g", "kb"])
    dx, dy = F.col("xa") - F.col("xb"), F.col("ya") - F.col("yb")
    return cut(met.filter(F.sqrt(dx * dx + dy * dy) <= F.col("link")).select("a", "b").distinct())


def _components(core: DataFrame, rows: int, most: int) -> DataFrame:
    """Add ``component``, the smallest id among the core points connected to each core point at its level.

    There are at most ``rows`` core points, and at most ``most`` at one level.
    """
    side = F.col("link") * CELL_WIDTH
    placed = core.withColumns({"lx": _index("x", side), "ly": _index("y", side)})
    cells, links = _links(placed, rows, most)
    joined = connected_components(links, most)
    labelled = cells.select(*_AREA, F.struct("g", "rep").alias("node")).join(joined, "node", "left")
    labels = labelled.select(*_AREA, F.coalesce("component.rep", "node.rep").alias("component"))
    return lookup(placed, labels, _AREA, "inner", at_most=rows, most=most).drop("lx", "ly")


def _one_level(points: DataFrame, eps: float) -> DataFrame:
    return usable_points(points).withColumns(
        {"g": F.lit(0), "r": F.lit(float(eps)), "link": F.lit(float(eps))}
    )


def core_points(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """``id, core``: whether at least ``min_samples`` points, itself included, lie within ``eps`` of a point."""
    flagged, _ = _core_flags(_one_level(points, eps), min_samples)
    return flagged.select("id", "core")


def sparse_neighbors(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Neighbours within ``eps`` of the points that are not core points: ``id, other_id, dist``, self left out.

    Each such point has fewer than ``min_samples`` neighbours, so the table grows with the points; the neighbours of
    core points, whose number has no bound, are never listed.
    """
    flagged, rows = _core_flags(_one_level(points, eps), min_samples)
    pairs = _near(_as_queries(flagged.filter(~F.col("core"))), flagged, min_samples, rows)
    return pairs.filter(F.col("qid") != F.col("id")).select(
        F.col("qid").alias("id"), F.col("id").alias("other_id"), "dist"
    )


def numbered(labels: DataFrame, by: Sequence[str], points: DataFrame, rows: int) -> DataFrame:
    """Number the clusters from 0 in order of ``by``; points without one are noise."""
    order = global_rank(labels.select(*by).distinct(), by, "_place")
    placed = lookup(labels, order, by, "inner", at_most=rows)
    return (
        points.select("id")
        .join(placed.select("id", F.col("_place").cast("int").alias("prediction")), "id", "left")
        .withColumn("prediction", F.coalesce("prediction", F.lit(NOISE)))
    )


def dbscan(points: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Exact DBSCAN of ``id, x, y`` with unique ids: ``id, prediction``, -1 for noise.

    Clusters are numbered by their smallest core id, and a border point joins the lowest-numbered cluster within reach,
    as a scan in id order would do. Points without coordinates are noise.
    """
    flagged, rows = _core_flags(_one_level(points, eps), min_samples)
    core = cut(_components(flagged.filter("core"), rows, rows).select("g", "id", "x", "y", "cx", "cy", "component"))
    border = (
        _near(_as_queries(flagged.filter(~F.col("core"))), core, min_samples, rows)
        .groupBy("qid")
        .agg(F.min("component").alias("component"))
        .select(F.col("qid").alias("id"), "component")
    )
    labels = cut(core.select("id", "component").unionByName(border))
    return numbered(labels, ["component"], points, rows)


def _radii(points: DataFrame, min_samples: int, alpha: float, levels: int) -> list[float]:
    """Falling radii, in equal ratios, from one that reaches all points to one that only the densest stay within.

    How many points lie in well-filled cells is counted for grids, each twice as fine as the one before: 24 at a time,
    until well-filled cells hold fewer than a hundredth of the points or every place has a cell of its own.
    """
    box = points.agg(
        F.count("*").alias("n"),
        F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("width"),
    ).head()
    if not box["n"] or not box["width"]:
        return [1.0]
    places = points.groupBy("x", "y").agg(F.count("*").alias("n"))
    different = places.count()
    held: list[int] = []
    # Past 1000 halvings no two different doubles of the box share a cell.
    while len(held) < 1000 and (not held or held[-1] >= 0.01 * box["n"]):
        first = len(held)
        grids = places.select("x", "y", "n", F.explode(F.sequence(F.lit(first), F.lit(first + 23))).alias("j"))
        side = F.lit(box["width"]) / F.pow(F.lit(2.0), F.col("j"))
        cells = grids.groupBy("j", *[F.rint(F.col(c) / side) for c in ("x", "y")]).agg(F.sum("n").alias("n"))
        filled = cells.groupBy("j").agg(
            F.sum(F.when(F.col("n") > min_samples, F.col("n"))).alias("n"), F.count("*").alias("cells")
        )
        rows = {r["j"]: r for r in filled.collect()}
        held += [rows[j]["n"] or 0 for j in range(first, first + 24)]
        if rows[first + 23]["cells"] == different:
            break
    coarse = max([j for j, n in enumerate(held) if n >= 0.99 * box["n"]], default=0)
    fine = max([j for j, n in enumerate(held) if n >= 0.01 * box["n"]], default=coarse)
    top = box["width"] / 2**coarse * 1.5 / min(alpha, 1.0)
    bottom = box["width"] / 2**fine / 4
    if levels == 1:
        return [top]
    ratio = (bottom / top) ** (1 / (levels - 1))
    return [top * ratio**i for i in range(levels)]


def density_levels(
    points: DataFrame, radii: Sequence[float], min_samples: int, alpha: float = 1.0
) -> DataFrame:
    """Components of dense points at falling radii: ``g, id, component``, with ``g`` the place in ``radii``.

    A point is dense at a radius if its ``min_samples``-th other point lies within it; dense points are joined if they
    lie within ``alpha`` times the radius. Components at one level are unions of those at the next.
    """
    # That module takes its clusters from this one.
    from driftmap.operators.hierarchy import core_distances

    steps = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(float(r)).alias("r")) for i, r in enumerate(radii)])
    at_levels = lambda df: df.select("*", F.inline(steps)).withColumn("link", F.col("r") * float(alpha))
    usable, seen = cut_counting(usable_points(points))
    by_id = usable.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if by_id.filter((F.col("n") > 1) | F.col("id").isNull()).isEmpty():
        known = usable.join(core_distances(usable, min_samples), "id").filter(F.col("core") < math.inf)
        core, found = cut_counting(at_levels(known).filter(F.col("core") <= F.col("r")).drop("core"))
        rows = found["rows"]
    else:  # ids that name no single point: neighbours are counted by id at every level
        flagged, rows = _core_flags(at_levels(usable), min_samples + 1)
        core = flagged.filter("core").drop("core", "cx", "cy")
    return cut(_components(core, rows, seen["rows"]).select("g", "id", "component"))


def density_tree(
    points: DataFrame,
    min_cluster_size: int = 20,
    min_samples: int = 10,
    alpha: float = 0.4,
    levels: int | Sequence[float] = 32,
) -> DataFrame:
    """Clusters of varying density, by excess of mass over a tree of levels: ``id, prediction``, -1 for noise.

    The hierarchy of mutual-reachability components is taken at ``levels`` radii instead of at every distance, so the
    result approximates that of the full hierarchy, closer with more levels. ``levels`` may also list the radii, falling.
    A component with at least ``min_cluster_size`` points goes on as the same cluster while it does not split in two or
    more of that size. Its stability is the sum over levels of its size times the gain in 1/radius; a cluster is kept
    if it is at least as stable as the best choice among its parts. The root, holding everything, is never kept.
    """
    usable, seen = cut_counting(usable_points(points))
    usable_rows = seen["rows"]
    radii = list(levels) if isinstance(levels, Sequence) else _radii(usable, min_samples, alpha, levels)
    members = density_levels(usable, radii, min_samples, alpha)
    inverse = [1.0 / r for r in radii]
    before = [inverse[0] ** 2 / inverse[1] if len(radii) > 1 else 0.0, *inverse[:-1]]
    gains = F.array(*[F.lit(now - then) for now, then in zip(inverse, before)])

    sizes = members.groupBy("g", "component").agg(F.count("*").alias("size"))
    nodes = cut(sizes.filter(F.col("size") >= min_cluster_size))
    if nodes.isEmpty():
        return points.select("id", F.lit(NOISE).alias("prediction"))
    # A component is named by one of its points, so its parent is that point's component one level up.
    up = members.select((F.col("g") + 1).alias("g"), F.col("id").alias("component"), F.col("component").alias("up"))
    linked = nodes.join(up, ["g", "component"], "left").withColumn(
        "parent", F.struct((F.col("g") - 1).alias("g"), F.coalesce("up", F.lit(-1).cast("bigint")).alias("component"))
    )
    brothers = linked.groupBy("parent").agg(F.count("*").alias("_parts"))
    tree = cut(
        lookup(linked, brothers, ["parent"], "inner").select(
            F.struct("g", "component").alias("node"),
            "parent",
            (F.col("size") * F.element_at(gains, F.col("g") + 1)).alias("mass"),
            (F.col("_parts") > 1).alias("born"),
        )
    )
    heads = _heads(tree)
    clusters = heads.groupBy("head").agg(
        F.sum("mass").alias("stability"),
        F.max(F.when(F.col("node") == F.col("head"), F.col("parent"))).alias("above"),
    )
    named = heads.select(F.col("node").alias("above"), F.col("head").alias("outer"))
    clusters = cut(clusters.filter(F.col("head.g") >= 0).join(named, "above", "left").drop("above"))
    if clusters.isEmpty():  # only the root, which is never kept
        return points.select("id", F.lit(NOISE).alias("prediction"))
    kept = excess_of_mass(clusters)

    in_kept = heads.join(kept, "head", "left_semi").select("node.g", "node.component", "head")
    held = lookup(members, cut(in_kept), ["g", "component"], "inner", most=usable_rows)
    # Of nested choices the outermost wins.
    labels = held.groupBy("id").agg(F.min("head").alias("head"))
    labels = cut(labels.select("id", F.col("head.component").alias("component"), F.col("head.g").alias("g")))
    return numbered(labels, ["component", "g"], points, usable_rows)


def _heads(tree: DataFrame) -> DataFrame:
    """Add ``head``: the node at which the cluster of each node was born; the root's is at level -1."""
    heads = cut(tree.withColumn("head", F.when(F.col("born"), F.col("node")).otherwise(F.col("parent"))))
    while True:
        step = heads.select(F.col("node").alias("head"), F.col("head").alias("_next"))
        longer = heads.join(step, "head", "left").withColumn("_to", F.coalesce("_next", "head"))
        longer, seen = cut_counting(longer, moved=F.col("_to") != F.col("head"))
        heads = longer.drop("head", "_next").withColumnRenamed("_to", "head")
        if not seen["moved"]:
            return heads


def excess_of_mass(clusters: DataFrame) -> DataFrame:
    """Heads of the clusters at least as stable as the best choice among the clusters inside them.

    The best of a cluster is ``max(stability, sum of its parts' best)``. Parts that are known are added up; a cluster with one
    unknown part depends on it by ``max(a, x + b)``, and such steps are composed by doubling, so that neither deep nor broad
    trees take many rounds.
    """
    none = F.lit(None)
    nodes, seen = cut_counting(
        clusters.select(
            "head", "outer", "stability", none.cast("double").alias("best"),
            F.when(F.lit(False), F.col("head")).alias("on"), none.cast("double").alias("a"), none.cast("double").alias("b"),
        )
    )
    rows = seen["rows"]
    open_ = F.col("best").isNull()

    def parts(nodes: DataFrame) -> DataFrame:
        known = nodes.filter(F.col("outer").isNotNull()).groupBy(F.col("outer").alias("head"))
        return known.agg(
            F.count_if(open_).alias("waiting"), F.sum("best").alias("inside"), F.max(F.when(open_, F.col("head"))).alias("only")
        )

    while True:
        met = lookup(nodes, parts(nodes), ["head"], at_most=rows)
        inside, waiting = F.coalesce("inside", F.lit(0.0)), F.coalesce("waiting", F.lit(0))
        starts = open_ & (waiting == 1) & F.col("on").isNull()
        begun = cut(
            met.select(
                "head", "outer", "stability",
                F.when(open_ & (waiting == 0), F.greatest("stability", inside)).otherwise(F.col("best")).alias("best"),
                *[F.when(starts, new).otherwise(F.col(c)).alias(c) for c, new in (("on", F.col("only")), ("a", F.col("stability")), ("b", inside))],
            )
        )
        step = begun.select(F.col("head").alias("on"), *[F.col(c).alias(f"_{c}") for c in ("best", "on", "a", "b")])
        met = lookup(begun, step, ["on"], at_most=rows)
        further = F.col("_best").isNull() & F.col("_on").isNotNull()
        nodes, seen = cut_counting(
            met.select(
                "head", "outer", "stability",
                F.when(open_ & F.col("_best").isNotNull(), F.greatest(F.col("a"), F.col("_best") + F.col("b")))
                .otherwise(F.col("best")).alias("best"),
                F.when(further, F.col("_on")).otherwise(F.col("on")).alias("on"),
                F.when(further, F.greatest(F.col("a"), F.col("_a") + F.col("b"))).otherwise(F.col("a")).alias("a"),
                F.when(further, F.col("b") + F.col("_b")).otherwise(F.col("b")).alias("b"),
            ),
            open=open_,
        )
        if not seen["open"]:
            break
    final = lookup(nodes, parts(nodes), ["head"], at_most=rows)
    return cut(final.filter(F.col("stability") >= F.coalesce("inside", F.lit(0.0))).select("head"))
