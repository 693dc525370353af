"""The exact hierarchy of density clusters of 2-D points: spanning tree, dendrogram, condensed tree.

Two points are joined at the *mutual reachability* ``max(core(a), core(b), distance / alpha)``, where a point's core
distance is that of its ``min_samples``-th other point. The components at every distance form one tree; clusters are its
branches of at least ``min_cluster_size`` points, and those are kept whose excess of mass is largest.

* **Places.** Points at one spot are one place with a number of copies, so a spot of any size is one row.
* **Blocks.** Places are put in Morton order, range-partitioned, and cut into blocks of equal counts; 16 blocks in a row
  make a node of the next level, and so on: a packed tree of boxes whose parent and child numbers are arithmetic.
* **Core distances** are found inside a block first; then every block goes down the tree, past boxes out of its reach,
  and meets the few blocks that are left.
* **Spanning tree** by Borůvka rounds: every component looks for its nearest foreign place. Blocks keep their own spanning
  tree, so the best link inside a block is known without pairs; beyond it, boxes bound the reachability from below and
  above, nodes that lie in the component itself are passed by, and only blocks that may hold a shorter link are opened.
  Components at least halve each round.
* **Dendrogram.** Links in order of length are cut into chunks. What the links before a chunk have joined is found by
  halving: the first half's components are contracted in the second, for all ranges at once, in ``log2(chunks)`` steps.
  Then every chunk is merged by one task. Links of equal length count as one merge of many parts, so the tree is unique.
* **Clusters** are chains of merges; chains are found as components, outermost choices by doubling.

Every table has rows in proportion to the places, whatever the densities; there is no list of levels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.operators.cluster import NOISE
from driftmap.operators.components import connected_components, follow
from driftmap.operators.density import excess_of_mass, numbered, usable_points
from driftmap.operators.scale import cut, cut_counting, global_rank, lookup

#: Places in a block (up to twice as many), children of a node, and links merged by one task.
BLOCK, FAN, CHUNK = 512, 16, 200_000
#: Blocks to a file, hence about to a task: few bytes, but some seconds of work. Most files of one table.
_TOGETHER, _FILES = 8, 2_000


def _spread(v: Column) -> Column:
    """The lower 26 bits of ``v`` with a gap after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _places(points: DataFrame) -> tuple[DataFrame, int]:
    """``place, x, y, n``: different spots, numbered in Morton order, with their numbers of points."""
    spots = cut(points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    box = spots.agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("x", "y")]).head()
    if box["min_x"] is None:
        return spots.withColumn("place", F.lit(0).cast("bigint")), 0
    width = max(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])
    # A width beyond all doubles, or next to nothing, leaves the order to the coordinates alone.
    scale = (2**26 - 1) / width if 1e-290 < width < math.inf else 0.0
    cell = lambda c: F.floor((F.col(c) - F.lit(box[f"min_{c}"])) * F.lit(scale)).cast("bigint")
    code = _spread(cell("x")).bitwiseOR(F.shiftleft(_spread(cell("y")), 1))
    ranked = global_rank(spots.withColumn("_code", code if scale else F.lit(0)), ["_code", "x", "y"], "place")
    places, seen = cut_counting(ranked.drop("_code"))
    return places, seen["rows"]


def _distance(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    dx, dy = x[:, None] - u[None, :], y[:, None] - v[None, :]
    return np.sqrt(dx * dx + dy * dy)


def _row_map(df: DataFrame, f: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """Every row, whose arrays come as numpy arrays, becomes the rows that ``f`` returns."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {}
                for name in batch.schema.names:
                    value = batch.column(name)[i]
                    array = isinstance(value, pa.ListScalar) and value.is_valid
                    row[name] = value.values.to_numpy(zero_copy_only=False) if array else value.as_py()
                made = f(row)
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*made)], names)

    return df.mapInArrow(run, schema)


def _packed(places: DataFrame, cols: list[str], number: int) -> DataFrame:
    """``block, first`` and one array per column: the places of each of ``number`` blocks in order, spread over files."""
    rows = F.array_sort(F.collect_list(F.struct("place", *cols)))
    files = min(-(-number // _TOGETHER), _FILES)
    grouped = places.repartition(files, "block").groupBy("block").agg(F.min("place").alias("first"), rows.alias("_rows"))
    return cut(grouped.select("block", "first", *[F.col(f"_rows.{c}").alias(c) for c in cols]))


def _levels(nodes: DataFrame, count: int, sums: Callable[[], list[Column]]) -> list[DataFrame]:
    """Tables of nodes, ``node`` and what ``sums`` keeps, from the blocks up to at most ``FAN`` nodes."""
    levels = [nodes]
    while count > FAN:
        count = -(-count // FAN)
        up = F.floor(F.col("node") / FAN).cast("bigint").alias("node")
        levels.append(cut(levels[-1].groupBy(up).agg(*sums())))
    return levels


def _boxes() -> list[Column]:
    return [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1")]


def _gap(far: bool = False) -> Column:
    """Least (or greatest) distance between the box ``q`` and the node's box."""
    if far:
        side = lambda a, b: F.greatest(F.abs(F.col(f"q.{b}") - F.col(a)), F.abs(F.col(b) - F.col(f"q.{a}")))
    else:
        side = lambda a, b: F.greatest(F.lit(0.0), F.col(a) - F.col(f"q.{b}"), F.col(f"q.{a}") - F.col(b))
    dx, dy = side("x0", "x1"), side("y0", "y1")
    return F.sqrt(dx * dx + dy * dy)


def _descend(
    queries: DataFrame, count: int, levels: list[DataFrame], keep: Callable[[DataFrame, int], DataFrame]
) -> DataFrame:
    """``block, q, node``: pairs of the ``count`` blocks that ``keep`` leaves, level by level, given the pairs and their number."""
    top = -(-count // FAN ** (len(levels) - 1))
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(top - 1).cast("bigint")))
    pairs, rows = queries.select("*", first.alias("node")), count * top
    for depth, nodes in enumerate(reversed(levels)):
        if depth:
            child = F.explode(F.sequence(F.col("node") * FAN, F.col("node") * FAN + (FAN - 1)))
            pairs, rows = pairs.select(*queries.columns, child.alias("node")), rows * FAN
        met = lookup(pairs, nodes, ["node"], "inner", at_most=rows)
        pairs, seen = cut_counting(keep(met, rows).select(*queries.columns, "node"))
        rows = seen["rows"]
    return pairs.filter(F.col("node") != F.col("block"))


def _opened(pairs: DataFrame, blocks: DataFrame, cols: list[str], other: list[str]) -> DataFrame:
    """Pairs of blocks with the arrays of both, those of the second with ``r_`` before their names."""
    second = blocks.select(F.col("block").alias("node"), *[F.col(c).alias(f"r_{c}") for c in other])
    return pairs.join(blocks.select("block", *cols), "block").join(second, "node")


def _core_blocks(places: DataFrame, count: int, min_samples: int, block: int) -> tuple[DataFrame, int]:
    """Blocks ``block, first, x, y, n, core`` with the exact core distances, and their number."""
    number = max(1, count // max(block, min_samples + 1))
    in_block = F.floor(F.col("place") * number / count).cast("bigint")
    placed = cut(places.withColumn("block", in_block))
    blocks = _packed(placed, ["x", "y", "n"], number)

    def inside(row: dict) -> list[tuple]:
        x, y, n = row["x"], row["y"], row["n"]
        d = _distance(x, y, x, y)
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(n[order], axis=1)
        enough = held >= min_samples + 1
        at = np.where(enough[:, -1], enough.argmax(1), len(x) - 1)
        reach = np.where(enough[:, -1], np.take_along_axis(d, order, 1)[np.arange(len(x)), at], np.inf)
        return [(row["block"], row["first"], x, y, n, reach, float(reach.max()))]

    doubles = "x array<double>, y array<double>, n array<bigint>"
    local = cut(_row_map(blocks, inside, f"block bigint, first bigint, {doubles}, reach array<double>, most double"))
    if number == 1:
        return local.withColumnRenamed("reach", "core").drop("most"), 1

    box = F.struct(F.array_min("x").alias("x0"), F.array_max("x").alias("x1"), F.array_min("y").alias("y0"), F.array_max("y").alias("y1"))
    nodes = cut(local.select(F.col("block").alias("node"), box.alias("b")).select("node", "b.*"))
    levels = _levels(nodes, number, _boxes)
    queries = local.select("block", box.alias("q"), "most")
    near = _descend(queries, number, levels, lambda met, _: met.filter(_gap() <= F.col("most")))

    def across(row: dict) -> list[tuple]:
        u, v = row["r_x"], row["r_y"]
        dx = np.maximum(np.maximum(u.min() - row["x"], row["x"] - u.max()), 0)
        dy = np.maximum(np.maximum(v.min() - row["y"], row["y"] - v.max()), 0)
        reached = np.flatnonzero(np.sqrt(dx * dx + dy * dy) <= row["reach"])
        d = _distance(row["x"][reached], row["y"][reached], u, v)
        made = []
        for i, place in enumerate(reached):
            close = np.flatnonzero(d[i] <= row["reach"][place])
            close = close[np.argsort(d[i][close], kind="stable")][: min_samples + 1]
            if len(close):
                made.append((row["first"] + place, d[i][close], row["r_n"][close]))
        return made

    found = "place bigint, d array<double>, m array<bigint>"
    other = cut(_row_map(_opened(near, local, ["first", "x", "y", "reach"], ["x", "y", "n"]), across, found))

    def own(row: dict) -> list[tuple]:
        d = _distance(row["x"], row["y"], row["x"], row["y"])
        made = []
        for i in range(len(d)):
            close = np.flatnonzero(d[i] <= row["reach"][i])
            close = close[np.argsort(d[i][close], kind="stable")][: min_samples + 1]
            made.append((row["first"] + i, d[i][close], row["n"][close]))
        return made

    # Only places that another block may be near to look again.
    asked = other.select("place").distinct()
    mine = _row_map(local.select("first", "x", "y", "n", "reach"), own, found).join(asked, "place", "left_semi")
    # min_samples + 1 distances from each block within reach.
    merged = other.unionByName(mine).groupBy("place").agg(
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("d", "m")))).alias("c")
    )
    state = F.struct(F.lit(0).cast("bigint").alias("held"), F.lit(None).cast("double").alias("d"))
    core = F.aggregate(
        "c",
        state,
        lambda s, c: F.struct(
            (s["held"] + c["m"]).alias("held"),
            F.when(s["d"].isNotNull(), s["d"]).when(s["held"] + c["m"] >= min_samples + 1, c["d"]).alias("d"),
        ),
    )["d"]
    again = merged.select("place", core.alias("again"))
    before = local.select(F.posexplode("reach").alias("i", "reach"), "first").select((F.col("first") + F.col("i")).alias("place"), "reach")
    known = placed.join(before, "place").join(again, "place", "left").withColumn("core", F.coalesce("again", "reach"))
    return _packed(known, ["x", "y", "n", "core"], number), number


def _lowest(w: np.ndarray, lo: np.ndarray, hi: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Index of the first link, by length and then by its ends, of each group."""
    order = np.lexsort((hi, lo, w, group))
    first = np.ones(len(order), bool)
    first[1:] = group[order][1:] != group[order][:-1]
    return order[first]


def _own_tree(x: np.ndarray, y: np.ndarray, core: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning tree of a block's places as ends and lengths; of equal lengths, the lower numbers go first."""
    count = len(x)
    w = np.maximum(np.maximum(core[:, None], core[None, :]), _distance(x, y, x, y) / alpha)
    best, source, out = np.full(count, np.inf), np.zeros(count, np.int64), np.ones(count, bool)
    ends, at, numbers = [], 0, np.arange(count)
    for _ in range(count - 1):
        out[at] = False
        lo, hi = np.minimum(at, numbers), np.maximum(at, numbers)
        was_lo, was_hi = np.minimum(source, numbers), np.maximum(source, numbers)
        earlier = (lo < was_lo) | ((lo == was_lo) & (hi < was_hi))
        better = out & ((w[at] < best) | ((w[at] == best) & earlier))
        best[better], source[better] = w[at][better], at
        ties = np.flatnonzero(out & (best == best[out].min()))
        lo, hi = np.minimum(source[ties], ties), np.maximum(source[ties], ties)
        pick = np.lexsort((hi, lo))[0]
        at = int(ties[pick])
        ends.append((lo[pick], hi[pick], best[at]))
    lo, hi, length = zip(*ends) if ends else ((), (), ())
    return np.array(lo, np.int64), np.array(hi, np.int64), np.array(length, float)


_LINKS = "component bigint, w double, lo bigint, hi bigint, other bigint"


def _first_link(links: DataFrame) -> DataFrame:
    """The shortest link of each component."""
    best = links.groupBy("component").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("l"))
    return best.select("component", "l.*")


def _spanning_tree(blocks: DataFrame, number: int, rows: int, alpha: float) -> DataFrame:
    """``lo, hi, w``: the shortest tree of links between all ``rows`` places."""

    def grow(row: dict) -> list[tuple]:
        lo, hi, w = _own_tree(row["x"], row["y"], row["core"], alpha)
        return [(row["block"], row["first"], row["x"], row["y"], row["core"], lo + row["first"], hi + row["first"], w)]

    schema = "block bigint, first bigint, x array<double>, y array<double>, core array<double>, lo array<bigint>, hi array<bigint>, w array<double>"
    blocks = cut(_row_map(blocks.select("block", "first", "x", "y", "core"), grow, schema))
    if number == 1:
        return cut(blocks.select(F.explode(F.arrays_zip("lo", "hi", "w")).alias("l")).select("l.*"))

    facts = blocks.select(
        "block",
        *[f(c).alias(n) for f, c, n in ((F.array_min, "x", "x0"), (F.array_max, "x", "x1"), (F.array_min, "y", "y0"),
                                        (F.array_max, "y", "y1"), (F.array_min, "core", "low"), (F.array_max, "core", "high"))],
    )
    facts = cut(facts)
    state = cut(blocks.select("block", F.sequence("first", F.col("first") + F.size("x") - 1).alias("component")))

    def inside(row: dict) -> list[tuple]:
        a, b = (row["component"][row[c] - row["first"]] for c in ("lo", "hi"))
        cross = np.flatnonzero(a != b)
        if not len(cross):
            return []
        lo, hi, w = (np.concatenate([row[c][cross]] * 2) for c in ("lo", "hi", "w"))
        mine, other = np.concatenate([a[cross], b[cross]]), np.concatenate([b[cross], a[cross]])
        return [(mine[i], w[i], lo[i], hi[i], other[i]) for i in _lowest(w, lo, hi, mine)]

    def across(row: dict) -> list[tuple]:
        w = np.maximum(row["core"][:, None], row["r_core"][None, :])
        w = np.maximum(w, _distance(row["x"], row["y"], row["r_x"], row["r_y"]) / alpha)
        w[row["component"][:, None] == row["r_component"][None, :]] = np.inf
        # The first of equal lengths is the one with the lower number.
        j = w.argmin(1)
        length, other = w[np.arange(len(w)), j], row["r_component"][j]
        mine, theirs = row["first"] + np.arange(len(w)), row["r_first"] + j
        lo, hi = np.minimum(mine, theirs), np.maximum(mine, theirs)
        kept = [i for i in _lowest(length, lo, hi, row["component"]) if length[i] < np.inf]
        return [(row["component"][i], length[i], lo[i], hi[i], other[i]) for i in kept]

    sums = lambda: [*_boxes(), F.min("low").alias("low"), F.max("high").alias("high"), F.min("c0").alias("c0"), F.max("c1").alias("c1")]
    tree, left = [], rows
    while left > 1:
        current = blocks.join(state, "block")
        own = cut(_first_link(_row_map(current.select("first", "lo", "hi", "w", "component"), inside, _LINKS)))
        colours = state.select("block", F.array_min("component").alias("c0"), F.array_max("component").alias("c1"))
        described = cut(facts.join(colours, "block"))
        levels = _levels(described.withColumnRenamed("block", "node"), number, sums)
        # How far the components of a block need to look; those that lie in whole blocks only have no link yet.
        known = state.select("block", F.explode(F.array_distinct("component")).alias("component"))
        reach = lookup(known, own.select("component", "w"), ["component"], at_most=rows)
        reach = reach.groupBy("block").agg(F.max(F.coalesce("w", F.lit(math.inf))).alias("most"))
        box = F.struct("x0", "x1", "y0", "y1", "low", "c0", "c1").alias("q")
        queries = cut(described.select("block", box).join(reach, "block"))
        alone = F.col("q.c0") == F.col("q.c1")

        def keep(met: DataFrame, at_most: int) -> DataFrame:
            least = F.greatest(F.col("q.low"), F.col("low"), _gap() / alpha)
            most = F.greatest(F.col("q.low"), F.col("high"), _gap(far=True) / alpha)
            foreign = met.filter(~(alone & (F.col("c0") == F.col("c1")) & (F.col("c0") == F.col("q.c0"))))
            foreign = foreign.withColumns({"_least": least, "_c": F.when(alone, F.col("q.c0")), "_top": most})
            # Some link of a component is at most as long as the farthest a foreign node can be.
            bounds = foreign.filter(F.col("_c").isNotNull()).groupBy("_c").agg(F.min("_top").alias("_bound"))
            met = lookup(foreign, bounds, ["_c"], at_most=at_most)
            return met.filter(F.col("_least") <= F.least("most", F.coalesce("_bound", F.lit(math.inf))))

        pairs = _descend(queries, number, levels, keep).select("block", "node")
        cols = ["first", "x", "y", "core", "component"]
        beyond = _row_map(_opened(pairs, current, cols, cols), across, _LINKS)
        chosen, seen = cut_counting(_first_link(own.unionByName(beyond)))
        tree.append(chosen.select("lo", "hi", "w").distinct())
        # Every component goes to the other end of its link; of two that chose the same link the smaller stays.
        back = chosen.select(F.col("component").alias("other"), F.col("other").alias("_back"))
        hooks = lookup(chosen.select("component", "other"), back, ["other"], at_most=seen["rows"])
        end = F.when((F.col("_back") == F.col("component")) & (F.col("component") < F.col("other")), F.col("component"))
        hooks = hooks.select(F.col("component").alias("node"), F.coalesce(end, "other").alias("component"))
        moved = follow(cut(hooks), seen["rows"])
        left = moved.filter("node = component").count()
        to = moved.withColumnsRenamed({"component": "_to", "node": "component"})
        names = lookup(known, to, ["component"], "inner", at_most=rows)
        names = names.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("component", "_to"))).alias("names"))
        renamed = state.join(names.select("block", F.col("names.component").alias("old"), F.col("names._to").alias("new")), "block")
        state = cut(
            _row_map(
                renamed,
                lambda row: [(row["block"], row["new"][np.searchsorted(row["old"], row["component"])])],
                "block bigint, component array<bigint>",
            )
        )
    merged = tree[0]
    for more in tree[1:]:
        merged = merged.unionByName(more)
    return cut(merged)


def reachability_tree(points: DataFrame, min_samples: int = 10, alpha: float = 1.0, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Places ``place, x, y, n, core`` and the shortest tree of links ``lo, hi, w`` between them by mutual reachability.

    ``points`` has ``x, y``; points without finite coordinates are left out. Links between copies at one place, as long as its
    core distance, are not listed.
    """
    if not alpha > 0 or min_samples < 0:
        raise ValueError("alpha must be positive and min_samples not negative")
    spots = points.select(F.lit(0).alias("id"), "x", "y")
    places, count = _places(usable_points(spots).withColumns({"x": F.col("x") + 0.0, "y": F.col("y") + 0.0}))
    if not count:
        empty = places.select("place", "x", "y", "n", F.lit(0.0).alias("core"))
        return empty, places.select(F.col("place").alias("lo"), F.col("place").alias("hi"), F.lit(0.0).alias("w"))
    blocks, number = _core_blocks(places, count, min_samples, BLOCK if block is None else block)
    blocks = cut(blocks)
    cores = blocks.select("first", F.posexplode("core").alias("i", "core"))
    cores = cores.select((F.col("first") + F.col("i")).alias("place"), "core")
    return cut(places.join(cores, "place").select("place", "x", "y", "n", "core")), _spanning_tree(blocks, number, count, alpha)


def core_distances(points: DataFrame, min_samples: int = 10, block: int | None = None) -> DataFrame:
    """``id, core``: the distance of each point's ``min_samples``-th other point, infinite if there are fewer."""
    usable = cut(usable_points(points).withColumns({"x": F.col("x") + 0.0, "y": F.col("y") + 0.0}))
    places, count = _places(usable)
    if not count:
        return usable.select("id", F.lit(math.inf).alias("core"))
    blocks, _ = _core_blocks(places, count, min_samples, BLOCK if block is None else block)
    found = blocks.select(F.explode(F.arrays_zip("x", "y", "core")).alias("p")).select("p.*")
    return lookup(usable, found, ["x", "y"], "inner").select("id", "core")


def _chunked(links: DataFrame, places: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """Links ``at, w, chunk, u, v`` in order of length, with the size and the last link (NULL for a place) of what ``u`` and ``v``
    stand for: components of all links in the chunks before."""
    ordered, seen = cut_counting(global_rank(links, ["w", "lo", "hi"], "at"))
    chunks = max(1, -(-seen["rows"] // chunk))
    edges = ordered.select("at", "w", F.floor(F.col("at") / chunk).cast("bigint").alias("chunk"), F.col("lo").alias("u"), F.col("hi").alias("v"))
    facts = places.select(F.lit(0).cast("bigint").alias("part"), F.col("place").alias("node"), F.col("n").alias("size"), F.lit(None).cast("bigint").alias("last"))
    steps = (chunks - 1).bit_length()
    for step in reversed(range(steps)):
        edges = edges.withColumns({"part": F.shiftright("chunk", step + 1), "late": F.shiftright("chunk", step) % 2 == 1})
        edges, facts = cut(edges), cut(facts)
        early = edges.filter(~F.col("late"))
        key = lambda c: F.struct("part", F.col(c).alias("node"))
        joined = connected_components(early.select(key("u").alias("a"), key("v").alias("b")))
        to = cut(joined.select("node.part", "node.node", F.col("component.node").alias("_to")))
        # What each component of the first half has become: its size, and the last of its links.
        sizes = lookup(facts, to, ["part", "node"], "inner").groupBy("part", "_to").agg(F.sum("size").alias("size"))
        ends = lookup(early.select("part", F.col("u").alias("node"), "at"), to, ["part", "node"], "inner")
        made = sizes.join(ends.groupBy("part", "_to").agg(F.max("at").alias("last")), ["part", "_to"])
        late = edges.filter("late")
        for side in ("u", "v"):
            late = lookup(late, to.withColumnRenamed("node", side), ["part", side])
            late = late.withColumn(side, F.coalesce("_to", side)).drop("_to")
        late = cut(late)
        use = lambda rows: rows.select("part", F.col("u").alias("node")).union(rows.select("part", F.col("v").alias("node"))).distinct()
        old = facts.join(use(early), ["part", "node"], "left_semi").withColumn("part", F.col("part") * 2)
        new = made.withColumnRenamed("_to", "node").select("part", "node", "size", "last")
        same = facts.join(to, ["part", "node"], "left_anti")
        late_facts = new.unionByName(same).join(use(late), ["part", "node"], "left_semi").withColumn("part", F.col("part") * 2 + 1)
        facts = old.unionByName(late_facts)
        edges = early.unionByName(late)
    edges = edges.drop("part", "late")
    facts = cut(facts.withColumnRenamed("part", "chunk"))
    for side in ("u", "v"):
        known = facts.withColumnsRenamed({"node": side, "size": f"{side}_size", "last": f"{side}_last"})
        edges = lookup(edges, known, ["chunk", side], "inner", at_most=seen["rows"])
    return cut(edges), seen["rows"]


_MERGES = "at bigint, w double, size bigint, a_link bigint, a_place bigint, b_link bigint, b_place bigint"


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """All merges of one chunk, in order: the two parts of each, named by their last link or by their place."""
    frame = frame.sort_values("at")
    nodes = pd.unique(np.concatenate([frame["u"].to_numpy(), frame["v"].to_numpy()]))
    number = {node: i for i, node in enumerate(nodes.tolist())}
    parent = list(range(len(nodes)))
    size, last = [0] * len(nodes), [-1] * len(nodes)
    for side in ("u", "v"):
        lasts = frame[f"{side}_last"].fillna(-1).astype("int64").tolist()
        for node, n, link in zip(frame[side].tolist(), frame[f"{side}_size"].tolist(), lasts):
            size[number[node]], last[number[node]] = n, link
    place = nodes.tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    made = []
    for at, w, u, v in zip(frame["at"].tolist(), frame["w"].tolist(), frame["u"].tolist(), frame["v"].tolist()):
        a, b = root(number[u]), root(number[v])
        sides = [(last[i], -1) if last[i] >= 0 else (-1, place[i]) for i in (a, b)]
        if size[a] < size[b]:
            a, b = b, a
        parent[b] = a
        size[a] += size[b]
        last[a] = at
        made.append((at, w, size[a], *sides[0], *sides[1]))
    return pd.DataFrame(made, columns=["at", "w", "size", "a_link", "a_place", "b_link", "b_place"])


def merge_tree(links: DataFrame, places: DataFrame, chunk: int | None = None) -> DataFrame:
    """``node, parent, w, size``: the tree of merges. Links are nodes from 0 in order of length, the place ``p`` is ``-1 - p``."""
    edges, _ = _chunked(links, places, CHUNK if chunk is None else chunk)
    merges = cut(edges.groupBy("chunk").applyInPandas(_merge, _MERGES))
    child = lambda s: F.when(F.col(f"{s}_link") >= 0, F.col(f"{s}_link")).otherwise(-1 - F.col(f"{s}_place"))
    above = merges.select(F.explode(F.array(child("a"), child("b"))).alias("node"), F.col("at").alias("parent"))
    leaves = places.select((-1 - F.col("place")).alias("node"), F.col("core").alias("w"), F.col("n").alias("size"))
    return cut(merges.select(F.col("at").alias("node"), "w", "size").unionByName(leaves).join(above, "node", "left"))


def _grouped(tree: DataFrame, rows: int) -> DataFrame:
    """The tree with merges of equal length as one node: ``node, group, parent, w, size`` per node, and its group's parent group."""
    above = tree.select(F.col("node").alias("parent"), F.col("w").alias("_w"))
    met = cut(lookup(tree, above, ["parent"], at_most=rows))
    ties = met.filter(F.col("w") == F.col("_w")).select(F.col("node").alias("a"), F.col("parent").alias("b"))
    groups = cut(connected_components(ties).withColumnsRenamed({"component": "group"}))
    named = lookup(met.drop("_w"), groups, ["node"], at_most=rows).withColumn("group", F.coalesce("group", "node"))
    named = cut(named)
    outside = lookup(named, groups.withColumnsRenamed({"node": "parent", "group": "_up"}), ["parent"], at_most=rows)
    return cut(outside.withColumn("up", F.coalesce("_up", "parent")).drop("_up"))


def density_hierarchy(
    points: DataFrame,
    min_cluster_size: int = 20,
    min_samples: int = 10,
    alpha: float = 0.4,
    block: int | None = None,
    chunk: int | None = None,
) -> DataFrame:
    """Clusters of varying density by excess of mass over the exact hierarchy: ``id, prediction``, -1 for noise.

    ``points`` has unique ``id`` and ``x, y``; points without finite coordinates are noise. A component of at least
    ``min_cluster_size`` points goes on as one cluster while it does not split into two or more of that size. Its stability
    is the sum over its points of the gain in 1/length from its birth until the point leaves; lengths of zero count as the
    shortest one above zero. A cluster is kept if it is at least as stable as the best choice among its parts; the root,
    holding everything, is never kept. Clusters are numbered by their smallest id. ``block`` and ``chunk`` set how many places
    and links one task takes; the result does not depend on them.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has at least two points")
    usable, seen = cut_counting(usable_points(points).withColumns({"x": F.col("x") + 0.0, "y": F.col("y") + 0.0}))
    places, links = reachability_tree(usable, min_samples, alpha, block)
    none = points.select("id", F.lit(NOISE).alias("prediction"))
    count = places.count()
    if count < 2:
        return none
    rows = 2 * count
    tree = _grouped(merge_tree(links, places, chunk), rows)
    shortest = tree.filter((F.col("w") > 0) & (F.col("w") < math.inf)).agg(F.min("w")).head()[0]
    if shortest is None:
        return none
    gain = 1.0 / F.greatest(F.col("w"), F.lit(shortest))

    # Groups of merges: the topmost node has the size of all.
    outer = F.max(F.when(F.col("up") != F.col("group"), F.col("up")))
    groups = tree.groupBy("group").agg(F.max("w").alias("w"), F.max("size").alias("size"), outer.alias("up"))
    groups = cut(groups)
    big = F.col("size") >= min_cluster_size
    inner = groups.filter(big & F.col("up").isNotNull()).groupBy(F.col("up").alias("group"))
    inner = inner.agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("inside"))
    events = groups.filter(big).join(inner, "group", "left").withColumn("split", F.coalesce(F.col("parts") > 1, F.lit(False)))
    stay = F.when(F.col("parts") == 1, F.col("inside")).otherwise(F.lit(0))
    events = events.withColumns({"gain": gain, "mass": (F.col("size") - stay) * gain})
    events, seen_events = cut_counting(events.select("group", "up", "size", "gain", "mass", "split"))
    # The parent of a big group is big.
    above = events.select(F.col("group").alias("up"), F.col("split").alias("up_split"), F.col("gain").alias("up_gain"))
    events = cut(lookup(events, above, ["up"], at_most=seen_events["rows"]))
    chains = connected_components(events.filter(~F.col("up_split")).select(F.col("group").alias("a"), F.col("up").alias("b")))
    chains = chains.select(F.col("node").alias("group"), F.col("component").alias("head"))
    named = lookup(events, chains, ["group"], at_most=seen_events["rows"]).withColumn("head", F.coalesce("head", "group"))
    named = cut(named)
    first = F.coalesce("up_split", F.lit(True))
    clusters = named.groupBy("head").agg(
        F.sum("mass").alias("mass"),
        F.max(F.when(first, F.col("up"))).alias("up"),
        F.max(F.when(first, F.col("size") * F.col("up_gain"))).alias("born"),
    )
    inside = named.select(F.col("group").alias("up"), F.col("head").alias("outer"))
    clusters = clusters.filter(F.col("up").isNotNull()).join(inside, "up")
    clusters = cut(clusters.select("head", "outer", (F.col("mass") - F.col("born")).alias("stability")))
    if clusters.isEmpty():
        return none
    outermost = _outermost(clusters, excess_of_mass(clusters))

    # Every place leaves at the first big merge above it; merges below are fewer than the cluster size deep.
    small = cut(groups.filter(~big).select("group", F.col("up").alias("to")))
    while True:
        step = small.select(F.col("group").alias("to"), F.col("to").alias("_to"), F.lit(True).alias("_small"))
        longer = lookup(small, step, ["to"], at_most=rows)
        small, moved = cut_counting(
            longer.select("group", F.when(F.col("_small"), F.col("_to")).otherwise(F.col("to")).alias("to"), "_small"),
            moved=F.col("_small"),
        )
        small = small.drop("_small")
        if not moved["moved"]:
            break
    leaves = tree.filter("node < 0").select((-1 - F.col("node")).alias("place"), "group")
    leaves = lookup(leaves, small.withColumn("_small", F.lit(True)), ["group"], at_most=rows)
    leaves = leaves.select("place", F.when(F.col("_small"), F.col("to")).otherwise(F.col("group")).alias("group"))
    leaves = lookup(leaves, named.select("group", "head"), ["group"], "inner", at_most=rows)
    leaves = lookup(leaves, outermost, ["head"], "inner", at_most=rows).select("place", "cluster")
    spots = cut(leaves.join(places, "place").select("x", "y", "cluster"))
    labels = cut(lookup(usable, spots, ["x", "y"], "inner", at_most=seen["rows"]).select("id", "cluster"))
    lowest = labels.groupBy("cluster").agg(F.min("id").alias("low"))
    return numbered(lookup(labels, lowest, ["cluster"], "inner", at_most=seen["rows"]), ["low"], points, seen["rows"])


def _outermost(clusters: DataFrame, kept: DataFrame) -> DataFrame:
    """``head, cluster``: for each cluster inside a kept one, or kept, the outermost such."""
    marked = clusters.join(kept.withColumn("_kept", F.lit(True)), "head", "left")
    ways, seen = cut_counting(
        marked.select("head", F.col("outer").alias("to"), F.when(F.col("_kept"), F.col("head")).alias("cluster"))
    )
    while True:
        step = ways.select(F.col("head").alias("to"), F.col("to").alias("_to"), F.col("cluster").alias("_cluster"), F.lit(True).alias("_on"))
        longer = lookup(ways, step, ["to"], at_most=seen["rows"])
        ways, seen = cut_counting(
            longer.select("head", F.col("_to").alias("to"), F.coalesce("_cluster", "cluster").alias("cluster"), "_on"), on=F.col("_on")
        )
        ways = ways.drop("_on")
        if not seen["on"]:
            return ways.filter(F.col("cluster").isNotNull()).select("head", "cluster")
