"""Bisecting k-means for every number of clusters at once.

Clusters are split in two by 2-means, the largest first. Whatever the number of clusters asked for, a cluster is always split
the same way, so all results are cuts of one tree: that for ``k`` clusters follows from the sizes alone. Large clusters are
split a level at a time: all that may be among the ``k - 1`` largest share the same passes over the rows, whose number follows
from the levels and rounds. Each row finds its cluster by walking down the tree, which is broadcast and has a small multiple of
``k`` nodes, and tasks return partial sums of the clusters that are being split. A cluster of at most ``_AT_ONCE`` values meets
in a task, which splits it and its parts without further passes; such clusters are dealt out over the tasks of one shuffle.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.operators.scale import cut, cut_counting

#: A cluster whose variance is less than this part of its mean square is a point but for rounding, and is not split.
_LEAST_SPREAD = 1e-13
#: Values, rows by dimensions, of the clusters that a task may hold as wholes, and rows of a task in a pass over all of them.
_AT_ONCE, _TASK_ROWS = 1 << 20, 1 << 14


class SplitTree:
    """Nodes by number: ``path`` ('' is the root, then 0 or 1 a step), ``size`` and mean ``center``; split ones have two ``parts``
    and, in ``ways``, the centres that tell their rows apart."""

    def __init__(self, size: int, center: np.ndarray, start: np.ndarray | None):
        self.path, self.size, self.center, self.start = [""], [size], [center], [start]
        self.parts: dict[int, tuple[int, int]] = {}
        self.ways: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.whole: set[int] = set()

    def rank(self, node: int) -> tuple:
        return -self.size[node], len(self.path[node]), self.path[node]

    def add(self, node: int, ways: tuple[np.ndarray, np.ndarray], facts: list[tuple[int, np.ndarray, np.ndarray | None]]) -> None:
        first = len(self.path)
        for digit, (size, center, start) in zip("01", facts, strict=True):
            self.path.append(self.path[node] + digit)
            self.size.append(size)
            self.center.append(center)
            self.start.append(start)
        self.parts[node], self.ways[node] = (first, first + 1), ways

    def wanted(self, k: int) -> list[int]:
        """Leaves that may be among the ``k - 1`` clusters split first."""
        open_ = [n for n in range(len(self.path)) if n not in self.whole and (n in self.parts or self.start[n] is not None)]
        return [n for n in sorted(open_, key=self.rank)[: k - 1] if n not in self.parts]

    def leaves(self, k: int) -> list[int]:
        """The clusters of the cut into ``k`` from left to right; fewer if no more can be split."""
        split = set(sorted(self.parts, key=self.rank)[: k - 1])
        found, stack = [], [0]
        while stack:
            node = stack.pop()
            if node in split:
                stack += self.parts[node][::-1]
            else:
                found.append(node)
        return found

    def walk(self, matrix: np.ndarray, stop: set[int] = frozenset()) -> np.ndarray:
        """The leaf of every row, or the node of ``stop`` on its way there."""
        at = np.zeros(len(matrix), np.int64)
        moving = {0: np.arange(len(matrix))}
        while moving:
            further = {}
            for node, rows in moving.items():
                at[rows] = node
                if node in self.parts and node not in stop and len(rows):
                    a, b = self.parts[node]
                    right = _nearer(matrix[rows], *self.ways[node])
                    further[a], further[b] = rows[~right], rows[right]
            moving = further
        return at


def _nearer(matrix: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each row is nearer to ``b``; equal distances go to ``a``."""
    return ((matrix - b) ** 2).sum(1) < ((matrix - a) ** 2).sum(1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _facts(n: int, sums: np.ndarray, squares: np.ndarray) -> tuple[int, np.ndarray, np.ndarray | None]:
    """Size, centre, and the step from the centre at which a split begins: along the widest dimension; None if all is one point."""
    center = sums / n
    spread = squares / n - center * center
    wide = int(np.argmax(spread)) if len(spread) else 0
    if n < 2 or not len(spread) or not spread[wide] > _LEAST_SPREAD * (squares.sum() / n):
        return n, center, None
    step = np.zeros(len(center))
    step[wide] = math.sqrt(spread[wide])
    return n, center, step


def _sums(rows: DataFrame, tree: SplitTree | None, centers: dict[int, np.ndarray]) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]:
    """Number, sum and sum of squares of the rows on each side of every cluster in ``centers``; without a tree, of all rows."""
    shared = rows.sparkSession.sparkContext.broadcast((tree, centers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs = shared.value
        total: dict[int, list] = {}
        for batch in batches:
            matrix = _matrix(batch.column("vector"))
            at = known.walk(matrix, set(pairs)) if known else np.zeros(len(matrix), np.int64)
            for node in np.unique(at).tolist():
                if known and node not in pairs:
                    continue
                inside = matrix[at == node]
                right = _nearer(inside, *pairs[node]) if known else np.zeros(len(inside), bool)
                for side in (0, 1):
                    part = inside[right == bool(side)]
                    if len(part):
                        sums = total.setdefault(2 * node + side, [0, 0.0])
                        sums[0] += len(part)
                        sums[1] = sums[1] + np.concatenate([part.sum(0), (part * part).sum(0)])
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total)), pa.array([t[0] for t in total.values()]), pa.array([t[1] for t in total.values()])],
                ["side", "n", "v"],
            )

    made = rows.mapInArrow(run, "side bigint, n bigint, v array<double>")
    # One row a task and side; what arrives here is at most two rows for each cluster of the tree.
    summed = made.groupBy("side").agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))
    found = {}
    for r in summed.collect():
        v = np.array(r["v"])
        found[divmod(r["side"], 2)] = (r["n"], v[: len(v) // 2], v[len(v) // 2 :])
    return found


def _two_means(matrix: np.ndarray, center: np.ndarray, start: np.ndarray, max_iter: int) -> tuple | None:
    """The last two centres with rows on both sides, and the rows of the second; None if there are none."""
    centers, kept = (center - start, center + start), None
    for _ in range(max_iter):
        right = _nearer(matrix, *centers)
        if right.all() or not right.any():
            break
        kept = centers, right
        now = tuple(part.sum(0) / len(part) for part in (matrix[~right], matrix[right]))
        if all(np.array_equal(a, b) for a, b in zip(now, centers)):
            break
        centers = now
    return kept


def _split_within(rows: DataFrame, tree: SplitTree, active: list[int], k: int, max_iter: int) -> None:
    """Split small clusters and those of their parts that are above the mean size of ``k - 1``, each cluster in one task.

    A cluster is split in at most twice its share of ``k - 1`` splits, so all return less than ``2 * k`` besides the first of each.
    """
    most = {n: 1 + 2 * (k - 1) * tree.size[n] // tree.size[0] for n in active}
    facts = {n: (tree.size[n], tree.center[n], tree.start[n], most[n]) for n in active}
    shared = rows.sparkSession.sparkContext.broadcast((tree, facts))
    everything = tree.size[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shared.value
        for batch in batches:
            at = known.walk(_matrix(batch.column("vector")))
            inside = np.isin(at, list(wanted))
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("vector")], ["at", "vector"]).filter(pa.array(inside))

    def split(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table.column("at")[0].as_py()
        matrix = _matrix(table.column("vector").chunk(0))
        size, center, start, left = shared.value[1][node]
        found, open_ = [], [(-size, 0, "", center, start, matrix)]
        while open_ and left:
            _, depth, path, center, start, inside = heapq.heappop(open_)
            if path and len(inside) * (k - 1) < everything:
                break
            kept, left = _two_means(inside, center, start, max_iter), left - 1
            if kept is None:
                found.append((path, [], [], [], []))
                continue
            ways, right = kept
            parts = inside[~right], inside[right]
            sides = [_facts(len(p), p.sum(0), (p * p).sum(0)) for p in parts]
            wide = [-1 if f[2] is None else int(np.argmax(f[2])) for f in sides]
            steps = [0.0 if f[2] is None else float(f[2].max()) for f in sides]
            found.append((path, [len(p) for p in parts], np.concatenate([*ways, *[f[1] for f in sides]]), wide, steps))
            for digit, part, (n, middle, step) in zip("01", parts, sides):
                if step is not None:
                    heapq.heappush(open_, (-n, depth + 1, path + digit, middle, step, part))
        columns = [[node] * len(found), range(len(found)), *zip(*found)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    kinds = pa.schema(
        [("at", pa.int64()), ("step", pa.int32()), ("path", pa.string()), ("n", pa.list_(pa.int64())), ("v", pa.list_(pa.float64())),
         ("wide", pa.list_(pa.int32())), ("start", pa.list_(pa.float64()))]
    )
    vector = dict(rows.dtypes)["vector"]
    placed = rows.mapInArrow(place, f"at bigint, vector {vector}").repartition(2 * len(active), "at")
    splits = placed.groupBy("at").applyInArrow(
        split, "at bigint, step int, path string, n array<bigint>, v array<double>, wide array<int>, start array<double>"
    )
    numbers = {path: n for n, path in enumerate(tree.path)}
    for r in sorted(splits.collect(), key=lambda r: (r["at"], r["step"])):
        node = numbers[tree.path[r["at"]] + r["path"]]
        if not r["n"]:
            tree.whole.add(node)
            continue
        a, b, *middles = np.split(np.array(r["v"]), 4)
        starts = []
        for wide, step in zip(r["wide"], r["start"]):
            starts.append(None if wide < 0 else np.zeros(len(a)))
            if wide >= 0:
                starts[-1][wide] = step
        tree.add(node, (a, b), list(zip(r["n"], middles, starts)))
        for part in tree.parts[node]:
            numbers[tree.path[part]] = part


def fit_splits(df: DataFrame, k: int, col: str = "embedding", max_iter: int = 30) -> SplitTree | None:
    """The tree of splits that holds the cuts into 1 to ``k`` clusters; None without rows. Vectors have one length."""
    return _grow(_spread(df, col), k, max_iter)


def _grow(rows: DataFrame, k: int, max_iter: int) -> SplitTree | None:
    everything = _sums(rows, None, {}).get((0, 0))
    if everything is None:
        return None
    tree = SplitTree(*_facts(*everything))
    small = _AT_ONCE // max(len(tree.center[0]), 1)
    while active := tree.wanted(k):
        large = [n for n in active if tree.size[n] > small]
        if not large:
            _split_within(rows, tree, active, k, max_iter)
            continue
        centers = {n: (tree.center[n] - tree.start[n], tree.center[n] + tree.start[n]) for n in large}
        moving, sides = set(large), {}
        for _ in range(max_iter):
            found = _sums(rows, tree, {n: centers[n] for n in moving})
            for n in list(moving):
                both = [found.get((n, s)) for s in (0, 1)]
                if None in both:  # the last centres with rows on both sides stay
                    moving.discard(n)
                    continue
                sides[n] = (centers[n], both)
                now = tuple(b[1] / b[0] for b in both)
                if all(np.array_equal(a, b) for a, b in zip(now, centers[n])):
                    moving.discard(n)
                centers[n] = now
            if not moving:
                break
        for n in large:
            if n in sides:
                tree.add(n, sides[n][0], [_facts(*b) for b in sides[n][1]])
            else:
                tree.whole.add(n)
    return tree


def _spread(df: DataFrame, col: str) -> DataFrame:
    """The vectors in files of like size, however those of the input are cut, so that every pass has work for all cores."""
    rows, seen = cut_counting(_prepared(df, col))
    return cut(rows.repartition(max(1, -(-seen["rows"] // _TASK_ROWS))))


def _prepared(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).select(F.col(col).alias("vector"))


def label_splits(df: DataFrame, tree: SplitTree, ks: Sequence[int], id_col: str = "id", col: str = "embedding") -> DataFrame:
    """``id, k, prediction``: the cluster of each row with a vector in the cut into each ``k``, all in one pass."""
    cuts = [(int(k), {n: i for i, n in enumerate(tree.leaves(k))}) for k in ks]
    shared = df.sparkSession.sparkContext.broadcast((tree, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shared.value
        for batch in batches:
            matrix = _matrix(batch.column("vector"))
            for k, leaves in wanted:
                at = known.walk(matrix, set(leaves))
                labels = pa.array([leaves[n] for n in at.tolist()], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([k] * len(at), pa.int32()), labels], ["id", "k", "prediction"])

    rows = df.filter(F.col(col).isNotNull()).select(F.col(id_col).alias("id"), F.col(col).alias("vector"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, k int, prediction int")


def _units(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def sweep_splits(df: DataFrame, ks: Sequence[int], col: str = "embedding", max_iter: int = 30) -> DataFrame:
    """``algo, k, k_actual, silhouette`` of bisecting k-means for every ``k``: one tree, and two passes to score all its cuts.

    The silhouette is that of cosine distances, in linear time: the mean distance of a row to a cluster follows from the
    cluster's sum of unit vectors, and sums of all clusters of all cuts are sums over the tree's leaves.
    """
    rows = _spread(df, col)
    tree = _grow(rows, max(ks), max_iter)
    spark, kinds = df.sparkSession, "algo string, k int, k_actual int, silhouette double"
    if tree is None:
        return spark.createDataFrame([("bisecting", int(k), 0, None) for k in ks], kinds)
    shared = spark.sparkContext.broadcast(tree)

    def leaf_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            matrix = _matrix(batch.column("vector"))
            at, units = shared.value.walk(matrix), _units(matrix)
            for node in np.unique(at).tolist():
                total[node] = total.get(node, 0.0) + units[at == node].sum(0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], ["leaf", "v"])

    made = rows.mapInArrow(leaf_sums, "leaf bigint, v array<double>").groupBy("leaf")
    sums = np.zeros((len(tree.path), len(tree.center[0])))
    for r in made.agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")).collect():  # a row for each leaf
        sums[r["leaf"]] = r["v"]
    for node in sorted(tree.parts, reverse=True):  # parts have higher numbers
        sums[node] = sums[list(tree.parts[node])].sum(0)
    sizes = np.array(tree.size, float)
    cuts = [tree.leaves(k) for k in ks]
    facts = spark.sparkContext.broadcast((sums, sizes, cuts))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, cuts = facts.value
        total = np.zeros(len(cuts))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                matrix = _matrix(batch.column("vector").slice(start, 1024))
                means = 1 - _units(matrix) @ sums.T / sizes
                for i, leaves in enumerate(cuts):
                    if len(leaves) < 2:
                        continue
                    place = {n: j for j, n in enumerate(leaves)}
                    own = np.array([place[n] for n in shared.value.walk(matrix, set(leaves)).tolist()])
                    here, size, every = means[:, leaves], sizes[leaves][own], np.arange(len(own))
                    inner = here[every, own] * size / np.maximum(size - 1, 1)
                    here[every, own] = np.inf
                    outer = here.min(1)
                    most = np.maximum(inner, outer)
                    value = np.divide(outer - inner, most, out=np.zeros_like(most), where=most > 0)
                    total[i] += value[size > 1].sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "v"])

    summed = rows.mapInArrow(scores, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    value = {r["i"]: r["v"] / tree.size[0] for r in summed.collect()}  # one row for each k
    found = [
        ("bisecting", int(k), len(leaves), value[i] if len(leaves) > 1 else None) for i, (k, leaves) in enumerate(zip(ks, cuts, strict=True))
    ]
    return spark.createDataFrame(found, kinds)
