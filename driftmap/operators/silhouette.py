"""The exact Euclidean silhouette."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.operators.cluster import NOISE
from driftmap.operators.scale import cut

#: Most and least points per block. A task compares one block with all points, so its work grows with their number.
BLOCK, _LEAST_BLOCK, _BLOCKS = 16_384, 1024, 64
#: Points that travel together; a task holds its own block, a few packs, and a part of their distances at a time.
_PACK = 256
_ROWS_AT_ONCE = 64
#: Between these, squares of coordinates and of their differences neither overflow nor vanish.
_SMALL, _LARGE = 1e-130, 1e150


def _plain(*values: np.ndarray) -> bool:
    """Whether distances may be taken as roots of sums of squares."""
    sizes = np.abs(np.concatenate(values))
    return bool(((sizes == 0) | ((sizes > _SMALL) & (sizes < _LARGE))).all())


def _add_distances(total: np.ndarray, lx, ly, plain: bool, rx, ry, starts: np.ndarray, columns: np.ndarray) -> None:
    """Add to the ``columns`` of ``total`` every left point's distances to the right points of each run from ``starts``."""
    for at in range(0, len(lx), _ROWS_AT_ONCE):
        part = slice(at, at + _ROWS_AT_ONCE)
        gaps, other = lx[part, None] - rx[None, :], ly[part, None] - ry[None, :]
        if plain:
            gaps *= gaps
            other *= other
            gaps += other
            np.sqrt(gaps, out=gaps)
        else:
            gaps = np.hypot(gaps, other)
        total[part, columns] += np.add.reduceat(gaps, starts, axis=1)


def _scores(clusters: list[int], sizes: list[int]):
    """A function that compares the block that comes first in a partition with all that follows, itself included.

    It gives each point's cluster size, mean distance inside and least mean distance to another cluster; rows of one ``id``
    and cluster count as one point with all their distances.
    """
    clusters, sizes = np.array(clusters), np.array(sizes, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_parts, held, total, left, plain = [], [], None, None, True

        def met(pack: list[np.ndarray]) -> None:
            _, label, x, y = pack
            order = np.argsort(label, kind="stable")
            label = label[order]
            starts = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            columns = np.searchsorted(clusters, label[starts])
            _add_distances(total, left[2], left[3], plain and _plain(x, y), x[order], y[order], starts, columns)

        def joined(packs: list) -> list[np.ndarray]:
            return [np.concatenate(c) for c in zip(*packs)]

        def begin() -> None:
            nonlocal left, total, plain
            left = joined(own_parts)
            total, plain = np.zeros((len(left[0]), len(clusters))), _plain(left[2], left[3])
            met(left)

        for batch in batches:
            for i in range(batch.num_rows):
                pack = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("id", "prediction", "x", "y")]
                if batch.column("is_right")[i].as_py():
                    if left is None:
                        begin()
                    held.append(pack)
                    if len(held) == 8:
                        met(joined(held))
                        held.clear()
                else:
                    own_parts.append(pack)
        if not own_parts:
            return
        if left is None:
            begin()
        if held:
            met(joined(held))
        ids, own = left[0], left[1]
        order = np.lexsort((own, ids))
        first = np.flatnonzero(np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(own[order]) != 0)])
        copies = np.diff(np.r_[first, len(ids)])
        for at in range(0, len(first), 4096):
            part, end = slice(at, at + 4096), first[at + 4096] if at + 4096 < len(first) else len(ids)
            sums = np.add.reduceat(total[order[first[at] : end]], first[part] - first[at], axis=0)
            members = copies[part, None] * sizes[None, :]
            every, mine = np.arange(len(sums)), np.searchsorted(clusters, own[order[first[part]]])
            size = members[every, mine]
            inner = np.divide(sums[every, mine], size - 1, out=np.zeros(len(sums)), where=size > 1)
            means = sums / members
            means[every, mine] = np.nan
            outer = np.fmin.reduce(means, axis=1)
            none = np.full(len(sums), len(clusters) < 2)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(size.astype("i8")),
                    pa.array(inner, mask=size < 2),
                    pa.array(outer, mask=none),
                ],
                names=["size", "inner", "outer"],
            )

    return run


def silhouette_exact(df: DataFrame, block: int | None = None) -> DataFrame:
    """Mean Euclidean silhouette of labelled 2-D points without noise: ``n_rows, n_clusters, silhouette``.

    The score needs the distance between all points, so the work is quadratic however it is arranged: points are put
    into blocks of about ``block`` points by a hash of their unique ``id``, each task compares one block with all points, which
    it reads in packs, and only finished scores leave it. There is a task for each block, so the longest grows with the
    points, not with their square. By default blocks grow with the points up to ``BLOCK``. A task holds a sum for each point of
    its block and cluster. ``silhouette`` is the measure with linear work. A point alone in its cluster scores 0; NULL with
    fewer than two clusters.
    """
    points = df.filter(F.col("prediction") != NOISE).select(
        F.col("id").cast("bigint"),
        F.col("prediction").cast("int"),
        F.col("x").cast("double"),
        F.col("y").cast("double"),
    )
    points = cut(points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()))
    # One row for each cluster.
    found = sorted((r["prediction"], r["count"]) for r in points.groupBy("prediction").count().collect())
    rows = sum(n for _, n in found)
    block = block or max(_LEAST_BLOCK, min(BLOCK, -(-rows // _BLOCKS)))
    blocks, each = max(1, -(-rows // block)), -(-block // _PACK)
    pack = F.pmod(F.xxhash64("id"), F.lit(blocks * each))
    packed = points.groupBy(pack.alias("pack")).agg(F.collect_list(F.struct("id", "prediction", "x", "y")).alias("p"))
    packed = packed.select("pack", F.pmod("pack", F.lit(blocks)).alias("block"), "p.id", "p.prediction", "p.x", "p.y")
    task = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("task")
    dealt = (
        packed.select("*", task)
        .withColumn("is_right", F.col("task") != F.col("block"))
        .repartitionById(blocks, F.col("task").cast("int"))
        .sortWithinPartitions("is_right", "pack")
        .select("is_right", "id", "prediction", "x", "y")
    )
    per_point = dealt.mapInArrow(_scores([c for c, _ in found], [n for _, n in found]), "size bigint, inner double, outer double")
    score = F.when(F.col("size") == 1, F.lit(0.0)).otherwise(
        F.coalesce(
            (F.col("outer") - F.col("inner")) / F.nullif(F.greatest("inner", "outer"), F.lit(0.0)), F.lit(0.0)
        )
    )
    value = F.avg(score) if len(found) > 1 else F.lit(None).cast("double")
    return per_point.agg(
        F.count("*").alias("n_rows"), F.lit(len(found)).cast("bigint").alias("n_clusters"), value.alias("silhouette")
    )
