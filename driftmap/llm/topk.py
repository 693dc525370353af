"""Exact top-k search by inner product with a vector-approximation file.

Every vector is kept twice: exact, and as quantised cells of one byte per component. Each dimension has cells of its own,
between quantiles of its values, so a far value widens the last cell of one dimension only. Blocks of cells are scanned for a
block of queries at a time; a cell's borders bound the score from below and above. A candidate whose upper bound is less
than the k-th largest lower bound of its query cannot be among the k best and is left out. Exact vectors are then read in
the order of upper bounds, first the k with the largest and then twice as many a round, as long as a bound reaches the
k-th exact score found so far; when none does, the result is certain. No recall is lost.

Queries are a stated set, met in blocks by blocks of all rows; survivors are a few rows per query. Equal vectors give
equal scores and ties go to smaller ids, so of a group of copies only the ``k + 1`` smallest ids (one may be the query)
can matter; the rest are left out before anything is compared, with partial cuts in each task.

Defined results: vectors that are NULL, empty or hold NULL or non-finite components, and rows without id, take no part;
of rows with one id the largest vector stands; vectors of another length than the query's are no candidates; with fewer
than k candidates all are returned; an empty table gives no rows; other columns are ignored. Scores must fit a BIGINT.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.operators.scale import cut, cut_counting, lookup


def scaled(col: Column, factor: float = 64.0) -> Column:
    """Components times ``factor``, rounded down; NULL for vectors that take no part."""
    finite = F.forall(col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(col, lambda c: F.floor(F.lit(factor) * c.cast("double")))
    return F.when((F.size(col) > 0) & finite, whole)


def _borders(vectors: DataFrame, cells: int) -> np.ndarray:
    """Where each cell of each dimension begins, and one past the last value; every cell of a dimension with few values has one.

    Quantiles are approximate, which only makes cells more or less full: bounds hold for any borders.
    """
    steps = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    values = vectors.select(F.posexplode("vector").alias("pos", "value"))
    rows = values.groupBy("pos").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.percentile_approx("value", steps, 10 * cells).alias("inner")
    )
    found = {r["pos"]: np.unique([r["low"], *r["inner"]]).tolist() + [r["high"] + 1] for r in rows.collect()}  # a row a dimension
    borders = np.zeros((len(found), cells + 1), np.int64)
    for pos, values in found.items():
        borders[pos] = values + [values[-1]] * (cells + 1 - len(values))
    return borders


def _pack(rows: DataFrame, group: str, number: int, shared=None) -> DataFrame:
    """Blocks ``dim, <group>, ids, cells`` of at most a few thousand vectors as bytes: cells within borders, or the numbers."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        matrix = np.array(frame["vector"].tolist(), np.int64)
        if shared is not None:
            cells = np.empty(matrix.shape, np.uint8)
            for d in range(matrix.shape[1]):
                ends = shared.value[d]
                cells[:, d] = np.searchsorted(ends[: np.searchsorted(ends, ends[-1])], matrix[:, d], "right") - 1
            matrix = cells
        return pd.DataFrame(
            {
                "dim": [key[0]],
                group: [key[1]],
                "ids": [frame["id"].to_numpy(np.int64).tobytes()],
                "cells": [matrix.tobytes()],
            }
        )

    keyed = rows.select(F.size("vector").alias("dim"), F.expr(f"pmod(xxhash64(id), {number})").alias(group), "id", "vector")
    return keyed.groupBy("dim", group).applyInPandas(run, f"dim int, {group} bigint, ids binary, cells binary")


def _scan(k: int, shared):
    """For each pair of blocks: the candidates of every query that may be among its k best, with bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("dim", "ids", "cells", "query_ids", "queries")}
                ids, dim = np.frombuffer(row["ids"], np.int64), row["dim"]
                cells = np.frombuffer(row["cells"], np.uint8).reshape(len(ids), dim)
                borders = shared.value[:dim]
                ends = [borders[np.arange(dim), cells].astype(float), (borders[np.arange(dim), cells.astype(int) + 1] - 1).astype(float)]
                asked = np.frombuffer(row["query_ids"], np.int64)
                queries = np.frombuffer(row["queries"], np.int64).reshape(len(asked), dim).astype(float)
                up, down = np.maximum(queries, 0), np.minimum(queries, 0)
                # Sums of products are exact below 2**53; beyond, the bounds give way by more than the rounding.
                room = np.abs(queries) @ np.maximum(np.abs(ends[0]), np.abs(ends[1])).T * 2.0**-48
                room[room < 2.0**-2] = 0
                lower = up @ ends[0].T + down @ ends[1].T - room
                upper = up @ ends[1].T + down @ ends[0].T + room
                lower[asked[:, None] == ids[None, :]] = -np.inf
                most = min(k, len(ids))
                best = -np.partition(-lower, most - 1, axis=1)[:, :most]
                kept, highs, tops = [], [], []
                for q in range(len(asked)):
                    here = np.flatnonzero((upper[q] >= best[q].min()) & (lower[q] > -np.inf))
                    kept.append(ids[here])
                    highs.append(np.ceil(upper[q][here]).astype(np.int64))
                    top = best[q][best[q] > -np.inf]
                    tops.append(np.floor(top).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked), *[pa.array(x, pa.list_(pa.int64())) for x in (kept, highs, tops)]],
                    ["query_id", "vec_ids", "uppers", "lowers"],
                )

    return run


def _with_score(pairs: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, vec_id, score`` from exact vectors."""
    asked = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    exact = vectors.select(F.col("id").alias("vec_id"), "vector")
    product = F.aggregate(
        F.zip_with("query", "vector", lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x
    )
    both = lookup(lookup(pairs, asked, ["query_id"], "inner"), exact, ["vec_id"], "inner")
    return both.select("query_id", "vec_id", product.alias("score"))


def top_k(
    vectors: DataFrame,
    query: Column,
    k: int = 20,
    bits: int = 8,
    query_rows: int = 512,
    block_rows: int = 8192,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every row that meets ``query``, a condition on ``id``.

    ``vectors`` has ``id`` and ``vector`` (an array of whole numbers, NULL to take no part). Cells have ``2**bits`` steps.
    """
    if not 1 <= bits <= 8:
        raise ValueError("cells take one byte: bits must be 1 to 8")
    known = vectors.filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
    unique = cut(known.groupBy("id").agg(F.max("vector").alias("vector")))
    copies = Window.partitionBy("vector").orderBy("id")
    candidates = cut(
        unique.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= k + 1).select("id", "vector")
    )
    queries = unique.filter(query)
    count, asked = candidates.count(), queries.count()
    blocks, parts = max(1, math.ceil(count / block_rows)), max(1, math.ceil(asked / query_rows))
    # Two tables of numbers a dimension and cell: their size is set by the vectors' length and ``bits``.
    borders = vectors.sparkSession.sparkContext.broadcast(_borders(candidates, 2**bits))

    approximate = _pack(candidates, "block", blocks, borders)
    questions = _pack(queries, "part", parts).select(
        "dim",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
        F.col("ids").alias("query_ids"),
        F.col("cells").alias("queries"),
    )
    found = cut(
        questions.join(approximate, ["dim", "block"]).mapInArrow(
            _scan(k, borders),
            "query_id bigint, vec_ids array<bigint>, uppers array<bigint>, lowers array<bigint>",
        )
    )
    by_lower = Window.partitionBy("query_id").orderBy(F.col("lower").desc())
    sure = (
        found.select("query_id", F.explode("lowers").alias("lower"))
        .withColumn("_n", F.row_number().over(by_lower))
        .filter(F.col("_n") <= k)
        .groupBy("query_id")
        .agg(F.min("lower").alias("least"), F.count(F.lit(1)).alias("n"))
        .select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    )
    by_upper = Window.partitionBy("query_id").orderBy(F.col("upper").desc(), "vec_id")
    reach = F.filter(F.arrays_zip("vec_ids", "uppers"), lambda c: F.col("least").isNull() | (c["uppers"] >= F.col("least")))
    survivors = cut(
        found.join(sure, "query_id")
        .select("query_id", F.explode(reach).alias("c"))
        .select("query_id", F.col("c.vec_ids").alias("vec_id"), F.col("c.uppers").alias("upper"))
        .withColumn("turn", F.row_number().over(by_upper))
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda scores: scores.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    read = k
    scores = cut(ranked(_with_score(survivors.filter(F.col("turn") <= k).select("query_id", "vec_id"), unique, queries)))
    while True:
        # With fewer than k scores there are fewer than k candidates, all read in the first round.
        worst = scores.filter(F.col("rank") == k).select("query_id", F.col("score").alias("worst"))
        open_ = survivors.filter(F.col("turn") > read).join(worst, "query_id").filter(F.col("upper") >= F.col("worst"))
        read *= 2
        later, seen = cut_counting(open_.select("query_id", "vec_id", "turn"))
        if not seen["rows"]:
            break
        more = _with_score(later.filter(F.col("turn") <= read).select("query_id", "vec_id"), unique, queries)
        scores = cut(ranked(scores.drop("rank").unionByName(more)))
    return scores.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
