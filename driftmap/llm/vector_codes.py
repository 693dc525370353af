"""Product codes of vectors: exact integer k-means with slice-and-intersect candidate masks.

A vector of whole numbers is cut into equal parts; each part is replaced by the index of its nearest codebook entry.
Codebooks start from the smallest ids and are refined by a fixed number of rounds in whole numbers, so results depend
neither on partitioning nor on the order of additions.

The nearest entry is found with bitmasks. Per dimension, the entries' coordinates are sorted, and for every prefix of that
order a mask of 64-bit words tells which entries it holds. The distance to one probed entry is the initial radius: every
entry at most that far lies, in each dimension, in a slice of the sorted order, and a slice's mask is the difference of
two prefix masks. The AND of all slices holds every entry that may be nearest; only those are compared exactly.

Each round is one pass over the stored vectors with partial sums in the tasks: what is shuffled and what the driver sees is
``parts * entries`` rows a task and a round, set by parameters. Codebooks are broadcast; their size is set alike.

Defined results: vectors that are NULL or hold NULL or non-finite components are left out; the length of the first kept
vector (by id, NULL ids last, then by value) is the length of the codebooks, and vectors of another length have NULL codes and errors; a length that ``parts``
does not divide is filled up with zeros; with fewer rows than entries every row is an entry; repeated rows and ids count
as rows; equal distances go to the lower index; components beyond 2**24 after scaling are an error; an empty table gives
no rows; columns other than ``id``, ``vector`` and ``label`` are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.llm.common import group_label
from driftmap.operators.scale import cut, lookup

#: Parts compared at a time, and entries looked at for the initial radius.
_ROWS, _PROBES = 2048, 8
#: Largest component; sums of squares of differences then stay far below 2**63.
_MOST = 1 << 24


def whole_numbers(vector: Column, factor: float = 1024.0) -> Column:
    """Components times ``factor``, rounded down; NULL for vectors that are left out."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(vector, lambda c: F.floor(F.lit(factor) * c.cast("double")))
    return F.when(vector.isNotNull() & finite, scaled)


class Nearest:
    """Finds the nearest of ``entries`` (rows of whole numbers) for many points, exactly."""

    def __init__(self, entries: np.ndarray):
        self.entries, count = entries, len(entries)
        words = max(1, math.ceil(count / 64))
        own = np.zeros((count, words), np.uint64)
        own[np.arange(count), np.arange(count) // 64] = np.uint64(1) << (np.arange(count) % 64).astype(np.uint64)
        self.orders = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, self.orders, axis=0)
        # prefixes[d, i] has the bits of the i entries with the smallest coordinates in dimension d.
        self.prefixes = np.zeros((entries.shape[1], count + 1, words), np.uint64)
        for d in range(entries.shape[1]):
            self.prefixes[d, 1:] = np.bitwise_or.accumulate(own[self.orders[:, d]], axis=0)
        self.widest = int(np.argmax(np.ptp(entries, axis=0))) if entries.shape[1] else 0

    def _radius(self, points: np.ndarray) -> np.ndarray:
        """Squared distance to the best of a few entries close in the widest dimension."""
        d = self.widest
        near = np.searchsorted(self.sorted[:, d], points[:, d]) - _PROBES // 2
        near = np.clip(near[:, None] + np.arange(min(_PROBES, len(self.entries))), 0, len(self.entries) - 1)
        gaps = self.entries[self.orders[near, d]] - points[:, None, :]
        return (gaps * gaps).sum(2).min(1)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """For every point a mask of entries that holds all its nearest ones."""
        reach = np.sqrt(self._radius(points).astype(float)).astype(np.int64) + 1
        masks = None
        for d in range(points.shape[1]):
            start = np.searchsorted(self.sorted[:, d], points[:, d] - reach, "left")
            end = np.searchsorted(self.sorted[:, d], points[:, d] + reach, "right")
            piece = self.prefixes[d, end] & ~self.prefixes[d, start]
            masks = piece if masks is None else masks & piece
        return masks

    def __call__(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of, and squared distance to, the nearest entry of every point; ties go to the lower index."""
        if not points.shape[1]:
            return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        index, distance = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
        # Fewer points at a time if their parts are long, so that the compared pairs stay within some 64 MB.
        step = max(1, min(_ROWS, (1 << 23) // (len(self.entries) * points.shape[1])))
        for at in range(0, len(points), step):
            some = points[at : at + step]
            bits = np.unpackbits(self.candidates(some).view(np.uint8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)
            gaps = some[row] - self.entries[entry]
            found = np.einsum("ij,ij->i", gaps, gaps)
            starts = np.searchsorted(row, np.arange(len(some)))
            least = np.minimum.reduceat(found, starts)
            best = np.flatnonzero(found == least[row])
            first = np.searchsorted(row[best], np.arange(len(some)))
            index[at : at + step], distance[at : at + step] = entry[best[first]], least
        return index, distance


def _matrix(column: pa.ListArray, parts: int, width: int) -> np.ndarray:
    """Rows of vectors as ``rows, parts, width``, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    matrix = np.zeros((len(column), parts * width), np.int64)
    if len(flat):
        matrix[:, : len(flat) // len(column)] = flat.reshape(len(column), -1)
    return matrix.reshape(len(column), parts, width)


def _sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, n, sums``: how many parts each entry is nearest to, and their sums; a row a task and used entry."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = [Nearest(book) for book in shared.value]
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            matrix = _matrix(batch.column("vector"), parts, width)
            for p in range(parts):
                index, _ = find[p](matrix[:, p])
                counts[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, matrix[:, p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
             pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            ["part", "entry", "n", "sums"],
        )

    made = vectors.select("vector").mapInArrow(run, "part int, entry int, n bigint, sums array<bigint>")
    # Entry by entry: tasks * parts * entries rows, added up by position before they are put together again.
    totals = made.select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "value"))
    return (
        totals.groupBy("part", "entry", "place")
        .agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
        .groupBy("part", "entry")
        .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "value"))).alias("sums"))
        .select("part", "entry", "n", F.col("sums.value").alias("sums"))
    )


def _first(vectors: DataFrame, count: int) -> list[list[int]]:
    """The vectors with the smallest ids, NULL ids last."""
    ordered = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(count)
    return [row["vector"] for row in ordered.select("vector").collect()]


def train(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> np.ndarray:
    """Codebooks ``parts, entries, width`` for ``id, vector`` of one length; refined ``rounds`` times over all rows."""
    start = _first(vectors, entries)
    length = len(start[0])
    width = math.ceil(length / parts)
    padded = np.zeros((len(start), parts * width), np.int64)
    padded[:, :length] = np.array(start, np.int64)
    books = padded.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds if length else 0):
        for row in _sums(vectors, books).collect():
            books[row["part"], row["entry"]] = np.array(row["sums"], np.int64) // row["n"]
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in order of part, entry and position, as decimal numbers between commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """``id, label, code, error``: two hex digits a part (four beyond 256 entries), and the sum of squared distances."""
    parts, entries, width = books.shape
    digits = 2 if entries <= 256 else 4
    if entries > 65536:
        raise ValueError("codes have at most four hex digits a part")
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = [Nearest(book) for book in shared.value]
        for batch in batches:
            matrix = _matrix(batch.column("vector"), parts, width)
            found = [find[p](matrix[:, p]) for p in range(parts)]
            codes = ["".join(f"{i:0{digits}x}" for i in row) for row in np.stack([f[0] for f in found], 1).tolist()]
            columns = [*[batch.column(c) for c in ("id", "label")], pa.array(codes, pa.string())]
            error = pa.array(np.sum([f[1] for f in found], axis=0))
            yield pa.RecordBatch.from_arrays([*columns, error], ["id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, code string, error bigint"
    return vectors.select("id", "label", "vector").mapInArrow(run, schema)


def code_vectors(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """``id, label, code, error, label_error, codebooks_sha256`` for ``id, label, vector``; vectors hold whole numbers or are NULL.

    ``label_error`` is the sum of errors over rows of the same label, NULL labels together.
    """
    small = F.forall("vector", lambda c: F.abs(c) <= _MOST)
    checked = F.when(small, F.col("vector")).otherwise(F.raise_error(F.lit(f"a component is beyond {_MOST}")))
    kept = cut(vectors.filter(F.col("vector").isNotNull()).select("id", "label", checked.alias("vector")))
    uncoded = [F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error")]
    first = _first(kept, 1)
    if first:
        fits = F.size("vector") == len(first[0])
        books = train(kept.filter(fits), parts, entries, rounds)
        coded = encode(kept.filter(fits), books).unionByName(kept.filter(~fits).select("id", "label", *uncoded))
        sha256 = digest(books)
    else:
        coded, sha256 = kept.select("id", "label", *uncoded), digest(np.zeros(0, np.int64))
    coded = cut(coded.withColumn("_label", group_label(F.col("label"))))
    sums = coded.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return lookup(coded, sums, ["_label"]).select(
        "id", "label", "code", "error", "label_error", F.lit(sha256).alias("codebooks_sha256")
    )
