"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, each at least two thresholds' angles from the others. Every vector is described by its
nearest pivots in order. Inverted lists hold, for every pair of pivots, the vectors that have both among their
``LISTED`` nearest; two vectors that meet in a list and share at least ``SHARED`` of their ``NEAREST`` nearest pivots are
candidates, and candidates are verified by their cosines. All vectors are indexed; only the pivots are a sample. Of pairs
at the threshold of 0.93 in 64 dimensions about 0.3 % share too few pivots, of closer ones fewer.

Groups of copies are kept whole instead of being paired. Equal vectors with one label are one row with a count. Then,
in a few rounds, vectors with the same two nearest pivots and label are compared with one leader of theirs: those within half
the threshold's angle of it form a *cell*, whose members are all linked by the triangle inequality. Lists hold cells. A
pair of cells is linked as a whole or not at all if the cells' middles and radii say so; only the rest is opened, first
members against a cell, then members against members. So a group of any size costs a row per member, and the table of
links never holds the pairs inside a group. Long lists are compared in blocks; short ones share a task.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, rows without label and
vectors of different lengths link with nothing; NULL ids are larger than any other, and a component of rows without id
has the id NULL; repeated rows and rows that share an id are rows of their own that link as any others do; ``kept`` is
true where the id is the component's, NULL or not; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.llm.common import stored
from driftmap.operators.components import connected_components
from driftmap.operators.scale import lookup

#: Vectors in the sample that pivots are chosen from.
PIVOTS = 1024
#: Nearest pivots that pair up into lists, nearest pivots that are compared, and how many of those must be shared.
LISTED, NEAREST, SHARED = 8, 16, 4
#: Times that vectors left over look for a leader.
ROUNDS = 3
#: Members of a list, or of a cell that is opened, that one task takes at a time.
_BLOCK = 2048
#: Room for rounding in angles, far above the error of a sum of products.
_ROOM = 1e-6


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _cosine(a: str, b: str) -> Column:
    return _dot(f"{a}_vector", f"{b}_vector") / (F.col(f"{a}_norm") * F.col(f"{b}_norm"))


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def _classes(rows: DataFrame) -> DataFrame:
    """``id, label, dim, vector, norm, n, low``: equal vectors with one label as one row with their number and smallest id."""
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = rows.filter(F.col("label").isNotNull() & (F.size("vector") > 0) & finite)
    grouped = usable.groupBy("label", "vector").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    doubles = grouped.withColumn("vector", F.transform("vector", lambda c: c.cast("double")))
    measured = doubles.withColumns({"dim": F.size("vector"), "norm": F.sqrt(_dot("vector", "vector"))})
    # Written, so that the numbers given here stay with their rows.
    known = measured.filter((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    return stored(known.withColumn("id", F.monotonically_increasing_id()), "classes")


def choose_pivots(classes: DataFrame, alike: float, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors from a sample of ``count`` rows by the hash of their values; of two alike, the first stays."""
    sample = classes.orderBy(F.xxhash64("vector", "label"), "id").limit(count).select("vector", "norm").collect()
    dim = max((len(r["vector"]) for r in sample), default=0)
    kept = np.zeros((0, dim))
    for r in sample:
        unit = np.zeros(dim)
        unit[: len(r["vector"])] = np.array(r["vector"]) / r["norm"]
        if not len(kept) or (kept @ unit).max() < alike:
            kept = np.vstack([kept, unit])
    return kept


def _described(classes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``nearest``, the numbers of the nearest pivots in order, and ``lists``, the pairs of pivots that list a vector.

    Vectors of other lengths than the pivots' are cut or filled with zeros. A single pivot pairs with itself.
    """
    shared = classes.sparkSession.sparkContext.broadcast(pivots)
    fields = [f.name for f in classes.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        most = min(NEAREST, len(points))
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector")
            lengths = np.diff(vectors.offsets.to_numpy())
            place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            row = np.repeat(np.arange(len(lengths)), lengths)
            matrix = np.zeros((len(lengths), points.shape[1]))
            fits = place < points.shape[1]
            matrix[row[fits], place[fits]] = vectors.flatten().to_numpy()[fits]
            likeness = matrix @ points.T
            near = np.argpartition(-likeness, most - 1, axis=1)[:, :most]
            order = np.argsort(-np.take_along_axis(likeness, near, 1), axis=1, kind="stable")
            near = np.take_along_axis(near, order, 1).astype(np.int32)
            listed = np.sort(near[:, :LISTED], axis=1)
            low, high = np.triu_indices(listed.shape[1], 1) if most > 1 else ([0], [0])
            as_lists = [
                pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel())
                for m in (near, listed[:, low] * np.int32(65536) + listed[:, high])
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *as_lists], [*fields, "nearest", "lists"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.schema)
    return classes.mapInArrow(run, f"{schema}, nearest array<int>, lists array<int>")


def _members(described: DataFrame, half: float) -> DataFrame:
    """Add ``cell``, the class whose vector leads the cell; every member is within the angle ``half`` of it."""
    left = described.withColumns({"p": F.col("nearest")[0], "q": F.get("nearest", F.lit(1))}).fillna({"q": -1})
    keys, done = ["label", "dim", "p", "q"], []
    for turn in range(ROUNDS):
        draw = F.xxhash64("id", F.lit(turn))
        leader = F.min_by(F.struct("id", "vector", "norm"), draw).alias("leader")
        met = lookup(left, left.groupBy(*keys).agg(leader), keys, "inner")
        cosine = _dot("vector", "leader.vector") / (F.col("norm") * F.col("leader.norm"))
        own = (F.col("id") == F.col("leader.id")) | (_angle(cosine) <= half - _ROOM)
        met = stored(met.withColumn("cell", F.when(own, F.col("leader.id"))).drop("leader"), "members")
        done.append(met.filter(F.col("cell").isNotNull()))
        left = met.filter(F.col("cell").isNull()).drop("cell")
    done.append(left.withColumn("cell", F.col("id")))
    members = done[0]
    for more in done[1:]:
        members = members.unionByName(more)
    return members.drop("p", "q")


def _cells(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with the number of their cell's members, and cells ``cell, label, dim, members, n, low, vector, norm, radius,
    nearest, lists``: middle and radius, the members' nearest pivots, and the pairs of pivots that list the cell."""
    sizes = members.groupBy("cell").agg(
        F.count(F.lit(1)).alias("members"), F.sum("n").alias("cell_n"), F.min("low").alias("cell_low")
    )
    members = stored(lookup(members, sizes, ["cell"], "inner"), "members")
    common = ["cell", "label", "dim", "members", F.col("cell_n").alias("n"), F.col("cell_low").alias("low")]
    single = members.filter(F.col("members") == 1).select(
        *common, "vector", "norm", F.lit(0.0).alias("radius"), "nearest", "lists"
    )
    several = members.filter(F.col("members") > 1)
    unit = F.transform("vector", lambda c: c / F.col("norm"))
    # Sums of vectors, by partial sums in the tasks; a middle of no length cannot be: members lie within a quarter turn.
    middles = several.groupBy("cell").agg(Summarizer.sum(array_to_vector(unit)).alias("m"))
    middles = middles.select("cell", vector_to_array("m").alias("middle_vector"))
    middles = stored(middles.withColumn("middle_norm", F.sqrt(_dot("middle_vector", "middle_vector"))), "middles")
    off = _angle(_dot("vector", "middle_vector") / (F.col("norm") * F.col("middle_norm")))
    radii = lookup(several, middles, ["cell"], "inner").groupBy("cell").agg(F.max(off).alias("radius"))
    # At most as many rows a cell as there are pivots, and pairs of pivots.
    near = several.select("cell", F.explode("nearest").alias("p")).distinct()
    near = near.groupBy("cell").agg(F.collect_list("p").alias("nearest"))
    keys = several.select("cell", F.explode("lists").alias("p")).distinct()
    keys = keys.groupBy("cell").agg(F.collect_list("p").alias("lists"))
    facts = several.select(*common).dropDuplicates(["cell"])
    grouped = (
        facts.join(middles, "cell").join(radii, "cell").join(near, "cell").join(keys, "cell")
        .withColumnsRenamed({"middle_vector": "vector", "middle_norm": "norm"})
    )
    return members, stored(single.unionByName(grouped.select(*single.columns)), "cells")


def _candidates(cells: DataFrame, pivots: int) -> DataFrame:
    """``a, b``: cells that meet in a list and share enough pivots, once each; found in blocks of a list."""
    entries = cells.select("label", "dim", "cell", F.explode("lists").alias("list"))
    keys = ["label", "dim", "list"]
    sizes = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    # Most lists hold one vector; those go before anything is moved by cell.
    met = lookup(entries, sizes, keys, "inner")
    parts = F.ceil(F.col("n") / _BLOCK).cast("int")
    placed = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("cell"), F.col("parts")).cast("int"))
    entry = F.struct("cell", "nearest")
    blocks = (
        placed.join(cells.select("cell", "nearest"), "cell")
        .groupBy(*keys, "parts", "part")
        .agg(F.collect_list(entry).alias("rows"))  # some _BLOCK rows each, dealt by hash
    )
    blocks = stored(blocks, "lists")
    every = F.sequence(F.col("part"), F.col("parts") - 1)
    left = blocks.select(*keys, F.col("part").alias("i"), F.explode(every).alias("part"), F.col("rows").alias("left_rows"))
    right = blocks.select(*keys, "part", F.col("rows").alias("right_rows"))
    across = left.filter(F.col("i") < F.col("part")).join(right, [*keys, "part"]).select("left_rows", "right_rows")
    inside = blocks.select(F.col("rows").alias("left_rows"), F.lit(None).cast(blocks.schema["rows"].dataType).alias("right_rows"))
    shared = min(SHARED, pivots)

    def side(rows: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each list begins, cells, and their pivots as bits."""
        flat = rows.flatten()
        near = flat.field("nearest")
        bits = np.zeros((len(flat), pivots), np.uint8)
        bits[np.repeat(np.arange(len(flat)), np.diff(near.offsets.to_numpy())), near.flatten().to_numpy()] = 1
        words = np.packbits(np.pad(bits, ((0, 0), (0, -pivots % 64))), axis=1).view(np.uint64)
        starts = rows.offsets.to_numpy()
        return starts - starts[0], flat.field("cell").to_numpy(), words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            cells_in = sum(pc.list_value_length(whole.column(c)).fill_null(0).to_numpy() for c in ("left_rows", "right_rows"))
            # A few thousand cells at a time, as their bits are wide.
            turns = np.cumsum(cells_in) // (2 * _BLOCK)
            for turn in np.unique(turns):
                begin, end = np.searchsorted(turns, [turn, turn + 1])
                batch = whole.slice(begin, end - begin)
                lefts, rights = batch.column("left_rows"), batch.column("right_rows")
                alone = rights.is_null().to_numpy(zero_copy_only=False)
                left_at, left_cells, left_bits = side(lefts)
                right_at, right_cells, right_bits = side(rights)
                found: list[np.ndarray] = []
                for i in range(batch.num_rows):
                    mine = slice(left_at[i], left_at[i + 1])
                    other = mine if alone[i] else slice(right_at[i], right_at[i + 1])
                    cells_, bits = (left_cells, left_bits) if alone[i] else (right_cells, right_bits)
                    for start in range(mine.start, mine.stop, 256):
                        some = slice(start, min(start + 256, mine.stop))
                        same = np.bitwise_count(left_bits[some, None] & bits[None, other]).sum(2, dtype=np.int32)
                        p, q = np.nonzero(same >= shared)
                        pair = np.stack([left_cells[some][p], cells_[other][q]], 1)
                        found.append(np.sort(pair[(pair[:, 0] < pair[:, 1]) | (not alone[i])], axis=1))
                pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return inside.unionByName(across).mapInArrow(run, "a bigint, b bigint").distinct()


def _verdict(angle: Column, reach: Column, limit: float) -> Column:
    """Whether all pairs between two balls are within ``limit``; NULL if that must be looked up."""
    return F.when(angle + reach <= limit - _ROOM, True).when(angle - reach > limit + _ROOM, False)


def _with_members(rows: DataFrame, members: DataFrame, side: str) -> DataFrame:
    """Replace cell ``side`` of each row by its members; large cells come in parts, so that none gathers in one task."""
    parts = F.ceil(F.col("members") / _BLOCK).cast("int")
    part = F.pmod(F.xxhash64("id"), parts).cast("int")
    inner = members.select(
        F.col("cell").alias(side), part.alias("_part"), F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"),
        F.col("vector").alias(f"{side}_vector"), F.col("norm").alias(f"{side}_norm"),
    )
    every = F.sequence(F.lit(0), F.ceil(F.col(f"{side}_members") / _BLOCK).cast("int") - 1)
    return rows.withColumn("_part", F.explode(every)).join(inner, [side, "_part"]).drop("_part")


def links(classes: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All links of classes with one label and length, without the pairs inside cells:

    members of cells; ``a, b`` cells linked as wholes; ``a_id, a, b`` members linked to a whole cell; and ``a_id, a, b_id,
    b`` single links.
    """
    limit = math.acos(threshold)
    # Pivots lie far apart by the measure of a link, so that linked vectors see them in much the same order.
    pivots = choose_pivots(classes, math.cos(min(2 * limit, math.pi / 2)))
    described = stored(_described(classes, pivots), "described")
    members, cells = _cells(_members(described, limit / 2))
    facts = cells.select("cell", "members", "vector", "norm", "radius")
    as_side = lambda s: facts.select(
        F.col("cell").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("members", "vector", "norm", "radius")]
    )
    pairs = stored(_candidates(cells, len(pivots)), "candidates")
    count = pairs.count()
    met = lookup(pairs, as_side("a"), ["a"], "inner", at_most=count)
    met = lookup(met, as_side("b"), ["b"], "inner", at_most=count)
    cosine, reach = _cosine("a", "b"), F.col("a_radius") + F.col("b_radius")
    singles = (F.col("a_members") == 1) & (F.col("b_members") == 1)
    judged = met.withColumn(
        "linked", F.when(singles, cosine >= threshold).otherwise(_verdict(_angle(cosine), reach, limit))
    )
    judged = stored(
        judged.filter(F.col("linked").isNull() | F.col("linked")).select("a", "b", "a_members", "b_members", "linked"), "judged"
    )
    whole = judged.filter("linked").select("a", "b")

    # Members of the larger cell against the other one's ball.
    larger = F.col("a_members") >= F.col("b_members")
    turned = judged.filter(F.col("linked").isNull()).select(
        *[F.when(larger, F.col(f"a{c}")).otherwise(F.col(f"b{c}")).alias(f"a{c}") for c in ("", "_members")],
        *[F.when(larger, F.col(f"b{c}")).otherwise(F.col(f"a{c}")).alias(f"b{c}") for c in ("", "_members")],
    )
    balls = as_side("b").drop("b_members")
    one = _with_members(lookup(turned, balls, ["b"], "inner"), members, "a")
    near = F.when(F.col("b_members") == 1, _cosine("a", "b") >= threshold).otherwise(
        _verdict(_angle(_cosine("a", "b")), F.col("b_radius"), limit)
    )
    one = one.withColumn("linked", near).filter(F.col("linked").isNull() | F.col("linked"))
    one = stored(one.select("a", "a_id", "a_n", "a_vector", "a_norm", "b", "b_members", "linked"), "opened")
    to_cell = one.filter("linked").select("a_id", "a", "a_n", "b")
    both = _with_members(one.filter(F.col("linked").isNull()), members, "b").filter(_cosine("a", "b") >= threshold)
    return members, whole, to_cell, stored(both.select("a_id", "a", "a_n", "b_id", "b", "b_n"), "links")


def near_vectors(rows: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``id, n_links, component_id, kept`` for every row of ``id, vector, label``.

    Rows of one label whose vectors have a cosine of at least ``threshold`` are linked; ``n_links`` counts the other rows
    a row is linked with, ``component_id`` is the smallest id that links lead to.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold is a cosine between 0 and 1")
    rows = rows.select("id", "vector", "label")
    classes = _classes(rows)
    members, whole, to_cell, single = links(classes, threshold)
    cell_n = members.select("cell", "cell_n").dropDuplicates(["cell"])
    sized = lambda df, c: lookup(df, cell_n.withColumnRenamed("cell", c), [c], "inner")

    # What all members of a cell gain, and what single members gain besides.
    gains = [
        sized(whole, "b").select(F.col("a").alias("cell"), F.col("cell_n").alias("k")),
        sized(whole, "a").select(F.col("b").alias("cell"), F.col("cell_n").alias("k")),
        to_cell.select(F.col("b").alias("cell"), F.col("a_n").alias("k")),
    ]
    by_cell = gains[0].union(gains[1]).union(gains[2]).groupBy("cell").agg(F.sum("k").alias("cell_k"))
    own = [
        sized(to_cell, "b").select(F.col("a_id").alias("id"), F.col("cell_n").alias("k")),
        single.select(F.col("a_id").alias("id"), F.col("b_n").alias("k")),
        single.select(F.col("b_id").alias("id"), F.col("a_n").alias("k")),
    ]
    by_member = own[0].union(own[1]).union(own[2]).groupBy("id").agg(F.sum("k").alias("k"))

    edges = whole.union(to_cell.select("a", "b")).union(single.select("a", "b")).distinct()
    parts = connected_components(edges).withColumnRenamed("node", "cell")
    joined = lookup(members, parts, ["cell"]).withColumn("component", F.coalesce("component", "cell"))
    joined = stored(joined, "components")
    lows = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    zero, count = F.lit(0).cast("bigint"), joined.count()
    counted = lookup(joined, lows, ["component"], at_most=count)
    counted = lookup(counted, by_cell, ["cell"], at_most=count).join(by_member, "id", "left")
    result = counted.select(
        "label",
        "vector",
        (F.col("cell_n") - 1 + F.coalesce("cell_k", zero) + F.coalesce("k", zero)).alias("n_links"),
        "component_id",
    )
    # Back to the rows by label and vector, as they were grouped.
    keyed = rows.withColumn("_key", F.transform("vector", lambda c: c.cast("double")))
    linked = lookup(keyed, result.withColumnRenamed("vector", "_key").withColumn("_in", F.lit(True)), ["label", "_key"])
    component = F.when(F.col("_in"), F.col("component_id")).otherwise(F.col("id"))
    return linked.select(
        "id", F.coalesce("n_links", zero).alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
