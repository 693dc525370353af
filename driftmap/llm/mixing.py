"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are dealt into blocks by a hash. Every source draws whole blocks in a random order, without replacement within
a pass over the source, until its target is reached; only the last block is cut. The exact numbers of drawn blocks per
source are then split among the output shards by a binary tree: each node divides its blocks in two halves, and each
half's numbers per source follow the multivariate hypergeometric distribution. The tree is a table of blocks with the
node each has reached, written once a level. Shard ``s`` takes the next blocks of each source's permutation, so shards are disjoint, and shuffles its rows locally.

Everything is DataFrame operations. Rows are aggregated to (source, block) before any shuffle; there are about
``sqrt(rows)`` blocks, so neither a block nor the blocks of a hot source outgrow a task. The tables per source hold one
row per source name.

Defined results: NULL texts have no words; NULL sources form one source, last in order; documents without words are
drawn with their block but add nothing; repeated rows are drawn together; an empty table gives an empty mix; columns of
any name are carried in the struct ``doc``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmap.llm.common import draw_key, first_32_bits, group_label, n_words, root_of
from driftmap.operators.scale import cut, running_total

#: Text per task of the mix, and how many ranges of a shard one task takes, so that hashing them evens out.
TASK_BYTES = 128 << 20
RANGES_PER_TASK = 8


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``label, source_size, target`` from one row per source with ``source, label, source_size``.

    Sources share ``share`` times all words by weight; none gets more than ``cap`` times its own, and what is cut off is
    shared again by weight among the others. Sorted by the level at which they are full, the level of the rest follows
    from running sums.
    """
    repeated = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("weight", F.element_at(repeated, (place - 1) % len(weights) + 1)).withColumn(
        "full", cap * F.col("source_size")
    )
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_level = Window.orderBy(F.col("full") / F.col("weight"), "label")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", left / F.sum("weight").over(from_here)).withColumn(
        "place", F.row_number().over(by_level)
    )
    first_open = F.min(
        F.when(F.col("level") * F.col("weight") <= F.col("full"), F.struct("place", "level"))
    ).over(everything)
    open_level = first_open["level"]
    target = F.coalesce(F.least(F.col("full"), open_level * F.col("weight")), F.col("full"))
    return levels.withColumn("target", target).select("label", "source_size", "target")


def split_tree(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """``shard, label, blocks``: the exact quotas (``label, blocks``) divided among ``shards``; rows above 0 only.

    The drawn blocks are rows, each at a node of the tree. A node sends the right number of its blocks, those with the
    smallest coins of that node, to its left half: how many of each source go left then follows the multivariate
    hypergeometric distribution. Coins are ranked over range partitions, so no node has to fit into a task.
    """
    nodes = quotas.filter("blocks > 0").select(
        "label",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("number"),
        F.lit(0).alias("first"),
        F.lit(shards).alias("leaves"),
        F.lit(1).cast("bigint").alias("one"),
    )
    half = F.floor(F.col("leaves") / 2).cast("int")

    def counted(slices: DataFrame) -> DataFrame:
        """A node's blocks are the sum over its slices, so a level reads only what it wrote, not the levels before."""
        return slices.withColumn("total", F.sum("_total").over(Window.partitionBy("first")))

    for _ in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        coin = F.md5(F.concat_ws(":", F.lit(seed), "first", "leaves", "label", "number"))
        tossed = nodes.withColumn("coin", coin)
        ranked = running_total(tossed, ["coin", "label", "number"], "one", "rank", ["first"], keep=counted)
        goes_left = F.col("rank") < F.floor(F.col("total") * half / F.col("leaves"))
        nodes = ranked.select(
            "label",
            "number",
            F.when(goes_left | (F.col("leaves") == 1), F.col("first")).otherwise(F.col("first") + half).alias("first"),
            F.when(F.col("leaves") == 1, 1).when(goes_left, half).otherwise(F.col("leaves") - half).alias("leaves"),
            "one",
        )
    return nodes.groupBy(F.col("first").alias("shard"), "label").agg(F.count(F.lit(1)).alias("blocks"))


def plan_mix(
    docs: DataFrame,
    carry: Sequence[str] | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 16,
    seed: str = "mix",
) -> DataFrame:
    """What the mix takes of each document: ``doc, size, source_size, target, draws``.

    ``docs`` has ``doc_id``, ``text`` and ``source``. ``doc`` holds the columns ``carry`` (all by default); ``draws`` has
    ``copy, shard, place`` for each time the document is taken. Sources weigh ``weights``, repeated in the order of
    their names.
    """
    blocks = root_of(docs.count())
    key = draw_key(seed, F.col("doc_id"), F.col("text"))
    rows = (
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("doc"),
            F.col("source").cast("string").alias("source"),
            group_label(F.col("source")).alias("label"),
            n_words(F.col("text")).alias("size"),
            key.alias("key"),
        )
        .withColumn("block", first_32_bits(F.col("key")) % blocks)
    )
    units = cut(rows.groupBy("source", "label", "block").agg(F.sum("size").alias("words")))
    sizes = units.groupBy("source", "label").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)

    copies = F.explode(F.sequence(F.lit(0), F.lit(max(0, math.ceil(cap) - 1)))).alias("copy")
    order = ["copy", "turn", "block"]
    drawn = (
        units.join(targets, "label")
        .select("label", "block", "words", "source_size", "target", copies)
        .withColumn("turn", F.md5(F.concat_ws(":", F.lit(seed), "copy", "label", "block")))
        .withColumn(
            "before",
            F.coalesce(
                F.sum("words").over(
                    Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .withColumn("number", F.row_number().over(Window.partitionBy("label").orderBy(*order)) - 1)
        .withColumn("limit", F.col("target") - F.col("before"))
    )
    drawn = cut(drawn)
    taken = drawn.filter(F.col("limit") > 0)
    quotas = taken.groupBy("label").agg(F.count(F.lit(1)).alias("blocks"))
    dealt = split_tree(quotas, shards, seed)
    earlier = Window.partitionBy("label").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    seats = (
        dealt.withColumn("first", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)))
        .select("label", "shard", F.explode(F.expr("sequence(first, first + blocks - 1)")).alias("number"))
    )
    draws = (
        taken.join(seats, ["label", "number"])
        .groupBy("label", "block")
        .agg(F.collect_list(F.struct("copy", "shard", "limit")).alias("block_draws"))
    )
    units_drawn = drawn.filter("copy = 0").select("label", "block", "source_size", "target").join(
        draws, ["label", "block"], "left"
    )
    units_drawn = cut(units_drawn)  # one row per source and block; the rows below meet a table, not the plan of the tree
    inside = Window.partitionBy("label", "block").orderBy("key", "size")
    # Of the last block, the documents up to the one nearest to the target are taken.
    middle = F.col("_before") + F.col("size") / 2
    return (
        rows.join(units_drawn, ["label", "block"])
        .withColumn(
            "_before",
            F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .select(
            "doc",
            "size",
            "source_size",
            "target",
            F.transform(
                F.filter(F.coalesce("block_draws", F.array()), lambda d: middle <= d["limit"]),
                lambda d: F.struct(
                    d["copy"].alias("copy"),
                    d["shard"].alias("shard"),
                    F.md5(F.concat_ws(":", F.lit(seed), d["copy"], F.col("key"))).alias("place"),
                ),
            ).alias("draws"),
        )
    )


def mix(docs: DataFrame, shards: int = 16, task_bytes: int = TASK_BYTES, **options) -> DataFrame:
    """The mix itself: ``shard, copy, doc``, one row per time a document is taken, shuffled within its shard.

    A shard is written by as many tasks as its share of all text asks for, each with the rows of some ranges of the
    random ``place`` that orders the shard.
    """
    plan = plan_mix(docs, shards=shards, **options)
    text = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(text * options.get("share", 1.5) / task_bytes))
    ranges = math.ceil(RANGES_PER_TASK * tasks / shards)
    part = F.floor(first_32_bits(F.col("place")) * ranges / 2**32)
    return (
        plan.select("doc", F.explode("draws").alias("draw"))
        .select("draw.shard", "draw.copy", "draw.place", "doc")
        .withColumn("part", part)
        .repartition(tasks, "shard", "part")
        .sortWithinPartitions("shard", "place")
        .drop("place", "part")
    )
