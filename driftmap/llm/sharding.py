"""Sharding by proportional stratified interleaving.

Rows are put in a seeded random order within their source and given the fractional rank ``(rank + 1/2) / rows of the
source``. Sorted by it, every stretch of the table holds all sources in proportion; cut into equal counts, so does every
shard. Law: ``rows`` (counts are at most one apart).

Both sorts use about ``sqrt(rows)`` buckets of a uniform value, so no task sorts a whole source: the rank within a
source is the number of rows in earlier hash buckets plus the rank in the bucket, and the rows before each bucket of
fractional ranks follow from the sources' counts alone.

Defined results: NULL sources form one stratum; NULL texts have no bytes and the crc32 of the empty text; rows that are
equal in all of ``doc_id``, ``text`` and ``source`` are interchangeable; empty tables give no rows; columns of any name
are carried in the struct ``doc``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.llm.common import draw_key, first_32_bits, group_label, root_of


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def text_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def interleave(
    docs: DataFrame, shards: int = 40, carry: Sequence[str] | None = None, seed: str = "shards", **columns: Column
) -> DataFrame:
    """``shard, slot, doc`` and the given ``columns``, computed before any shuffle.

    ``docs`` has ``doc_id``, ``text`` and ``source``; ``doc`` holds the columns ``carry``, by default all.
    """
    rows = docs.count()
    buckets = root_of(rows)
    key = draw_key(seed, F.col("doc_id"), F.col("text"))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("doc"),
        F.struct(*[c.alias(name) for name, c in columns.items()], F.lit(0).alias("_")).alias("computed"),
        group_label(F.col("source")).alias("label"),
        key.alias("key"),
    ).withColumn("bucket", F.shiftright(first_32_bits(F.col("key")) * buckets, 32))

    by_label = Window.partitionBy("label")
    counts = (
        keyed.groupBy("label", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "label",
            "bucket",
            F.coalesce(
                F.sum("n").over(by_label.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("earlier"),
            F.sum("n").over(by_label).alias("of_source"),
        )
    )
    ranked = (
        keyed.join(counts, ["label", "bucket"])
        .withColumn(
            "rank",
            F.col("earlier") + F.row_number().over(Window.partitionBy("label", "bucket").orderBy("key")) - 1,
        )
        .withColumn("part", (2 * F.col("rank") + 1) / (2 * F.col("of_source")))
        .withColumn("slice", F.expr(f"(2 * rank + 1) * {buckets} div (2 * of_source)"))
    )
    # Rows of a source with a fractional rank below slice / buckets, in whole numbers.
    below = F.expr(f"greatest(0, (2 * of_source * slice + {buckets} - 1) div (2 * {buckets}))")
    before = (
        counts.groupBy("label")
        .agg(F.max("of_source").alias("of_source"))
        .select("of_source", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("slice"))
        .groupBy(F.col("slice").cast("bigint").alias("slice"))
        .agg(F.sum(below).alias("rows_before"))
    )
    inside = Window.partitionBy("slice").orderBy("part", "label", "key")
    return (
        ranked.join(before, "slice")
        .withColumn("at", F.col("rows_before") + F.row_number().over(inside) - 1)
        .withColumn("shard", F.expr(f"cast(at * {shards} div {max(1, rows)} as int)"))
        .withColumn("slot", F.expr(f"at - (shard * {rows}L + {shards - 1}) div {shards}"))
        .select("shard", "slot", "doc", *[F.col(f"computed.{name}").alias(name) for name in columns])
    )
