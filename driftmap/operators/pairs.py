"""Pairing consecutive snapshots of the same key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftmap.operators.scale import cut, hot_hashes, split_hot


def consecutive_pairs(
    df: DataFrame,
    key: str | Sequence[str],
    order: str | Sequence[str],
    cols: Sequence[str],
    tie: Sequence[str] = (),
    require: str | None = None,
    hot_rows: int | None = None,
    hot: Sequence[int] | None = None,
    prefix: str = "previous_",
    keep_first: bool = False,
) -> DataFrame:
    """Add ``previous_<col>`` from the row before in ``order`` (then ``tie``) within ``key``.

    Rows whose ``previous_<require>`` is NULL are left out (the first of each key, and successors of a row without that
    value); ``require`` defaults to the first of ``cols``. Keys with too many rows for one task are cut into ordered
    slices, each handed the last row of the slice before it. ``hot`` names such keys by hash if they are known.
    With ``keep_first`` no row is left out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ordering = ([order] if isinstance(order, str) else list(order)) + list(tie)
    required = prefix + (require or cols[0])

    if hot is None:
        hot = hot_hashes(df, keys, hot_rows)
    if hot:
        hot_df, cold_df = split_hot(df, keys, hot)
        paired = _lag_in_key(cold_df, keys, ordering, cols, prefix).unionByName(
            _lag_over_slices(hot_df, keys, ordering, cols, prefix)
        )
    else:
        paired = _lag_in_key(df, keys, ordering, cols, prefix)
    return paired if keep_first else paired.filter(F.col(required).isNotNull())


def _lag_in_key(df: DataFrame, keys: list[str], order: list[str], cols: Sequence[str], prefix: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({prefix + c: F.lag(c).over(window) for c in cols})


def _lag_over_slices(
    df: DataFrame, keys: list[str], order: list[str], cols: Sequence[str], prefix: str
) -> DataFrame:
    # Numbering the rows first, in storage, lets even equal copies of one row be spread over slices.
    numbered = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    position = [*order, "_row"]
    ranged = numbered.repartitionByRange(*[F.col(c) for c in (*keys, *position)])
    spread = cut(ranged.withColumn("_slice", F.spark_partition_id()))

    last = spread.groupBy(*keys, "_slice").agg(
        F.max_by(F.struct(*cols), F.struct(*position)).alias("_carry")
    )
    over_slices = Window.partitionBy(*keys).orderBy("_slice")
    carried = last.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col("_slice").alias("_key_slice"),
        F.lag("_carry").over(over_slices).alias("_carry"),
    )
    same = F.col("_slice") == F.col("_key_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))

    window = Window.partitionBy(*keys, "_slice").orderBy(*position)
    # carried has one row per hot key and slice: at most HOT_GROUPS plus the number of slices.
    return (
        spread.withColumns({prefix + c: F.lag(c).over(window) for c in cols})
        .withColumn("_first", F.row_number().over(window) == 1)
        .join(F.broadcast(carried), same, "left")
        .withColumns(
            {prefix + c: F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.col(prefix + c)) for c in cols}
        )
        .drop("_row", "_slice", "_first", "_carry", "_key_slice", *[f"_key_{k}" for k in keys])
    )
