"""Building blocks that keep every operator safe on skewed and very large inputs.

* ``cut`` ends a lineage in a table in shared storage, so that iterations survive lost executors.
* ``hot_hashes`` finds the few keys that hold too many rows for one task. Their number is bounded by arithmetic:
  a key is hot only above ``total / HOT_GROUPS`` rows, so there are never more than ``HOT_GROUPS`` of them.
* ``lookup`` joins a table with unique keys; rows of hot keys meet a broadcast of at most ``HOT_GROUPS`` rows and so
  stay where they are, all other rows take the ordinary join.
* ``running_total`` and ``global_rank`` order any number of rows without a single-task window.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: Most keys that can be treated as hot, hence the most rows ``lookup`` broadcasts.
HOT_GROUPS = 2_000
#: A key with fewer rows than this is never hot; one task sorts or aggregates that many rows with ease.
HOT_ROWS = 1_000_000

_own_roots: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables, as named by the cluster's ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    # Only a local session without the setting, as in tests, gets a folder of its own.
    application = spark.sparkContext.applicationId
    if application not in _own_roots:
        _own_roots[application] = tempfile.mkdtemp(prefix="driftmap-")
    return _own_roots[application]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this application wrote; results that still read them must be stored before."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(settings).delete(target, True)
    return len(paths)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and return that table, with no lineage behind it.

    A written table, unlike a checkpointed plan, tells the optimizer its true size, and is read by column.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``cut``, and the number of ``rows`` and of rows meeting each condition, counted while writing."""
    seen = Observation()
    tally = [F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in counts.items()]]
    return cut(df.observe(seen, *tally)), seen.get


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_hashes(
    df: DataFrame, keys: Sequence[str], hot_rows: int | None = None, at_most: int | None = None, most: int | None = None
) -> list[int]:
    """Hashes of the keys that hold more than ``max(hot_rows, total / HOT_GROUPS)`` rows; at most ``HOT_GROUPS``.

    ``at_most`` is a known upper bound of the number of rows, which saves counting them; ``most`` is one of the rows of a single
    key, which saves counting by key if it is low.
    """
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    if most is not None and most <= hot_rows:
        return []
    hashed = df.select(key_hash(keys).alias("_key"))
    total = hashed.count() if at_most is None else at_most
    if total <= hot_rows:
        return []
    counts = hashed.groupBy("_key").count()
    hot = counts.filter(F.col("count") > max(hot_rows, total // HOT_GROUPS))
    return sorted(row["_key"] for row in hot.collect())


def split_hot(df: DataFrame, keys: Sequence[str], hot: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Rows of hot keys, and the other rows."""
    is_hot = key_hash(keys).isin(list(hot))
    return df.filter(is_hot), df.filter(~is_hot)


def lookup(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot_rows: int | None = None,
    at_most: int | None = None,
    hot: Sequence[int] | None = None,
    most: int | None = None,
) -> DataFrame:
    """Join ``table``, unique in ``keys``, onto ``df`` without gathering a hot key's rows in one task.

    ``hot`` names the hot keys by hash if they are known; ``at_most`` and ``most`` are bounds for ``hot_hashes``.
    """
    keys = list(keys)
    if hot is None:
        hot = hot_hashes(df, keys, hot_rows, at_most, most)
    if not hot:
        return df.join(table, keys, how)
    hot_df, cold_df = split_hot(df, keys, hot)
    hot_table, _ = split_hot(table, keys, hot)
    # hot_table has at most one row per hot key, so at most HOT_GROUPS rows.
    return hot_df.join(F.broadcast(hot_table), keys, how).unionByName(cold_df.join(table, keys, how))


def _sliced(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Spread rows over tasks in global ``order`` and record each row's slice; cut so that slices stay as they are."""
    ranged = df.repartitionByRange(*[F.col(c) for c in order])
    return cut(ranged.withColumn("_slice", F.spark_partition_id()))


def running_total(
    df: DataFrame,
    order: Sequence[str],
    measure: str,
    name: str,
    groups: Sequence[str] = (),
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``measure`` over the rows before this one in ``order``, within ``groups``.

    ``order`` must not tie inside a group. Rows are range-partitioned, summed per slice, and the slice totals (one row
    per slice and group boundary) are carried forward. ``keep`` may choose among the slices, given with the sum
    ``_carried`` before each and its own ``_total``; the rows of the others are dropped before they are sorted. Columns
    that it adds to a slice are added to the slice's rows.
    """
    groups, order = list(groups), list(order)
    spread = _sliced(df, groups + order)
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = spread.groupBy(*groups, "_slice").agg(F.sum(measure).alias("_total"))
    carried = totals.withColumn("_carried", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    if keep is not None:
        carried = keep(carried)
    inside = (
        Window.partitionBy(*groups, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    # carried has at most (number of slices + number of groups) rows.
    return (
        spread.join(F.broadcast(carried.drop("_total")), [*groups, "_slice"])
        .withColumn(name, F.coalesce(F.sum(measure).over(inside), F.lit(0)) + F.col("_carried"))
        .drop("_carried", "_slice")
    )


def global_rank(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add ``name``: the 0-based position of each row in ``order`` over the whole table."""
    return running_total(df.withColumn("_one", F.lit(1).cast("bigint")), order, "_one", name).drop("_one")
