"""Joins, filters, samples and top lists."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmap.operators.scale import lookup


#: Rows per group that Spark keeps in each task before a shuffle (its window group limit), and parts of larger groups.
_RANKED_EARLY, _GROUP_PARTS = 1000, 64


def keep_relevant(
    df: DataFrame, urls: DataFrame, key: str = "url", how: str = "left_semi", hot: Sequence[int] | None = None
) -> DataFrame:
    """Keep rows whose ``key`` is listed. ``how="inner"`` repeats a row for every copy of its key in the list.

    Rows of keys with too many rows for one task stay where they are; ``hot`` names such keys by hash if they are known.
    """
    if how != "left_semi":
        return df.join(urls.select(key), key, how)
    return lookup(df, urls.select(key).distinct(), [key], how, hot=hot)


def name_clusters(df: DataFrame, names: DataFrame) -> DataFrame:
    """Attach ``name`` to cluster ids, NULL where a cluster has none; ``names`` has one row per ``prediction``."""
    return lookup(df, names.select("prediction", "name"), ["prediction"])


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features", handle_invalid: str = "skip") -> DataFrame:
    """Combine numeric or vector columns into one ML vector column."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=handle_invalid).transform(df)


def changed_only(df: DataFrame, cols: str | Sequence[str]) -> DataFrame:
    """Rows in which at least one of ``cols`` is not zero."""
    names = [cols] if isinstance(cols, str) else list(cols)
    return df.filter(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in names]))


def non_negative(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col) >= 0)


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def _key_draw(key: Column) -> Column:
    """A number in 0 .. 2**32-1 that depends on the key only."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_sample(df: DataFrame, key: str, fraction: float) -> DataFrame:
    """A sample by key: all rows of a key are in or out, in every run and however the data is partitioned."""
    return df.filter(_key_draw(F.col(key)) < int(fraction * 2**32))


def cluster_members(df: DataFrame, cluster: int, n: int = 40, key: str = "url") -> DataFrame:
    """All members of a cluster if there are at most ``n``, else a repeatable sample of ``n``."""
    return df.filter(F.col("prediction") == cluster).orderBy(F.md5(key), key).limit(n)


def top_n_per_group(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``.

    Each task keeps ``n`` per group before rows are shuffled. Spark does that up to ``_RANKED_EARLY``; for more, rows are
    first ranked in parts of each group.
    """
    groups = [group] if isinstance(group, str) else list(group)
    if n > _RANKED_EARLY:
        part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(_GROUP_PARTS))
        inside = Window.partitionBy(*groups, "_part").orderBy(*order)
        df = df.withColumn("_part", part).withColumn("_rank", F.row_number().over(inside))
        df = df.filter(F.col("_rank") <= n).drop("_part", "_rank")
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


def top_k(df: DataFrame, col: str, k: int = 1, tie: Sequence[str] = ()) -> DataFrame:
    """The ``k`` rows with the largest ``col``."""
    return df.orderBy(F.col(col).desc_nulls_last(), *tie).limit(k)
