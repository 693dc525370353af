"""Counts, shares, summaries and histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmap.functions.vectors import parse_vector
from driftmap.operators.scale import cut, running_total


def _is_float(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType))


def _present(df: DataFrame, col: str) -> Column:
    """Neither NULL nor NaN."""
    known = F.col(col).isNotNull()
    return known & ~F.isnan(col) if _is_float(df, col) else known


def _per_column(df: DataFrame, cols: Sequence[str], measures: dict[str, callable]) -> DataFrame:
    """One pass over ``df``; one result row per column with the given aggregates."""
    parts = [
        F.struct(F.lit(c).alias("column"), *[make(c).alias(name) for name, make in measures.items()]) for c in cols
    ]
    # The aggregate is a single row; it is turned into rows afterwards.
    return df.agg(F.array(*parts).alias("_rows")).select(F.inline("_rows"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def vector_coverage(df: DataFrame, col: str = "semanticVector") -> DataFrame:
    """How many vectors are set, not set, or neither, with percentages of all rows."""
    is_set, not_set = F.col(col).startswith("["), F.col(col) == "not set"
    counts = df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(is_set).alias("n_set"),
        F.count_if(not_set).alias("n_not_set"),
    )
    share = lambda c: F.round(100.0 * F.col(c) / F.nullif("n_rows", F.lit(0)), 2)
    return counts.withColumns(
        {
            "n_other": F.col("n_rows") - F.col("n_set") - F.col("n_not_set"),
            "set_pct": share("n_set"),
            "not_set_pct": share("n_not_set"),
        }
    )


def corrupt_profile(df: DataFrame) -> DataFrame:
    """Rows per malformed text; NULL stands for well-formed rows."""
    # Looking at the address as well keeps the scan from reading the corrupt column alone, which Spark refuses.
    malformed = F.col("_corrupt_record").isNotNull() | F.col("url").isNull()
    text = F.when(malformed, F.col("_corrupt_record")).alias("_corrupt_record")
    return df.groupBy(text).agg(F.count("*").alias("count"))


def vector_lengths(df: DataFrame, col: str = "semanticVector") -> DataFrame:
    """Rows per vector length; 0 is an empty vector, NULL one that is not set."""
    vector = F.col(col)
    if isinstance(df.schema[col].dataType, T.StringType):
        vector = parse_vector(vector)
    length = F.when(vector.isNotNull(), F.size(vector))
    return df.groupBy(length.alias("length")).agg(F.count("*").alias("count"))


def snapshots_per_key(df: DataFrame, key: str = "url") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("count"))


def distinct_keys(df: DataFrame, key: str = "url", approximate: bool = False) -> DataFrame:
    counted = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.agg(counted.alias("n_keys"))


def zero_counts(df: DataFrame, cols: Sequence[str], atol: float = 0.0) -> DataFrame:
    """Per column, rows whose value is zero (within ``atol``); all columns in one pass."""
    return _per_column(df, cols, {"zeros": lambda c: F.count_if(F.abs(c) <= atol if atol else F.col(c) == 0)})


def zero_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column, the percentage of rows that are zero, to one decimal; NULL counts as not zero."""
    is_zero = lambda c: F.coalesce((F.col(c) == 0).cast("int"), F.lit(0))
    return _per_column(df, cols, {"zero_pct": lambda c: F.round(100 * F.avg(is_zero(c)), 1)})


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return _per_column(df, cols, {"nulls": lambda c: F.count_if(F.col(c).isNull())})


def changed_share(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows in which any of ``cols`` is not zero, against all rows."""
    changed = F.lit(False)
    for c in cols:
        changed = changed | (F.col(c) != 0)
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(changed).alias("n_changed"),
        (F.count_if(changed) / F.nullif(F.count("*"), F.lit(0))).alias("changed_ratio"),
    )


def unchanged_keys(df: DataFrame, key: str, col: str) -> DataFrame:
    """Keys whose mean difference is zero, with their number of rows."""
    means = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.avg(col).alias("_mean"))
    return means.filter(F.col("_mean") == 0).drop("_mean")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value in value order; missing values are not counted."""
    return df.filter(_present(df, col)).groupBy(col).agg(F.count("*").alias("count")).orderBy(col)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: ``column, prob, value``.

    Values are counted first, then ranked by a distributed running total, so no task holds a whole column and a value
    shared by many rows costs one.
    """
    cells = F.inline(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    )
    counts = cut(
        df.select(cells)
        .filter(F.col("value").isNotNull() & ~F.isnan("value"))
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )
    total = counts.groupBy("column").agg(F.sum("n").alias("total"))
    wanted = total.select(
        "column", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"), "total"
    ).withColumn("place", F.col("prob") * (F.col("total") - 1))
    floor, ceil = F.floor("place"), F.ceil("place")

    def holding(slices: DataFrame) -> DataFrame:
        """Only the slices with one of the wanted places are ranked."""
        reach = (F.col("_carried") <= ceil) & (floor < F.col("_carried") + F.col("_total"))
        return slices.join(F.broadcast(wanted), "column").filter(reach).select(slices.columns).distinct()

    ranked = running_total(counts, ["value"], "n", "first", groups=["column"], keep=holding)
    # wanted has len(cols) * len(probs) rows; each value answers for the places within its run of equal copies.
    holds = lambda place: (F.col("first") <= place) & (place < F.col("first") + F.col("n"))
    found = ranked.join(F.broadcast(wanted), "column").filter(holds(floor) | holds(ceil))
    low = F.max(F.when(holds(floor), F.col("value")))
    high = F.max(F.when(holds(ceil), F.col("value")))
    weight = F.first(F.col("place") - floor)
    return found.groupBy("column", "prob").agg((low + (high - low) * weight).alias("value"))


def summary_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: ``count, mean, std, min, p25, p50, p75, max`` of the values present; quartiles are exact."""
    present = lambda c: F.when(_present(df, c), F.col(c).cast("double"))
    moments = _per_column(
        df,
        cols,
        {
            "count": lambda c: F.count(present(c)),
            "mean": lambda c: F.avg(present(c)),
            "std": lambda c: F.stddev_samp(present(c)),
            "min": lambda c: F.min(present(c)),
            "max": lambda c: F.max(present(c)),
        },
    )
    probs = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    quartiles = exact_quantiles(df, cols, list(probs.values()))
    wide = quartiles.groupBy("column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for name, p in probs.items()]
    )
    return moments.join(wide, "column", "left").select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"
    )


def histogram(df: DataFrame, col: str, n: int = 20, edges: Sequence[float] | None = None) -> DataFrame:
    """Rows per bin: ``bin, lo, hi, count``, empty bins included, the last bin closed on both sides.

    With ``edges`` the bins are fixed and values outside them are not counted; otherwise ``n`` bins of equal width span
    the values, one bin if they are all equal, none if there are no values. NULL, NaN and infinite values are ignored.
    """
    spark = df.sparkSession
    v = F.col("v")
    values = df.filter(_present(df, col)).select(F.col(col).cast("double").alias("v")).filter(F.abs(v) < float("inf"))
    if edges is not None:
        bounds = F.array(*[F.lit(float(e)) for e in edges])
        last = len(edges) - 2
        inside = values.filter((v >= float(edges[0])) & (v <= float(edges[-1])))
        position = F.least(F.size(F.filter(bounds, lambda e: e <= v)) - 1, F.lit(last)).cast("bigint")
        bins = spark.range(0, last + 1, 1, 1).select(
            F.col("id").alias("bin"),
            F.element_at(bounds, (F.col("id") + 1).cast("int")).alias("lo"),
            F.element_at(bounds, (F.col("id") + 2).cast("int")).alias("hi"),
        )
        counts = inside.groupBy(position.alias("bin")).agg(F.count("*").alias("count"))
    else:
        span = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
        lo, hi = span["lo"], span["hi"]
        step = (hi - lo) / n
        position = F.when(hi > lo, F.least(F.floor((v - lo) / step), F.lit(n - 1))).otherwise(F.lit(0))
        bin_ = F.col("bin")
        bins = (
            spark.range(0, n, 1, 1)
            .withColumnRenamed("id", "bin")
            .filter(lo.isNotNull() & ((bin_ == 0) | (hi > lo)))
            .select(
                "bin",
                (lo + bin_ * step).alias("lo"),
                F.when((bin_ == n - 1) | (hi == lo), hi).otherwise(lo + (bin_ + 1) * step).alias("hi"),
            )
        )
        counts = values.groupBy(position.cast("bigint").alias("bin")).agg(F.count("*").alias("count"))
    # Both sides have one row per bin.
    return bins.join(counts, "bin", "left").select("bin", "lo", "hi", F.coalesce("count", F.lit(0)).alias("count"))


def histogram_2d(df: DataFrame, x: str, y: str, nx: int = 50, ny: int = 50) -> DataFrame:
    """Rows per cell of an ``nx`` by ``ny`` grid over the values: ``binx, biny, count``, cells with rows only."""
    values = df.filter(_present(df, x) & _present(df, y)).select(
        F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy")
    )
    span = values.agg(
        F.struct(
            F.min("vx").alias("x0"), F.max("vx").alias("x1"), F.min("vy").alias("y0"), F.max("vy").alias("y1")
        )
    ).scalar()

    def position(v: str, lo: Column, hi: Column, n: int) -> Column:
        place = F.least(F.floor((F.col(v) - lo) / ((hi - lo) / n)), F.lit(n - 1))
        return F.when(hi > lo, place).otherwise(F.lit(0)).cast("bigint")

    cells = values.groupBy(
        position("vx", span["x0"], span["x1"], nx).alias("binx"),
        position("vy", span["y0"], span["y1"], ny).alias("biny"),
    )
    return cells.agg(F.count("*").alias("count"))


def kernel_density(
    df: DataFrame, x: str, y: str, nx: int = 50, ny: int = 50, bandwidth: float = 1.0, reach: float = 4.0
) -> DataFrame:
    """Smoothed rows per cell of the grid of ``histogram_2d``: ``binx, biny, density``, cells that the kernel reaches only.

    The kernel is a Gaussian with ``bandwidth`` cells as its deviation, cut ``reach`` deviations from the centre and scaled
    to a sum of 1; what falls outside the grid is left out. It is the product of one kernel along each axis, so cells
    meet ``2 * reach * bandwidth + 1`` weights twice, once along each axis, and not their square. Rows are counted by cell
    first, so all further work is on cells.
    """
    steps = math.floor(reach * bandwidth)
    weights = [math.exp(-d * d / (2 * bandwidth * bandwidth)) for d in range(-steps, steps + 1)]
    stencil = F.array(
        *[
            F.struct(F.lit(d).cast("bigint").alias("step"), F.lit(w / sum(weights)).alias("weight"))
            for d, w in zip(range(-steps, steps + 1), weights)
        ]
    )

    def smooth(cells: DataFrame, axis: str, other: str, n: int) -> DataFrame:
        spread = cells.select(axis, other, "density", F.inline(stencil)).select(
            (F.col(axis) + F.col("step")).alias(axis), other, (F.col("density") * F.col("weight")).alias("density")
        )
        return spread.filter(F.col(axis).between(0, n - 1)).groupBy(axis, other).agg(F.sum("density").alias("density"))

    cells = histogram_2d(df, x, y, nx, ny).withColumn("density", F.col("count").cast("double"))
    return smooth(smooth(cells, "binx", "biny", nx), "biny", "binx", ny).select("binx", "biny", "density")


def hexagons(df: DataFrame, x: str, y: str, size: float = 1.0) -> DataFrame:
    """Rows per hexagon: ``q, r, x, y, count``, hexagons with rows only.

    Hexagons stand on a corner, ``size`` from centre to corner; ``q`` and ``r`` are axial coordinates and ``x, y`` the centre.
    A row belongs to the hexagon whose centre is nearest. NULL, NaN and infinite values are ignored.
    """
    vx, vy = F.col("vx"), F.col("vy")
    values = df.filter(_present(df, x) & _present(df, y)).select(
        F.col(x).cast("double").alias("vx"), F.col(y).cast("double").alias("vy")
    )
    q, r = F.col("aq"), F.col("ar")
    axial = values.filter((F.abs(vx) < float("inf")) & (F.abs(vy) < float("inf"))).select(
        ((vx * (1 / math.sqrt(3)) - vy / 3) / size).alias("aq"), (2 * vy / 3 / size).alias("ar")
    )
    nearest = lambda v: F.floor(v + 0.5)
    # The three coordinates sum to 0; the one that rounding moved most is set from the other two.
    whole = axial.select("aq", "ar", nearest(q).alias("wq"), nearest(r).alias("wr"), nearest(-q - r).alias("ws"))
    off_q, off_r, off_s = F.abs(F.col("wq") - q), F.abs(F.col("wr") - r), F.abs(F.col("ws") + q + r)
    worst_q = (off_q > off_r) & (off_q > off_s)
    cells = whole.groupBy(
        F.when(worst_q, -F.col("wr") - F.col("ws")).otherwise(F.col("wq")).cast("bigint").alias("q"),
        F.when(worst_q | (off_r <= off_s), F.col("wr")).otherwise(-F.col("wq") - F.col("ws")).cast("bigint").alias("r"),
    ).agg(F.count("*").alias("count"))
    return cells.select(
        "q",
        "r",
        ((F.col("q") + F.col("r") / 2) * (size * math.sqrt(3))).alias("x"),
        (F.col("r") * (1.5 * size)).alias("y"),
        "count",
    )
