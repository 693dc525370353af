"""Correlation matrices with significance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmap.operators import scale
from driftmap.operators.scale import cut, lookup, running_total

#: Ranks of at most so many values are broadcast to the rows.
_FEW_VALUES = 10_000


def _upper_tail(t: float, dof: float) -> float:
    """Two-sided p-value of Student's t: the continued fraction of the incomplete beta function, or for very many
    degrees of freedom, where that rounds, the normal tail of Wallace's transformation."""
    if dof > 1e7:
        z = (8 * dof + 1) / (8 * dof + 3) * math.sqrt(dof * math.log1p(t * t / dof))
        return math.erfc(z / math.sqrt(2.0))
    x, rest = dof / (dof + t * t), t * t / (dof + t * t)
    a, b = dof / 2.0, 0.5
    if rest <= 0.0:
        return 1.0
    if x <= 0.0:
        return 0.0
    flipped = x > (a + 1) / (a + b + 2)
    if flipped:
        a, b, x, rest = b, a, rest, x
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(rest)
    ) / a
    # Evaluated from the tail inwards, with enough terms for any number of degrees of freedom.
    terms = int(60 + 2 * math.sqrt(max(a, b)))
    value = 1.0
    for m in range(terms, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1.0 + even / (1.0 + odd / value)
    head = 1.0 - (a + b) * x / (a + 1) / value
    result = front / head
    return 1.0 - result if flipped else result


@F.pandas_udf(T.DoubleType())
def _p_value(t: pd.Series, n: pd.Series) -> pd.Series:
    # Runs on the few rows of a finished matrix.
    return pd.Series(
        [np.nan if pd.isna(ti) or ni < 3 else _upper_tail(float(ti), float(ni) - 2) for ti, ni in zip(t, n)]
    )


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """All pairs of columns: ``a, b, r, n, t, p, stars``.

    Each pair uses the rows in which both values are present. ``t`` is NULL where it is not finite; ``stars`` has one
    star for each of p <= .05, .01, .001. A column without variation has no correlation, not even with itself.
    """
    if method == "pearson":
        upper = _pearson(df, cols)
    elif method == "spearman":
        upper = _spearman(df, cols)
    else:
        raise ValueError(f"unknown method {method!r}")
    mirrored = F.explode(
        F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
            F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
        )
    )
    names = F.array(*[F.lit(c) for c in cols])
    full = upper.select(mirrored.alias("at"), "r", "n").select(
        F.element_at(names, F.col("at.i") + 1).alias("a"),
        F.element_at(names, F.col("at.j") + 1).alias("b"),
        F.when(F.col("at.i") == F.col("at.j"), F.when((F.col("n") > 1) & F.col("r").isNotNull(), F.lit(1.0))).otherwise(F.col("r")).alias("r"),
        "n",
    )
    rest = 1.0 - F.col("r") * F.col("r")
    t = F.when((rest > 0) & (F.col("n") > 2), F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(rest, F.lit(0.0))))
    p = (
        F.when(F.col("r").isNull(), F.lit(None).cast("double"))
        .when(rest <= 0, F.lit(0.0))
        .otherwise(F.nanvl(F.col("_p"), F.lit(None).cast("double")))
    )
    stars = F.when(F.col("p").isNull(), "").otherwise(
        F.concat(*[F.when(F.col("p") <= limit, "*").otherwise("") for limit in (0.05, 0.01, 0.001)])
    )
    return (
        full.withColumn("t", t)
        .withColumn("_p", _p_value("t", "n"))
        .withColumn("p", p)
        .withColumn("stars", stars)
        .select("a", "b", "r", "n", "t", "p", "stars")
    )


def _pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    parts = []
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            both = F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNotNull()
            a, b = (F.when(both, F.col(f"c{k}")) for k in (i, j))
            spread = F.stddev_pop(a) * F.stddev_pop(b)
            r = F.least(F.greatest(F.covar_pop(a, b) / F.nullif(spread, F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
            r = F.when(spread > 0, r)
            parts.append(
                F.struct(
                    F.lit(i).alias("i"),
                    F.lit(j).alias("j"),
                    F.nanvl(r, F.lit(None).cast("double")).alias("r"),
                    F.count_if(both).alias("n"),
                )
            )
    return values.agg(F.array(*parts).alias("_rows")).select(F.inline("_rows"))


def _spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of average ranks; ranks are taken among the rows complete in a pair of columns.

    A pass counts each column's values, and with them the rows in which each other column is present. Running totals of these
    counts are ranks; a column has ranks of its own for a partner only if that one leaves out some of its rows. Each row then
    looks up the ranks of its values, once a column, and one aggregation sums all pairs.
    """
    k = len(cols)
    zero = F.lit(0.0)  # added, it makes a negative zero a positive one
    rows = df.select(*[(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) + zero).alias(f"v{i}") for i, c in enumerate(cols)])
    entries = [F.struct(F.lit(i).alias("i"), F.col(f"v{i}").alias("value"), *[F.col(f"v{j}").isNotNull().alias(f"p{j}") for j in range(k)]) for i in range(k)]
    counts = cut(
        rows.select(F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy("i", "value")
        .agg(*[F.count_if(f"p{j}").alias(f"n{j}") for j in range(k)])
    )
    # One row for each column.
    totals = {
        r["i"]: r
        for r in counts.groupBy("i")
        .agg(F.count(F.lit(1)).alias("values"), *[F.sum(f"n{j}").alias(f"n{j}") for j in range(k)])
        .collect()
    }
    n = lambda i, j: totals[i][f"n{j}"] if i in totals else 0
    alone = df.sparkSession.createDataFrame(
        [(i, i, 1.0 if i in totals and totals[i]["values"] > 1 else None, n(i, i)) for i in range(k)], "i int, j int, r double, n bigint"
    )
    pairs = [(i, j) for i, j in combinations(range(k), 2) if n(i, j)]
    if not pairs:
        return alone
    #: The partner for whose sake a column has other ranks, or the column itself.
    among = lambda i, j: i if n(i, j) == n(i, i) else j
    wanted = sorted({(i, among(i, j)) for i, j in pairs} | {(j, among(j, i)) for i, j in pairs})
    sets = F.array(*[F.struct(F.lit(j).alias("j"), F.when(F.col("i") == i, F.col(f"n{j}")).alias("n")) for i, j in wanted])
    listed = counts.select("i", "value", F.inline(sets)).filter("n > 0")
    ranked = running_total(listed, ["value"], "n", "before", groups=["i", "j"])
    by_value = cut(
        ranked.groupBy("i", "value").agg(
            *[F.max(F.when(F.col("j") == j, F.col("before") + (F.col("n") + 1) / 2)).alias(f"r{j}") for j in range(k)]
        )
    )
    # Few values first: they meet the rows where they are.
    for i in sorted({i for i, _ in wanted}, key=lambda i: (totals[i]["values"], i)):
        kept = [F.col(f"r{j}").alias(f"r{i}_{j}") for a, j in wanted if a == i]
        ranks = by_value.filter(F.col("i") == i).select(F.col("value").alias(f"v{i}"), *kept)
        if totals[i]["values"] <= _FEW_VALUES:
            rows = rows.join(F.broadcast(ranks), f"v{i}", "left")
        else:
            often = counts.filter((F.col("i") == i) & (F.col(f"n{i}") > max(scale.HOT_ROWS, n(i, i) // scale.HOT_GROUPS)))
            hot = [r["h"] for r in often.select(F.xxhash64("value").alias("h")).collect()]  # at most HOT_GROUPS
            rows = lookup(rows, ranks, [f"v{i}"], "left", hot=sorted(hot))
    # The mean rank is known, so sums are taken around it.
    parts = []
    for i, j in pairs:
        both = F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull()
        a, b = (F.when(both, F.col(f"r{x}_{among(x, y)}") - (n(i, j) + 1) / 2) for x, y in ((i, j), (j, i)))
        sums = [F.sum(a * b), F.sum(a * a), F.sum(b * b)]
        parts.append(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), *[x.alias(y) for x, y in zip(sums, ("ab", "aa", "bb"))], F.lit(n(i, j)).cast("bigint").alias("n")))
    sums = rows.agg(F.array(*parts).alias("_rows")).select(F.inline("_rows"))
    spread = F.nullif(F.sqrt(F.col("aa")) * F.sqrt(F.col("bb")), F.lit(0.0))
    r = F.when(spread.isNotNull(), F.least(F.greatest(F.col("ab") / spread, F.lit(-1.0)), F.lit(1.0)))
    return sums.select("i", "j", r.alias("r"), "n").unionByName(alone)
