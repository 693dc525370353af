"""Rank correlation against pandas, and what it writes on the way."""

import numpy as np
import pandas as pd
import pytest

import driftmap as dm
from driftmap.operators import correlation, scale

COLS = ["a", "b", "c"]


def gaps(n: int = 400) -> pd.DataFrame:
    """Few and many values, values shared by many rows, and gaps in two columns."""
    draw = np.random.default_rng(7)
    df = pd.DataFrame({"a": draw.integers(0, 5, n) * 1.0, "b": draw.normal(size=n), "c": draw.integers(-40, 40, n) / 4})
    df["b"] += df["a"]
    df.loc[::7, "b"] = 3.0
    df.loc[::5, "a"] = None
    df.loc[1::9, "c"] = None
    df.loc[df["c"] == 0, "c"] = np.where(np.arange((df["c"] == 0).sum()) % 2, 0.0, -0.0)
    return df


@pytest.mark.parametrize("few, hot_rows", [(10_000, None), (0, None), (0, 20)])
def test_equals_pandas(spark, monkeypatch, few, hot_rows):
    monkeypatch.setattr(correlation, "_FEW_VALUES", few)
    if hot_rows:
        monkeypatch.setattr(scale, "HOT_ROWS", hot_rows)
    df = gaps()
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in df.itertuples(index=False)]
    found = dm.correlation_matrix(spark.createDataFrame(rows, "a double, b double, c double"), COLS, "spearman").collect()
    got = {(r.a, r.b): (r.n, r.r) for r in found}
    assert len(got) == 9
    for x in COLS:
        for y in COLS:
            both = df[[x, y]].dropna() if x != y else df[[x]].dropna()
            ranks = both.rank()
            want = np.corrcoef(ranks[x], ranks[y])[0, 1] if x != y else 1.0
            assert got[x, y] == (len(both), pytest.approx(want, rel=1e-9))


def test_columns_without_common_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0)], "a double, b double")
    found = {(r.a, r.b): (r.n, r.r) for r in dm.correlation_matrix(df, ["a", "b"], "spearman").collect()}
    assert found == {("a", "a"): (2, 1.0), ("b", "b"): (1, None)}
    assert {r.r for r in dm.correlation_matrix(df.filter("a > 9"), ["a", "b"], "spearman").collect()} == {None}


def test_writes_values_not_pairs_of_values(spark, monkeypatch):
    written, real = [], scale.cut

    def seen(df):
        done = real(df)
        written.append(done.count())
        return done

    monkeypatch.setattr(scale, "cut", seen)
    monkeypatch.setattr(correlation, "cut", seen, raising=False)
    rows = [(float(i), float(j), float((i * 7 + j) % 30)) for i in range(30) for j in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    dm.correlation_matrix(df, COLS, "spearman").collect()
    assert written and max(written) <= 90
