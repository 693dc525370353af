"""Constant columns, equal points, broken vectors, and other inputs at the edge."""

import numpy as np
import pytest

import driftmap as dm
from driftmap.operators import correlation, density, encoder
from driftmap.operators.cluster import sweep_k, topic_model
from driftmap.operators.relational import top_n_per_group
from driftmap.sources.crawl import read_points
from pyspark.sql import functions as F


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_constant_column_has_no_correlation(spark, method):
    rows = spark.createDataFrame([(1.0, float(i), float(i * i)) for i in range(20)], "c double, x double, y double")
    got = {(r["a"], r["b"]): r for r in correlation.correlation_matrix(rows, ["c", "x", "y"], method).collect()}
    for pair in (("c", "c"), ("c", "x"), ("x", "c")):
        assert got[pair]["r"] is None and got[pair]["p"] is None and got[pair]["stars"] == ""
    assert got["x", "x"]["r"] == 1.0 and got["x", "x"]["stars"] == "***"
    assert got["x", "y"]["r"] > 0.9


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_one_row_has_no_correlation(spark, method):
    rows = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert {r["r"] for r in correlation.correlation_matrix(rows, ["x", "y"], method).collect()} == {None}


def test_p_values_of_very_many_rows():
    for t in (0.5, 2.0, 5.0):
        assert correlation._upper_tail(t, 1e12) == pytest.approx(correlation._upper_tail(t, 9e6), rel=1e-4)
    assert correlation._upper_tail(1.959964, 1e14) == pytest.approx(0.05, rel=1e-5)


def test_tree_of_equal_points_is_noise(spark):
    points = spark.createDataFrame([(i, 1.0, 2.0) for i in range(50)], "id bigint, x double, y double")
    assert {r["prediction"] for r in dm.density_tree(points).collect()} == {-1}


def test_far_outlier_does_not_hide_clusters(spark):
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(c, 0.01, (60, 2)) for c in (0.0, 1.0)])
    near = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    schema = "id bigint, x double, y double"
    radii = density._radii(spark.createDataFrame([*near, (999, 1e9, 1e9)], schema), 10, 0.4, 64)
    assert radii[-1] < 0.05


def test_infinite_values_are_not_binned(spark):
    rows = spark.createDataFrame([(1.0,), (3.0,), (float("inf"),), (float("nan"),), (None,)], "v double")
    got = dm.histogram(rows, "v", 2).orderBy("bin").collect()
    assert [(r["lo"], r["hi"], r["count"]) for r in got] == [(1.0, 2.0, 1), (2.0, 3.0, 1)]


def test_many_rows_per_group(spark):
    rows = spark.range(6000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    got = top_n_per_group(rows, "g", [F.col("v").desc()], 1500)
    assert got.columns == ["g", "v"] and got.count() == 3000 and got.agg(F.min("v")).first()[0] == 3000


def test_every_k_has_a_row(spark):
    rows = spark.createDataFrame([([float(i), 1.0],) for i in range(10)], "embedding array<double>")
    got = {r["k"]: r for r in sweep_k(rows, "kmeans", [2, 10, 50]).collect()}
    assert set(got) == {2, 10, 50} and got[2]["k_actual"] == 2 and got[50]["k_actual"] <= 10
    same = spark.createDataFrame([([1.0, 1.0],)] * 5, "embedding array<double>")
    assert sweep_k(same, "kmeans", [3]).first()["silhouette"] is None
    assert sweep_k(rows.limit(0), "kmeans", [2]).first()["k_actual"] == 0


def test_topics_use_all_rows_and_terms(spark):
    rows = [(i, [f"w{i % 3}a", f"w{i % 3}b", f"w{i % 3}c"] * 3) for i in range(60)] + [(99, [])]
    table = spark.createDataFrame(rows, "id bigint, tokens array<string>")
    terms, assigned = topic_model(table, 3, n_terms=9)
    assert terms.select("term").distinct().count() == 9
    got = {r["id"]: r["prediction"] for r in assigned.collect()}
    assert len(got) == 61 and got[99] is None and len({p for p in got.values() if p is not None}) > 1
    with pytest.raises(ValueError):
        topic_model(table, 3, vocabulary=8)


def test_encoder_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    rows = [([float(x) for x in rng.normal(0, 1, 6)],) for _ in range(300)]
    table = spark.createDataFrame(rows, "embedding array<double>")
    losses = [
        [round(r["mean_loss"], 10) for r in encoder.autoencoder_fit(t, [6, 3], epochs=2)[1].orderBy("epoch").collect()]
        for t in (table.repartition(1), table.repartition(7))
    ]
    assert losses[0] == losses[1]


@pytest.mark.parametrize("bad", [[1.0, 2.0], [1.0, None, 3.0], [float("nan")] * 3])
def test_encoder_refuses_broken_vectors(spark, bad):
    table = spark.createDataFrame([([1.0, 2.0, 3.0],), (bad,), (None,)], "embedding array<double>")
    with pytest.raises(ValueError):
        encoder.autoencoder_fit(table, [3, 2], epochs=1)


def test_point_ids_do_not_depend_on_splits(spark, tmp_path):
    lines = "\n".join(f"http://a/{i % 500},{(i * 7) % 100}.5,{i % 13}" for i in range(3000))
    (tmp_path / "points.csv").write_text("url,Dimension 1,Dimension 2\n" + lines + "\n")
    found = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "64m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            found.append(sorted(map(tuple, read_points(spark, str(tmp_path)).collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found[0] == found[1] and [r[0] for r in found[0]] == list(range(3000))
