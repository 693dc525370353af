"""Reduction, clustering and encoder: invariants."""

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

import driftmap as dm
from driftmap.operators.encoder import Encoder
from driftmap.plans.derived import crawl, relevant

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF_DIR}/embeddings.parquet").cache()


def test_pca(spark, vectors):
    ev = dm.explained_variance(vectors).orderBy("k").collect()
    shares = [r.ev for r in ev]
    assert sum(shares) == pytest.approx(1) and shares == sorted(shares, reverse=True)
    model = dm.pca_model(vectors, 3)
    scores = np.array([r[0] for r in dm.pca_project(vectors, 3, center=True, model=model).select("scores").collect()])
    assert scores.mean(axis=0) == pytest.approx(0, abs=1e-9)
    spread = np.cov(scores.T)
    assert spread - np.diag(np.diag(spread)) == pytest.approx(0, abs=1e-9)
    total = np.array([r[0] for r in vectors.select("embedding").collect()]).var(axis=0, ddof=1).sum()
    assert np.diag(spread) / total == pytest.approx(shares[:3])


def test_gradients():
    rng = np.random.default_rng(3)
    model = Encoder.start([5, 4, 2], "relu", "linear", "sigmoid", seed=1)
    x = rng.uniform(size=(7, 5))
    flat = model.flat()
    _, grad = model.gradients(x)
    for i in rng.choice(len(flat), 25, replace=False):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        slope = (model.with_flat(flat + step).gradients(x)[0] - model.with_flat(flat - step).gradients(x)[0]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-7)


def test_encoder_learns(spark, vectors, tmp_path):
    model, curve = dm.autoencoder_fit(
        vectors.repartition(3), [64, 48, 32], bottleneck="linear", output="linear", lr=3e-3, epochs=15, shards=3
    )
    losses = [r.mean_loss for r in curve.orderBy("epoch").collect()]
    assert len(losses) == 15 and losses[-1] < losses[0]
    x = np.array([r[0] for r in vectors.select("embedding").collect()], dtype="f8")
    error = dm.reconstruction_error(dm.reconstruct(vectors, model), "embedding", "reconstructed").head()
    assert error.n_rows == len(x) and error.mse < x.var(axis=0).mean()
    dm.save_model(model, str(tmp_path / "m"), spark)
    again = dm.load_model(spark, str(tmp_path / "m"))
    assert (again.flat() == model.flat()).all() and again.bottleneck == "linear"
    with_null = vectors.limit(2).select("embedding").union(spark.createDataFrame([(None,)], "embedding array<float>"))
    widths = dm.autoencode(with_null, again).select(F.size("encoded").alias("n"), F.col("encoded").isNull().alias("none"))
    assert sorted(r.n for r in widths.collect() if not r.none) == [32, 32]
    assert dm.autoencode(with_null, again).filter("encoded is null").count() == 1


def test_sweep(spark, vectors):
    swept = dm.sweep_k(vectors, "kmeans", [2, 4, 10_000]).collect()
    assert [(r.k, r.k_actual) for r in swept] == [(2, 2), (4, 4), (10_000, vectors.count())]
    labelled = dm.fit_clusters(vectors, "kmeans", 2)
    assert dm.silhouette(labelled).head().silhouette == pytest.approx(swept[0].silhouette)
    alone = labelled.withColumn("prediction", F.lit(0))
    assert dm.silhouette(alone).head().silhouette is None


def test_saved_model_predicts_the_same(spark, vectors, tmp_path):
    features = dm.to_features(vectors, "embedding")
    model = KMeans(k=3, seed=1).fit(features)
    dm.save_model(model, str(tmp_path / "k"))
    again = dm.load_model(spark, str(tmp_path / "k"))
    ours, theirs = (m.transform(features).orderBy("vec_id").select("prediction").collect() for m in (model, again))
    assert ours == theirs


def test_topics(spark):
    rows = [(i, ["wine", "red"] if i % 2 else ["beer", "hop"]) for i in range(40)] + [(40, [])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    terms, assigned = dm.topic_model(df, 2, n_terms=2)
    assert terms.groupBy("topic").count().filter("count = 2").count() == 2
    found = {r.id: r.prediction for r in assigned.collect()}
    assert found.pop(40) is None and set(found.values()) <= {0, 1} and len(found) == 40


def test_drift_plan(spark):
    snapshots = crawl(spark, SF_DIR)
    plan = dm.semantic_drift(snapshots, relevant(snapshots))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Window [") == 1


def test_unit_vectors_tie_the_distances(spark, vectors):
    pairs = dm.consecutive_pairs(vectors, "label", "vec_id", ["embedding"])
    gap = dm.squared_distance("embedding", "previous_embedding") - 2 * dm.cosine_distance("embedding", "previous_embedding")
    assert pairs.agg(F.max(F.abs(gap))).head()[0] < 1e-5
