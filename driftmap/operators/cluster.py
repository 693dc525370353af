"""Clustering sweeps, topic models, centres and the silhouette in linear time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.functions.vectors import to_features
from driftmap.operators.scale import cut

NOISE = -1


def _estimator(algo: str, k: int, seed: int, params: dict):
    """Estimator with the settings of the analysis, overridden by ``params``."""
    if algo == "kmeans":
        return KMeans(k=k, seed=seed, **params)
    if algo == "bisecting":
        return BisectingKMeans(k=k, seed=seed, **{"maxIter": 30, **params})
    if algo == "gmm":
        return GaussianMixture(k=k, seed=seed, **{"maxIter": 50, **params})
    raise ValueError(f"unknown algorithm {algo!r}")


def silhouette_score(
    df: DataFrame, metric: str = "cosine", features: str = "features", clusters: int | None = None
) -> float | None:
    """Mean silhouette of a labelled vector column; None with fewer than two clusters, whose number may be given."""
    if clusters is None:
        clusters = df.select("prediction").distinct().limit(2).count()
    if clusters < 2:
        return None
    return ClusteringEvaluator(
        predictionCol="prediction", featuresCol=features, metricName="silhouette", distanceMeasure=metric
    ).evaluate(df)


def silhouette(df: DataFrame, metric: str = "cosine", col: str = "embedding") -> DataFrame:
    """The silhouette as a one-row table, from an array column ``col`` and ``prediction``."""
    labelled = to_features(df.select(col, "prediction"), col)
    score = silhouette_score(labelled, metric)
    return df.sparkSession.createDataFrame([(metric, score)], "metric string, silhouette double")


def fit_clusters(df: DataFrame, algo: str, k: int, seed: int = 1, col: str = "embedding", **params) -> DataFrame:
    """Add ``prediction`` from one fit."""
    features = to_features(df, col)
    return _estimator(algo, k, seed, params).fit(features).transform(features).drop("features", "probability")


def sweep_k(
    df: DataFrame,
    algo: str,
    ks: Sequence[int],
    seed: int = 1,
    col: str = "embedding",
    metric: str = "cosine",
    **params,
) -> DataFrame:
    """Fit one model per ``k`` and score it: ``algo, k, k_actual, silhouette``.

    The vectors are prepared and cached once for all fits, and labelled once per fit. Every ``k`` has a row; with fewer
    rows than ``k`` there are fewer clusters, and with fewer than two the silhouette is NULL.
    """
    features = to_features(df, col).select("features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = features.count()
        rows = []
        for k in ks:
            if not n:
                rows.append((algo, int(k), 0, None))
                continue
            model = _estimator(algo, k, seed, params).fit(features)
            found = sum(size > 0 for size in model.summary.clusterSizes)
            labelled = model.transform(features).select("features", "prediction")
            rows.append((algo, int(k), found, silhouette_score(labelled, metric, clusters=found)))
    finally:
        features.unpersist()
    return df.sparkSession.createDataFrame(rows, "algo string, k int, k_actual int, silhouette double")


def cluster_centers(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Mean vector per cluster as ``prediction, pos, value``, without noise.

    Vectors are averaged as wholes, with partial sums in each task; only finished centres are unfolded.
    """
    members = to_features(df.filter(F.col("prediction") != NOISE), col)
    centers = members.groupBy("prediction").agg(vector_to_array(Summarizer.mean(F.col("features"))).alias("center"))
    return centers.select("prediction", F.posexplode("center").alias("pos", "value"))


def cluster_summary(df: DataFrame) -> DataFrame:
    """Number of clusters, rows, and the percentage of noise."""
    is_noise = F.col("prediction") == NOISE
    return df.agg(
        F.count_distinct(F.when(~is_noise, F.col("prediction"))).alias("n_clusters"),
        F.count("*").alias("n_rows"),
        F.round(100 * F.avg(is_noise.cast("int")), 2).alias("noise_pct"),
    )


def cluster_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("prediction").agg(F.count("*").alias("count"))


def topic_model(
    df: DataFrame,
    k: int,
    n_terms: int = 3,
    id_col: str = "id",
    tokens: str = "tokens",
    vocabulary: int | None = None,
    max_iter: int = 20,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """LDA over token lists: the top terms per topic, and the likeliest topic per row.

    Returns ``topic, term, weight`` and ``id, prediction``; rows with no tokens get no topic (NULL). Expectation
    maximisation looks at all rows in every pass. Its start depends on how rows are partitioned, so topics may be
    numbered and weighted otherwise on another cluster. All terms are used; Spark ML keeps them on the driver, and a
    caller may set ``vocabulary``, the most terms allowed, beyond which this raises.
    """
    rows = cut(df.select(F.col(id_col).alias("id"), F.col(tokens).alias(tokens)))
    different = rows.select(F.explode(tokens).alias("term")).agg(F.count_distinct("term")).first()[0]
    if vocabulary is not None and different > vocabulary:
        raise ValueError(f"{different} distinct terms, more than the {vocabulary} allowed")
    if not different:
        none = rows.sparkSession.createDataFrame([], "topic int, term string, weight double")
        return none, rows.select("id", F.lit(None).cast("int").alias("prediction"))
    counter = CountVectorizer(inputCol=tokens, outputCol="features", vocabSize=different).fit(rows)
    features = counter.transform(rows)
    known = features.filter(F.size(tokens) > 0)
    model = LDA(k=k, maxIter=max_iter, seed=seed, featuresCol="features", optimizer="em").fit(known)
    words = rows.sparkSession.createDataFrame(list(enumerate(counter.vocabulary)), "term_id int, term string")
    terms = (
        model.describeTopics(n_terms)
        .select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("t"))
        .select("topic", F.col("t.termIndices").alias("term_id"), F.col("t.termWeights").alias("weight"))
        .join(words, "term_id")
        .select("topic", "term", "weight")
    )
    share = vector_to_array("topicDistribution")
    best = (F.array_position(share, F.array_max(share)) - 1).cast("int")
    assigned = model.transform(features).select(
        "id", F.when(F.size(tokens) > 0, best).alias("prediction")
    )
    return terms, assigned
