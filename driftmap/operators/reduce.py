"""Column scaling and principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, PCAModel, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.functions.vectors import to_features


def standardize(df: DataFrame, col: str, out: str | None = None, ddof: int = 1) -> DataFrame:
    """Centre and scale every position of a vector column; a constant position becomes 0.

    ``ddof=1`` divides by the sample deviation, ``ddof=0`` by that of the population.
    """
    features = to_features(df, col, "_features")
    model = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True, withStd=True).fit(features)
    scaled = vector_to_array("_scaled")
    if ddof == 0:
        n = features.count()
        factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
        scaled = F.transform(scaled, lambda v: v * factor)
    return model.transform(features).withColumn(out or col, scaled).drop("_features", "_scaled")


def pca_model(df: DataFrame, k: int, col: str = "embedding") -> PCAModel:
    """Fit ``k`` components; only the d x d covariance reaches the driver."""
    return PCA(k=k, inputCol="_features", outputCol="_scores").fit(to_features(df, col, "_features"))


def _signs(model: PCAModel) -> list[float]:
    """+1 or -1 per component, so that its loading of largest magnitude is positive."""
    loadings = model.pc.toArray()
    largest = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return [1.0 if v >= 0 else -1.0 for v in largest]


def pca_project(
    df: DataFrame,
    k: int,
    col: str = "embedding",
    out: str = "scores",
    center: bool = False,
    model: PCAModel | None = None,
) -> DataFrame:
    """Add the first ``k`` component scores as an array.

    A model fitted with more components may be passed in to save a second fit. As in Spark ML, scores are not centred
    unless asked for.
    """
    model = model or pca_model(df, k, col)
    features = to_features(df, col, "_features")
    signs = _signs(model)[:k]
    shift = [0.0] * k
    if center:
        mean = features.select(Summarizer.mean(F.col("_features")).alias("m")).head()["m"].toArray()
        shift = [float(v) for v in mean @ model.pc.toArray()[:, :k]]
    scores = F.slice(vector_to_array(F.col(model.getOutputCol())), 1, k)
    centred = F.zip_with(scores, F.array(*[F.lit(v) for v in shift]), lambda s, m: s - m)
    signed = F.zip_with(centred, F.array(*[F.lit(v) for v in signs]), lambda s, sign: s * sign)
    return model.transform(features).withColumn(out, signed).drop("_features", model.getOutputCol())


def project_2d(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Add ``x`` and ``y``: the first two centred component scores."""
    projected = pca_project(df, 2, col, "_scores2", center=True)
    return projected.withColumns({"x": F.col("_scores2")[0], "y": F.col("_scores2")[1]}).drop("_scores2")


def explained_variance(
    df: DataFrame, k: int | None = None, col: str = "embedding", model: PCAModel | None = None
) -> DataFrame:
    """One row per component: its share of the variance, and the share up to it; ``k`` defaults to the width."""
    if model is None:
        if k is None:
            k = df.filter(F.col(col).isNotNull()).select(F.size(col).alias("d")).head()["d"]
        model = pca_model(df, k, col)
    shares = [float(v) for v in model.explainedVariance.toArray()]
    rows = [(i + 1, ev, cum) for i, (ev, cum) in enumerate(zip(shares, np.cumsum(shares).tolist()))]
    return df.sparkSession.createDataFrame(rows, "k int, ev double, cum_ev double")


def optimal_k(ev: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Fewest components whose share is above ``threshold``; all of them if none is."""
    above = F.min(F.when(F.col("cum_ev") > threshold, F.col("k")))
    return ev.agg(F.coalesce(above, F.max("k")).alias("k"))
