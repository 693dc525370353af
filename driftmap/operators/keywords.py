"""Naming clusters by the words of their page addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.functions.text import drop_stopwords, url_tokens
from driftmap.operators.cluster import NOISE
from driftmap.operators.relational import top_n_per_group


def explode_tokens(df: DataFrame, tokens: str = "filtered") -> DataFrame:
    """One lower-cased token per row; rows without tokens vanish."""
    return df.select("prediction", F.explode(tokens).alias("token")).withColumn("token", F.lower("token"))


def token_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("prediction", "token").agg(F.count("*").alias("count"))


def cluster_keywords(
    df: DataFrame, n: int = 1, drop_noise: bool = False, mode: str = "reference", url: str = "url"
) -> DataFrame:
    """The ``n`` most frequent address words per cluster: ``prediction, token, count``, in cluster order.

    Stop words are dropped before lower-casing, and equal counts are ordered by token.
    """
    if drop_noise:
        df = df.filter(F.col("prediction") != NOISE)
    words = df.select("prediction", drop_stopwords(url_tokens(url, mode)).alias("filtered"))
    counts = token_counts(explode_tokens(words))
    top = top_n_per_group(counts, "prediction", [F.col("count").desc(), F.col("token").asc()], n)
    return top.orderBy("prediction", F.col("count").desc(), "token")
