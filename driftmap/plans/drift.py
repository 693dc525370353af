"""Semantic drift: how far a page's vector, size and link counts move between consecutive crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmap.functions.vectors import (
    abs_difference,
    cosine_distance,
    euclidean_distance,
    link_count,
    parse_vector,
)
from driftmap.operators.pairs import consecutive_pairs
from driftmap.operators.relational import keep_relevant
from driftmap.operators.scale import hot_hashes

MEASURES = (
    "euclidean_distance",
    "cosine_distance",
    "content_length_difference",
    "internal_link_count_difference",
    "external_link_count_difference",
)


#: What is compared between snapshots, and what orders snapshots of one date.
COMPARED = ("vector", "contentLength", "internal", "external")
TIE = ("contentLength", "internal", "external", "vector")


def snapshots(crawl: DataFrame) -> DataFrame:
    """``url, fetchDate`` and what is compared, of a flattened crawl; the vector may be text or an array."""
    vector = F.col("semanticVector")
    if isinstance(crawl.schema["semanticVector"].dataType, T.StringType):
        vector = parse_vector(vector)
    return crawl.select(
        "url",
        "fetchDate",
        vector.alias("vector"),
        "contentLength",
        link_count("internalLinks").alias("internal"),
        link_count("externalLinks").alias("external"),
    )


def measures(pairs: DataFrame, clamp: bool = False) -> DataFrame:
    """Distances and differences of snapshots paired with the one before."""
    return pairs.select(
        "url",
        "fetchDate",
        euclidean_distance("vector", "previous_vector").alias("euclidean_distance"),
        cosine_distance("vector", "previous_vector", clamp).alias("cosine_distance"),
        abs_difference("previous_contentLength", "contentLength").alias("content_length_difference"),
        abs_difference("previous_internal", "internal").cast("bigint").alias("internal_link_count_difference"),
        abs_difference("previous_external", "external").cast("bigint").alias("external_link_count_difference"),
    )


def semantic_drift(
    crawl: DataFrame, urls: DataFrame | None = None, clamp: bool = False, hot_rows: int | None = None
) -> DataFrame:
    """One row per page and crawl that has a predecessor, with two distances and three differences.

    ``crawl`` is a flattened crawl (``url, semanticVector, fetchDate, contentLength, internalLinks, externalLinks``);
    the vector may be text or an array. ``urls`` keeps listed pages only. Snapshots of a page with equal dates are
    ordered by their other values, so the result does not depend on how the data is partitioned.
    """
    # Parsed vectors and counts are a fraction of the text and the lists, and only they are shuffled.
    known = crawl.filter(F.col("url").isNotNull())
    # Counted before the join: this reads one column of the crawl.
    hot = hot_hashes(known, ["url"], hot_rows)
    rows = snapshots(known)
    if urls is not None:
        rows = keep_relevant(rows, urls, hot=hot)
    pairs = consecutive_pairs(rows, key="url", order="fetchDate", cols=COMPARED, tie=TIE, hot=hot)
    return measures(pairs, clamp)
