"""Inputs for the catalogued queries, derived by Spark from the given tables.

The ``crawl`` has one snapshot per document: document ``d`` is week ``d div P`` of page ``d % P``, with ``P`` pages.
Its size comes from the document, its vector from the embeddings (some weeks keep the vector of the week before, some
have none), its links from the page's HTML. ``CRAWL_SQL`` states the same for the SQL check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crawl(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """Flattened snapshots; ``text`` gives vectors as the text a crawl would hold."""
    pages, documents, embeddings = (table(spark, sf_dir, n) for n in ("pages", "documents", "embeddings"))
    n_pages = pages.agg(F.count("*")).scalar()
    n_vectors = embeddings.agg(F.count("*")).scalar()
    page, week = F.col("page"), F.col("w")
    source = F.when((week % 2 == 1) & (page % 3 == 0), week - 1).otherwise(week)
    unset = (page % 5 == 4) & (week % 2 == 0)
    vector = F.col("embedding").cast("string") if text else F.col("embedding")
    snapshots = documents.select(
        "n_chars", (F.col("doc_id") % n_pages).alias("page"), F.floor(F.col("doc_id") / n_pages).alias("w")
    )
    links = pages.select(
        F.col("page_id").alias("link_page"),
        F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1).alias("internalLinks"),
    )
    return (
        snapshots.withColumn("vec_id", (page + n_pages * source) % n_vectors)
        .withColumn("link_page", (page + F.floor(week / 2)) % n_pages)
        .join(embeddings.select("vec_id", "embedding"), "vec_id")
        .join(pages.select(F.col("page_id").alias("page"), "url"), "page")
        .join(links, "link_page")
        .select(
            "url",
            F.when(unset, "not set" if text else None).otherwise(vector).alias("semanticVector"),
            F.date_format(F.date_add(F.lit("2020-07-06").cast("date"), (7 * week).cast("int")), "yyyy-MM-dd").alias(
                "fetchDate"
            ),
            F.col("n_chars").alias("contentLength"),
            "internalLinks",
            F.transform(
                F.slice(F.array(*[F.lit(i) for i in range(1, 6)]), 1, ((F.floor(week / 3) + page) % 5).cast("int")),
                lambda i: F.concat(F.lit("x"), i.cast("string")),
            ).alias("externalLinks"),
        )
    )


def nested_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl as it is stored: fields under ``fetch``, and the week it belongs to."""
    fields = ["semanticVector", "fetchDate", "contentLength", "internalLinks", "externalLinks"]
    return crawl(spark, sf_dir).select("url", F.struct(*fields).alias("fetch"), F.col("fetchDate").alias("week"))


def relevant(snapshots: DataFrame) -> DataFrame:
    """Pages whose vector is set in every snapshot."""
    return snapshots.groupBy("url").agg(F.every(F.col("semanticVector").startswith("[")).alias("ok")).filter("ok").select("url")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as points: two fixed sums over all positions, of whole numbers, so that they are exact everywhere."""

    def coordinate(weight: Callable[[Column], Column]) -> Column:
        terms = F.transform("embedding", lambda v, i: F.floor(v.cast("double") * 65536) * weight(i.cast("bigint")))
        return (F.aggregate(terms, F.lit(0).cast("bigint"), lambda s, t: s + t) / 1048576.0).cast("double")

    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        coordinate(lambda i: (3 * i * i + i) % 7 - 3).alias("x"),
        coordinate(lambda i: (5 * i + 2) % 9 - 4).alias("y"),
        F.col("label").alias("prediction"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("label", "prediction")


def clustered_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a cluster id between -1 and 5."""
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", (F.col("page_id") % 7 - 1).cast("int").alias("prediction")
    )


CRAWL_SQL = """
base AS (
  SELECT n_chars, doc_id % n.pages AS page, doc_id // n.pages AS w, n.pages, n.vectors
  FROM documents, (SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM embeddings) AS vectors) n
),
crawl AS (
  SELECT p.url AS url,
         CASE WHEN b.page % 5 = 4 AND w % 2 = 0 THEN NULL ELSE CAST(e.embedding AS DOUBLE[]) END AS vec,
         strftime(DATE '2020-07-06' + CAST(7 * w AS INTEGER), '%Y-%m-%d') AS fetchDate,
         n_chars AS contentLength,
         CAST(len(regexp_extract_all(l.html, 'href="(/[^"]*)"', 1)) AS BIGINT) AS internal,
         CAST((w // 3 + b.page) % 5 AS BIGINT) AS external
  FROM base b
  JOIN embeddings e
    ON e.vec_id = (b.page + b.pages * (CASE WHEN w % 2 = 1 AND b.page % 3 = 0 THEN w - 1 ELSE w END)) % b.vectors
  JOIN pages p ON p.page_id = b.page
  JOIN pages l ON l.page_id = (b.page + w // 2) % b.pages
),
relevant AS (SELECT url FROM crawl GROUP BY url HAVING count(vec) = count(*))
"""

DRIFT_SQL = (
    CRAWL_SQL
    + """,
lagged AS (
  SELECT *, lag(vec) OVER s AS p_vec, lag(contentLength) OVER s AS p_length,
         lag(internal) OVER s AS p_internal, lag(external) OVER s AS p_external
  FROM crawl WHERE url IN (SELECT url FROM relevant)
  WINDOW s AS (PARTITION BY url ORDER BY fetchDate)
),
drift AS (
  SELECT url, fetchDate,
         list_distance(vec, p_vec) AS euclidean_distance,
         1 - list_cosine_similarity(vec, p_vec) AS cosine_distance,
         abs(contentLength - p_length) AS content_length_difference,
         abs(internal - p_internal) AS internal_link_count_difference,
         abs(external - p_external) AS external_link_count_difference
  FROM lagged WHERE p_vec IS NOT NULL
)
"""
)

POINTS_SQL = """
points AS (
  SELECT vec_id AS id, label AS prediction,
         list_sum([floor(v::DOUBLE * 65536)::BIGINT * ((3 * (i - 1) * (i - 1) + (i - 1)) % 7 - 3) FOR v, i IN embedding])::DOUBLE / 1048576 AS x,
         list_sum([floor(v::DOUBLE * 65536)::BIGINT * ((5 * (i - 1) + 2) % 9 - 4) FOR v, i IN embedding])::DOUBLE / 1048576 AS y
  FROM embeddings
)
"""
