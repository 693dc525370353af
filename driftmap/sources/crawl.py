"""Readers for crawl snapshots, allow-lists and 2-D points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.operators.scale import running_total

#: Declared, never inferred: inference would read every gzip file twice.
CRAWL_SCHEMA = (
    "url STRING, fetch STRUCT<semanticVector: STRING, fetchDate: STRING, contentLength: BIGINT, "
    "internalLinks: ARRAY<STRING>, externalLinks: ARRAY<STRING>>, _corrupt_record STRING"
)

_WEEK_FOLDER = r"/(\d{4}-\d{2}-\d{2})/[^/]*$"


def read_crawl(spark: SparkSession, path: str, week: str | None = None) -> DataFrame:
    """Read JSON snapshots kept as ``path/<week>/*``; one week reads that folder only.

    Malformed lines are kept with their text in ``_corrupt_record``. ``week`` comes from the folder name.
    """
    return (
        spark.read.schema(CRAWL_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(f"{path.rstrip('/')}/{week or '*'}/*")
        .withColumn("week", F.regexp_extract("_metadata.file_path", _WEEK_FOLDER, 1))
    )


def read_relevant_urls(spark: SparkSession, path: str) -> DataFrame:
    """Read the allow-list of page addresses, each once."""
    return spark.read.parquet(path).select("url").distinct()


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Read 2-D points from CSV with a header: ``id, url, x, y`` and ``prediction`` where the file has one.

    Coordinates that are not numbers become NULL. ``id`` is the place of a row in the order of its values, so it depends
    neither on how files are split nor on their order; equal rows get consecutive ids.
    """
    raw = spark.read.option("header", True).csv(path)
    columns = [
        F.col("url"),
        F.col("`Dimension 1`").try_cast("double").alias("x"),
        F.col("`Dimension 2`").try_cast("double").alias("y"),
    ]
    if "prediction" in raw.columns:
        columns.append(F.col("prediction").try_cast("int").alias("prediction"))
    rows = raw.select(*columns)
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("_copies"))
    placed = running_total(counted, rows.columns, "_copies", "_first")
    copies = F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias("id")
    return placed.select(copies, *rows.columns)


def flatten_crawl(df: DataFrame) -> DataFrame:
    """Lift the fields of ``fetch`` to columns; ``week`` is kept where present."""
    fields = ["semanticVector", "fetchDate", "contentLength", "internalLinks", "externalLinks"]
    kept = ["week"] if "week" in df.columns else []
    return df.select("url", *[F.col(f"fetch.{f}").alias(f) for f in fields], *kept)
