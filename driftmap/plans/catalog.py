"""Named queries over the given tables, each with the SQL that states the same result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import driftmap.operators.profile as profile
from driftmap.functions.text import HTML_ENDING, LAST_DOT, NOT_WORD, PROTOCOL, STOP_WORDS, drop_stopwords, url_tokens
from driftmap.functions.vectors import (
    cosine_distance,
    euclidean_distance,
    link_counts,
    parse_vector,
    rowwise_minmax,
    squared_distance,
    to_features,
    with_vector,
)
from driftmap.operators import cluster, density, hierarchy, neighbors, relational
from driftmap.operators.correlation import correlation_matrix
from driftmap.operators.encoder import autoencode, autoencoder_fit, reconstruct, reconstruction_error
from driftmap.operators.keywords import cluster_keywords, explode_tokens, token_counts
from driftmap.operators.pairs import consecutive_pairs
from driftmap.operators.reduce import explained_variance, optimal_k, pca_model, pca_project, project_2d, standardize
from driftmap.operators.scale import cut, scratch_path
from driftmap.operators.silhouette import silhouette_exact
from driftmap.operators.splits import sweep_splits
from driftmap.operators.topics import topic_tables
from driftmap.operators.training import autoencoder_fit_synchronous
from driftmap.plans.derived import (
    CRAWL_SQL,
    DRIFT_SQL,
    POINTS_SQL,
    clustered_urls,
    crawl,
    labelled,
    nested_crawl,
    points,
    relevant,
    table,
)
from driftmap.plans.drift import MEASURES, semantic_drift
from driftmap.plans.history import add_week, drift_so_far
from driftmap.sources.crawl import flatten_crawl, read_crawl, read_points, read_relevant_urls
from driftmap.sources.sinks import load_model, save_model, write_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

EPS, MIN_SAMPLES = 0.02, 5
#: The same for vectors of length one projected to the plane.
PIPELINE_EPS, PIPELINE_SAMPLES = 0.03, 5
#: Numbers of clusters that are tried.
SWEEP = (2, 50, 100, 200, 350, 500, 750, 1000)
DIFFERENCES = MEASURES[2:]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def rounded(c: str, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return (F.round(c, digits) + F.lit(0.0)).alias(c)


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift from a crawl landed as a table, as the list of relevant pages reads it too."""
    snapshots = cut(crawl(spark, sf_dir))
    return semantic_drift(snapshots, relevant(snapshots))


def stored_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift table, written once for analyses that pass over it more than once."""
    return cut(drift(spark, sf_dir))


ROUNDED_DRIFT_SQL = (
    DRIFT_SQL
    + """, steady AS (SELECT url, fetchDate, round(cosine_distance, 9) + 0.0 AS cosine_distance, euclidean_distance,
  content_length_difference, internal_link_count_difference, external_link_count_difference FROM drift)
"""
)


def steady_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drift table with cosine distances freed of rounding noise, which differs between engines."""
    return stored_drift(spark, sf_dir).withColumn("cosine_distance", rounded("cosine_distance", 9))


# --- sources and sinks ------------------------------------------------------------------------------------------------


def _stored_crawl(spark: SparkSession, sf_dir: str) -> str:
    """Write the crawl as gzipped JSON, one folder per week, and return where."""
    path = scratch_path(spark, "crawl")
    stored = cut(nested_crawl(spark, sf_dir).withColumnRenamed("week", "folder"))
    weeks = [r["folder"] for r in stored.select("folder").distinct().collect()]
    for week in weeks:  # one folder per week, as crawls arrive
        stored.filter(F.col("folder") == week).drop("folder").write.option("compression", "gzip").json(f"{path}/{week}")
    return path


_SNAPSHOT_SQL = """SELECT url, fetchDate, fetchDate AS week, contentLength, internal AS "internalLinksCount",
    external AS "externalLinksCount", (vec IS NOT NULL) AS is_set FROM crawl"""


def _snapshot(df: DataFrame) -> DataFrame:
    return link_counts(flatten_crawl(df)).select(
        "url", "fetchDate", "week", "contentLength",
        F.col("internalLinksCount").cast("bigint"), F.col("externalLinksCount").cast("bigint"),
        F.col("semanticVector").startswith("[").alias("is_set"),
    )


@query("read_crawl", f"WITH {CRAWL_SQL} {_SNAPSHOT_SQL}")
def _(spark, sf_dir):
    return _snapshot(read_crawl(spark, _stored_crawl(spark, sf_dir)))


@query("read_crawl_week", f"WITH {CRAWL_SQL} {_SNAPSHOT_SQL} WHERE fetchDate = '2020-07-13'")
def _(spark, sf_dir):
    return _snapshot(read_crawl(spark, _stored_crawl(spark, sf_dir), week="2020-07-13"))


@query("read_relevant_urls", f"WITH {CRAWL_SQL} SELECT url FROM relevant")
def _(spark, sf_dir):
    path = scratch_path(spark, "relevant")
    urls = relevant(crawl(spark, sf_dir))
    write_table(urls.union(urls), path)
    return read_relevant_urls(spark, path)


@query(
    "read_points",
    f"WITH {POINTS_SQL} SELECT 'p' || id AS url, round(x, 6) AS x, round(y, 6) AS y, prediction FROM points",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "points")
    written = points(spark, sf_dir).select(
        F.col("x").alias("Dimension 1"), F.col("y").alias("Dimension 2"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("url"), "prediction",
    )
    write_table(written, path, fmt="csv")
    return read_points(spark, path).select("url", rounded("x"), rounded("y"), "prediction")


@query("write_table", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def _(spark, sf_dir):
    path = scratch_path(spark, "lines")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    write_table(lines, path, partition_by="l_returnflag")
    return spark.read.schema(lines.schema).parquet(path)


@query("save_and_load_model")
def _(spark, sf_dir):
    path = scratch_path(spark, "model")
    vectors = table(spark, sf_dir, "embeddings")
    features = to_features(vectors, "embedding")
    save_model(cluster._estimator("kmeans", 4, 1, {}).fit(features), path)
    return load_model(spark, path).transform(features).select("vec_id", "prediction")


# --- projections, filters, samples ------------------------------------------------------------------------------------


@query(
    "flatten_crawl",
    f"""WITH {CRAWL_SQL} SELECT url, fetchDate, contentLength, vec IS NOT NULL AS is_set FROM crawl""",
)
def _(spark, sf_dir):
    return flatten_crawl(nested_crawl(spark, sf_dir)).select(
        "url", "fetchDate", "contentLength", F.col("semanticVector").startswith("[").alias("is_set")
    )


@query("with_vector", f"WITH {CRAWL_SQL} SELECT url, fetchDate FROM crawl WHERE vec IS NOT NULL")
def _(spark, sf_dir):
    return with_vector(crawl(spark, sf_dir)).select("url", "fetchDate")


@query(
    "parse_vector",
    f"""WITH {CRAWL_SQL} SELECT url, fetchDate, CAST(len(vec) AS INTEGER) AS length,
        round(list_sum(vec), 6) + 0.0 AS total FROM crawl""",
)
def _(spark, sf_dir):
    parsed = crawl(spark, sf_dir).withColumn("v", parse_vector("semanticVector"))
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda t, x: t + x)
    return parsed.select(
        "url", "fetchDate", F.when(F.col("v").isNotNull(), F.size("v")).alias("length"),
        (F.round(total, 6) + 0.0).alias("total"),
    )


@query(
    "link_counts",
    f"""WITH {CRAWL_SQL} SELECT url, fetchDate, CAST(internal AS INTEGER) AS "internalLinksCount",
        CAST(external AS INTEGER) AS "externalLinksCount" FROM crawl""",
)
def _(spark, sf_dir):
    return link_counts(crawl(spark, sf_dir)).select("url", "fetchDate", "internalLinksCount", "externalLinksCount")


@query(
    "to_features",
    """SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos, unnest(CAST(embedding AS DOUBLE[])) AS value
       FROM embeddings""",
)
def _(spark, sf_dir):
    features = to_features(table(spark, sf_dir, "embeddings"), "embedding")
    return features.select("vec_id", F.posexplode(vector_to_array("features")).alias("pos", "value"))


@query(
    "assemble",
    f"WITH {POINTS_SQL} SELECT id, CAST(0 AS INTEGER) AS pos, x AS value FROM points UNION ALL SELECT id, 1, y FROM points",
)
def _(spark, sf_dir):
    features = relational.assemble(points(spark, sf_dir), ["x", "y"])
    return features.select("id", F.posexplode(vector_to_array("features")).alias("pos", "value"))


@query(
    "non_negative",
    """WITH s AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
       SELECT user_id, event_id, round(step, 6) + 0.0 AS step FROM s WHERE step >= 0""",
)
def _(spark, sf_dir):
    stepped = table(spark, sf_dir, "events").withColumn(
        "step", F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    )
    return relational.non_negative(stepped, "step").select("user_id", "event_id", rounded("step"))


@query(
    "not_null_and_non_negative",
    f"""WITH {CRAWL_SQL}, length AS (SELECT url, fetchDate, len(vec) AS length FROM crawl)
        SELECT url, fetchDate, CAST(length AS INTEGER) AS length FROM length WHERE length IS NOT NULL AND length >= 0""",
)
def _(spark, sf_dir):
    length = F.size(parse_vector("semanticVector"))
    lengths = crawl(spark, sf_dir).select(
        "url", "fetchDate", F.when(parse_vector("semanticVector").isNotNull(), length).alias("length")
    )
    return relational.non_negative(relational.not_null(lengths, "length"), "length")


@query(
    "changed_only",
    f"""WITH {ROUNDED_DRIFT_SQL} SELECT url, fetchDate, {', '.join(DIFFERENCES)}, round(cosine_distance, 6) + 0.0 AS cosine_distance,
        round(euclidean_distance, 6) + 0.0 AS euclidean_distance FROM steady WHERE """
    + " OR ".join(f"{c} <> 0" for c in MEASURES),
)
def _(spark, sf_dir):
    changed = relational.changed_only(steady_drift(spark, sf_dir), MEASURES)
    return changed.select("url", "fetchDate", *DIFFERENCES, *[rounded(c) for c in MEASURES[:2]])


@query(
    "hash_sample",
    """SELECT doc_id, n_chars FROM documents
       WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) < CAST(floor(0.12 * 4294967296) AS BIGINT)""",
)
def _(spark, sf_dir):
    return relational.hash_sample(table(spark, sf_dir, "documents"), "doc_id", 0.12).select("doc_id", "n_chars")


@query(
    "cluster_members",
    """SELECT page_id, url FROM pages WHERE page_id % 7 - 1 = 3 ORDER BY md5(url), url LIMIT 40""",
)
def _(spark, sf_dir):
    return relational.cluster_members(clustered_urls(spark, sf_dir), 3).select("page_id", "url")


@query(
    "cluster_sample",
    """SELECT page_id, url FROM pages WHERE page_id % 7 - 1 = 3 ORDER BY md5(url), url LIMIT 10""",
)
def _(spark, sf_dir):
    return relational.cluster_members(clustered_urls(spark, sf_dir), 3, n=10).select("page_id", "url")


# --- joins ------------------------------------------------------------------------------------------------------------


@query("keep_relevant", f"WITH {CRAWL_SQL} SELECT url, fetchDate FROM crawl WHERE url IN (SELECT url FROM relevant)")
def _(spark, sf_dir):
    snapshots = crawl(spark, sf_dir)
    return relational.keep_relevant(snapshots, relevant(snapshots)).select("url", "fetchDate")


@query(
    "name_clusters",
    """WITH c AS (SELECT page_id, CAST(page_id % 7 - 1 AS INTEGER) AS prediction FROM pages),
       names AS (SELECT prediction, 'cluster of ' || min(page_id) AS name FROM c WHERE prediction >= 0 GROUP BY prediction)
       SELECT page_id, c.prediction, name FROM c LEFT JOIN names ON names.prediction = c.prediction""",
)
def _(spark, sf_dir):
    pages = clustered_urls(spark, sf_dir)
    named = pages.filter("prediction >= 0").groupBy("prediction").agg(F.min("page_id").cast("string").alias("first"))
    names = named.select("prediction", F.concat(F.lit("cluster of "), "first").alias("name"))
    return relational.name_clusters(pages, names).select("page_id", "prediction", "name")


_NEAR_SQL = f"""WITH {POINTS_SQL},
near AS (
  SELECT a.id, b.id AS other_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
  FROM points a JOIN points b
    ON b.x BETWEEN a.x - 1.01 * {EPS} AND a.x + 1.01 * {EPS} AND b.y BETWEEN a.y - 1.01 * {EPS} AND a.y + 1.01 * {EPS}
   AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {EPS}
),
flags AS (SELECT id, count(*) >= {MIN_SAMPLES} AS core FROM near GROUP BY id)
"""


@query("core_points", _NEAR_SQL + "SELECT id, core FROM flags")
def _(spark, sf_dir):
    return density.core_points(points(spark, sf_dir), EPS, MIN_SAMPLES)


@query("eps_neighbors", _NEAR_SQL + "SELECT id, other_id, round(dist, 6) AS dist FROM near WHERE id <> other_id")
def _(spark, sf_dir):
    placed = cut(points(spark, sf_dir))
    found = neighbors.eps_neighbors(placed, EPS)
    return neighbors.expand_neighbors(placed, found, EPS).select("id", "other_id", rounded("dist"))


@query("neighbor_degrees", _NEAR_SQL + "SELECT id, count(*) - 1 AS degree FROM near GROUP BY id")
def _(spark, sf_dir):
    return neighbors.eps_neighbors(points(spark, sf_dir), EPS).degree


@query(
    "sparse_neighbors",
    _NEAR_SQL
    + """SELECT near.id, other_id, round(dist, 6) AS dist FROM near JOIN flags ON flags.id = near.id
         WHERE NOT core AND near.id <> other_id""",
)
def _(spark, sf_dir):
    return density.sparse_neighbors(points(spark, sf_dir), EPS, MIN_SAMPLES).select("id", "other_id", rounded("dist"))


# --- windows and sorts ------------------------------------------------------------------------------------------------


@query(
    "quantity_steps",
    """SELECT * FROM (
         SELECT l_orderkey, l_linenumber, l_partkey,
                abs(l_quantity - lag(l_quantity) OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
                  AS step FROM lineitem) WHERE step IS NOT NULL""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity"
    )
    paired = consecutive_pairs(lines, "l_partkey", "l_shipdate", ["l_quantity"], tie=["l_orderkey", "l_linenumber"])
    return paired.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.abs(F.col("l_quantity") - F.col("previous_l_quantity")).alias("step")
    )


@query(
    "user_event_steps",
    """SELECT * FROM (
         SELECT event_id, user_id, value - lag(value) OVER s AS change, lag(event_type) OVER s AS previous_event_type
         FROM events WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id))
       WHERE previous_event_type IS NOT NULL""",
)
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    paired = consecutive_pairs(events, "user_id", "ts", ["event_type", "value"], tie=["event_id"])
    return paired.select(
        "event_id", "user_id", (F.col("value") - F.col("previous_value")).alias("change"), "previous_event_type"
    )


@query(
    "top_n_per_group",
    """SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) AS place
         FROM lineitem) WHERE place <= 3""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    order = [F.col("l_quantity").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()]
    return relational.top_n_per_group(lines, "l_partkey", order, 3)


@query(
    "top_k",
    f"""WITH {DRIFT_SQL} SELECT url, fetchDate, content_length_difference FROM drift
        ORDER BY content_length_difference DESC, url, fetchDate LIMIT 10""",
)
def _(spark, sf_dir):
    largest = relational.top_k(drift(spark, sf_dir), "content_length_difference", 10, ["url", "fetchDate"])
    return largest.select("url", "fetchDate", "content_length_difference")


# --- vector and scalar functions --------------------------------------------------------------------------------------

_NEIGHBOUR_SQL = """WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a, lag(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS b
  FROM embeddings)"""


@query(
    "vector_distances",
    _NEIGHBOUR_SQL
    + """ SELECT vec_id, round(list_distance(a, b), 6) AS euclidean, round(1 - list_cosine_similarity(a, b), 6) + 0.0 AS cosine,
           round(list_distance(a, b) * list_distance(a, b), 6) AS squared FROM v WHERE b IS NOT NULL""",
)
def _(spark, sf_dir):
    paired = consecutive_pairs(table(spark, sf_dir, "embeddings"), "label", "vec_id", ["embedding"])
    a, b = "embedding", "previous_embedding"
    return paired.select(
        "vec_id",
        F.round(euclidean_distance(a, b), 6).alias("euclidean"),
        (F.round(cosine_distance(a, b), 6) + 0.0).alias("cosine"),
        F.round(squared_distance(a, b), 6).alias("squared"),
    )


@query(
    "rowwise_minmax",
    """SELECT vec_id, pos, round((v - lo) / (hi - lo), 6) AS value FROM (
         SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v,
                CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
                list_min(CAST(embedding AS DOUBLE[])) AS lo, list_max(CAST(embedding AS DOUBLE[])) AS hi FROM embeddings)""",
)
def _(spark, sf_dir):
    scaled = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.posexplode(rowwise_minmax("embedding")).alias("pos", "value")
    )
    return scaled.select("vec_id", "pos", rounded("value"))


@query(
    "standardize",
    """WITH u AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v,
                         CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings),
       s AS (SELECT pos, avg(v) AS mean, stddev_samp(v) AS dev FROM u GROUP BY pos)
       SELECT vec_id, u.pos, round((v - mean) / dev, 6) + 0.0 AS value FROM u JOIN s ON s.pos = u.pos""",
)
def _(spark, sf_dir):
    scaled = standardize(table(spark, sf_dir, "embeddings"), "embedding")
    return scaled.select("vec_id", F.posexplode("embedding").alias("pos", "value")).select(
        "vec_id", "pos", rounded("value")
    )


# --- drift ------------------------------------------------------------------------------------------------------------


@query(
    "semantic_drift",
    f"""WITH {DRIFT_SQL} SELECT url, fetchDate, round(euclidean_distance, 6) + 0.0 AS euclidean_distance,
        round(cosine_distance, 6) + 0.0 AS cosine_distance, {', '.join(DIFFERENCES)} FROM drift""",
)
def _(spark, sf_dir):
    return drift(spark, sf_dir).select(
        "url", "fetchDate", rounded("euclidean_distance"), rounded("cosine_distance"), *DIFFERENCES
    )


@query("drift_by_week", ORACLES["semantic_drift"])
def _(spark, sf_dir):
    """The same rows, from one week of the crawl after the other."""
    stored = cut(crawl(spark, sf_dir))
    urls = cut(relevant(stored))
    path = scratch_path(spark, "history")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for row in stored.select("fetchDate").distinct().orderBy("fetchDate").collect():  # one a week
        add_week(stored.filter(F.col("fetchDate") == row["fetchDate"]), path, row["fetchDate"], urls, buckets=buckets)
    return drift_so_far(spark, path).select(
        "url", "fetchDate", rounded("euclidean_distance"), rounded("cosine_distance"), *DIFFERENCES
    )


# --- counts and profiles ----------------------------------------------------------------------------------------------


@query("row_count", f"WITH {DRIFT_SQL} SELECT count(*) AS n_rows FROM drift")
def _(spark, sf_dir):
    return profile.row_count(drift(spark, sf_dir))


@query(
    "vector_coverage",
    f"""WITH {CRAWL_SQL} SELECT count(*) AS n_rows, count(vec) AS n_set, count(*) - count(vec) AS n_not_set,
        CAST(0 AS BIGINT) AS n_other, round(100.0 * count(vec) / count(*), 2) AS set_pct,
        round(100.0 * (count(*) - count(vec)) / count(*), 2) AS not_set_pct FROM crawl""",
)
def _(spark, sf_dir):
    return profile.vector_coverage(crawl(spark, sf_dir))


@query(
    "corrupt_profile",
    """SELECT CASE WHEN page_id % 10 = 9 THEN '{"url": ' || page_id END AS _corrupt_record, count(*) AS count
       FROM pages GROUP BY 1""",
)
def _(spark, sf_dir):
    path = scratch_path(spark, "broken")
    pages = table(spark, sf_dir, "pages")
    number = F.col("page_id").cast("string")
    broken = F.concat(F.lit('{"url": '), number)
    line = F.when(F.col("page_id") % 10 == 9, broken).otherwise(F.to_json(F.struct("url")))
    pages.select(line.alias("value")).write.option("compression", "gzip").text(f"{path}/2020-07-06")
    return profile.corrupt_profile(read_crawl(spark, path))


@query(
    "vector_lengths",
    f"WITH {CRAWL_SQL} SELECT CAST(len(vec) AS INTEGER) AS length, count(*) AS count FROM crawl GROUP BY 1",
)
def _(spark, sf_dir):
    return profile.vector_lengths(crawl(spark, sf_dir))


@query("snapshots_per_key", f"WITH {CRAWL_SQL} SELECT url, count(*) AS count FROM crawl GROUP BY url")
def _(spark, sf_dir):
    return profile.snapshots_per_key(crawl(spark, sf_dir))


@query("distinct_keys", f"WITH {DRIFT_SQL} SELECT count(DISTINCT url) AS n_keys FROM drift")
def _(spark, sf_dir):
    return profile.distinct_keys(drift(spark, sf_dir))


def _each(template: str, columns=MEASURES) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in columns)


@query("zero_counts", f"WITH {DRIFT_SQL} " + _each("SELECT '{c}' AS \"column\", count(CASE WHEN abs({c}) <= 1e-9 THEN 1 END) AS zeros FROM drift"))
def _(spark, sf_dir):
    return profile.zero_counts(drift(spark, sf_dir), MEASURES, atol=1e-9)


@query(
    "zero_share",
    f"WITH {ROUNDED_DRIFT_SQL} "
    + _each("SELECT '{c}' AS \"column\", round(100 * avg(CASE WHEN {c} = 0 THEN 1 ELSE 0 END), 1) AS zero_pct FROM steady"),
)
def _(spark, sf_dir):
    return profile.zero_share(steady_drift(spark, sf_dir), MEASURES)


@query(
    "null_counts",
    f"WITH {DRIFT_SQL} " + _each("SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls FROM drift"),
)
def _(spark, sf_dir):
    return profile.null_counts(drift(spark, sf_dir), MEASURES)


@query(
    "changed_share",
    f"""WITH {DRIFT_SQL} SELECT count(*) AS n_rows, count(CASE WHEN euclidean_distance <> 0 THEN 1 END) AS n_changed,
        count(CASE WHEN euclidean_distance <> 0 THEN 1 END) / count(*) AS changed_ratio FROM drift""",
)
def _(spark, sf_dir):
    return profile.changed_share(drift(spark, sf_dir), ["euclidean_distance"])


@query(
    "unchanged_keys",
    f"""WITH {DRIFT_SQL} SELECT url, count(*) AS n_rows FROM drift GROUP BY url
        HAVING avg(internal_link_count_difference) = 0""",
)
def _(spark, sf_dir):
    return profile.unchanged_keys(drift(spark, sf_dir), "url", "internal_link_count_difference")


_STATS_SQL = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS p25,
  round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM """
_LINE_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _stats(df: DataFrame, cols) -> DataFrame:
    return profile.summary_stats(df, cols).select(
        "column", "count", *[rounded(c, 4) for c in ("mean", "std")], "min",
        *[rounded(c, 4) for c in ("p25", "p50", "p75")], "max",
    )


@query("summary_stats", _each(_STATS_SQL + "lineitem", _LINE_COLUMNS))
def _(spark, sf_dir):
    return _stats(table(spark, sf_dir, "lineitem"), _LINE_COLUMNS)


@query(
    "drift_summary",
    f"WITH {ROUNDED_DRIFT_SQL} SELECT * REPLACE (round(min, 4) + 0.0 AS min, round(max, 4) + 0.0 AS max) FROM ("
    + _each(_STATS_SQL + "steady")
    + ")",
)
def _(spark, sf_dir):
    return _stats(cut(steady_drift(spark, sf_dir)), MEASURES).withColumns({c: rounded(c, 4) for c in ("min", "max")})


def _histogram_sql(source: str, col: str, n: int) -> str:
    return f"""x AS (SELECT CAST({col} AS DOUBLE) AS v FROM {source} WHERE {col} IS NOT NULL),
    span AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / {n} AS step FROM x),
    filled AS (SELECT CAST(least(floor((v - lo) / step), {n - 1}) AS BIGINT) AS bin, count(*) AS n FROM x, span GROUP BY 1)
    SELECT CAST(r.range AS BIGINT) AS bin, round(lo + r.range * step, 6) AS lo,
           round(CASE WHEN r.range = {n - 1} THEN hi ELSE lo + (r.range + 1) * step END, 6) AS hi, coalesce(n, 0) AS count
    FROM range({n}) r CROSS JOIN span LEFT JOIN filled ON filled.bin = r.range"""


def _bins(df: DataFrame) -> DataFrame:
    return df.select("bin", rounded("lo"), rounded("hi"), "count")


@query("histogram", f"WITH {DRIFT_SQL}, {_histogram_sql('drift', 'content_length_difference', 20)}")
def _(spark, sf_dir):
    return _bins(profile.histogram(stored_drift(spark, sf_dir), "content_length_difference"))


@query("distance_histogram", f"WITH {DRIFT_SQL}, {_histogram_sql('drift', 'euclidean_distance', 20)}")
def _(spark, sf_dir):
    return _bins(profile.histogram(stored_drift(spark, sf_dir), "euclidean_distance"))


@query("cosine_histogram", f"WITH {ROUNDED_DRIFT_SQL}, {_histogram_sql('steady', 'cosine_distance', 20)}")
def _(spark, sf_dir):
    return _bins(profile.histogram(steady_drift(spark, sf_dir), "cosine_distance"))


@query(
    "cosine_histogram_non_negative",
    f"WITH {ROUNDED_DRIFT_SQL}, kept AS (SELECT * FROM steady WHERE cosine_distance >= 0), "
    + _histogram_sql("kept", "cosine_distance", 20),
)
def _(spark, sf_dir):
    return _bins(profile.histogram(relational.non_negative(steady_drift(spark, sf_dir), "cosine_distance"), "cosine_distance"))


@query("price_histogram", f"WITH {_histogram_sql('lineitem', 'l_extendedprice', 50)}")
def _(spark, sf_dir):
    return _bins(profile.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50))


@query(
    "fixed_edge_histogram",
    """WITH edges AS (SELECT range AS bin, range * 5.0 AS lo, range * 5.0 + 5 AS hi FROM range(8))
       SELECT bin, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(l_quantity) AS count
       FROM edges LEFT JOIN lineitem ON l_quantity >= lo AND (l_quantity < hi OR (bin = 7 AND l_quantity = hi)) GROUP BY ALL""",
)
def _(spark, sf_dir):
    return profile.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", edges=[5.0 * i for i in range(9)])


@query("value_counts", "SELECT l_quantity, count(*) AS count FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1 ORDER BY 1")
def _(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "lineitem"), "l_quantity")


@query(
    "drift_value_counts",
    f"""WITH {DRIFT_SQL} SELECT content_length_difference, count(*) AS count FROM drift
        WHERE content_length_difference IS NOT NULL GROUP BY 1 ORDER BY 1""",
)
def _(spark, sf_dir):
    return profile.value_counts(drift(spark, sf_dir), "content_length_difference")


@query(
    "histogram_2d",
    """WITH s AS (SELECT min(l_quantity) AS x0, (max(l_quantity) - min(l_quantity)) / 20 AS dx,
                         min(l_extendedprice) AS y0, (max(l_extendedprice) - min(l_extendedprice)) / 30 AS dy FROM lineitem)
       SELECT CAST(least(floor((l_quantity - x0) / dx), 19) AS BIGINT) AS binx,
              CAST(least(floor((l_extendedprice - y0) / dy), 29) AS BIGINT) AS biny, count(*) AS count
       FROM lineitem, s GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return profile.histogram_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 20, 30)


@query(
    "kernel_density",
    f"""WITH {POINTS_SQL},
span AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM points),
cells AS (SELECT least(floor((x - x0) / ((x1 - x0) / 60)), 59)::BIGINT AS cx,
                 least(floor((y - y0) / ((y1 - y0) / 60)), 59)::BIGINT AS cy, count(*) AS n
          FROM points, span GROUP BY ALL),
weights AS (SELECT d, exp(-d * d / 4.5) AS w FROM range(-6, 7) t(d)),
kernel AS (SELECT d, w / (SELECT sum(w) FROM weights) AS w FROM weights)
SELECT cx + a.d AS binx, cy + b.d AS biny, round(sum(n * a.w * b.w), 9) AS density
FROM cells, kernel a, kernel b
WHERE cx + a.d BETWEEN 0 AND 59 AND cy + b.d BETWEEN 0 AND 59 GROUP BY ALL""",
)
def _(spark, sf_dir):
    grid = profile.kernel_density(points(spark, sf_dir), "x", "y", 60, 60, bandwidth=1.5)
    return grid.select("binx", "biny", rounded("density", 9))


@query(
    "hexagons",
    f"""WITH {POINTS_SQL},
axial AS (SELECT (0.5773502691896258::DOUBLE * x - y / 3) / 0.5::DOUBLE AS q, (2 * y / 3) / 0.5::DOUBLE AS r FROM points),
whole AS (SELECT *, floor(q + 0.5::DOUBLE) AS wq, floor(r + 0.5::DOUBLE) AS wr, floor(-q - r + 0.5::DOUBLE) AS ws FROM axial),
off AS (SELECT *, abs(wq - q) AS dq, abs(wr - r) AS dr, abs(ws + q + r) AS ds FROM whole)
SELECT (CASE WHEN dq > dr AND dq > ds THEN -wr - ws ELSE wq END)::BIGINT AS q,
       (CASE WHEN (dq > dr AND dq > ds) OR dr <= ds THEN wr ELSE -wq - ws END)::BIGINT AS r, count(*) AS count
FROM off GROUP BY ALL""",
)
def _(spark, sf_dir):
    return profile.hexagons(points(spark, sf_dir), "x", "y", size=0.5).select("q", "r", "count")


def _matrix_sql(source: str, cols, rank: bool = False) -> str:
    parts = []
    for a in cols:
        for b in cols:
            pair = f"SELECT CAST({a} AS DOUBLE) AS u, CAST({b} AS DOUBLE) AS v FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
            if rank:
                pair = f"""SELECT rank() OVER (ORDER BY u) + (count(*) OVER (PARTITION BY u) - 1) / 2.0 AS u,
                    rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS v FROM ({pair})"""
            r = "1.0" if a == b else "corr(u, v)"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, CAST({r} AS DOUBLE) AS r, count(*) AS n FROM ({pair})")
    return f"""SELECT a, b, round(r, 6) + 0.0 AS r, n,
        CASE WHEN a <> b AND r * r < 1 THEN round(r * sqrt((n - 2) / (1 - r * r)), 4) + 0.0 END AS t FROM ({' UNION ALL '.join(parts)})"""


def _matrix(df: DataFrame) -> DataFrame:
    return df.select("a", "b", rounded("r"), "n", rounded("t", 4))


@query("pearson_matrix", f"WITH {ROUNDED_DRIFT_SQL} " + _matrix_sql("steady", MEASURES))
@query("drift_pearson", f"WITH {ROUNDED_DRIFT_SQL} " + _matrix_sql("steady", MEASURES))
def _(spark, sf_dir):
    return _matrix(correlation_matrix(steady_drift(spark, sf_dir), MEASURES))


@query(
    "drift_spearman",
    f"WITH {ROUNDED_DRIFT_SQL}, r AS (SELECT * REPLACE (round(euclidean_distance, 9) AS euclidean_distance) FROM steady) "
    + f"SELECT a, b, r, n FROM ({_matrix_sql('r', MEASURES, rank=True)})",
)
def _(spark, sf_dir):
    steady = steady_drift(spark, sf_dir).withColumn("euclidean_distance", rounded("euclidean_distance", 9))
    # Both distances rank unit vectors alike, so t is the quotient of two rounding errors there.
    return _matrix(correlation_matrix(steady, MEASURES, "spearman")).drop("t")


@query(
    "constant_column_correlation",
    """WITH c AS (SELECT l_quantity AS q, l_tax AS t FROM lineitem)
       SELECT 'one' AS a, 'one' AS b, CAST(NULL AS DOUBLE) AS r, count(*) AS n, CAST(NULL AS DOUBLE) AS t FROM c
       UNION ALL SELECT 'one', 'q', NULL, count(*), NULL FROM c UNION ALL SELECT 'q', 'one', NULL, count(*), NULL FROM c
       UNION ALL SELECT 'q', 'q', 1.0, count(*), NULL FROM c""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit(1.0).alias("one"), F.col("l_quantity").alias("q"))
    return _matrix(correlation_matrix(rows, ["one", "q"]))


@query("correlation_significance")
def _(spark, sf_dir):
    return correlation_matrix(table(spark, sf_dir, "lineitem"), _LINE_COLUMNS)


@query("spearman_matrix", _matrix_sql("lineitem", _LINE_COLUMNS, rank=True))
def _(spark, sf_dir):
    return _matrix(correlation_matrix(table(spark, sf_dir, "lineitem"), _LINE_COLUMNS, "spearman"))


@query(
    "cluster_summary",
    """WITH c AS (SELECT CAST(page_id % 7 - 1 AS INTEGER) AS prediction FROM pages)
       SELECT count(DISTINCT CASE WHEN prediction <> -1 THEN prediction END) AS n_clusters, count(*) AS n_rows,
              round(100 * avg(CASE WHEN prediction = -1 THEN 1 ELSE 0 END), 2) AS noise_pct FROM c""",
)
def _(spark, sf_dir):
    return cluster.cluster_summary(clustered_urls(spark, sf_dir))


@query("cluster_sizes", "SELECT label AS prediction, count(*) AS count FROM embeddings GROUP BY label")
def _(spark, sf_dir):
    return cluster.cluster_sizes(labelled(spark, sf_dir))


# --- dimensionality reduction -----------------------------------------------------------------------------------------


@query("pca_project")
def _(spark, sf_dir):
    projected = pca_project(table(spark, sf_dir, "embeddings"), 5)
    return projected.select("vec_id", F.posexplode("scores").alias("pos", "value"))


@query("project_2d")
def _(spark, sf_dir):
    return project_2d(table(spark, sf_dir, "embeddings")).select("vec_id", "x", "y")


@query("explained_variance")
def _(spark, sf_dir):
    return explained_variance(table(spark, sf_dir, "embeddings"))


@query("optimal_k")
def _(spark, sf_dir):
    return optimal_k(explained_variance(table(spark, sf_dir, "embeddings")), 0.95)


def _fit(spark: SparkSession, sf_dir: str):
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.select(F.size("embedding").alias("d")).head()["d"]
    model, curve = autoencoder_fit(
        vectors, [width, 2 * width // 3, width // 3], bottleneck="linear", output="linear", lr=2e-3
    )
    return vectors, model, curve


@query("autoencoder_fit")
def _(spark, sf_dir):
    return _fit(spark, sf_dir)[2]


@query("autoencoder_batches")
def _(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    width = vectors.select(F.size("embedding").alias("d")).head()["d"]
    layers = [width, 2 * width // 3, width // 3]
    return autoencoder_fit_synchronous(
        vectors, layers, bottleneck="linear", output="linear", lr=2e-3, batch=800, epochs=5
    )[1]


@query("autoencode")
def _(spark, sf_dir):
    vectors, model, _curve = _fit(spark, sf_dir)
    return autoencode(vectors, model).select("vec_id", F.posexplode("encoded").alias("pos", "value"))


@query("autoencoder_error")
def _(spark, sf_dir):
    vectors, model, _curve = _fit(spark, sf_dir)
    return reconstruction_error(reconstruct(vectors, model), "embedding", "reconstructed")


@query(
    "reconstruction_error",
    _NEIGHBOUR_SQL
    + """ SELECT count(*) AS n_rows, round(avg(list_distance(a, b) * list_distance(a, b) / len(a)), 8) AS mse
          FROM v WHERE b IS NOT NULL""",
)
def _(spark, sf_dir):
    paired = consecutive_pairs(table(spark, sf_dir, "embeddings"), "label", "vec_id", ["embedding"])
    return reconstruction_error(paired, "embedding", "previous_embedding").select("n_rows", rounded("mse", 8))


# --- clustering -------------------------------------------------------------------------------------------------------


@query("sweep_kmeans")
def _(spark, sf_dir):
    return cluster.sweep_k(table(spark, sf_dir, "embeddings"), "kmeans", SWEEP)


@query("sweep_bisecting")
def _(spark, sf_dir):
    return sweep_splits(table(spark, sf_dir, "embeddings"), SWEEP)


@query("sweep_gmm")
def _(spark, sf_dir):
    reduced = pca_project(table(spark, sf_dir, "embeddings"), 2)
    return cluster.sweep_k(reduced, "gmm", [2, 4], col="scores", metric="squaredEuclidean")


_COMPONENT_SQL = (
    _NEAR_SQL.replace("WITH", "WITH RECURSIVE", 1)
    + """, core AS (SELECT id FROM flags WHERE core),
links AS (SELECT n.id, n.other_id FROM near n JOIN core a ON a.id = n.id JOIN core b ON b.id = n.other_id),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT l.other_id, r.root FROM reach r JOIN links l ON l.id = r.id),
component AS (SELECT id, min(root) AS component FROM reach GROUP BY id)
"""
)


@query(
    "dbscan",
    _COMPONENT_SQL
    + """, label AS (
  SELECT id, component FROM component
  UNION ALL
  SELECT n.id, min(c.component) FROM near n JOIN component c ON c.id = n.other_id
  WHERE n.id NOT IN (SELECT id FROM core) GROUP BY n.id)
SELECT p.id, CAST(coalesce(r.place, -1) AS INTEGER) AS prediction FROM points p LEFT JOIN label l ON l.id = p.id
LEFT JOIN (SELECT component, row_number() OVER (ORDER BY component) - 1 AS place
           FROM (SELECT DISTINCT component FROM component)) r ON r.component = l.component""",
)
def _(spark, sf_dir):
    return density.dbscan(points(spark, sf_dir), EPS, MIN_SAMPLES)


@query("density_tree")
def _(spark, sf_dir):
    return density.density_tree(points(spark, sf_dir), 20, 10, 0.4)


_LEVELS = (0.05, 0.03, 0.02)


@query(
    "density_levels",
    f"""WITH RECURSIVE {POINTS_SQL},
radii AS (SELECT * FROM (VALUES {', '.join(f'({i}, {r})' for i, r in enumerate(_LEVELS))}) t(g, r)),
near AS (
  SELECT g, CAST(r AS DOUBLE) AS r, a.id, b.id AS other_id,
         sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
  FROM points a JOIN points b ON true CROSS JOIN radii
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= CAST(r AS DOUBLE)),
core AS (SELECT g, id FROM near GROUP BY g, id HAVING count(*) >= 6),
links AS (SELECT n.g, n.id, n.other_id FROM near n JOIN core a ON a.g = n.g AND a.id = n.id
          JOIN core b ON b.g = n.g AND b.id = n.other_id WHERE dist <= 0.8 * r),
reach(g, id, root) AS (SELECT g, id, id FROM core
  UNION SELECT r.g, l.other_id, r.root FROM reach r JOIN links l ON l.g = r.g AND l.id = r.id)
SELECT CAST(g AS INTEGER) AS g, id, min(root) AS component FROM reach GROUP BY ALL""",
)
def _(spark, sf_dir):
    return density.density_levels(points(spark, sf_dir), _LEVELS, 5, 0.8)


@query("density_hierarchy")
def _(spark, sf_dir):
    return hierarchy.density_hierarchy(points(spark, sf_dir), 20, 10, 0.4)


@query(
    "core_distances",
    f"""WITH {POINTS_SQL},
near AS (SELECT a.id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS dist
         FROM points a JOIN points b ON a.id <> b.id),
placed AS (SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist) AS place FROM near)
SELECT id, round(dist, 9) AS core FROM placed WHERE place = 10""",
)
def _(spark, sf_dir):
    return hierarchy.core_distances(points(spark, sf_dir), 10).select("id", rounded("core", 9))


def _address_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered_urls(spark, sf_dir).select(
        F.col("page_id").alias("id"),
        F.transform(drop_stopwords(url_tokens("url", "path")), F.lower).alias("tokens"),
    )


@query("topic_terms")
def _(spark, sf_dir):
    return topic_tables(_address_words(spark, sf_dir), 3)[0]


@query("topic_assignments")
def _(spark, sf_dir):
    return topic_tables(_address_words(spark, sf_dir), 3)[1]


_SILHOUETTE_SQL = """,
sizes AS (SELECT prediction, count(*) AS n FROM v GROUP BY prediction),
u AS (SELECT vec_id, prediction, unnest(a) AS x, generate_subscripts(a, 1) AS pos FROM v),
sums AS (SELECT prediction, pos, sum(x) AS s FROM u GROUP BY ALL),
squares AS (SELECT prediction, sum(list_dot_product(a, a)) AS q FROM v GROUP BY prediction),
dots AS (SELECT u.vec_id, u.prediction AS own, s.prediction AS other, sum(u.x * s.s) AS d
         FROM u JOIN sums s ON s.pos = u.pos GROUP BY ALL),
means AS (SELECT d.vec_id, own, other, n, {mean} AS m
          FROM dots d JOIN sizes z ON z.prediction = other JOIN squares q ON q.prediction = other
          JOIN v ON v.vec_id = d.vec_id),
sides AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS n,
                 max(CASE WHEN own = other AND n > 1 THEN m * n / (n - 1) END) AS i, min(CASE WHEN own <> other THEN m END) AS o
          FROM means GROUP BY vec_id)
SELECT '{metric}' AS metric, round(avg(CASE WHEN n = 1 THEN 0 ELSE (o - i) / greatest(o, i) END), 6) + 0.0 AS silhouette FROM sides"""


def _silhouette(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    return cluster.silhouette(labelled(spark, sf_dir), metric).select("metric", rounded("silhouette"))


@query(
    "silhouette_cosine",
    """WITH v AS (SELECT vec_id, label AS prediction, [x / sqrt(list_dot_product(e, e)) FOR x IN e] AS a
       FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"""
    + _SILHOUETTE_SQL.format(mean="1 - d.d / n", metric="cosine"),
)
def _(spark, sf_dir):
    return _silhouette(spark, sf_dir, "cosine")


@query(
    "silhouette_squared_euclidean",
    "WITH v AS (SELECT vec_id, label AS prediction, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)"
    + _SILHOUETTE_SQL.format(mean="list_dot_product(v.a, v.a) + q.q / n - 2 * d.d / n", metric="squaredEuclidean"),
)
def _(spark, sf_dir):
    return _silhouette(spark, sf_dir, "squaredEuclidean")


@query(
    "silhouette_exact",
    f"""WITH {POINTS_SQL},
sizes AS (SELECT prediction, count(*) AS n FROM points GROUP BY prediction),
sums AS (SELECT a.id, a.prediction AS own, b.prediction AS other,
                sum(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS s FROM points a, points b GROUP BY ALL),
sides AS (SELECT id, own, max(CASE WHEN own = other THEN s / (n - 1) END) AS i, min(CASE WHEN own <> other THEN s / n END) AS o
          FROM sums JOIN sizes ON sizes.prediction = other GROUP BY ALL)
SELECT count(*) AS n_rows, count(DISTINCT own) AS n_clusters, round(avg((o - i) / greatest(o, i)), 6) AS silhouette FROM sides""",
)
def _(spark, sf_dir):
    return silhouette_exact(points(spark, sf_dir)).select("n_rows", "n_clusters", rounded("silhouette"))


@query(
    "cluster_centers",
    """SELECT prediction, pos, round(avg(x), 6) + 0.0 AS value FROM (
         SELECT label AS prediction, unnest(CAST(embedding AS DOUBLE[])) AS x,
                CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos FROM embeddings) GROUP BY ALL""",
)
def _(spark, sf_dir):
    return cluster.cluster_centers(labelled(spark, sf_dir)).select("prediction", "pos", rounded("value"))


# --- keywords ---------------------------------------------------------------------------------------------------------

_STOP_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
_WORDS_SQL = f"""WITH words AS (
  SELECT page_id, CAST(page_id % 7 - 1 AS INTEGER) AS prediction,
         [w FOR w IN string_split_regex(regexp_replace(
            regexp_replace(regexp_replace(url, '{HTML_ENDING}', ''), '{LAST_DOT}', ''), '{PROTOCOL}', '', 'g'),
            '{NOT_WORD}') IF w <> ''] AS tokens FROM pages),
kept AS (SELECT page_id, prediction, [w FOR w IN tokens IF lower(w) NOT IN ({_STOP_LIST})] AS tokens FROM words),
tokens AS (SELECT prediction, lower(unnest(tokens)) AS token FROM kept),
counts AS (SELECT prediction, token, count(*) AS count FROM tokens GROUP BY ALL)
"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered_urls(spark, sf_dir).withColumn("tokens", url_tokens("url"))


@query("url_tokens", _WORDS_SQL + "SELECT page_id, array_to_string(tokens, ' ') AS tokens FROM words")
def _(spark, sf_dir):
    return _tokens(spark, sf_dir).select("page_id", F.array_join("tokens", " ").alias("tokens"))


@query("remove_stopwords", _WORDS_SQL + "SELECT page_id, array_to_string(tokens, ' ') AS tokens FROM kept")
def _(spark, sf_dir):
    kept = _tokens(spark, sf_dir).withColumn("tokens", drop_stopwords("tokens"))
    return kept.select("page_id", F.array_join("tokens", " ").alias("tokens"))


@query("token_counts", _WORDS_SQL + "SELECT prediction, token, count FROM counts")
def _(spark, sf_dir):
    kept = _tokens(spark, sf_dir).withColumn("filtered", drop_stopwords("tokens"))
    return token_counts(explode_tokens(kept))


@query("topic_pipeline")
def _(spark, sf_dir):
    """Vectors to the plane, clusters by density, and the words that their pages' addresses share."""
    placed = project_2d(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").alias("id"), "x", "y")
    addresses = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url")
    found = cut(density.dbscan(placed.select("id", "x", "y"), PIPELINE_EPS, PIPELINE_SAMPLES))
    return cluster_keywords(addresses.join(found, "id"), n=5)


@query(
    "cluster_keywords",
    _WORDS_SQL
    + """SELECT prediction, token, count FROM (SELECT *, row_number() OVER (
         PARTITION BY prediction ORDER BY count DESC, token) AS place FROM counts) WHERE place <= 5""",
)
def _(spark, sf_dir):
    return cluster_keywords(clustered_urls(spark, sf_dir), n=5)
