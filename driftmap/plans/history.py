"""Semantic drift week by week, from the last snapshot of every page instead of the whole history.

A history is a folder. ``last-<number>-<buckets>-<week>`` is a table of the last snapshot of each page, bucketed and sorted by
url, so that a new week is shuffled to it and the history stays where it is; ``drift-<number>-<week>`` holds the drift rows
of that week. A week writes both under the next number, the drift first. The newest ``last`` table whose write has been
committed is the state, so a week takes effect at one moment or not at all, and a week that failed is simply run again.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from driftmap.operators.pairs import consecutive_pairs
from driftmap.operators.relational import keep_relevant
from driftmap.operators.scale import cut
from driftmap.plans.drift import COMPARED, TIE, measures, snapshots

#: Tasks that share the pages, set when a history begins.
BUCKETS = 200
_LAST = re.compile(r"last-(\d{8})-(\d+)-(.*)$")
_DRIFT = re.compile(r"drift-(\d{8})-(.*)$")


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _committed(spark: SparkSession, path: str, pattern: re.Pattern) -> list[tuple[str, ...]]:
    """Tables of the history whose write has ended, oldest first: their names and the parts of these."""
    files, target = _folder(spark, path)
    if not files.exists(target):
        return []
    names = [status.getPath().getName() for status in files.listStatus(target)]
    found = [(name, *match.groups()) for name in sorted(names) if (match := pattern.match(name))]
    return [f for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{f[0]}/_SUCCESS"))]


def _bucketed(spark: SparkSession, location: str, schema: str, buckets: int) -> DataFrame:
    """The table at ``location``, read in its buckets; the catalog forgets it, the files stay."""
    name = f"last_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (url) SORTED BY (url) INTO {buckets} BUCKETS "
        f"LOCATION '{location}'"
    )
    return spark.table(name)


def _to_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows of different pages dealt as the history is, so that a join moves only them, whatever the session's partitions."""
    return rows.repartition(buckets, "url")


def last_snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    """The last snapshot of every page so far; None before the first week."""
    state = _committed(spark, path, _LAST)
    return spark.read.parquet(f"{path}/{state[-1][0]}") if state else None


def drift_so_far(spark: SparkSession, path: str) -> DataFrame | None:
    """The drift rows of all weeks; None before the first week."""
    state = _committed(spark, path, _LAST)
    if not state:
        return None
    # A drift table above the state belongs to a week that has not taken effect.
    parts = [f"{path}/{name}" for name, number, _ in _committed(spark, path, _DRIFT) if number <= state[-1][1]]
    return spark.read.parquet(*parts)


def add_week(
    crawl: DataFrame, path: str, week: str, urls: DataFrame | None = None, clamp: bool = False, buckets: int = BUCKETS
) -> DataFrame:
    """Add a week's flattened crawl to the history at ``path`` and return its drift rows, as ``semantic_drift`` defines them.

    Weeks come in order of their names, letters, digits and ``.-_``. A page's snapshot must be dated after those it had in
    earlier weeks; a week with an earlier one is refused as a whole. A page may have several snapshots in a week, and need not be in every week.
    Rows without url are left out, as are pages that ``urls`` does not list. ``buckets`` counts for a new history only.
    """
    spark = crawl.sparkSession
    if not re.fullmatch(r"[\w.-]+", week):
        raise ValueError(f"{week!r} is no name of a week")
    state = _committed(spark, path, _LAST)
    if state and week <= state[-1][3]:
        raise ValueError(f"week {week} does not come after {state[-1][3]}")
    number = int(state[-1][1]) + 1 if state else 1
    buckets = int(state[-1][2]) if state else buckets

    rows = snapshots(crawl.filter(F.col("url").isNotNull()))
    if urls is not None:
        rows = keep_relevant(rows, urls)
    newest = F.struct("fetchDate", *TIE)
    fresh = rows.groupBy("url").agg(F.max_by(F.struct("fetchDate", *COMPARED), newest).alias("new"))
    marked = rows.withColumn("known", F.lit(True))
    paired = cut(consecutive_pairs(marked, "url", "fetchDate", [*COMPARED, "known"], TIE, keep_first=True))

    fields = [f.name for f in rows.schema if f.name != "url"]
    if state:
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        last = _bucketed(spark, f"{path}/{state[-1][0]}", schema, buckets)
    else:
        last = spark.createDataFrame([], rows.schema)
    # A page's first snapshot of the week follows its last one of the history; there is one a page, whatever its number of rows.
    before = last.select("url", *[F.col(c).alias(f"last_{c}") for c in fields])
    first = F.col("previous_known").isNull()
    met = _to_buckets(paired.filter(first), buckets).join(before, "url", "left")
    seen = Observation()
    met = met.observe(seen, F.count_if(F.col("fetchDate") <= F.col("last_fetchDate")).alias("late"))
    met = met.withColumns({f"previous_{c}": F.col(f"last_{c}") for c in COMPARED}).select(*paired.columns)
    watched = met.unionByName(paired.filter(~first))
    drift_path = f"{path}/drift-{number:08d}-{week}"
    measures(watched.filter(F.col("previous_vector").isNotNull()), clamp).write.mode("overwrite").parquet(drift_path)
    if seen.get["late"]:
        files, target = _folder(spark, drift_path)
        files.delete(target, True)
        raise ValueError(f"{seen.get['late']} snapshots of week {week} are not after those of earlier weeks")

    merged = last.select("url", F.struct(*[F.col(c) for c in ("fetchDate", *COMPARED)]).alias("old")).join(
        _to_buckets(fresh, buckets), "url", "full"
    )
    newer = merged.select("url", F.coalesce("new", "old").alias("s")).select("url", *[F.col(f"s.{c}").alias(c) for c in fields])
    name = f"last_{uuid.uuid4().hex}"
    target = f"{path}/last-{number:08d}-{buckets}-{week}"
    files, folder = _folder(spark, target)
    files.delete(folder, True)  # of a run that was not committed
    spread = newer if state else _to_buckets(newer, buckets)  # the history already lies in its buckets
    spread.write.format("parquet").option("path", target).bucketBy(buckets, "url").sortBy("url").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files are the history's
    for old in state[:-1]:  # the state before is kept for readers that have begun
        files, folder = _folder(spark, f"{path}/{old[0]}")
        files.delete(folder, True)
    return spark.read.parquet(drift_path)
