"""Hot keys take other plans; results stay the same."""

import os

import pytest
from pyspark.sql import functions as F

import driftmap as dm
from driftmap.operators import scale


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def skewed(spark):
    """A third of the rows belongs to one key, with equal dates and whole copies among them."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string"))
    return spark.range(600).select(
        key.alias("k"),
        F.concat(F.lit("d"), (F.xxhash64("id") % 40).cast("string")).alias("day"),
        F.floor(F.col("id") / 90).alias("size"),
    )


def test_pairs_of_a_hot_key(spark, skewed):
    plain = dm.consecutive_pairs(skewed, "k", "day", ["size", "day"], tie=["size"])
    sliced = dm.consecutive_pairs(skewed, "k", "day", ["size", "day"], tie=["size"], hot_rows=20)
    assert rows(plain) == rows(sliced) and plain.count() == 600 - skewed.select("k").distinct().count()


def test_pairs_of_a_missing_key(spark, skewed):
    with_null = skewed.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    plain = dm.consecutive_pairs(with_null, "k", "day", ["size"], tie=["size"])
    sliced = dm.consecutive_pairs(with_null, "k", "day", ["size"], tie=["size"], hot_rows=20)
    assert rows(plain) == rows(sliced)


def test_rows_without_a_value_hide_their_successor(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("a", 4, 9)], "k string, t int, v int")
    for hot_rows in (None, 1):
        pairs = dm.consecutive_pairs(df, "k", "t", ["v"], hot_rows=hot_rows)
        assert [(r.t, r.previous_v) for r in pairs.orderBy("t").collect()] == [(2, 5), (4, 7)]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_of_a_hot_key(spark, skewed, how):
    table = skewed.groupBy("k").count().filter("k <> '1'")
    assert rows(scale.lookup(skewed, table, ["k"], how)) == rows(scale.lookup(skewed, table, ["k"], how, hot_rows=20))


def test_hot_keys_are_bounded(spark, skewed, monkeypatch):
    assert len(scale.hot_hashes(skewed, ["k"], hot_rows=20)) == 1
    monkeypatch.setattr(scale, "HOT_GROUPS", 3)
    assert len(scale.hot_hashes(skewed, ["k"], hot_rows=1)) <= 3


def test_drift_does_not_depend_on_skew(spark):
    from driftmap.plans.derived import crawl

    snapshots = crawl(spark, "/root/testdata/sf0.001").withColumn("url", F.when(F.col("url") < "http://t", "u").otherwise(F.col("url")))
    assert rows(dm.semantic_drift(snapshots)) == rows(dm.semantic_drift(snapshots, hot_rows=5))


def test_scratch_folder_comes_from_the_session(spark):
    class Session:
        sparkContext = spark.sparkContext

        class conf:
            get = staticmethod({"spark.checkpoint.dir": "hdfs://cluster/shared"}.get)

    assert scale.scratch_root(Session()) == "hdfs://cluster/shared"
    assert scale.scratch_path(Session(), "cut").startswith("hdfs://cluster/shared/cut-")
    path = scale.scratch_path(spark, "cut")
    assert path.startswith(scale.scratch_root(spark)) and path != scale.scratch_path(spark, "cut")


def test_scratch_tables_can_be_cleared(spark, monkeypatch):
    monkeypatch.setattr(scale, "_written", {})
    table = scale.cut(spark.range(5))
    path = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and scale.clear_scratch(spark) == 1 and not os.path.exists(path)
