"""Literal fixtures for column functions, profiles and sources."""

import math

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

import driftmap as dm
from driftmap.functions.text import STOP_WORDS
from driftmap.operators import scale


def one(df):
    return df.head()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("[0.5, -0.25]", [0.5, -0.25]),
        ("[0.5,-0.25]", [0.5, -0.25]),
        ("[]", []),
        ("not set", None),
        (None, None),
    ],
)
def test_parse_vector(spark, text, expected):
    df = spark.createDataFrame([(text,)], "v string")
    assert one(df.select(dm.parse_vector("v"))) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://cellar.com/privacy.aspx", ["cellar", "com", "privacy"]),
        ("https://chwine.com/about/newsletter", ["chwine"]),
        ("https://x.com/a/b.html", ["x"]),
        ("http://www.a-b.fr/café_x/y.php", ["a", "b", "fr", "café_x", "y"]),
        ("http://localhost/foo/bar", ["localhost", "foo", "bar"]),
        ("https://e.com/search?q=1.5&z=2", ["e", "com", "search", "q", "1"]),
        (None, None),
    ],
)
def test_url_tokens(spark, url, expected):
    df = spark.createDataFrame([(url,)], "u string")
    assert one(df.select(dm.url_tokens("u"))) == expected


@pytest.mark.parametrize(
    "url, expected",
    [
        ("https://x.com/a/b.html", ["x", "com", "a", "b"]),
        ("https://chwine.com/about/newsletter", ["chwine", "com", "about", "newsletter"]),
        ("https://x.com", ["x", "com"]),
    ],
)
def test_url_tokens_by_path(spark, url, expected):
    df = spark.createDataFrame([(url,)], "u string")
    assert one(df.select(dm.url_tokens("u", "path"))) == expected


def test_stop_words(spark):
    df = spark.createDataFrame([(["The", "wine", "i", "And", "ABOUT"],)], "tokens array<string>")
    assert dm.remove_stopwords(df).head()["filtered"] == ["wine"]
    assert sorted(STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))


def test_distances(spark):
    df = spark.createDataFrame([([3.0, 0.0], [0.0, 4.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    row = df.select(
        dm.euclidean_distance("a", "b").alias("e"),
        dm.squared_distance("a", "b").alias("s"),
        dm.cosine_distance("a", "b").alias("c"),
        dm.cosine_distance("a", "z").alias("none"),
        dm.cosine_distance("a", "a", clamp=True).alias("same"),
    ).head()
    assert (row.e, row.s, row.c, row.none) == (5.0, 25.0, 1.0, None)
    assert row.same >= 0


def test_nulls_pass_through(spark):
    df = spark.createDataFrame([(None, 3, None)], "a bigint, b bigint, l array<string>")
    row = df.select(dm.abs_difference("a", "b").alias("d"), dm.link_count("l").alias("n")).head()
    assert (row.d, row.n) == (None, None)


def test_rowwise_minmax(spark):
    df = spark.createDataFrame([([1.0, 3.0, 2.0],), ([5.0, 5.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(dm.rowwise_minmax("v")).collect()] == [[0.0, 1.0, 0.5], [0.0, 0.0], None]


def test_histograms(spark):
    values = spark.createDataFrame([(v,) for v in (0.0, 1.0, 2.0, 10.0, None, math.nan)], "v double")
    bins = dm.histogram(values, "v", 5).orderBy("bin").collect()
    assert [r["count"] for r in bins] == [2, 1, 0, 0, 1]
    assert [(r.lo, r.hi) for r in bins] == [(0, 2), (2, 4), (4, 6), (6, 8), (8, 10)]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [tuple(r) for r in dm.histogram(same, "v").collect()] == [(0, 3.0, 3.0, 2)]
    assert dm.histogram(values.filter("v > 99 and not isnan(v)"), "v").collect() == []
    fixed = dm.histogram(values, "v", edges=[0, 1, 2]).orderBy("bin").collect()
    assert [r["count"] for r in fixed] == [1, 2]


def test_standardize(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([2.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    assert sorted(r[0] for r in dm.standardize(df, "v").collect()) == [[-1.0, 0.0], [0.0, 0.0], [1.0, 0.0]]
    wide = sorted(r[0][0] for r in dm.standardize(df, "v", ddof=0).collect())
    assert wide == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])


def test_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 7.0), (4.0, 8.0)], "a double, b double")
    row = dm.correlation_matrix(df, ["a", "b"]).filter("a = 'a' and b = 'b'").head()
    assert row.r == pytest.approx(0.984324, abs=1e-6) and row.n == 3
    # Two-sided t with one degree of freedom: 1 - 2 atan(t) / pi.
    assert row.p == pytest.approx(1 - 2 * math.atan(row.t) / math.pi, rel=1e-9)
    diagonal = dm.correlation_matrix(df, ["a", "b"]).filter("a = b").collect()
    assert [(r.r, r.p, r.stars) for r in diagonal] == [(1.0, 0.0, "***")] * 2


@pytest.mark.parametrize("t, dof, p", [(2.228139, 10, 0.05), (12.7062, 1, 0.05), (1.959964, 1e9, 0.05), (0.0, 7, 1.0)])
def test_p_values(t, dof, p):
    from driftmap.operators.correlation import _upper_tail

    assert _upper_tail(t, dof) == pytest.approx(p, abs=2e-6)


def test_spearman_takes_ranks_among_complete_rows(spark):
    rows = [(1.0, 9.0), (2.0, None), (2.0, 4.0), (2.0, 5.0), (7.0, 1.0), (None, 3.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    row = dm.correlation_matrix(df, ["a", "b"], "spearman").filter("a = 'a' and b = 'b'").head()
    # Ranks 1, 2.5, 2.5, 4 against 4, 2, 3, 1.
    assert row.n == 4 and row.r == pytest.approx(-4.5 / math.sqrt(4.5 * 5.0))


def test_optimal_k(spark):
    ev = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.45, 0.95), (3, 0.05, 1.0)], "k int, ev double, cum_ev double")
    assert one(dm.optimal_k(ev, 0.95)) == 3
    assert one(dm.optimal_k(ev, 0.4)) == 1
    assert one(dm.optimal_k(ev, 2.0)) == 3


def test_keep_relevant_once_or_per_copy(spark):
    pages = spark.createDataFrame([("a",), ("b",)], "url string")
    listed = spark.createDataFrame([("a",), ("a",)], "url string")
    assert dm.keep_relevant(pages, listed).count() == 1
    assert dm.keep_relevant(pages, listed, how="inner").count() == 2


def test_crawl_with_broken_lines(spark, tmp_path):
    week = tmp_path / "2020-09-07"
    week.mkdir()
    (week / "a.json").write_text(
        '{"url": "u", "fetch": {"semanticVector": "[1.0]", "fetchDate": "d", "contentLength": 3, "internalLinks": ["x"]}}\n'
        "{broken\n"
    )
    df = dm.read_crawl(spark, str(tmp_path))
    assert {(r["_corrupt_record"], r["count"]) for r in dm.corrupt_profile(df).collect()} == {(None, 1), ("{broken", 1)}
    row = dm.link_counts(dm.flatten_crawl(df.filter("url is not null"))).head()
    assert (row.week, row.internalLinksCount, row.externalLinksCount) == ("2020-09-07", 1, None)


def test_running_total_and_rank(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("g"), F.xxhash64("id").alias("v"), (F.col("id") % 7).alias("m")
    )
    rows = scale.running_total(df, ["v"], "m", "before", groups=["g"]).collect()
    expected, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r.g, r.v)):
        expected[r.v] = seen.get(r.g, 0)
        seen[r.g] = seen.get(r.g, 0) + r.m
    assert {r.v: r.before for r in rows} == expected
    ranks = scale.global_rank(df, ["v"], "place").orderBy("v").collect()
    assert [r.place for r in ranks] == list(range(1000))
