"""Drift week by week against the drift of the whole history."""

import random

import pytest

import driftmap as dm
from driftmap.operators import scale

SCHEMA = (
    "url string, semanticVector string, fetchDate string, contentLength bigint, internalLinks array<string>, "
    "externalLinks array<string>"
)
WEEKS = ["2020-09-07", "2020-09-14", "2020-09-21", "2020-09-28"]


def weekly_rows():
    rnd = random.Random(3)
    weeks = []
    for week in WEEKS:
        rows = []
        for page in range(40):
            for visit in range(rnd.choice([0, 1, 1, 1, 3])):
                vector = rnd.choice(["not set", None, "[0.5, 1.0, -2.0]", f"[{rnd.random()}, {rnd.random()}, 1.0]"])
                day = f"{week[:8]}{int(week[8:]) + visit // 2:02d}"  # two snapshots of one date may occur
                rows.append((f"p{page}", vector, day, rnd.choice([None, 5, 900]), ["a"] * rnd.randrange(4), None))
        weeks.append([*rows, (None, "[1.0, 2.0, 3.0]", week, 1, [], [])])
    return weeks


def listed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [False, True])
def test_weeks_equal_the_whole(spark, tmp_path, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(scale, "HOT_ROWS", 4)
    path, weeks = str(tmp_path / "history"), weekly_rows()
    urls = spark.createDataFrame([(f"p{i}",) for i in range(35)], "url string")
    parts = []
    for name, rows in zip(WEEKS, weeks):
        parts += listed(dm.add_week(spark.createDataFrame(rows, SCHEMA), path, name, urls, buckets=3))
    whole = dm.semantic_drift(spark.createDataFrame([r for w in weeks for r in w], SCHEMA), urls)
    assert sorted(parts, key=repr) == listed(whole) == listed(dm.drift_so_far(spark, path)) and len(parts) > 25
    last = {r.url: r.fetchDate for r in dm.last_snapshots(spark, path).collect()}
    assert last == {u: max(r[2] for w in weeks for r in w if r[0] == u) for u in last} and len(last) == 35
    assert len([p for p in (tmp_path / "history").iterdir() if p.name.startswith("last-")]) == 2


def test_history_is_not_shuffled(spark, tmp_path):
    path, weeks = str(tmp_path / "history"), weekly_rows()
    dm.add_week(spark.createDataFrame(weeks[0], SCHEMA), path, WEEKS[0], buckets=4)
    from driftmap.plans.history import _bucketed, _to_buckets

    last = dm.last_snapshots(spark, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in last.schema)
    folder = next(p for p in (tmp_path / "history").iterdir() if p.name.startswith("last-"))
    kept = _bucketed(spark, str(folder), schema, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = spark.createDataFrame([("p1", 1)], "url string, k int")
        plan = kept.join(_to_buckets(new, 4), "url", "full")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan


def test_refused_and_repeated_weeks(spark, tmp_path):
    path, weeks = str(tmp_path / "history"), weekly_rows()
    first = spark.createDataFrame(weeks[0], SCHEMA)
    assert dm.drift_so_far(spark, path) is None and dm.last_snapshots(spark, path) is None
    dm.add_week(first, path, WEEKS[0], buckets=2)
    before = listed(dm.last_snapshots(spark, path))
    for rows, name in ((weeks[0], WEEKS[0]), (weeks[0], WEEKS[1]), (weeks[1], "a/b")):
        with pytest.raises(ValueError):
            dm.add_week(spark.createDataFrame(rows, SCHEMA), path, name)
    assert listed(dm.last_snapshots(spark, path)) == before
    # A week whose state was never committed does not count, and can be run again.
    (tmp_path / "history" / f"last-00000002-2-{WEEKS[1]}").mkdir()
    expected = listed(dm.drift_so_far(spark, path))
    assert listed(dm.last_snapshots(spark, path)) == before
    again = listed(dm.add_week(spark.createDataFrame(weeks[1], SCHEMA), path, WEEKS[1]))
    assert listed(dm.drift_so_far(spark, path)) == sorted([*expected, *again], key=repr)
    empty = dm.add_week(spark.createDataFrame([], SCHEMA), path, WEEKS[2])
    assert empty.count() == 0 and dm.last_snapshots(spark, path).count() > 0
