"""Bisecting k-means for all numbers of clusters at once."""

import numpy as np
import pytest

import driftmap as dm
from driftmap.functions.vectors import to_features
from driftmap.operators import splits
from driftmap.operators.cluster import silhouette_score

KS = (2, 3, 5, 12, 40)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(6, 5)) * 3
    rows = np.concatenate([m + rng.normal(size=(20 + 5 * i, 5)) * 0.4 for i, m in enumerate(middles)])
    return np.concatenate([rows, np.repeat(rows[:1], 25, 0)])


@pytest.fixture(scope="module")
def df(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9999, None)]
    return spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3).cache()


def labels(df, tree, ks):
    found = {}
    for r in dm.label_splits(df, tree, ks).collect():
        found.setdefault(r.k, {})[r.id] = r.prediction
    return found


def test_every_cut_equals_its_own_fit(df):
    all_cuts = labels(df, dm.fit_splits(df, max(KS)), KS)
    for k in (2, 5, 12):
        assert labels(df, dm.fit_splits(df, k), [k])[k] == all_cuts[k]
    for coarse, fine in zip(KS, KS[1:]):
        pairs = {(all_cuts[fine][i], all_cuts[coarse][i]) for i in all_cuts[fine]}
        assert len(pairs) == fine and len({p[1] for p in pairs}) == coarse


def test_largest_clusters_are_split_first(df, vectors):
    tree = dm.fit_splits(df, 12)
    sizes = {p: tree.size[n] for n, p in enumerate(tree.path)}
    order = sorted(tree.parts, key=tree.rank)[:11]
    found = labels(df, tree, [12])[12]
    assert sorted(np.bincount(list(found.values()))) == sorted(tree.size[n] for n in tree.leaves(12))
    assert min(tree.size[n] for n in order) >= max(tree.size[n] for n in tree.leaves(12) if n not in tree.whole and tree.start[n] is not None)
    assert sizes[""] == len(vectors) and all(sizes[p] == sizes[p + "0"] + sizes[p + "1"] for p in sizes if p + "0" in sizes)
    # The groups that the rows were made of come apart first.
    six = labels(df, dm.fit_splits(df, 12), [7])[7]
    made = np.repeat(np.arange(6), [20 + 5 * i for i in range(6)])
    assert all(len({made[i] for i in range(len(made)) if six[i] == c}) == 1 for c in set(six.values()))


def test_scores_equal_those_of_labelled_rows(spark, df):
    tree = dm.fit_splits(df, max(KS))
    found = {r.k: (r.k_actual, r.silhouette) for r in dm.sweep_splits(df, KS).collect()}
    assert list(found) == list(KS)
    labelled = dm.label_splits(df, tree, KS).join(df, "id")
    for k in (2, 5, 40):
        features = to_features(labelled.filter(f"k = {k}").select("embedding", "prediction"), "embedding")
        assert found[k][0] == k and found[k][1] == pytest.approx(silhouette_score(features), abs=1e-9)


def test_few_equal_and_no_rows(spark):
    schema = "id long, embedding array<double>"
    same = spark.createDataFrame([(i, [0.1, 0.7]) for i in range(9)] + [(20, [1.0, 0.0])], schema)
    assert [(r.k, r.k_actual) for r in dm.sweep_splits(same, [1, 2, 50]).collect()] == [(1, 1), (2, 2), (50, 2)]
    one = dm.sweep_splits(same.filter("id = 20"), [2]).head()
    assert (one.k_actual, one.silhouette) == (1, None)
    none = dm.sweep_splits(spark.createDataFrame([], schema), [2]).head()
    assert (none.k_actual, none.silhouette) == (0, None) and dm.fit_splits(spark.createDataFrame([(1, None)], schema), 3) is None


def test_small_clusters_are_split_in_one_task_without_more_passes(df, vectors, monkeypatch):
    passes = []
    real = splits._sums
    monkeypatch.setattr(splits, "_sums", lambda *a: passes.append(1) or real(*a))
    small = labels(df, dm.fit_splits(df, max(KS)), KS)
    assert len(passes) == 1  # the size and mean of all rows
    # A limit of so few rows lets some levels take passes, and with none all do.
    monkeypatch.setattr(splits, "_AT_ONCE", 60 * vectors.shape[1])
    assert labels(df, dm.fit_splits(df, max(KS)), KS) == small
    monkeypatch.setattr(splits, "_AT_ONCE", 0)
    assert labels(df, dm.fit_splits(df, max(KS)), KS) == small
    assert len(passes) > 20
