"""Near-duplicate vectors: links, components and recall against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from driftmap.llm import embedding_dedup
from driftmap.llm.embedding_dedup import near_vectors

SCHEMA = "id bigint, vector array<float>, label int, cell string, n int, component int, dim string, part int, low int"


def brute(rows, threshold):
    """``(id, n_links, component_id, kept)`` for rows ``id, vector, label``, in any order."""
    usable = [
        i
        for i, (_, v, label) in enumerate(rows)
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    vectors = {i: np.array(np.array(rows[i][1], np.float32), float) for i in usable}
    parent, links = list(range(len(rows))), Counter()

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, i in enumerate(usable):
        for j in usable[:k]:
            a, b = vectors[i], vectors[j]
            if rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(root(i), []).append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in low.items()}
    return [(r[0], links[i], low[root(i)], r[0] == low[root(i)]) for i, r in enumerate(rows)]


def groups(seed, dim, spreads, each, singles):
    rnd = np.random.default_rng(seed)
    unit = lambda v: v / np.linalg.norm(v)
    out = [unit(rnd.normal(size=dim)) for _ in range(singles)]
    for spread in spreads:
        middle = unit(rnd.normal(size=dim))
        out += [unit(middle + spread * unit(rnd.normal(size=dim))) * rnd.uniform(0.2, 9) for _ in range(each)]
    return [v.astype(np.float32).tolist() for v in out]


def awkward():
    vectors = groups(3, 16, [0.02, 0.1, 0.2, 0.25, 0.3, 0.4], 25, 60)
    rnd = random.Random(1)
    rows = [(i, v, rnd.choice([1, 1, 2])) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[70], 1) for i in range(30)]  # exact copies
    rows += [(5, vectors[80], 1), (5, vectors[5], 1), (None, vectors[81], 1), (None, vectors[81], 1), (None, [1.0] * 16, 9)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1), (2004, vectors[70], None)]
    rows += [(2005, [None] * 16, 1), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1), (2008, [1.0] * 20, 1), (2008, [1.0] * 20, 1)]
    rows += [(2009, [float("inf")] * 16, 1), (2010, [-0.0] * 15 + [1.0], 3), (2011, [0.0] * 15 + [1.0], 3)]
    return rows


def run(spark, rows, threshold=0.93):
    df = spark.createDataFrame([(*r, "c", 1, 2, "d", 3, 4) for r in rows], SCHEMA).repartition(4)
    return [tuple(r) for r in near_vectors(df, threshold).select("id", "n_links", "component_id", "kept").collect()]


def same(found, want):
    want = [(i, n, c, i == c) for i, n, c, _ in want]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_equals_all_pairs_on_awkward_rows(spark):
    rows = awkward()
    want = brute(rows, 0.93)
    assert sum(w[1] for w in want) > 1500
    same(run(spark, rows), want)


def test_blocks_of_long_lists_and_of_opened_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "_BLOCK", 5)
    rows = [(i, v, 1) for i, v in enumerate(groups(4, 6, [0.05, 0.15, 0.3, 0.6], 30, 20))]
    same(run(spark, rows), brute(rows, 0.93))


def test_a_group_of_near_copies_makes_no_pairs(spark, monkeypatch):
    vectors = groups(5, 32, [0.1], 400, 200)
    rows = [(i, v, 1) for i, v in enumerate(vectors)]
    counts = []
    real = embedding_dedup._candidates
    monkeypatch.setattr(embedding_dedup, "_candidates", lambda *a: counts.append((df := real(*a)).count()) or df)
    found = run(spark, rows)
    assert sorted(found) == sorted(brute(rows, 0.93))
    assert sum(f[1] for f in found) == 400 * 399 and counts[0] < 2_000


def test_recall_near_the_threshold(spark):
    """Every vector has a partner at a cosine of 0.93 to 0.95, the hardest to find, among 3000 others."""
    rnd = np.random.default_rng(6)
    base = rnd.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rnd.normal(size=base.shape)
    off -= (off * base).sum(1, keepdims=True) * base
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rnd.uniform(0.9301, 0.95, (1500, 1))
    both = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * off])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(both)]
    found = {r[0]: r for r in run(spark, rows)}
    linked = sum(found[i][1] >= 1 and found[i + 1500][2] == found[i][2] for i in range(1500))
    assert linked >= 0.98 * 1500
    assert sum(r[1] for r in found.values()) <= 3000


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 1)], [(1, None, None)], [(3, [1.0], 1), (2, [2.0], 1), (4, [-1.0], 1)]])
def test_tiny_tables(spark, rows):
    same(run(spark, rows), brute(rows, 0.93))
