"""The topic model against a plain numpy expectation maximisation with the same start."""

import numpy as np
import pytest

import driftmap as dm
from driftmap.operators import scale, topics
from driftmap.operators.topics import term_shares, topic_tables

SCHEMA = "id long, tokens array<string>"


def texts(n: int = 50) -> list[tuple]:
    draw = np.random.default_rng(3)
    kinds = [[f"{kind}{i}" for i in range(12)] for kind in "abc"]
    rows = [(i, [str(w) for w in draw.choice(kinds[i % 3], 15)] + ["every"]) for i in range(n)]
    return rows + [(n, []), (n + 1, None), (None, ["a1", "b1"]), (n + 2, ["a1", None])]


def brute(start, k: int, passes: int, doc_weight: float, term_weight: float):
    ids = sorted({r["id"] for r in start})
    terms = sorted({r["term"] for r in start})
    i = np.array([ids.index(r["id"]) for r in start])
    t = np.array([terms.index(r["term"]) for r in start])
    n = np.array([r["n"] for r in start], float)[:, None]
    share = np.array([r["share"] for r in start])

    def sums():
        of_doc, of_term = np.zeros((len(ids), k)), np.zeros((len(terms), k))
        np.add.at(of_doc, i, n * share)
        np.add.at(of_term, t, n * share)
        return of_doc, of_term

    for _ in range(passes):
        of_doc, of_term = sums()
        share = (of_term[t] + term_weight) * (of_doc[i] + doc_weight) / (of_term.sum(0) + len(terms) * term_weight)
        share /= share.sum(1, keepdims=True)
    of_doc, of_term = sums()
    return dict(zip(ids, of_doc)), dict(zip(terms, of_term / of_term.sum(0)))


@pytest.mark.parametrize("hot_rows", [None, 20])
def test_equals_numpy(spark, monkeypatch, hot_rows):
    if hot_rows:
        monkeypatch.setattr(scale, "HOT_ROWS", hot_rows)  # the word in every text is then a hot term
    df = spark.createDataFrame(texts(), SCHEMA).repartition(3)
    of_doc, of_term = brute(term_shares(df, 3).collect(), 3, 6, 0.5, 0.1)
    top, assigned = topic_tables(df, 3, n_terms=99, max_iter=6, doc_weight=0.5)
    got = {(r.topic, r.term): r.weight for r in top.collect()}
    assert got == {(j, w): pytest.approx(v[j], rel=1e-9) for w, v in of_term.items() for j in range(3)}
    rows = {r.id: r.prediction for r in assigned.collect()}
    assert len(rows) == 54 and rows[50] is rows[51] is rows[None] is None
    assert all(of_doc[i][rows[i]] == pytest.approx(max(of_doc[i])) for i in of_doc)


def test_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(texts(20), SCHEMA)
    one, many = (dm.topic_tables(d, 2, max_iter=2)[1].collect() for d in (df.repartition(1), df.repartition(7)))
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_no_tokens(spark):
    top, assigned = dm.topic_tables(spark.createDataFrame([(1, []), (2, None)], SCHEMA), 2, max_iter=1)
    assert top.count() == 0 and [r.prediction for r in assigned.collect()] == [None, None]
    assert dm.topic_tables(spark.createDataFrame([], SCHEMA), 2, max_iter=1)[1].count() == 0


def test_passes_broadcast_nothing_that_grows(spark, monkeypatch):
    plans, real = [], topics.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan())
        return real(df)

    monkeypatch.setattr(topics, "cut", seen)
    df = spark.createDataFrame(texts(20), SCHEMA)
    assigned = dm.topic_tables(df, 2, max_iter=1)[1]
    hints = [str(p.toString()).count("strategy=merge") for p in (plans[-1], assigned._jdf.queryExecution().optimizedPlan())]
    assert hints == [2, 1]
