"""Each stage of the pipeline against brute force on its own input, and the whole against its stages."""

import re
from collections import Counter

import corpus_pipeline as cp
from corpus_texts import edited, words
from test_dedup import brute_groups, brute_hits

from driftmap.llm.queries import THRESHOLD, toxic_labels
from driftmap.llm.toxicity import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df):
    return Counter(map(tuple, df.select(COLUMNS).collect()))


def test_stages_are_five_in_order():
    assert [f.__name__ for _, f in cp.STAGES] == ["not_toxic", "one_of_each", "not_contaminated", "mixed", "sharded"]


def test_toxic_documents_go(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit(docs, toxic_labels(spark, sf_dir))
    good = {r["doc_id"] for r in score(docs, model, ["doc_id"]).filter(f"score < {THRESHOLD}").select("doc.doc_id").collect()}
    got = cp.not_toxic(spark, docs, sf_dir)
    assert got.columns == COLUMNS
    assert rows_of(got) == Counter(tuple(r) for r in docs.select(COLUMNS).collect() if r["doc_id"] in good)


def test_one_of_each_group_stays(spark, sf_dir):
    docs = documents(spark, sf_dir).union(documents(spark, sf_dir).limit(7))  # repeated rows
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = {r[0] for r in brute_groups(rows, 5, 80) if r[3]}
    got = cp.one_of_each(spark, docs, sf_dir)
    assert got.columns == COLUMNS
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(kept)


def test_contaminated_documents_go(spark, sf_dir):
    docs = documents(spark, sf_dir)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {r[0] for r in brute_hits([tuple(r) for r in docs.select("doc_id", "text").collect()], items) if r[2]}
    assert hit
    got = cp.not_contaminated(spark, docs, sf_dir)
    assert rows_of(got) == Counter(tuple(r) for r in docs.select(COLUMNS).collect() if r["doc_id"] not in hit)


def test_mix_takes_one_and_a_half_times_the_words(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = cp.mixed(spark, docs, sf_dir)
    assert got.columns == COLUMNS
    words = lambda df: [len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in df.collect()]
    before, after = words(docs), words(got)
    assert abs(sum(after) - 1.5 * sum(before)) <= 20 * max(before)
    assert max(rows_of(got).values()) <= 2 and set(rows_of(got)) <= set(rows_of(docs))


def test_run(spark, sf_dir):
    got = cp.run(spark, sf_dir)
    assert got.columns == [*COLUMNS, "shard", "slot"]
    rows = got.collect()
    assert rows and {r["shard"] for r in rows} == set(range(40))
    by_shard = Counter(r["shard"] for r in rows)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_awkward_rows_pass_every_stage(spark, docs, sf_dir):
    for _, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        assert set(docs.columns) <= set(out.columns)
        assert out.count() > 0
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_one_copy_stays_without_ids_and_under_one_id(spark):
    base = words(900, 200)
    copies = [edited(base, i, 1) for i in range(3)]
    schema = "doc_id bigint, text string"
    for ids in ([None] * 3, [7] * 3, [None, 7, 7], [9, 8, None]):
        rows = [*zip(ids, copies), (ids[0], copies[0]), (None, words(901, 90)), (7, words(902, 90)), (None, ""), (7, None)]
        got = [tuple(r) for r in cp.one_of_each(spark, spark.createDataFrame(rows, schema), "").collect()]
        near = [r for r in got if r[1] in copies]
        assert len(near) == 1 and len(got) == 5
        known = [i for i in ids if i is not None]
        assert near[0][0] == (min(known) if known else None)
