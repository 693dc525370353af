import random

import pytest
from pyspark.sql import functions as F

from driftmap.llm import toxicity as tx
from driftmap.llm.queries import op5_toxicity

RUDE = ["nincompoop", "blockhead", "dimwit", "scoundrel"]


def texts(n, seed=0):
    rnd = random.Random(seed)
    syllables = "ba ke lo mi nu ra se ti vo wu the and ing er".split()
    out = []
    for i in range(n):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.choice((20, 60, 300)))]
        toxic = i % 5 == 0
        for _ in range(max(2, len(words) // 40) if toxic else 0):
            words[rnd.randrange(len(words))] = rnd.choice(RUDE) + rnd.choice(("", ",", "!"))
        out.append((i, " ".join(words), int(toxic)))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = texts(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(4).cache()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4 != 2], "doc_id bigint, label int")
    return rows, docs, labels


def test_held_out_accuracy(corpus):
    rows, docs, labels = corpus
    got = {r["doc_id"]: r["score"] for r in tx.score(docs, tx.fit(docs, labels), ["doc_id"]).select("doc.doc_id", "score").collect()}
    held = [(y, got[i]) for i, _, y in rows if i % 4 == 2]
    toxic, plain = ([s for y, s in held if y == v] for v in (1, 0))
    assert sum(s >= 0.3 for s in toxic) >= 0.9 * len(toxic)
    assert sum(s >= 0.3 for s in plain) <= 0.02 * len(plain)
    assert all(0 <= s <= 1 for s in got.values())


def test_dictionaries_hold_typical_words(corpus):
    _, docs, labels = corpus
    model = tx.fit(docs, labels)
    assert all(w.encode() in model.toxic and w.encode() not in model.ordinary for w in RUDE)
    assert len(model.toxic) == len(model.ordinary)
    assert tx.fit(docs.repartition(7), labels.repartition(3)) == model


def test_windows_cover_all_words():
    for n in (0, 1, 7, 8, 9, 16, 17, 100):
        words = [b"w%d" % i for i in range(n)]
        made = tx.windows(words)
        assert {w for m in made for w in m.split()} == set(words)
        assert all(len(m.split()) <= tx.WINDOW for m in made)
    assert tx.text_words("It's ÄÖ x" + "y" * 200)[0:2] == [b"it", b"s"]
    assert max(map(len, tx.text_words("y" * 1000))) == tx.WORD_BYTES


def test_awkward_documents(spark, docs, rows, corpus):
    _, known, labels = corpus
    model = tx.fit(known, labels)
    got = tx.score(docs, model).select("doc.*", "score").collect()
    assert len(got) == len(rows)
    assert sorted(got[0].asDict()) == sorted([*docs.columns, "score"])
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert tx.score(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("keep", ["label = 1", "label = 0", "label IS NULL"])
def test_one_label_or_none(corpus, keep):
    _, docs, labels = corpus
    model = tx.fit(docs, labels.filter(keep))
    scores = {round(r["score"], 6) for r in tx.score(docs, model, ["doc_id"]).collect()}
    assert len(scores) == 1 and scores.pop() == {"label = 1": 1.0, "label = 0": 0.0, "label IS NULL": 0.0}[keep]


def test_sample_is_bounded(corpus):
    _, docs, labels = corpus
    few = tx.fit(docs, labels, sample_rows=200)
    assert few.toxic and few != tx.fit(docs, labels)


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = op5_toxicity(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = got.join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert sum(r["predicted"] == r["toxic"] for r in known) >= 0.85 * len(known)
    assert got.filter(F.col("score").isNull() | F.col("held_out").isNull()).count() == 0


def test_parts_of_words_and_strings_over_words(spark):
    rnd = random.Random(5)
    syllables = "ba ke lo mi nu ra se ti vo wu".split()
    rows = []
    for i in range(1200):
        words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 4))) for _ in range(60)]
        words += ["oh", "my", "so", "bad"]  # ordinary alone
        rnd.shuffle(words)
        toxic = i % 4 == 0
        if toxic:
            at = rnd.randrange(len(words))
            stem = "grimfolk" + "".join(rnd.choice(syllables) for _ in range(3))
            words[at:at] = ["oh", "my", "so", "bad"] if i % 8 else [stem, *words[:2], stem + "ra"]
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3], "doc_id bigint, label int")
    got = {r["doc_id"]: r["score"] for r in tx.score(docs, tx.fit(docs, labels), ["doc_id"]).select("doc.doc_id", "score").collect()}
    held = [i for i, _, _ in rows if i % 3 == 0]
    for chosen in ([i for i in held if i % 8 == 0], [i for i in held if i % 8 == 4]):
        assert sum(got[i] >= 0.3 for i in chosen) >= 0.9 * len(chosen)
    plain = [i for i in held if i % 4]
    assert sum(got[i] >= 0.3 for i in plain) <= 0.1 * len(plain)


def test_recall_per_language(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    known = op5_toxicity(spark, sf_dir).join(labels, "doc_id").join(langs, "doc_id").filter("held_out")
    share = known.groupBy("lang", "toxic").agg(F.avg("predicted").alias("share")).collect()
    found = {(r["lang"], r["toxic"]): r["share"] for r in share}
    assert all(found[lang, 1] >= 0.6 and found[lang, 0] <= 0.1 for lang in ("en", "fr", "de", "es"))
