import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus_texts import ITEM, PASSAGE, edited, words
from pyspark.sql import functions as F

from driftmap.llm import near_dedup as nd
from driftmap.llm import suffix_dedup as sd
from driftmap.llm.decontaminate import contamination, winnow
from driftmap.llm.near_dedup import near_duplicates
from driftmap.llm.suffix_dedup import remove_repeats, repeated_starts, sorted_suffixes

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BOTH = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def shingles(text, size):
    w = (text or "").encode().translate(LOWER).split()
    n = min(size, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset()


def brute_groups(rows, size, percent):
    """``(doc_id, n_shingles, component_id, kept)`` by comparing all pairs."""
    sets = [shingles(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        component = min(least[find(i)], default=None) if sets[i] else r[0]
        out.append((r[0], len(sets[i]), component, r[0] == component))
    return Counter(out)


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_are_all_pairs(docs, rows, size):
    got = near_duplicates(docs, size).drop("text_hash").collect()
    assert Counter(map(tuple, got)) == brute_groups(rows, size, 80)


def test_chains_of_near_copies(spark):
    """Each text is a near copy of the one before only; one edit chain per seed, and a bucket of strangers."""
    rows = []
    for seed in range(3):
        text = words(seed, 150)
        for i in range(30):
            rows.append((1000 * seed + i, text))
            text = edited(text, 1000 * seed + i, 2)
    random.Random(1).shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert Counter(map(tuple, near_duplicates(table, 4).drop("text_hash").collect())) == brute_groups(rows, 4, 80)


def test_hub_whose_copies_are_not_alike(spark):
    """Copies are near the first text and mostly not near each other; the hub's class is not the smallest."""
    hub = words(77, 200)
    rows = [(500, hub)] + [(i, edited(hub, i, 5)) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert Counter(map(tuple, near_duplicates(table, 4).drop("text_hash").collect())) == brute_groups(rows, 4, 80)


def test_blocks_of_a_bucket_meet(spark, monkeypatch):
    monkeypatch.setattr(nd, "_BLOCK", 4)
    hub = words(78, 200)
    rows = [(i, edited(hub, i, 8)) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert Counter(map(tuple, near_duplicates(table, 4).drop("text_hash").collect())) == brute_groups(rows, 4, 80)


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8, 0.95):
        found = []
        for _ in range(40):
            both = rng.integers(0, 2**64, int(1000 * share), np.uint64)
            sides = [np.concatenate([both, rng.integers(0, 2**64, (1000 - len(both)) // 2, np.uint64)]) for _ in "ab"]
            a, b = (nd.signature(nd.minima(np.unique(s))).view(np.uint64) for s in sides)
            x = a ^ b
            agree = int(np.bitwise_count(~(x | (x >> np.uint64(1))) & np.uint64(nd._LOW)).sum())
            found.append(nd.estimated_similarity(agree))
        assert abs(np.mean(found) - share) < 0.04
    assert nd.estimated_similarity(nd.least_agreement(80)) < 0.65


def test_no_documents(no_docs, docs):
    assert near_duplicates(no_docs).count() == 0
    assert remove_repeats(no_docs).count() == 0
    items = docs.sparkSession.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    assert contamination(no_docs, items).count() == 0
    assert {tuple(r)[3] for r in contamination(docs, items.limit(0)).collect()} == {0}


ITEMS = [
    (1, ITEM),
    (2, ITEM.upper() + "!"),
    (2, ITEM),
    (3, "short item words"),
    (4, None),
    (5, "..."),
    (None, PASSAGE),
    (10, PASSAGE + " and more"),
    (11, "one"),
    (12, "-"),
    (13, " ".join(["ab"] * 30)),
]


def brute_hits(rows, items):
    out = Counter()
    split = lambda t: (t or "").encode().translate(BOTH).split()
    windows = []
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        if n:
            windows.append((i, n, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}))
    for r in rows:
        w, hit, found = split(r[1]), set(), set()
        for i, n, grams in windows:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    if i is not None:
                        found.add(str(i))
        out[r[0], len(w), len(hit), tuple(sorted(found))] += 1
    return out


@pytest.mark.parametrize("window,gram", [(10, 5)])
def test_contamination_is_brute_force(spark, docs, rows, window, gram):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = contamination(docs, items, window, gram).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got) == brute_hits(rows, ITEMS)


def test_winnowing_keeps_a_gram_of_every_window():
    rng = np.random.default_rng(3)
    for n in (1, 5, 6, 7, 200):
        grams = rng.integers(0, 50, n).astype(np.uint64)
        kept = winnow(grams, 6)
        for i in range(max(1, n - 5)):
            part = grams[i : i + 6]
            assert all(kept[i : i + 6][part == part.min()])
        assert kept.sum() < n or n <= 7


def brute_repeats(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = Counter()
    for r, d in zip(rows, data):
        kept, at, spans, end = [], 0, 0, -1
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                if k > end:
                    kept.append(d[at:k])
                    spans += 1
                end = at = k + length
        rest = b"".join([*kept, d[at:]])
        out[r[0], len(d), len(d) - len(rest), spans, hashlib.sha256(rest).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length", [40, 200])
def test_repeats_are_brute_force(docs, rows, length):
    got = remove_repeats(docs, length, carry_text=True).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute_repeats(rows, length)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


@pytest.mark.parametrize("name", [None, 7])
def test_repeats_without_ids_and_under_one_id(spark, rows, name, monkeypatch):
    monkeypatch.setattr(sd, "HOT_ROWS", 3)  # rows that repeat as wholes stay where they are
    monkeypatch.setattr(sd, "HOT_GROUPS", 50)
    texts = [r[1] for r in rows] + ["the same row " * 30] * 20
    table = spark.createDataFrame([(name, t) for t in texts], "doc_id bigint, text string").repartition(5)
    want = brute_repeats([(name, t) for t in texts], 200)
    assert Counter(map(tuple, remove_repeats(table).collect())) == want


def test_repeats_in_small_alphabets(spark):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("ab") * rnd.choice((1, 1, 2, 60)) for _ in range(60))) for i in range(60)]
    rows += [(100 + i, rows[i][1][20:-10] + "tail") for i in range(10)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for length in (32, 64):
        assert Counter(map(tuple, remove_repeats(table, length).collect())) == brute_repeats(rows, length)


@pytest.mark.parametrize("letters,n", [(2, 400), (4, 3000), (1, 300), (256, 3000)])
def test_two_stage_sorting_is_sorting(letters, n):
    rng = np.random.default_rng(letters)
    text = rng.integers(0, letters, n).astype(np.uint8).tobytes() + bytes(range(1, 65))
    wanted = np.zeros(len(text), bool)
    wanted[np.flatnonzero(rng.random(n) < 0.7)] = True
    order = sorted_suffixes(text, wanted, 64)
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    keys = [text[p : p + 64] for p in order.tolist()]
    padded = text + bytes(64)
    keys = [padded[p : p + 64] for p in order.tolist()]
    assert keys == sorted(keys)


def test_repeated_windows_of_runs():
    rnd = random.Random(2)
    pool = [bytes(rnd.choice(b"abc") for _ in range(90)) for _ in range(6)]
    runs = [rnd.choice(pool) + rnd.choice(pool) for _ in range(25)]
    counts = [len(r) - 40 + 1 for r in runs]
    seen = Counter(r[k : k + 40] for r, c in zip(runs, counts) for k in range(c))
    want = [seen[r[k : k + 40]] > 1 for r, c in zip(runs, counts) for k in range(c)]
    assert repeated_starts(runs, counts, 40).tolist() == want


def test_owners_are_the_same_for_equal_windows():
    rnd = random.Random(9)
    shared = bytes(rnd.choice(b"abcdefgh ") for _ in range(700))
    owner_of = []
    for side in (b"x" * 37, b"yz" * 111):
        data = side + shared + side
        starts, counts, owners = sd.owned_runs(data)
        per_window = np.repeat(owners, counts)
        assert len(per_window) == len(data) - 199
        owner_of.append(per_window[len(side) : len(side) + 501])
    assert (owner_of[0] == owner_of[1]).all()


@pytest.mark.parametrize("length", [40, 200])
def test_crowded_owners_are_counted(spark, docs, rows, length, monkeypatch):
    monkeypatch.setattr(sd, "CROWDED", 2, raising=False)
    largest, was = [], sd._sorted

    def watched(contexts, length):
        pairs = contexts.groupBy("owner", "second").count()
        largest.append(pairs.agg(F.max("count")).first()[0] or 0)
        return was(contexts, length)

    monkeypatch.setattr(sd, "_sorted", watched)
    rnd = random.Random(6)
    more = [(200 + i, f"{rnd.random()} {rnd.random()} " * 8 + PASSAGE[:150] + f" {rnd.random()}" * 16) for i in range(40)]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    got = Counter(map(tuple, remove_repeats(table, length).collect()))
    assert got == brute_repeats([*rows, *more], length)
    assert largest[-1] <= 2


def test_near_duplicates_counts_written_tables_only(spark, docs, monkeypatch):
    kind, shuffles = type(docs), []
    count = kind.count

    def counted(self):
        shuffles.append(self._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return count(self)

    monkeypatch.setattr(kind, "count", counted)
    rows = near_duplicates(docs, 4, 80)
    assert shuffles and max(shuffles) == 0
    monkeypatch.undo()
    assert rows.count() == docs.count()
