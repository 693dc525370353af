import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from driftmap.llm.mixing import mix, plan_mix, split_tree
from driftmap.llm.queries import op1_mix_sources, op6_interleave
from driftmap.llm.sharding import interleave, text_bytes, text_crc32

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    """Share by weight, cut at the cap, share what was cut again, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        total = sum(weight[s] for s in rest)
        out = {s: cap * sizes[s] for s in full} | {s: left * weight[s] / total for s in rest}
        over = {s for s in rest if out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets_and_taken(docs, rows):
    sizes, longest = Counter(), Counter()
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        longest[r[3]] = max(longest[r[3]], n)
    want = targets(sizes)
    plan = plan_mix(docs).select("doc.*", F.col("size").alias("words"), "source_size", "target", "draws").collect()
    assert len(plan) == len(rows)
    taken = Counter()
    for r in plan:
        assert r["words"] == len(WORD.findall(r["text"] or ""))
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert len(r["draws"]) <= 2 and len({d["copy"] for d in r["draws"]}) == len(r["draws"])
        taken[r["source"]] += r["words"] * len(r["draws"])
    for s, target in want.items():
        assert abs(taken[s] - target) <= longest[s] / 2 + 1e-6


def test_reruns_and_partitions_agree(docs):
    runs = [sorted(plan_mix(d, ["doc_id"]).select("doc.doc_id", "size", F.size("draws")).collect(), key=str) for d in (docs, docs.repartition(3), docs)]
    assert runs[0] == runs[1] == runs[2]


def test_mix_rows_are_the_plan_and_shards_hold_the_mixture(docs):
    plan = Counter()
    for r in plan_mix(docs, shards=4).select("doc.doc_id", "doc.text", F.size("draws").alias("n")).collect():
        plan[r["doc_id"], r["text"]] += r["n"]
    got = mix(docs, shards=4).select("shard", "doc.*").drop("shard").select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == +plan
    assert set(mix(docs, shards=4).columns) == {"shard", "copy", "doc"}


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_tree_splits_quotas_exactly(spark, shards):
    quotas = {"a": 500, "b": 1, "n": 0, "c": 77}
    table = spark.createDataFrame(list(quotas.items()), "label string, blocks bigint")
    split = split_tree(table, shards, "seed").collect()
    by_source, by_shard = Counter(), Counter()
    for r in split:
        assert r["blocks"] >= 0
        by_source[r["label"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
    assert {k: v for k, v in quotas.items() if v} == dict(+by_source)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == shards
    a = [r["blocks"] for r in split if r["label"] == "a"]
    mean = 500 / shards
    assert all(abs(x - mean) < 6 * mean**0.5 for x in a)


def brute_shards(rows, shards):
    import hashlib

    def key(r):
        parts = ["-" if v is None else f"={v}" for v in (r[0], r[1])]
        return hashlib.md5(":".join(["shards", *parts]).encode()).hexdigest()

    by_source = defaultdict(list)
    for r in rows:
        by_source["n" if r[3] is None else "s" + r[3]].append((key(r), r))
    placed = []
    for label, members in by_source.items():
        members.sort(key=lambda m: m[0])
        placed += [((2 * i + 1) / (2 * len(members)), label, k, r) for i, (k, r) in enumerate(members)]
    placed.sort(key=lambda p: p[:3])
    n, out = len(rows), []
    for at, (_, _, _, r) in enumerate(placed):
        shard = at * shards // n
        out.append((r[0], r[1], shard, at - -(-shard * n // shards)))
    return Counter(out)


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_interleave_is_brute_force(docs, rows, shards):
    got = interleave(docs, shards).select("doc.doc_id", "doc.text", F.col("shard").alias("s"), "slot").collect()
    assert Counter(map(tuple, got)) == brute_shards(rows, shards)


def test_interleave_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs}
    source = {r["doc_id"]: r["source"] for r in docs}
    got = op6_interleave(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    slots, mixture = defaultdict(list), defaultdict(Counter)
    for r in got:
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
        slots[r["shard"]].append(r["slot"])
        mixture[r["shard"]][source[r["doc_id"]]] += 1
    assert set(slots) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    share = Counter(source.values())
    for counts in mixture.values():
        assert all(abs(counts[s] - n / 40) < 2 for s, n in share.items())


def test_columns_are_computed_before_the_shuffle(docs, rows):
    got = interleave(docs, 4, carry=["doc_id"], bytes=text_bytes(F.col("text")), crc=text_crc32(F.col("text")))
    assert Counter((r["bytes"], r["crc"]) for r in got.collect()) == Counter(
        (len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())) for r in rows
    )


def test_empty(no_docs):
    assert plan_mix(no_docs).count() == 0
    assert mix(no_docs).count() == 0
    assert interleave(no_docs).count() == 0


def test_mix_query_meets_targets(spark, sf_dir):
    got = op1_mix_sources(spark, sf_dir).collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum({(r["source_size"], r["target"]): r["target"] for r in got}.values()) > 0


def test_tree_is_a_random_cut_of_the_blocks(spark):
    # Over seeds, how many of 30 blocks of "a" among 90 go to the first of two shards has the hypergeometric moments.
    table = spark.createDataFrame([("a", 30), ("b", 60)], "label string, blocks bigint")
    left = []
    for seed in range(12):
        split = {(r["shard"], r["label"]): r["blocks"] for r in split_tree(table, 2, f"s{seed}").collect()}
        assert split[0, "a"] + split[0, "b"] == 45
        left.append(split[0, "a"])
    assert len(set(left)) > 1 and abs(sum(left) / 12 - 15) < 4 * 2.25 / 12**0.5


def test_mix_uses_tasks_by_size(docs):
    few, many = (mix(docs, shards=2, task_bytes=n) for n in (1 << 30, 4096))
    assert many.rdd.getNumPartitions() > 20
    placed = lambda df: Counter(map(tuple, df.select("shard", "copy", "doc.doc_id").collect()))
    assert placed(few) == placed(many)


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_plans_do_not_grow_with_the_tree(spark, docs):
    table = spark.createDataFrame([("a", 40), ("b", 25)], "label string, blocks bigint")
    assert exchanges(split_tree(table, 64, "seed")) == exchanges(split_tree(table, 2, "seed"))
    assert exchanges(plan_mix(docs, shards=64)) == exchanges(plan_mix(docs, shards=2)) <= 6
