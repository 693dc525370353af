import heapq
import math
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftmap.llm import token_files as tf
from driftmap.llm.topk import scaled, top_k

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_pieces_give_the_librarys_ids(tokenizer, rows):
    encoder = tf.PieceEncoder(PATH)
    assert encoder.by_piece
    odd = ["", " ", "\n\n  x", "I'M don't 'S we'LL", "a\x1c\x1db", "x\x85y\xa0\xa0z", "ǅabc ĳ 12½ ²³", "<|endoftext|>", "日本 x"]
    for text in odd + [r[1] or "" for r in rows]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == want


def test_encoders_outlive_the_tasks_that_bring_the_code(tmp_path):
    # As on a worker, the package is not there: the function comes pickled with each task, globals included.
    brought = "import pickle, sys; b = sys.stdin.buffer.read(); x, y = (pickle.loads(b)(sys.argv[1]) for _ in 'ab'); assert x is y"
    command = [sys.executable, "-c", brought, PATH]
    subprocess.run(command, input=cloudpickle.dumps(tf._encoder), cwd=tmp_path, check=True, timeout=120)


def test_few_kept_pieces_give_the_same_ids(tokenizer, rows, monkeypatch):
    monkeypatch.setattr(tf, "_PIECES", 50)
    encoder = tf.PieceEncoder(PATH)
    for text in [r[1] or "" for r in rows]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == want
        assert len(encoder.known) <= 50 and len(encoder.known.older) <= 50


def test_files_round_trip(spark, docs, rows, tokenizer, tmp_path):
    path = str(tmp_path / "tokens")
    tf.write_tokens(docs, path, PATH)
    got = tf.read_tokens(spark, path, carry_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    want = Counter((r[0], *tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0) for r in rows)
    assert Counter((r["doc_id"], *r["ids"]) for r in got) == want
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += len(r["ids"])


def test_no_documents(spark, no_docs, tmp_path):
    path = str(tmp_path / "tokens")
    tf.write_tokens(no_docs, path, PATH)
    assert tf.read_tokens(spark, path).count() == 0


def huffman_cost(counts):
    heap, cost = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


@pytest.mark.parametrize("n,most", [(1, 18), (2, 18), (3, 2), (100, 7), (100, 18), (1000, 11), (5000, 18)])
def test_lengths_are_limited_and_best(n, most):
    counts = np.random.default_rng(n).zipf(1.3, n).clip(1, 10**12)
    bits = tf.code_lengths(counts, most)
    assert bits.max() <= most and bits.min() >= 1
    assert n == 1 or sum(2.0 ** -int(b) for b in bits) == 1.0
    if n > 1:
        free = tf.code_lengths(counts, 60) if n <= 100 else None
        if free is not None:
            assert (free * counts).sum() == huffman_cost(counts)
        assert (bits * counts).sum() >= huffman_cost(counts)


def test_too_many_ids_for_the_limit():
    with pytest.raises(ValueError):
        tf.code_lengths(np.ones(9, np.int64), 3)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 70_000])
def test_blocks_decode_alone(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 40_000)
    seen, counts = np.unique(np.append(ids, 7), return_counts=True)
    code = tf.Code(seen, tf.code_lengths(counts))
    payload, checkpoints, bits = code.encode(ids)
    assert len(checkpoints) == math.ceil(n / tf.STEP) and len(payload) == (bits + 7) // 8
    assert code.decode(payload, checkpoints, n).tolist() == ids.tolist()


def brute_top(rows, wanted, k):
    best = {}
    for i, v in rows:
        ok = i is not None and v and all(c is not None and math.isfinite(c) for c in v)
        if ok:
            whole = [math.floor(64 * float(c)) for c in v]
            best[i] = max(best.get(i, whole), whole)
    out = []
    for q, v in best.items():
        if wanted(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in best.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("bits,k,block", [(8, 5, 50), (3, 5, 64), (1, 3, 1000), (2, 200, 30)])
def test_top_k_is_brute_force(spark, bits, k, block):
    rng = np.random.default_rng(bits)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 12)]) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # many copies: ties
    rows += [(300, [0.0] * 12), (301, None), (302, []), (303, [None] * 12), (304, [float("nan")] * 12)]
    rows += [(305, [float("inf")] + [0.0] * 11), (310, [1.0, 2.0]), (320, [3.0, -1.0]), (None, rows[0][1])]
    rows += [rows[5], (6, [9.0] * 12)]  # a repeated row, and a second vector for an id
    table = spark.createDataFrame(rows, "id bigint, embedding array<double>").repartition(3)
    vectors = table.select("id", scaled(F.col("embedding")).alias("vector"))
    got = top_k(vectors, F.col("id") % 5 == 0, k=k, bits=bits, query_rows=16, block_rows=block).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, lambda i: i % 5 == 0, k)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "id bigint, vector array<bigint>")
    assert top_k(empty, F.col("id") % 5 == 0).count() == 0


def test_an_outlier_does_not_widen_the_cells(spark, monkeypatch):
    from driftmap.llm import topk

    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 0.2, (800, 16))
    vectors[17, 4] = 1e7
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    read, real = [], topk._with_score
    monkeypatch.setattr(topk, "_with_score", lambda pairs, *a: read.append(pairs.count()) or real(pairs, *a))
    got = top_k(table.select("id", scaled(F.col("embedding")).alias("vector")), F.col("id") % 20 == 0, k=10).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, lambda i: i % 20 == 0, 10)
    assert sum(read) <= 10 * 10 * 40
