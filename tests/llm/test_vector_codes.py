"""Vector codes: the masks against all distances, and the whole against plain integer k-means."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftmap.llm.vector_codes import Nearest, code_vectors, whole_numbers

SCHEMA = "id bigint, embedding array<float>, label int, vector string, code string, part int, entry int, n int"


def brute(rows, parts, entries, rounds):
    """``(id, code, error, label_error)`` in any order, and the digest, for rows ``id, whole numbers, label``."""
    kept = sorted([r for r in rows if r[1] is not None], key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    width = -(-length // parts)
    fits = [r for r in kept if len(r[1]) == length]
    cuts = [[(list(r[1]) + [0] * (parts * width - length))[p * width : (p + 1) * width] for p in range(parts)] for r in fits]
    books = [[list(c[p]) for c in cuts[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            owners = [nearest(p, c[p])[1] for c in cuts]
            for i in range(len(books[p])):
                mine = [c[p] for c, o in zip(cuts, owners) if o == i]
                if mine:
                    books[p][i] = [sum(col) // len(mine) for col in zip(*mine)]
    out, errors = [], {}
    for r, c in zip(fits, cuts):
        found = [nearest(p, c[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]))
        errors[r[2]] = errors.get(r[2], 0) + out[-1][2]
    out += [(r[0], None, None, r[2]) for r in kept if len(r[1]) != length]
    text = ",".join(str(v) for book in books for e in book for v in e)
    return [(i, c, e, errors.get(label)) for i, c, e, label in out], hashlib.sha256(text.encode()).hexdigest()


def found(df):
    rows = df.collect()
    return [(r.id, r.code, r.error, r.label_error) for r in rows], {r.codebooks_sha256 for r in rows}


def awkward():
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 0.4) for _ in range(8)], i % 3) for i in range(120)]
    rows += [(200 + i, [rows[7][1][j] + rnd.gauss(0, 1e-3) for j in range(8)], 1) for i in range(60)]
    rows += [(5, rows[5][1], 0), (5, rows[9][1], None), (None, rows[3][1], None), (None, rows[3][1], None)]
    rows += [(300, None, 1), (301, [1.0, None] * 4, 1), (302, [float("nan")] * 8, 2), (303, [float("inf")] + [0.0] * 7, 2)]
    rows += [(304, [1.0, 2.0], 7), (305, [], 1)]
    return [(*r, "x", "y", 1, 2, 3) for r in rows]


@pytest.mark.parametrize("count", [1, 3, 64, 65, 256])
@pytest.mark.parametrize("spread", [1, 40, 100_000])
def test_masks_keep_every_nearest_entry(count, spread):
    rng = np.random.default_rng(count * spread)
    entries = rng.integers(-spread, spread + 1, (count, 5))
    points = np.concatenate([rng.integers(-spread, spread + 1, (500, 5)), entries, entries * 3])
    index, distance = Nearest(entries)(points)
    gaps = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (distance == gaps.min(1)).all() and (index == gaps.argmin(1)).all()


def test_masks_leave_most_entries_out():
    rng = np.random.default_rng(0)
    entries = rng.integers(-10_000, 10_000, (256, 4))
    masks = Nearest(entries).candidates(entries + rng.integers(-50, 50, entries.shape))
    assert np.bitwise_count(masks).sum(1).mean() < 8


@pytest.mark.parametrize("parts, entries", [(4, 16), (3, 256), (1, 2)])
def test_equals_brute_force(spark, parts, entries):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    whole = df.select("id", "label", whole_numbers(F.col("embedding")).alias("vector"))
    floors = {r.id: r.vector for r in whole.filter(F.col("id") >= 100).collect()}
    assert floors[300] is None and floors[301] is None and floors[302] is None and floors[303] is None and floors[305] == []
    numbers = [(r.id, r.vector, r.label) for r in whole.collect()]
    want, sha = brute(numbers, parts, entries, 4)
    got, shas = found(code_vectors(whole, parts, entries, 4))
    assert sorted(got, key=repr) == sorted(want, key=repr) and shas == {sha}


def test_empty_table_empty_vectors_and_too_large(spark):
    none = spark.createDataFrame([], "id bigint, label int, vector array<bigint>")
    assert code_vectors(none).count() == 0
    hollow = spark.createDataFrame([(1, 2, []), (2, None, [])], none.schema)
    assert sorted(found(code_vectors(hollow))[0]) == [(1, "00000000", 0, 0), (2, "00000000", 0, 0)]
    with pytest.raises(PySparkException):
        code_vectors(spark.createDataFrame([(1, 2, [1 << 40])], none.schema)).collect()
