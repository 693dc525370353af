"""Fill-in-the-middle: rotations, brute force over awkward rows, exact round trips."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmap.llm import fill_middle
from driftmap.llm.fill_middle import fill_in_middle, put_back, rearrange, restored, rotate


def expected(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h, n = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)], len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@given(st.binary(max_size=60), st.data())
def test_rotation_exchanges_blocks(data, draw):
    start, cut, end = sorted(draw.draw(st.integers(0, len(data))) for _ in range(3))
    buffer = bytearray(data)
    rotate(buffer, start, cut, end)
    assert buffer == data[:start] + data[cut:end] + data[start:cut] + data[end:]


def test_rotation_of_more_than_a_step(monkeypatch):
    monkeypatch.setattr(fill_middle, "_STEP", 7)
    data = bytes(range(256)) * 3
    buffer = bytearray(data)
    rotate(buffer, 5, 300, 760)
    assert buffer == data[:5] + data[300:760] + data[5:300] + data[760:]


@given(st.text("<>PSMaé日😀", max_size=30), st.data())
def test_round_trip_of_texts_like_sentinels(text, draw):
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    a, b = sorted(draw.draw(st.integers(0, len(text))) for _ in range(2))
    for first, form in ((False, "psm"), (True, "spm")):
        output = rearrange(text.encode(), a, b, first)
        p, m, s = text[:a], text[a:b], text[b:]
        assert output.decode() == (f"<S>{s}<P>{p}<M>{m}" if first else f"<P>{p}<S>{s}<M>{m}")
        assert put_back(output, form).decode() == text


def test_equals_brute_force(spark, docs, rows):
    more = [(1000 + i, t, *rows[0][2:]) for i, t in enumerate(["a<P>b", "<S", "<S>", "<M>" * 3, "é" * 9, "😀x" * 400] * 20)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    moved = fill_in_middle(table)
    found = [(r.doc.doc_id, r.doc.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in moved.collect()]
    want = [(r[0], r[1], *expected(r[0], r[1])) for r in [*rows, *more]]
    order = lambda row: tuple(map(repr, row))
    assert sorted(found, key=order) == sorted(want, key=order)
    assert {r[3] for r in want} == {"plain", "psm", "spm"}
    back = restored(moved)
    assert "output" not in back.columns
    assert back.filter(F.col("restored") != F.coalesce("doc.text", F.lit(""))).count() == 0
    assert back.count() == len(want)


@pytest.mark.parametrize("carry", [["doc_id"], [], None])
def test_empty_table_and_carried_columns(no_docs, carry):
    moved = fill_in_middle(no_docs, carry=carry)
    assert moved.count() == 0 and restored(moved).count() == 0
    assert moved.schema["doc"].dataType.names == (no_docs.columns if carry is None else carry)
