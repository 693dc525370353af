"""Fill-in-the-middle transformation by in-place block rotation, and its exact inverse.

Two draws from the row's id cut a text into prefix, middle and suffix, counted in code points. The text's bytes stay in
one bytearray: sentinels are inserted at the cuts, and blocks change places by rotation, that is by reversing both
blocks and then the whole, which needs no second copy of a text of any length. The inverse finds the sentinels, rotates
back and deletes them. A text that already holds a sentinel stays plain, so no sentinel of an output is in doubt.

Rows are independent: no shuffle, and a lost task is redone from its input alone. Draws come from the id, so reruns agree
and do not depend on partitioning.

Defined results: NULL texts are empty and thus plain; a NULL id draws as the empty string does; repeated rows give equal
results; an empty table gives no rows; other columns, whatever their names, are kept inside ``doc``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from driftmap.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, so many are rearranged; of 100 of these, so many begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
#: Bytes moved at a time while a block is reversed.
_STEP = 1 << 16


def _reverse(data: np.ndarray, start: int, end: int) -> None:
    """Reverse ``data[start:end]`` where it lies."""
    while end - start > 1:
        n = min(_STEP, (end - start) // 2)
        left = data[start : start + n].copy()
        data[start : start + n] = data[end - n : end][::-1]
        data[end - n : end] = left[::-1]
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Exchange the neighbouring blocks ``[start, cut)`` and ``[cut, end)``."""
    data = np.frombuffer(buffer, np.uint8)
    _reverse(data, start, cut)
    _reverse(data, cut, end)
    _reverse(data, start, end)


def _byte_offset(text: bytes, starts: np.ndarray | None, point: int) -> int:
    """Where code point ``point`` begins; without ``starts`` every code point is one byte."""
    if starts is None:
        return point
    return int(starts[point]) if point < len(starts) else len(text)


def rearrange(text: bytes, first: int, second: int, suffix_first: bool) -> bytes:
    """The text with sentinels, its middle (the code points from ``first`` to ``second``) at the end."""
    starts = None
    if not text.isascii():
        starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    a, b = (_byte_offset(text, starts, p) for p in (first, second))
    marks = [m.encode() for m in (PREFIX, MIDDLE, SUFFIX)]
    buffer = bytearray(text)
    for at, mark in zip((b, a, 0), reversed(marks), strict=True):
        buffer[at:at] = mark
    middle = a + len(marks[0])
    suffix = b + len(marks[0]) + len(marks[1])
    if suffix_first:
        rotate(buffer, 0, suffix, len(buffer))
    else:
        rotate(buffer, middle, suffix, len(buffer))
    return bytes(buffer)


def put_back(output: bytes, form: str) -> bytes:
    """The text that ``rearrange`` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    marks = [m.encode() for m in (PREFIX, MIDDLE, SUFFIX)]
    if form == "spm":
        rotate(buffer, 0, buffer.index(marks[0]), len(buffer))
    else:
        rotate(buffer, buffer.index(marks[2]), buffer.index(marks[1]), len(buffer))
    # Now prefix, middle and suffix are in order again, each behind its sentinel.
    for mark in reversed(marks):
        at = buffer.index(mark)
        del buffer[at : at + len(mark)]
    return bytes(buffer)


def _draws(id_: Column) -> Column:
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)])


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``doc, n, form, prefix_chars, middle_chars, output``: every whole text rearranged for training on its middle.

    ``doc`` holds the columns in ``carry`` (all without it). ``form`` is psm (prefix, suffix, middle), spm (suffix,
    prefix, middle) or plain; a plain text is its own output, without lengths of parts.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = F.struct(*[F.col(c) for c in (docs.columns if carry is None else carry)])
    rows = docs.select(held.alias("doc"), _draws(F.col(id)).alias("h"), whole.alias("text"), F.length(whole).cast("bigint").alias("n"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("n") == 0) | marked | (F.col("h")[2] % 100 >= RATE)
    points = [F.col("h")[i] % (F.col("n") + 1) for i in (0, 1)]
    cuts = rows.select(
        "doc",
        "n",
        F.when(plain, "plain").when(F.col("h")[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm").alias("form"),
        F.least(*points).alias("first"),
        F.greatest(*points).alias("second"),
        "text",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch, "text"):
                columns = [batch.column(c).to_pylist() for c in ("form", "first", "second")]
                outputs = []
                for text_, form, first, second in zip(batch.column("text").cast(pa.binary()), *columns, strict=True):
                    value = text_.as_py()
                    outputs.append(value if form == "plain" else rearrange(value, first, second, form == "spm"))
                kept = [batch.column(c) for c in ("doc", "n", "form", "first", "second")]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(outputs, pa.binary()).view(pa.string())],
                    ["doc", "n", "form", "first", "second", "output"],
                )

    kept = [cuts.schema[c] for c in ("doc", "n", "form", "first", "second")]
    done = cuts.mapInArrow(run, StructType([*kept, StructField("output", StringType())]))
    moved = F.col("form") != "plain"
    return done.select(
        "doc",
        "n",
        "form",
        F.when(moved, F.col("first")).alias("prefix_chars"),
        F.when(moved, F.col("second") - F.col("first")).alias("middle_chars"),
        "output",
    )


def restored(rows: DataFrame) -> DataFrame:
    """``restored``, the text rebuilt from ``output`` and ``form`` alone, in place of ``output``; other columns stay."""
    others = [f for f in rows.schema if f.name != "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch, "output"):
                outputs = batch.column("output").cast(pa.binary())
                texts = [put_back(t.as_py(), f) for t, f in zip(outputs, batch.column("form").to_pylist(), strict=True)]
                names = [f.name for f in others]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in names], pa.array(texts, pa.binary()).view(pa.string())],
                    [*names, "restored"],
                )

    return rows.mapInArrow(run, StructType([*others, StructField("restored", StringType())]))
