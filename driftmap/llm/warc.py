"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing: of records with equal payloads of some size, that with the smallest id is a response and the others revisit it.
Archives are text files whose records end in two line breaks, so Spark's text writer makes them, with its commit
protocol, in any store.

Reading: a record starts with the version line, but a payload may hold that line too. Tasks cut the files at every such
line and emit, for each, its offset and the offset at which its successor must start if it is a record (head and
``Content-Length``). Per file, pointer jumping from offset 0 then marks the reachable offsets in about ``log2(records)``
steps: each step adds what is one jump away from the marked ones and doubles all jumps. Lines inside payloads are not
reachable and are dropped; payloads that were cut at them are put together again.

A file is read by one task, as gzip files are; only 16 bytes per candidate of a file meet in a task, and the writer
bounds the records per file. Payload digests are taken where the file is read, so payloads are not shuffled, except
those few that hold a version line. Defined results: NULL payloads are empty; payloads below the least size are never
revisits; with equal payloads and equal ids all are responses; NULL ids stay NULL, and a payload that only rows without
id have is always a response; NULL addresses are left out of the head; line breaks in addresses are percent-encoded; an
empty table gives no archive records; a file that does not start with a record has none; other columns are not archived.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.operators.scale import HOT_GROUPS, HOT_ROWS, cut, key_hash, lookup

#: Fixed parts of the format.
VERSION = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_MAGIC = VERSION.encode()
_FIELD = re.compile(rb"(?im)^([A-Za-z-]+):[ \t]*(.*?)[ \t]*\r?$")


def write_archives(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 100,
    per_file: int = 50_000,
    date: str = "1970-01-01T00:00:00Z",
) -> None:
    """Write one record per row, with payloads of at least ``least`` bytes written once."""
    body = F.coalesce(F.col(f"`{payload}`"), F.lit(""))
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        body.alias("body"),
        F.octet_length(body).alias("bytes"),
        F.sha2(body.cast("binary"), 256).alias("digest"),
    )
    repeated = cut(
        rows.filter(F.col("bytes") >= least)
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
    )
    total = repeated.agg(F.sum("n")).first()[0] or 0
    hot = repeated.filter(F.col("n") > max(HOT_ROWS, total // HOT_GROUPS)).select(key_hash(["digest"]))
    known = lookup(
        rows, repeated.select("digest", "first"), ["digest"], hot=sorted(r[0] for r in hot.collect())
    )
    again = F.coalesce((F.col("first") != F.col("id")) | F.col("id").isNull(), F.lit(False)) & F.col(
        "first"
    ).isNotNull()
    address = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    lines = [
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes")),
        F.when(again, F.lit(f"WARC-Profile: {SAME_PAYLOAD}")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(again, F.lit(0)).otherwise(F.col("bytes"))),
    ]
    head = F.concat(F.lit(VERSION), F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))
    record = F.concat(head, F.when(again, F.lit("")).otherwise(F.col("body")))
    known.select(record.alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", per_file
    ).text(path)


def _fields(head: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head)}


def _head(piece: bytes) -> tuple[dict[str, str], int, int]:
    """Fields of a piece that follows a version line, bytes before its content, and the content's length or -1."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return {}, 0, -1
    fields = _fields(piece[:end])
    length = fields.get("content-length", "")
    return fields, end + 4, int(length) if length.isascii() and length.isdigit() and len(length) < 16 else -1


_SCANNED = (
    "file string, offset bigint, successor bigint, record_type string, record_id string, refers_to string, "
    "url string, declared_bytes bigint, declared_digest string, payload_bytes bigint, payload_digest string"
)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between version lines, in the order of each file."""
    return (
        spark.read.option("lineSep", VERSION)
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("value").cast("binary").alias("value"),
        )
    )


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """``file, offset, piece`` for every version line; the offset is that of the line."""
    now, at = None, 0
    for batch in batches:
        if any(batch.column("split").to_pylist()):
            raise ValueError("archives must be read by one task each: compress them with gzip")
        files = batch.column("file").to_pylist()
        for i, piece in enumerate(batch.column("value")):
            piece = piece.as_py()
            if files[i] != now:  # what stands before the first line of a file
                now, at = files[i], len(piece)
                continue
            yield now, at, piece
            at += len(_MAGIC) + len(piece)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SCANNED.split(", ")]
    types = [pa.int64() if c.split()[1] == "bigint" else pa.string() for c in _SCANNED.split(", ")]
    rows: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for file, offset, piece in _placed(batches):
        fields, skip, length = _head(piece)
        successor = offset + len(_MAGIC) + skip + length + len(RECORD_END) if length >= 0 else -1
        whole = 0 <= length <= len(piece) - skip
        size = fields.get("warc-payload-length", "")
        digest = fields.get("warc-payload-digest", "").rpartition(":")[2] or None
        rows.append(
            (
                file,
                offset,
                successor,
                fields.get("warc-type"),
                fields.get("warc-record-id"),
                fields.get("warc-refers-to"),
                fields.get("warc-target-uri"),
                int(size) if size.isascii() and size.isdigit() and len(size) < 16 else None,
                digest,
                length if whole else None,
                hashlib.sha256(piece[skip : skip + length]).hexdigest() if whole else None,
            )
        )
        if len(rows) >= 5_000:
            yield out()
            rows = []
    if rows:
        yield out()


def _reached(group: pd.DataFrame) -> pd.DataFrame:
    """The record that each candidate of a file is, or lies in; candidates in no record are left out."""
    group = group.sort_values("offset")
    offsets, successors = group["offset"].to_numpy(), group["successor"].to_numpy()
    n = len(offsets)
    found = np.searchsorted(offsets, successors)
    hit = (found < n) & (offsets[np.minimum(found, n - 1)] == successors) & (successors > offsets)
    jump = np.append(np.where(hit, found, n), n)  # n: no candidate there
    marked = np.zeros(n + 1, bool)
    marked[0] = offsets[0] == 0
    span = 1
    while span <= n:
        marked[jump[np.flatnonzero(marked)]] = True
        jump = jump[jump]
        span *= 2
    starts = np.flatnonzero(marked[:n])
    starts = starts[successors[starts] > offsets[starts]]  # without a length it is no record
    owner = np.searchsorted(starts, np.arange(n), side="right") - 1
    inside = owner >= 0
    if len(starts):
        inside &= offsets < successors[starts[np.maximum(owner, 0)]]
    record = offsets[starts[owner[inside]]] if len(starts) else offsets[:0]
    return pd.DataFrame({"file": group["file"].to_numpy()[inside], "offset": offsets[inside], "record": record})


def _assemble(group: pd.DataFrame) -> pd.DataFrame:
    """Size and digest of a payload from the pieces of its record."""
    whole = _MAGIC.join(group.sort_values("offset")["value"])
    _, skip, length = _head(whole)
    content = whole[skip : skip + length]
    complete = length >= 0 and len(content) == length
    return pd.DataFrame(
        {
            "file": [group["file"].iloc[0]],
            "record": [group["record"].iloc[0]],
            "put_bytes": pd.array([length if complete else None], "Int64"),
            "put_digest": [hashlib.sha256(content).hexdigest() if complete else None],
        }
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``file, offset, record_type, record_id, refers_to, url, payload_bytes, payload_digest``.

    Sizes and digests are those of the content read; for revisits, which have no content, those of the head. Records cut
    off by the end of a file have NULL there.
    """
    scanned = cut(_pieces(spark, path).mapInArrow(_scan, _SCANNED))
    reached = cut(
        scanned.select("file", "offset", "successor")
        .groupBy("file")
        .applyInPandas(_reached, "file string, offset bigint, record bigint")
    )
    records = scanned.join(reached.filter("offset = record").select("file", "offset"), ["file", "offset"])
    torn = records.filter("payload_bytes IS NULL").select("file", F.col("offset").alias("record"))
    parts = reached.join(torn, ["file", "record"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, offset, piece in _placed(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([offset], pa.int64()), pa.array([piece], pa.binary())],
                ["file", "offset", "value"],
            )

    if torn.isEmpty():
        put = None
    else:
        pieces = _pieces(spark, path).mapInArrow(place, "file string, offset bigint, value binary")
        put = (
            pieces.join(parts, ["file", "offset"])
            .groupBy("file", "record")
            .applyInPandas(_assemble, "file string, record bigint, put_bytes bigint, put_digest string")
            .withColumnRenamed("record", "offset")
        )
    if put is not None:
        records = records.join(put, ["file", "offset"], "left")
        records = records.withColumn("payload_bytes", F.coalesce("payload_bytes", "put_bytes")).withColumn(
            "payload_digest", F.coalesce("payload_digest", "put_digest")
        )
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "file",
        "offset",
        "record_type",
        "record_id",
        "refers_to",
        "url",
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )

