"""Token-id files with canonical, length-limited Huffman codes.

Documents are ordered by range partitioning on their id and encoded once, by a public tokenizer; blocks of consecutive
documents hold their ids. The counts of all ids give the code: package-merge limits its lengths, and the canonical order
lets the lengths alone describe it. Each block is then coded on its own, with the bit offset of every 256th id as a
checkpoint. A reader needs one block and the lengths; it looks up codes in one table, and checkpoints let it decode all
stretches of a block side by side.

The format is a folder with two Parquet tables: ``codes`` (``id, bits``) and ``blocks`` (``part, block, doc_ids,
counts, checkpoints, bits, payload``); parts and blocks follow the order of ids. Parquet gives splits, atomic commits and
any store; the driver sees only counts, of which there are at most as many as the vocabulary has ids.

Ids come from the tokenizers library. Its model is asked once per distinct piece between the borders at which it splits
texts anyway, and its answers are kept; texts with other characters than the Latin blocks, or with special tokens, are given
to it whole. Whether splitting here and there agree is tried on all those characters before it is relied on.

Defined results: a NULL text is empty; every document ends in the end id, also an empty one; NULL ids come first;
repeated rows stand side by side; an empty table gives files without blocks; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import types
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmap.llm.common import slices, stored

END_ID = 0
#: Ids per block at least, unless the part ends; ids between checkpoints; longest code.
BLOCK, STEP, MOST_BITS = 1 << 18, 256, 18
_LATIN = 0x250
#: Pieces of which an encoder keeps the ids, twice; the module in which a process keeps its encoders.
_PIECES, _KEPT = 400_000, "_driftmap_token_encoders"


def _characters(*kinds: str) -> str:
    """A character class of the Latin blocks by Unicode category."""
    return "".join(re.escape(chr(c)) for c in range(_LATIN) if unicodedata.category(chr(c))[0] in kinds)


class _PieceIds(dict):
    """Ids by piece, asked for when first met. Pieces met again outlive the others: those not met since ``_PIECES`` new ones go."""

    def __init__(self, ask: Callable[[str], bytes]):
        super().__init__()
        self.ask, self.older = ask, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.ask(piece)
        if len(self) >= _PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class PieceEncoder:
    """Ids of texts as little-endian bytes, from the tokenizer file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        letter, number, space = _characters("L"), _characters("N"), "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
        # The pieces of byte-level encoding: contractions, words, numbers, other signs, white space.
        self.pieces = re.compile(
            f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+"
        )
        self.foreign = re.compile(f"[^\\x00-{chr(_LATIN - 1)}]")
        self.signs = self._byte_signs()
        self.one = [np.array([i], self.dtype).tobytes() for i in range(self.tokenizer.get_vocab_size())]
        self.known = _PieceIds(self._piece_ids)
        self.by_piece = self._agrees()

    @staticmethod
    def _byte_signs() -> dict[int, str]:
        """The sign by which byte-level vocabularies name each byte of Latin texts, as the library gives it."""
        from tokenizers.pre_tokenizers import ByteLevel

        level = ByteLevel(add_prefix_space=False, use_regex=False)
        signs = {}
        for c in map(chr, range(_LATIN)):
            signs.update(zip(c.encode(), level.pre_tokenize_str(c)[0][0]))
        return signs

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece_ids(self, piece: str) -> bytes:
        named = piece.encode().decode("latin-1").translate(self.signs)
        return b"".join([self.one[t.id] for t in self.tokenizer.model.tokenize(named)])

    def _by_piece(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.pieces.findall(text)))

    def _agrees(self) -> bool:
        """Whether splitting here gives the ids that the library gives for whole texts, tried on every character."""
        probe = "".join(f"a{c}b{c} {c}1{c}{c}  {c}\n{c}'s{c}" for c in map(chr, range(_LATIN)))
        probe += " don't we'll I'm  x \n\n y\t\tz ''s 12ab"
        return "".join(self.pieces.findall(probe)) == probe and self._by_piece(probe) == self._ids(probe)

    def encode(self, text: str) -> bytes:
        if self.by_piece and (text.isascii() or not self.foreign.search(text)) and not any(s in text for s in self.special):
            return self._by_piece(text)
        return self._ids(text)


def _encoder(path: str) -> PieceEncoder:
    """The encoder that this process keeps for ``path``, with its answers.

    The package goes to Python workers inside each task, so globals of its modules start anew with every one; those of a module
    that the interpreter lists stay as long as the worker does.
    """
    kept = vars(sys.modules.setdefault(_KEPT, types.ModuleType(_KEPT)))
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Bits of the best prefix code with no code longer than ``most`` (package-merge); all counts are positive."""
    n = len(counts)
    if n > 1 << most:
        raise ValueError(f"{n} ids need codes of more than {most} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    level, kinds = leaves, [np.ones(n, bool)]
    for _ in range(most - 1):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        by_weight = np.argsort(both, kind="stable")
        level = both[by_weight]
        kinds.append(by_weight < n)
    bits, need = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(kinds):
        taken = int(is_leaf[:need].sum())
        bits[:taken] += 1
        need = 2 * (need - taken)
    out = np.empty(n, np.int64)
    out[order] = bits
    return out


class Code:
    """A canonical code from ids and their code lengths."""

    def __init__(self, ids: np.ndarray, bits: np.ndarray):
        order = np.lexsort((ids, bits))
        self.ids, self.bits = ids[order].astype(np.int64), bits[order].astype(np.int64)
        self.longest = int(self.bits.max(initial=1))
        room = np.int64(1) << (self.longest - self.bits)
        starts = np.concatenate([[0], np.cumsum(room)[:-1]]) if len(ids) else room
        size = int(self.ids.max(initial=-1)) + 1
        self.code, self.length = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code[self.ids] = (starts >> (self.longest - self.bits)).astype(np.uint64)
        self.length[self.ids] = self.bits
        # Codes at the left of a word, to be moved right by the place at which they begin.
        self.left = self.code << (64 - self.length).clip(max=63).astype(np.uint64)
        # One entry for every string of ``longest`` bits: the id that it starts with, and its length.
        self.table_id = np.zeros(1 << self.longest, np.uint32)
        self.table_bits = np.ones(1 << self.longest, np.uint8)
        filled = int(room.sum())
        self.table_id[:filled] = np.repeat(self.ids, room)
        self.table_bits[:filled] = np.repeat(self.bits, room)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, int]:
        """Payload, checkpoints, and number of bits."""
        if not len(ids):
            return b"", np.zeros(0, np.int64), 0
        length = self.length[ids]
        ends = np.cumsum(length)
        starts = ends - length
        word, inside = starts >> 6, starts & 63
        out = np.zeros(int(ends[-1] >> 6) + 2, np.uint64)
        whole = self.left[ids] >> inside.view(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.add.reduceat(whole, first)
        over = np.flatnonzero(inside + length > 64)
        out[word[over] + 1] |= self.left[ids[over]] << (64 - inside[over]).astype(np.uint64)
        bits = int(ends[-1])
        return out.astype(">u8").tobytes()[: (bits + 7) // 8], starts[::STEP], bits

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """All ``n`` ids of a block; the stretches between checkpoints are decoded side by side."""
        if not n:
            return np.zeros(0, np.uint32)
        padded = payload + bytes(8)
        window = np.ndarray((len(padded) - 4,), ">u4", padded, strides=(1,)).astype(np.uint32)
        last = len(payload) * 8
        at = checkpoints.astype(np.int64)
        out = np.empty((STEP, len(at)), np.uint32)
        down = np.uint32(32 - self.longest)
        for i in range(min(STEP, n)):
            seen = (window[at >> 3] << (at & 7).astype(np.uint32)) >> down
            out[i] = self.table_id[seen]
            at += self.table_bits[seen]
            np.minimum(at, last, out=at)
        return out.T.reshape(-1)[:n]


_BLOCKS = "part int, block int, doc_ids array<bigint>, counts array<bigint>, ids binary"


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Blocks of the ids of consecutive documents."""
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([end_id], encoder.dtype).tobytes()
        width, part, block = encoder.dtype.itemsize, TaskContext.get().partitionId(), 0
        names, counts, held, size = [], [], [], 0

        def out() -> pa.RecordBatch:
            many = pa.list_(pa.int64())
            values = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                pa.array([names], many),
                pa.array([counts], many),
                pa.array([b"".join(held)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(values, ["part", "block", "doc_ids", "counts", "ids"])

        for batch in batches:
            for piece in slices(batch, "text"):
                for name, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                    ids = encoder.encode(text) + end
                    names.append(name)
                    counts.append(len(ids) // width)
                    held.append(ids)
                    size += counts[-1]
                    if size >= BLOCK:
                        yield out()
                        block, names, counts, held, size = block + 1, [], [], [], 0
        if names:
            yield out()

    return ordered.mapInArrow(run, _BLOCKS)


def _dtype(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs(doc_id, text)`` with the tokenizer file and write token files to ``path``."""
    spark = docs.sparkSession
    dtype = _encoder(tokenizer).dtype
    blocks = stored(_tokenised(docs, tokenizer, end_id), "tokens")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                found = np.bincount(np.frombuffer(ids.as_buffer(), dtype))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    counted = blocks.select("ids").mapInArrow(tally, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted((r["id"], r["n"]) for r in counted.collect())  # at most one row per id of the vocabulary
    ids = np.array([r[0] for r in rows], np.int64)
    bits = code_lengths(np.array([r[1] for r in rows], np.int64))
    code = Code(ids, bits)
    spark.createDataFrame([(int(i), int(b)) for i, b in zip(ids, bits)], "id bigint, bits int").coalesce(
        1
    ).write.parquet(f"{path}/codes")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                payload, checkpoints, n = code.encode(np.frombuffer(batch.column("ids")[i].as_buffer(), dtype))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c).slice(i, 1) for c in ("part", "block", "doc_ids", "counts")],
                        pa.array([checkpoints], pa.list_(pa.int64())),
                        pa.array([n], pa.int64()),
                        pa.array([payload], pa.binary()),
                    ],
                    ["part", "block", "doc_ids", "counts", "checkpoints", "bits", "payload"],
                )

    schema = (
        "part int, block int, doc_ids array<bigint>, counts array<bigint>, checkpoints array<bigint>, bits bigint, "
        "payload binary"
    )
    blocks.mapInArrow(pack, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, carry_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in token files, and ``ids`` if wanted.

    ``start`` is the number of ids before the document in all files; the checksum is of its ids as little-endian unsigned
    32-bit numbers.
    """
    rows = spark.read.parquet(f"{path}/codes").collect()  # at most one row per id of the vocabulary
    code = Code(np.array([r["id"] for r in rows], np.int64), np.array([r["bits"] for r in rows], np.int64))
    blocks = spark.read.parquet(f"{path}/blocks")
    n_ids = F.aggregate("counts", F.lit(0).cast("bigint"), lambda s, n: s + n)
    sizes = blocks.select("part", "block", n_ids.alias("n"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part, a part being what one task wrote.
    across = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(across), F.lit(0)).alias("part_start")
    )
    starts = (
        sizes.withColumn("block_start", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(parts, "part")
        .select("part", "block", (F.col("part_start") + F.col("block_start")).alias("before"))
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                counts = batch.column("counts")[i].values.to_numpy()
                checkpoints = batch.column("checkpoints")[i].values.to_numpy()
                found = code.decode(batch.column("payload")[i].as_py(), checkpoints, int(counts.sum())).astype("<u4")
                ends = np.cumsum(counts)
                view = memoryview(found).cast("B")
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                n = len(counts)
                columns = {
                    "part": pa.array([batch.column("part")[i].as_py()] * n, pa.int32()),
                    "block": pa.array([batch.column("block")[i].as_py()] * n, pa.int32()),
                    "doc_id": batch.column("doc_ids")[i].values,
                    "local": pa.array(ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
                if carry_ids:
                    columns["ids"] = pa.array(
                        [found[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())], pa.list_(pa.int64())
                    )
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, block int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint"
    decoded = blocks.select("part", "block", "doc_ids", "counts", "checkpoints", "payload").mapInArrow(
        unpack, schema + (", ids array<bigint>" if carry_ids else "")
    )
    more = ["ids"] if carry_ids else []
    return decoded.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *more
    )
