"""Benchmark decontamination by winnowing.

Fingerprints are hashes of ``gram`` consecutive words; of every ``window - gram + 1`` consecutive ones the smallest is
kept. Two texts that share ``window`` words share the grams in them and so keep the same smallest one: every such span is
found. Fingerprints of documents and of the benchmark are joined, and each match is extended to the windows around it,
which are compared as wholes. Items of fewer words than a window are compared as they are.

Documents are read once, in a narrow pass. A Bloom filter of the benchmark's fingerprints, of a fixed largest size,
only spares the shuffle those that cannot match; the joins decide. Their benchmark side is salted, so that a passage in
a third of all documents is spread. Windows are compared by 64-bit hashes of all their words.

Defined results: NULL texts have no words; items without words have no windows; a repeated item counts once; items
without id mark words but are not listed; repeated rows give repeated results; empty tables give no rows, and without a
benchmark nothing is hit; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.llm.common import slices
from driftmap.operators.scale import cut

#: Bits of the Bloom filter at most: 16 MiB.
BLOOM_BITS = 1 << 27
_SALTS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class _WordHashes(dict):
    """Hashes of words; forgotten when there are very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _hashes(text: str | None, memo: _WordHashes) -> np.ndarray:
    """Hashes of the words of a text: lower-cased runs of ASCII letters, digits and all other characters."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of different ``n`` they differ."""
    if len(words) < n:
        return words[:0]
    size = len(words) - n + 1
    total = np.full(size, np.uint64(n), np.uint64)
    for i in range(n):
        total = total * _MIX + words[i : i + size]
    total ^= total >> np.uint64(29)
    return total * _MIX


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Which grams are the smallest of some ``w`` consecutive ones; of fewer, the smallest of all."""
    n = len(grams)
    if n <= w:
        return grams == grams.min() if n else np.zeros(0, bool)
    least = np.lib.stride_tricks.sliding_window_view(grams, w).min(1)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return grams <= np.lib.stride_tricks.sliding_window_view(padded, w).max(1)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def benchmark_hashes(items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """``item_id, words, kind, hash``: the fingerprints (``f``) and windows (``w``) of every item with its length."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    schema = "item_id string, words int, kind string, hash bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = _hashes(text, memo)
                n = min(len(words), window)
                if not n:
                    continue
                whole = _signed(np.unique(_grams(words, n))).tolist()
                if n == window:
                    grams = _grams(words, gram)
                    prints = _signed(np.unique(grams[winnow(grams, window - gram + 1)])).tolist()
                else:
                    prints = whole
                out += [(item, n, "f", h) for h in prints] + [(item, n, "w", h) for h in whole]
            columns = list(zip(*out)) or [()] * 4
            types = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "words", "kind", "hash"]
            )

    return rows.mapInArrow(run, schema)


def _bloom(prints: DataFrame) -> tuple[bytes, int]:
    """Bit set of the fingerprints, as bytes, and the logarithm of its size; at most ``BLOOM_BITS`` bits."""
    number = max(1, prints.count())
    power = min(BLOOM_BITS.bit_length() - 1, max(10, (16 * number).bit_length()))
    at = f"shiftrightunsigned(hash, {64 - power})"
    # At most one row per 64 bits, so never more than BLOOM_BITS / 64.
    rows = (
        prints.select(
            F.expr(f"shiftright({at}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({at} & 63 as int))").alias("bit")
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .collect()
    )
    bits = np.zeros(1 << (power - 6), np.int64)
    for row in rows:
        bits[row["word"]] = row["bits"]
    return bits.tobytes(), power


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` per document; ``items`` are the ids, as strings and sorted as such.

    A word is hit if it lies in a run of ``window`` words that an item holds, or in a whole item of fewer words.
    """
    hashed = cut(benchmark_hashes(items, window, gram))
    prints = hashed.filter("kind = 'f'").select("hash").distinct()
    bits, power = _bloom(prints)
    short = sorted(r[0] for r in hashed.filter(F.col("words") < window).select("words").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    schema = "doc_id bigint, text_hash bigint, n_words bigint, hits array<struct<print: bigint, start: int, words: int, window: bigint>>"
    hit_type = pa.list_(
        pa.struct([("print", pa.int64()), ("start", pa.int32()), ("words", pa.int32()), ("window", pa.int64())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        table = np.frombuffer(shared.value, np.uint64)
        shift, low = np.uint64(64 - power), np.uint64(63)

        def possible(hashes: np.ndarray) -> np.ndarray:
            at = hashes >> shift
            return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & low)) & np.uint64(1) > 0

        def hits(words: np.ndarray) -> list[dict]:
            found = []
            if len(words) >= window:
                grams = _grams(words, gram)
                at = np.flatnonzero(winnow(grams, window - gram + 1))
                at = at[possible(grams[at])]
                if len(at):
                    wholes = _signed(_grams(words, window))
                    for j in at.tolist():
                        print_ = int(_signed(grams[j : j + 1])[0])
                        for s in range(max(0, j - (window - gram)), min(j, len(words) - window) + 1):
                            found.append({"print": print_, "start": s, "words": window, "window": int(wholes[s])})
            for n in short:
                wholes = _grams(words, n)
                for s in np.flatnonzero(possible(wholes)).tolist() if len(wholes) else ():
                    whole = int(_signed(wholes[s : s + 1])[0])
                    found.append({"print": whole, "start": s, "words": n, "window": whole})
            return found

        for batch in batches:
            for part in slices(batch, "text"):
                counts, found = [], []
                for text in part.column("text").to_pylist():
                    words = _hashes(text, memo)
                    counts.append(len(words))
                    found.append(hits(words))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(counts, pa.int64()), pa.array(found, hit_type)],
                    ["doc_id", "text_hash", "n_words", "hits"],
                )

    scanned = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    ).mapInArrow(run, schema)
    # What is found depends on the text only, so rows with one id and text share it.
    scanned = cut(scanned.withColumn("_doc", F.coalesce("doc_id", F.lit(-1))))
    key = ["_doc", "text_hash"]
    salt = F.pmod(F.hash(*key), F.lit(_SALTS)).alias("salt")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    windows = hashed.filter("kind = 'w'")
    hit = (
        scanned.filter(F.size("hits") > 0)
        .select(*key, F.explode("hits").alias("h"))
        .select(*key, "h.*", salt)
        .join(salted(prints.withColumnRenamed("hash", "print")), ["print", "salt"], "left_semi")
        .select(*key, "salt", "start", "words", "window")
        .distinct()
        .join(salted(windows.select(F.col("hash").alias("window")).distinct()), ["window", "salt"], "left_semi")
    )
    hit = cut(hit)
    named = salted(windows.filter("item_id IS NOT NULL").select(F.col("hash").alias("window"), "item_id").distinct())
    listed = (
        hit.select(*key, "salt", "window")
        .distinct()
        .join(named, ["window", "salt"])
        .groupBy(*key)
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )

    def extend(state, s):
        end = s["start"] + s["words"]
        new = F.greatest(F.lit(0), end - F.greatest(state["end"], s["start"]))
        return F.struct(F.greatest(state["end"], end).alias("end"), (state["n"] + new).cast("bigint").alias("n"))

    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = hit.groupBy(*key).agg(
        F.aggregate(F.array_sort(F.collect_set(F.struct("start", "words"))), none, extend)["n"].alias("n_hit")
    )
    return (
        scanned.drop("hits")
        .join(covered, key, "left")
        .join(listed, key, "left")
        .select(
            "doc_id",
            "text_hash",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )
