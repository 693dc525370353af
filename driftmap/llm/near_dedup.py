"""Near-duplicate documents by b-bit MinHash.

A document is the set of hashes of its word shingles. Documents with equal sets are one class; all further work is on
classes. Each class has 128 minima: four at a time make a band, and of each only two bits are kept in a packed signature
of 256 bits. Classes that share a band meet in a bucket. Of two classes, the share of equal two-bit values, corrected for
the quarter that agrees by chance, estimates their similarity; pairs that could still reach the threshold, five standard
deviations considered, are confirmed on their full sets.

Buckets are never expanded into all pairs at once. First every member is compared with the bucket's smallest class only;
confirmed links name components. Then only buckets that still hold several components are looked at again, in blocks of
members against blocks, and only pairs across components are confirmed: first each member with its likeliest partners,
at last all pairs that the estimate allows. So groups of thousands of near copies cost a few rows each, and no link
between components is left out: with bands of four minima, a pair at the threshold of 0.8 shares no
band with a probability below 1e-7.

Defined results: words are split at ASCII white space after lower-casing A-Z; a text with fewer words than a shingle is
one shingle; NULL or empty texts have none and stand alone; repeated rows share class and component; NULL ids are larger
than any other, and a component of rows without id has the id NULL; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.llm.common import slices, stored
from driftmap.operators.components import connected_components
from driftmap.operators.scale import lookup

MINIMA, BANDS = 128, 32
#: Bits kept of each minimum, and the 64-bit mask with the lower bit of each.
BITS, _LOW = 2, 0x5555555555555555
_BLOCK = 512
#: After the first comparisons, members are compared across components: with their likeliest partners only, which joins
#: most of what belongs together, then with all that are left.
ROUNDS = (4, None)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SEEDS = np.random.default_rng(20).integers(0, 2**64, (2, MINIMA), np.uint64)
_XOR, _TIMES = _SEEDS[0][:, None], _SEEDS[1][:, None] | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """Hashes of words; forgotten when there are very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, size: int, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``size`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    if not n:
        return hashes
    total = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        total = total * _MIX + hashes[i : i + len(total)]
    total ^= total >> np.uint64(29)
    return np.unique(total * _MIX)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over a set."""
    best = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = (shingles[None, at : at + 4096] ^ _XOR) * _TIMES
        np.minimum(best, part.min(1), out=best)
    return best


def band_hashes(best: np.ndarray) -> np.ndarray:
    """One hash per band of consecutive minima."""
    rows = best.reshape(BANDS, -1)
    total = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        total = (total ^ rows[:, i]) * _MIX
        total ^= total >> np.uint64(32)
    return total.view(np.int64)


def signature(best: np.ndarray) -> np.ndarray:
    """The kept bits of all minima, 32 to a word of 64 bits. The low bits are taken after mixing."""
    mixed = (best ^ (best >> np.uint64(31))) * _MIX
    bits = (mixed >> np.uint64(64 - BITS)).reshape(-1, 64 // BITS)
    shifts = np.arange(0, 64, BITS, dtype=np.uint64)
    return np.bitwise_or.reduce(bits << shifts, axis=1).view(np.int64)


def least_agreement(percent: int) -> int:
    """Equal two-bit values from which two sets may be ``percent`` alike: five standard deviations below the mean."""
    chance = 0.5**BITS
    p = percent / 100 + (1 - percent / 100) * chance
    return max(0, math.floor(MINIMA * (p - 5 * math.sqrt(p * (1 - p) / MINIMA))))


def estimated_similarity(agreement: float) -> float:
    """Similarity from the number of equal values, corrected for those equal by chance."""
    chance = 0.5**BITS
    return (agreement / MINIMA - chance) / (1 - chance)


def _scan(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, text_hash, class, n_shingles, bands, signature`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                classes, counts, bands, signatures = [], [], [], []
                for text in part.column("text").to_pylist():
                    found = shingle_set(text, size, memo)
                    counts.append(len(found))
                    if len(found):
                        best = minima(found)
                        classes.append(hashlib.md5(found.tobytes(), usedforsecurity=False).digest())
                        bands.append(band_hashes(best))
                        signatures.append(signature(best))
                    else:
                        classes.append(None)
                        bands.append(None)
                        signatures.append(None)
                many = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("text_hash"),
                        pa.array(classes, pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array(bands, many),
                        pa.array(signatures, many),
                    ],
                    ["doc_id", "text_hash", "class", "n_shingles", "bands", "signature"],
                )

    schema = (
        "doc_id bigint, text_hash bigint, class binary, n_shingles bigint, bands array<bigint>, signature array<bigint>"
    )
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``class, shingles`` of the classes in ``wanted(class, doc_id)``, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                found = [shingle_set(text, size, memo).tobytes() for text in part.column("text").to_pylist()]
                keys = [hashlib.md5(f, usedforsecurity=False).digest() for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(found, pa.binary())], ["class", "shingles"]
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").alias("d")
    chosen = texts.join(
        wanted.select("doc_id").distinct().alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")), "left_semi"
    )
    found = chosen.mapInArrow(run, "class binary, shingles binary")
    return found.join(wanted.select("class"), "class", "left_semi").groupBy("class").agg(F.first("shingles").alias("shingles"))


def _agreement(a: str, b: str) -> str:
    """SQL for the number of equal two-bit values of two signatures."""
    words = []
    for i in range(MINIMA * BITS // 64):
        x = f"({a}[{i}] ^ {b}[{i}])"
        words.append(f"bit_count(~({x} | shiftrightunsigned({x}, 1)) & {_LOW}L)")
    return " + ".join(words)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, at_most: int | None = None) -> DataFrame:
    """The pairs ``a, b``, ``at_most`` so many, whose full sets are ``percent`` alike or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    first = sets.select(F.col("class").alias("a"), F.col("shingles").alias("set_a"))
    second = sets.select(F.col("class").alias("b"), F.col("shingles").alias("set_b"))
    joined = lookup(lookup(pairs, second, ["b"], "inner", at_most=at_most), first, ["a"], "inner", at_most=at_most)
    return joined.select("a", "b", "set_a", "set_b").mapInArrow(run, "a binary, b binary")


def _across(members: DataFrame, percent: int, best: int | None) -> DataFrame:
    """``a, partners``: pairs of members ``bucket, class, component, n_shingles, signature`` of one bucket that lie in different
    components and may be alike, found block against block. With ``best``, only each member's likeliest partners."""
    least = least_agreement(percent)
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / _BLOCK).cast("int")
    entry = F.struct("class", "component", "n_shingles", "signature")
    blocks = (
        members.join(sizes, "bucket")
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
        .groupBy("bucket", "parts", "part")
        .agg(F.collect_list(entry).alias("rows"))
    )
    blocks = stored(blocks, "blocks")
    left = blocks.select(
        "bucket", F.col("part").alias("i"), F.explode(F.sequence(F.col("part"), F.col("parts") - 1)).alias("j"),
        F.col("rows").alias("left_rows"),
    )
    right = blocks.select("bucket", F.col("part").alias("j"), F.col("rows").alias("right_rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, one = np.uint64(_LOW), np.uint64(1)

        def side(rows: list[dict]):
            names: dict[bytes, int] = {}
            label = np.array([names.setdefault(bytes(r["component"]), len(names)) for r in rows])
            size = np.array([r["n_shingles"] for r in rows])
            return label, names, size, np.array([r["signature"] for r in rows], np.int64).view(np.uint64)

        for batch in batches:
            for i in range(batch.num_rows):
                rows = [batch.column(c)[i].as_py() for c in ("left_rows", "right_rows")]
                both = rows[0] + rows[1]
                label, _, size, bits = side(both)
                n = len(rows[0])
                x = bits[:n, None, :] ^ bits[None, n:, :]
                agree = np.bitwise_count(~(x | (x >> one)) & low).sum(2)
                fits = 100 * np.minimum(size[:n, None], size[None, n:]) >= percent * np.maximum(size[:n, None], size[None, n:])
                agree = np.where((agree >= least) & fits & (label[:n, None] != label[None, n:]), agree.astype(np.int16), -1)
                chosen = agree >= 0
                if best is not None:
                    for axis in (0, 1):
                        most = min(best, agree.shape[axis])
                        limit = -np.partition(-agree, most - 1, axis=axis)
                        limit = limit.take([most - 1], axis=axis)
                        likely = agree >= np.maximum(limit, 0)
                        kept = likely if axis == 0 else kept | likely
                    chosen &= kept
                found = np.argwhere(chosen)
                # Pairs are listed under the member with more of them, so that lists are long and few.
                weight = np.concatenate([chosen.sum(1), chosen.sum(0)]).tolist()
                partners: dict[bytes, set[bytes]] = {}
                for p, q in found.tolist():
                    a, b = sorted((-weight[k], both[k]["class"]) for k in (p, n + q))
                    partners.setdefault(a[1], set()).add(b[1])
                lists = [list(b) for b in partners.values()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(partners), pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["a", "partners"]
                )

    met = left.join(right, ["bucket", "j"]).select("left_rows", "right_rows")
    listed = met.mapInArrow(run, "a binary, partners array<binary>")
    return listed.groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))


def _confirmed_lists(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b``, with ``b`` among the ``partners`` of ``a``, whose full sets are ``percent`` alike or more.

    Sets are dealt into blocks; a task holds one block and meets it with each ``a`` that has partners there, so that a
    set travels once per block and not once per pair.
    """
    blocks = max(1, math.ceil(sets.count() / _BLOCK))
    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    asked = (
        lookup(lists, sets.select(F.col("class").alias("a"), "shingles"), ["a"], "inner")
        .select("a", "shingles", "partners", F.explode(F.array_distinct(F.transform("partners", block_of))).alias("block"))
        .select(
            "block",
            F.lit(1).alias("kind"),
            F.col("a").alias("class"),
            "shingles",
            F.filter("partners", lambda c: block_of(c) == F.col("block")).alias("partners"),
        )
    )
    none = F.lit(None).cast("array<binary>").alias("partners")
    held = sets.select(block_of(F.col("class")).alias("block"), F.lit(0).alias("kind"), "class", "shingles", none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, here = None, {}
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("block", "kind", "class", "shingles", "partners")]
            for block, kind, name, shingles, partners in zip(*columns):
                if block != now:
                    now, here = block, {}
                x = np.frombuffer(shingles, np.uint64)
                if kind == 0:
                    here[name] = x
                    continue
                for partner in partners:
                    y = here[partner]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        found.append((name, partner))
            pairs = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in pairs], ["a", "b"])

    return (
        held.unionByName(asked)
        .repartition("block")
        .sortWithinPartitions("block", "kind")
        .mapInArrow(run, "a binary, b binary")
    )


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, with_component: bool = False) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id, kept``, one row per row of ``docs(doc_id, text)``.

    If ``with_component``, ``component`` names the group also where ids are NULL or repeat; NULL for documents without words.

    Documents are linked if their sets of shingles of ``size`` words have ``100 * |both| >= percent * |either|``.
    """
    scanned = stored(_scan(docs, size), "scanned")
    classes = stored(
        scanned.filter("class IS NOT NULL")
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("doc_id"),
            F.first("n_shingles").alias("n_shingles"),
            F.first("bands").alias("bands"),
            F.first("signature").alias("signature"),
        ),
        "classes",
    )
    banded = classes.select("class", F.explode("bands").alias("bucket"))
    shared = (
        banded.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("pivot"))
        .filter("n > 1")
        .select("bucket", "pivot")
    )
    members = stored(lookup(banded, shared, ["bucket"], "inner"), "members")
    wanted = members.select("class").distinct().join(classes.select("class", "doc_id"), "class")
    sets = stored(_sets(docs, stored(wanted, "wanted"), size), "sets")

    short = classes.select("class", "n_shingles", "signature")
    one = lambda c, to: short.select(
        F.col("class").alias(c), F.col("n_shingles").alias(f"n_{to}"), F.col("signature").alias(f"signature_{to}")
    )
    # No table made of members has more rows, so none is computed just to be counted.
    at_most = members.count()
    pairs = members.filter("pivot != class").select(F.col("pivot").alias("a"), F.col("class").alias("b")).distinct()
    signed = lookup(pairs, one("b", "b"), ["b"], "inner", at_most=at_most)
    likely = lookup(signed, one("a", "a"), ["a"], "inner", at_most=at_most).filter(
        f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"
        f" AND {_agreement('signature_a', 'signature_b')} >= {least_agreement(percent)}"
    )
    likely = stored(likely.select("a", "b"), "pairs")
    links = stored(_confirmed(likely, sets, percent, at_most), "links")
    # To begin with, a class is named by the smallest pivot it is linked to, or by that pivot's; equal names are connected.
    named = stored(links.groupBy(F.col("b").alias("class")).agg(F.min("a").alias("component")), "named")
    further = named.select(F.col("class").alias("component"), F.col("component").alias("further"))
    labels = lookup(named, further, ["component"]).select("class", F.coalesce("further", "component").alias("component"))

    for best in ROUNDS:
        labelled = lookup(members.select("bucket", "class"), labels, ["class"], at_most=at_most).select(
            "bucket", "class", F.coalesce("component", "class").alias("component")
        )
        labelled = stored(labelled, "labelled")
        mixed = (
            labelled.groupBy("bucket")
            .agg(F.min("component").alias("low"), F.max("component").alias("high"))
            .filter("low != high")
            .select("bucket", F.lit(True).alias("mixed"))
        )
        open_members = lookup(labelled, mixed, ["bucket"], "inner", at_most=at_most).drop("mixed")
        open_members = lookup(open_members, short, ["class"], "inner", at_most=at_most)
        open_members = stored(open_members, "open")
        likely_lists = stored(_across(open_members, percent, best), "likely")
        more = stored(_confirmed_lists(likely_lists, sets, percent), "more")
        if best is None and more.isEmpty():
            break
        links = links.unionByName(more)
        labels = connected_components(links).select(F.col("node").alias("class"), "component")

    placed = lookup(classes.select("class", "doc_id"), labels, ["class"]).select(
        "class", "doc_id", F.coalesce("component", "class").alias("component")
    )
    placed = stored(placed, "placed")
    smallest = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = lookup(placed.select("class", "component"), smallest, ["component"]).select("class", "component", "component_id")
    rows = lookup(scanned.select("doc_id", "text_hash", "class", "n_shingles"), found, ["class"])
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        *(["component"] if with_component else []),
    )
