"""Removal of repeated byte strings by sorted suffixes.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts elsewhere. Suffixes are sorted in two
stages: those smaller than their successors are sorted directly, all others are induced by scanning the buckets of first
bytes in order, each scanned suffix putting its predecessor next in its bucket. Neighbours with a common prefix of
``LENGTH`` bytes are repeats.

Not all suffixes are sorted, and never all in one place. Each window of ``LENGTH`` bytes has an owner: the smallest of
the hashes of its 16-byte grams, leftmost first. Equal windows have equal owners, so windows are compared only with
windows of the same owner hash, and consecutive windows of one owner form a run, about 90 bytes long.

1. One narrow pass gives the runs of each document with the hash of their owner and of their whole content.
2. Owner hashes that occur once are done. Where all runs of an owner hash have one content, all their windows repeat.
   Both follow from one aggregation with partial sums, so a passage in a third of all documents is a few rows per task.
3. Where contents differ, one run of each is fetched, split once more by a second kind of owner, and sent to the task of
   its pair of owner hashes. There suffixes are sorted, batch by batch; contents that occur twice repeat as wholes.
   A pair with more than ``CROWDED`` runs goes to no single task: each of its windows becomes a row with its hash, and
   hashes are counted with partial sums.
4. The repeated stretches of each document are merged and cut out.

Hashes have 64 bits; contents are told apart by owner and content hash, 128 bits together. Defined results: NULL texts are
empty; rows without an id, or with one id, are told apart by their texts; texts shorter than ``LENGTH`` keep everything; repeated rows repeat each other, so their long texts go entirely;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.llm.common import slices, stored
from driftmap.operators.scale import HOT_GROUPS, HOT_ROWS, key_hash, lookup

LENGTH, GRAM = 200, 16
#: Windows handled at once; their places take 24 bits of a sort key.
_PART = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_TIMES = (
    (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)),
    (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)),
)
#: Runs of one pair of owners from which on their windows are counted instead of sorted in one task.
CROWDED = 20_000
#: Bytes of runs sorted together.
_BATCH = 8_000_000


def _loads(data: bytes | bytearray, order: str) -> np.ndarray:
    """The eight bytes from every place on, as a view; the last seven places reach into padding."""
    return np.ndarray((len(data),), f"{order}u8", bytes(data) + bytes(8), strides=(1,))


def _sliding_least(values: np.ndarray, w: int) -> np.ndarray:
    """Smallest of every ``w`` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def owned_runs(data: bytes, kind: int = 0, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, and owner hash of each run of windows with one owner."""
    total = len(data) - length + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, counts, owners = [], [], []
    one, two = _TIMES[kind]
    for at in range(0, total, _PART):
        n = min(_PART, total - at)
        loads = np.array(_loads(data[at : at + n + length - 1], "<"))
        grams = loads[: n + length - GRAM] * one
        grams ^= grams >> np.uint64(29)
        grams += loads[8 : 8 + len(grams)]
        grams *= two
        grams ^= grams >> np.uint64(32)
        grams *= one
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        owner = (_sliding_least(keys, length - GRAM + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        starts.append(at + first)
        counts.append(np.diff(first, append=n))
        owners.append(grams[owner[first]])
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(owners)


def _content_hashes(data: bytes, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    view = memoryview(data)
    spans = zip(starts.tolist(), (starts + counts + length - 1).tolist())
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in spans), np.uint64, len(starts))


def sorted_suffixes(text: bytes, wanted: np.ndarray, length: int) -> np.ndarray:
    """Places that ``wanted`` marks, in the order of the ``length`` bytes from there on.

    ``text`` must go on for ``length`` bytes after the last of them.
    """
    data = np.frombuffer(text + bytes(length) + b"\xff", np.uint8)
    n = len(text)
    # A suffix is smaller than its successor if the next different byte is larger.
    last = len(data) - 1
    change = np.where(data[:-1] != data[1:], np.arange(last), last)
    change = np.minimum.accumulate(change[::-1])[::-1]
    smaller = data[change] < data[np.minimum(change + 1, last)]
    smaller = np.append(smaller, True)
    # Induction starts from smaller suffixes, so each stretch of wanted places goes on to the next of them.
    next_smaller = np.minimum.accumulate(np.where(smaller, np.arange(len(data)), last)[::-1])[::-1]
    marked = np.zeros(len(data), bool)
    marked[:n] = wanted
    ends = np.flatnonzero(marked[:-1] & ~marked[1:])
    cover = np.zeros(len(data) + 1, np.int64)
    np.add.at(cover, ends + 1, 1)
    np.add.at(cover, next_smaller[ends] + 1, -1)
    marked |= np.cumsum(cover[:-1]) > 0

    words = _loads(data.tobytes(), ">")
    seeds = _direct(np.flatnonzero(marked & smaller), words, length)
    firsts = data[seeds]
    bounds = np.searchsorted(firsts, np.arange(257))
    larger = marked & ~smaller
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    none = np.zeros(0, np.int64)
    for c in range(256):
        front = np.concatenate(induced[c]) if induced[c] else none
        bucket = []
        while len(front):  # runs of one byte put their predecessors into their own bucket
            bucket.append(front)
            before = front - 1
            before = before[before >= 0]
            front = before[larger[before] & (data[before] == c)]
        bucket.append(seeds[bounds[c] : bounds[c + 1]])
        full = np.concatenate(bucket)
        if not len(full):
            continue
        order.append(full)
        before = full - 1
        before = before[before >= 0]
        before = before[larger[before] & (data[before] > c)]
        chars = data[before]
        before = before[np.argsort(chars, kind="stable")]
        chars = np.unique(chars)
        edges = np.searchsorted(data[before], chars)
        for k, ch in enumerate(chars.tolist()):
            end = edges[k + 1] if k + 1 < len(edges) else len(before)
            induced[ch].append(before[edges[k] : end])
    found = np.concatenate(order) if order else none
    return found[(found < n) & wanted[np.minimum(found, n - 1)]] if n else none


def _direct(places: np.ndarray, words: np.ndarray, length: int) -> np.ndarray:
    """Sort places by the bytes from there on, eight at a time; only ties go on."""
    limit = len(words) - 1
    key = words[places].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    out, key = places[order], key[order]
    group = np.cumsum(np.diff(key, prepend=key[:1]) != 0) if len(key) else key.astype(np.int64)
    active = np.arange(len(out))
    for at in range(8, length, 8):
        tied = np.zeros(len(active), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        active, group = active[tied], group[tied]
        if not len(active):
            break
        key = words[np.minimum(out[active] + at, limit)].astype(np.uint64)
        order = np.lexsort((key, group))
        out[active] = out[active][order]
        key, group = key[order], group[order]
        group = np.cumsum((np.diff(key, prepend=key[:1]) != 0) | (np.diff(group, prepend=group[:1]) != 0))
    return out


def repeated_starts(runs: list[bytes], counts: list[int], length: int = LENGTH) -> np.ndarray:
    """For each of the first ``counts[i]`` windows of every run, one after the other: whether it occurs twice in all."""
    text = b"".join(runs)
    wanted = np.zeros(len(text), bool)
    begins = np.cumsum([0, *map(len, runs)])[:-1]
    places = np.concatenate([np.arange(b, b + c) for b, c in zip(begins, counts)]) if runs else np.zeros(0, np.int64)
    wanted[places] = True
    order = sorted_suffixes(text, wanted, length)
    words = _loads(text + bytes(length), ">")
    left, right = order[:-1], order[1:]
    alike = np.arange(len(left))
    for at in range(0, length, 8):
        at = min(at, length - 8)
        alike = alike[words[left[alike] + at] == words[right[alike] + at]]
    twice = np.zeros(len(text), bool)
    twice[left[alike]] = True
    twice[right[alike]] = True
    return twice[places]


#: What identifies a row: a hash of its id and text, and one of its text, 128 bits together.
_KEY = ["doc", "text_hash"]
_RUN = "array<struct<owner: bigint, content: bigint, start: int, n: int>>"


def _runs(docs: DataFrame, length: int) -> DataFrame:
    """``doc, text_hash, runs`` of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, columns = [], ([], [], [], [])
                for text in part.column("text").to_pylist():
                    data = text.encode("utf-8", "surrogatepass")
                    starts, counts, owners = owned_runs(data, 0, length)
                    contents = _content_hashes(data, starts, counts, length)
                    sizes.append(len(starts))
                    for column, values in zip(columns, (owners, contents, starts, counts)):
                        column.append(values)
                flat = [np.concatenate(c) if c else np.zeros(0) for c in columns]
                fields = [
                    pa.array(flat[0].astype(np.uint64).view(np.int64)),
                    pa.array(flat[1].astype(np.uint64).view(np.int64)),
                    pa.array(flat[2].astype(np.int32)),
                    pa.array(flat[3].astype(np.int32)),
                ]
                struct = pa.StructArray.from_arrays(fields, ["owner", "content", "start", "n"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc"), part.column("text_hash"), pa.ListArray.from_arrays(offsets, struct)],
                    ["doc", "text_hash", "runs"],
                )

    return docs.mapInArrow(run, f"doc bigint, text_hash bigint, runs {_RUN}")


def _single(rows: DataFrame, again: DataFrame, hot: list[int]) -> DataFrame:
    """One row of each id and text; ``again`` lists those that repeat, whose texts are combined before they move."""
    once = lookup(rows, again, _KEY, "left_anti", hot=hot).select(*_KEY, "text")
    return once.unionByName(lookup(rows, again, _KEY, "inner", hot=hot).groupBy(_KEY).agg(F.min("text").alias("text")))


def _contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The runs in ``wanted(doc, chosen)``, split by the second kind of owner: ``owner, content, at, second, n, run``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for text, chosen in zip(part.column("text").to_pylist(), part.column("chosen").to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    starts, counts, owners = owned_runs(data, 0, length)
                    contents = _content_hashes(data, starts, counts, length)
                    todo = {(c["owner"], c["content"]) for c in chosen}
                    keys = zip(owners.view(np.int64).tolist(), contents.view(np.int64).tolist())
                    for i, key in enumerate(keys):
                        if key not in todo:
                            continue
                        todo.remove(key)
                        whole = data[starts[i] : starts[i] + counts[i] + length - 1]
                        for at, n, second in zip(*(x.tolist() for x in owned_runs(whole, 1, length))):
                            signed = second - (1 << 64) if second >= 1 << 63 else second
                            rows.append((*key, at, signed, n, whole[at : at + n + length - 1]))
                columns = list(zip(*rows)) or [()] * 6
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)],
                    ["owner", "content", "at", "second", "n", "run"],
                )

    return (
        docs.join(wanted, "doc")
        .select("text", "chosen")
        .mapInArrow(run, "owner bigint, content bigint, at int, second bigint, n int, run binary")
    )


def _sorted(contexts: DataFrame, length: int) -> DataFrame:
    """``owner, content, first, last``: stretches of repeated windows, in places of the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        seen = group = None

        def out() -> pa.RecordBatch:
            found = []
            twice = repeated_starts([r[3] for r in held], [r[4] for r in held], length)
            begin = 0
            for owner, content, at, _, n in held:
                here = np.flatnonzero(np.diff(np.concatenate([[0], twice[begin : begin + n].view(np.int8), [0]])))
                found += [(owner, content, at + int(a), at + int(b) - 1) for a, b in zip(here[::2], here[1::2])]
                begin += n
            columns = list(zip(*found)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], ["owner", "content", "first", "last"]
            )

        def add(rows: list[tuple]) -> None:
            nonlocal size
            if len({r[1] for r in rows}) > 1:  # alone it has nothing to be compared with
                held.extend(rows)
                size += sum(len(r[3]) for r in rows)

        waiting: list[tuple] = []
        names = ("owner", "content", "at", "run", "n", "second")
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[:3] == seen:
                    continue  # one run of several equal documents is enough
                if (row[0], row[5]) != group:
                    add(waiting)
                    waiting, group = [], (row[0], row[5])
                    if size >= _BATCH:
                        yield out()
                        held.clear()
                        size = 0
                seen = row[:3]
                waiting.append(row[:5])
        add(waiting)
        if held:
            yield out()

    return (
        contexts.repartition("owner", "second")
        .sortWithinPartitions("owner", "second", "content", "at")
        .mapInArrow(run, "owner bigint, content bigint, first int, last int")
    )


def _counted(contexts: DataFrame, length: int) -> DataFrame:
    """The same as ``_sorted`` by counting windows, with no group in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "run"):
                ns = part.column("n").to_numpy()
                hashes = [
                    xxhash.xxh3_64_intdigest(view[k : k + length])
                    for data, n in zip(part.column("run").to_pylist(), ns.tolist())
                    for view in (memoryview(data),)
                    for k in range(n)
                ]
                at = np.repeat(part.column("at").to_numpy(), ns)
                place = at + np.arange(len(at)) - np.repeat(np.cumsum(ns) - ns, ns)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[pa.array(np.repeat(part.column(c).to_numpy(), ns)) for c in ("owner", "second", "content")],
                        pa.array(place.astype(np.int32)),
                        pa.array(np.array(hashes, np.uint64).view(np.int64)),
                    ],
                    ["owner", "second", "content", "place", "window"],
                )

    keys = ["owner", "second", "window"]
    single = contexts.dropDuplicates(["owner", "content", "at"]).select("owner", "second", "content", "at", "n", "run")
    schema = "owner bigint, second bigint, content bigint, place int, window bigint"
    every = stored(single.mapInArrow(run, schema), "windows")
    twice = stored(every.groupBy(keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "twice")
    found = lookup(every, twice.select(keys), keys, "inner", hot=_hot(twice, keys))
    return (
        found.groupBy("owner", "content")
        .agg(F.array_sort(F.collect_set("place")).alias("places"))
        .select("owner", "content", F.posexplode("places").alias("turn", "place"))
        .groupBy("owner", "content", F.col("place") - F.col("turn"))
        .agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .select("owner", "content", "first", "last")
    )


def _hot(counted: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the keys with too many rows for one task, from rows with their number ``rows``."""
    total = counted.agg(F.sum("rows")).first()[0] or 0
    hot = counted.filter(F.col("rows") > max(HOT_ROWS, total // HOT_GROUPS))
    return sorted(r[0] for r in hot.select(key_hash(keys)).collect())


def remove_repeats(docs: DataFrame, length: int = LENGTH, carry_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs(doc_id, text)``, and ``kept`` if wanted.

    ``kept`` holds the remaining bytes, which may not be whole characters.
    """
    if length % 8 or length < 2 * GRAM:
        raise ValueError(f"length must be a multiple of 8 and at least {2 * GRAM}")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    # Rows without an id, or with one id, are told apart by their texts, so their contents do not meet in one place.
    rows = rows.withColumn("doc", F.xxhash64("doc_id", "text_hash"))
    scanned = stored(_runs(rows.select("doc", "text_hash", "text"), length), "runs")
    every = scanned.select("doc", "text_hash", F.inline("runs"))
    counted = scanned.filter(F.size("runs") > 0).groupBy(_KEY).agg(F.count(F.lit(1)).alias("rows"))
    again = stored(counted.filter("rows > 1"), "again")
    copied = _hot(again, _KEY)
    owners = stored(
        every.groupBy("owner")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("content").alias("low"), F.max("content").alias("high"))
        .filter("rows > 1")
        .select("owner", "rows", (F.col("low") != F.col("high")).alias("differ")),
        "owners",
    )
    repeated = stored(
        lookup(every, owners.select("owner", "differ"), ["owner"], "inner", hot=_hot(owners, ["owner"])), "repeated"
    )
    contents = stored(
        repeated.filter("differ")
        .groupBy("owner", "content")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("doc").alias("doc")),
        "contents",
    )
    chosen = contents.groupBy("doc").agg(F.collect_list(F.struct("owner", "content")).alias("chosen"))
    texts = _single(rows, again.select(_KEY), copied) if again.head(1) else rows
    contexts = stored(_contexts(texts, chosen, length), "contexts")
    pair = ["owner", "second"]
    crowded = stored(
        contexts.groupBy(pair).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > CROWDED), "crowded"
    )
    found = _sorted(contexts, length)
    if crowded.head(1):
        marked = stored(
            lookup(
                contexts, crowded.select(*pair, F.lit(True).alias("crowded")), pair, "left", hot=_hot(crowded, pair)
            ),
            "marked",
        )
        found = _sorted(marked.filter("crowded IS NULL").drop("crowded"), length).unionByName(
            _counted(marked.filter("crowded"), length)
        )
    stretches = (
        found.groupBy("owner", "content")
        .agg(F.collect_list(F.struct("first", "last")).alias("stretches"))
    )
    judged = contents.join(stretches, ["owner", "content"], "left").select(
        "owner", "content", (F.col("rows") > 1).alias("whole"), "stretches"
    )
    known = lookup(
        repeated.filter("differ"),
        stored(judged, "judged"),
        ["owner", "content"],
        "inner",
        hot=_hot(contents, ["owner", "content"]),
    )
    entire = F.array(F.struct(F.col("start").alias("first"), (F.col("start") + F.col("n") - 1).alias("last")))
    moved = F.transform(
        F.coalesce("stretches", F.array().cast("array<struct<first: int, last: int>>")),
        lambda s: F.struct(
            (F.col("start") + s["first"]).alias("first"), (F.col("start") + s["last"]).alias("last")
        ),
    )
    covered = (
        repeated.filter("NOT differ")
        .select("doc", "text_hash", F.inline(entire))
        .unionByName(known.select("doc", "text_hash", F.inline(F.when(F.col("whole"), entire).otherwise(moved))))
        .groupBy(_KEY)
        .agg(F.collect_set(F.struct("first", "last")).alias("covered"))
    )

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, spans in zip(part.column("text").to_pylist(), part.column("covered").to_pylist()):
                    data = text.encode("utf-8", "surrogatepass")
                    kept, at, runs, end = [], 0, 0, -1
                    for span in sorted((s["first"], s["last"] + length) for s in spans or ()):
                        if span[0] > end:
                            kept.append(data[at : span[0]])
                            runs += 1
                        end = at = max(end, span[1])
                    kept.append(data[at:])
                    rest = b"".join(kept)
                    out.append((len(data), len(data) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest))
                columns = list(zip(*out))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                wide = 5 if carry_text else 4
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns[:wide], types[:wide])]],
                    ["doc_id", *names[:wide]],
                )

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return (
        lookup(rows, covered, _KEY, "left", hot=copied)
        .select("doc_id", "text", "covered")
        .mapInArrow(cut_out, schema + (", kept binary" if carry_text else ""))
    )
