"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

Texts are cut into windows of eight words, and every window is compressed twice, after each dictionary. A window that
comes out shorter after the toxic dictionary holds what is typical of toxic text. How many windows do, by one byte and by
two, is set against what ordinary documents of that length have by chance; a logistic curve calibrated on other labelled
documents turns the excess into a score.

Dictionaries are trained by choosing their content from the texts of their class. Candidates are all strings of six and
eight bytes of a text's words joined by spaces, so parts of words and strings that reach over several words count too. A
likelihood-ratio test (G²) finds those typical of a class. The passages of the class's texts that consist of typical
strings make its dictionary, after the words common to both classes that hold none. Both are equally long, so common words
stand equally far from a window, and windows differ in length by typical passages only. Matches take six bytes at least.
Windows of ordinary training documents without a typical string that come out shorter by mistake are put into both.

Labels are learned from a bounded sample: the ``SAMPLE_ROWS`` rows of each label with the smallest hashes; half of them
give the passages and half the curve. Strings, passages and words that reach the driver are bounded by the dictionaries'
sizes. Scoring reads every whole text in one pass without a shuffle.

Defined results: NULL and empty texts have no windows and get the score of a document without evidence;
rows with a NULL label are no examples; without examples of both labels, or without typical strings, every document gets
the share of label 1, or 0 if there are no labels; repeated rows get equal scores; an empty table gives no rows; columns
of any name are carried in the struct ``doc``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmap.llm.common import draw_key, first_32_bits, map_arrow, slices, stored

#: Most labelled rows of each label that are learned from.
SAMPLE_ROWS = 4000
#: Bytes of typical passages and of common words in a dictionary, and of what follows as zstandard does not search the last ones.
TYPICAL_BYTES, COMMON_BYTES, TAIL_BYTES = 8192, 32768, 16
#: Windows of ordinary documents, mistaken at first, that are put into both dictionaries.
MISTAKEN_WINDOWS = 200
#: Words in a window, most bytes of a word.
WINDOW, WORD_BYTES = 8, 64
#: Bytes of candidate strings, and most bytes of a passage; longer ones are cut.
STRINGS, PASSAGE = (6, 8), 64
#: A string is typical if its G² reaches this, as one in about a quarter of a million does by chance.
LEAST_G2 = 20.0
_LEAST_ROWS = 5
_KEPT = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def text_words(text: str | None) -> list[bytes]:
    """Lower-cased words, cut where they are very long."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_KEPT).split()
    if max(map(len, words), default=0) <= WORD_BYTES:
        return words
    return [w[i : i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]


def windows(words: list[bytes]) -> list[bytes]:
    """Windows that cover all words; the last one overlaps, or is short."""
    starts = list(range(0, len(words) - WINDOW + 1, WINDOW))
    if len(words) % WINDOW:
        starts.append(max(0, len(words) - WINDOW))
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in starts]


def places(data: bytes) -> list[np.ndarray]:
    """The strings that start at each place, as numbers, for each of ``STRINGS``; data has no zero bytes."""
    every = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
    return [(every[: max(0, len(data) - n + 1)] & np.uint64((1 << 8 * n) - 1)).view(np.int64) for n in STRINGS]


def strings(data: bytes) -> np.ndarray:
    """Distinct strings of ``data``."""
    return np.unique(np.concatenate(places(data)))


def joined(words: Sequence[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" " if words else b""


def passages(data: bytes, typical: np.ndarray) -> set[bytes]:
    """Stretches of ``data`` that strings in ``typical`` cover."""
    edges = np.zeros(len(data) + 1, np.int64)
    for n, found in zip(STRINGS, places(data)):
        at = np.flatnonzero(np.isin(found, typical))
        np.add.at(edges, at, 1)
        np.add.at(edges, at + n, -1)
    held = np.diff(np.concatenate([[0], np.cumsum(edges) > 0, [0]]).astype(np.int8))
    spans = zip(np.flatnonzero(held == 1).tolist(), np.flatnonzero(held == -1).tolist())
    most = max(STRINGS)  # pieces overlap, so that no string is cut
    return {data[k : min(k + PASSAGE, b)] for a, b in spans for k in range(a, max(a + 1, b - most), PASSAGE - most)}


def compressor(content: bytes):
    """A function that compresses after a dictionary of ``content``."""
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters(
        window_log=18,
        hash_log=17,
        chain_log=17,
        search_log=6,
        min_match=6,
        target_length=64,
        strategy=zstandard.STRATEGY_BTLAZY2,
        write_content_size=False,
        write_dict_id=False,
    )
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings).compress


@dataclass(frozen=True)
class Model:
    """Two dictionaries, the share of windows with a gain by chance (by one byte, by two), and the calibrated curve."""

    toxic: bytes
    ordinary: bytes
    chance: tuple[float, float]
    curve: tuple[float, ...]

    def evidence(self, text: str | None, after_toxic, after_ordinary) -> tuple[int, int, int]:
        """Number of windows, and of those that are a byte, or two, shorter after the toxic dictionary."""
        number = one = two = 0
        for window in windows(text_words(text)):
            gain = len(after_ordinary(window)) - len(after_toxic(window))
            number += 1
            one += gain >= 1
            two += gain >= 2
        return number, one, two


def _excess(hits, number, chance: float, lib):
    """How far ``hits`` lie above what chance gives, in about standard deviations, on a logarithmic scale."""
    return lib.log1p(lib.maximum(0.0, (hits - number * chance) / lib.sqrt(number * chance + 0.25)))


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, held back a little except for its constant."""
    hold = np.diag([1e-6, 1e-2, 1e-2])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (y - p)) - hold @ beta
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + hold
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return beta


def _g2(a: str, n: str, b: str, m: str):
    """Signed likelihood ratio of ``a`` of ``n`` against ``b`` of ``m``, as SQL; positive if the first is larger."""
    part = lambda k, size: f"if({k} = 0, 0D, {k} * ln({k} * ({n} + {m}) / (({a} + {b}) * {size})))"
    return f"2 * ({part(a, n)} + {part(b, m)}) * if({a} / {n} >= {b} / {m}, 1D, -1D)"


def _evidence(rows: DataFrame, model: Model, text: str, carry: Sequence[str]) -> DataFrame:
    """``doc, number, one, two`` of every row."""
    chosen = rows.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("doc"), F.col(f"`{text}`").alias("text"))
    doc = chosen.schema["doc"].dataType.simpleString()
    held: list = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.extend((compressor(model.toxic), compressor(model.ordinary)))
        found = [model.evidence(t, *held) for part in slices(batch, "text") for t in part.column("text").to_pylist()]
        columns = list(zip(*found)) or [()] * 3
        return pa.RecordBatch.from_arrays(
            [batch.column("doc"), *[pa.array(c, pa.int64()) for c in columns]], ["doc", "number", "one", "two"]
        )

    return map_arrow(chosen, run, f"doc {doc}, number bigint, one bigint, two bigint")


def _mistaken(rows: DataFrame, model: Model, typical: np.ndarray) -> DataFrame:
    """``window``: windows that are shorter after the toxic dictionary and hold no typical string."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        after_toxic, after_ordinary = compressor(model.toxic), compressor(model.ordinary)
        every = (w for text in batch.column("text").to_pylist() for w in windows(text_words(text)))
        shorter = (w for w in every if len(after_toxic(w)) < len(after_ordinary(w)))
        return pa.RecordBatch.from_arrays(
            [pa.array([w for w in shorter if not np.isin(strings(w), typical).any()], pa.binary())], ["window"]
        )

    return map_arrow(rows.select("text"), run, "window binary")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, label)`` with labels 0 and 1."""
    known = labels.filter("label IN (0, 1) AND doc_id IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("label").cast("int").alias("label")
    )
    seen = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(seen.values())
    share = seen.get(1, 0) / total if total else 0.0
    flat = math.log((share + 1e-9) / (1 - share + 1e-9)) if total else -40.0
    nothing = Model(b"", b"", (0.0, 0.0), (flat, 0.0, 0.0))
    if len(seen) < 2:
        return nothing
    turn = draw_key("toxicity", F.col("doc_id"))
    chosen = None
    for label in (0, 1):  # at most sample_rows rows each
        part = known.filter(F.col("label") == label).withColumn("turn", turn).orderBy("turn", "doc_id").limit(sample_rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    # Of several texts under one id, the one with the smallest hash.
    sample = sample.groupBy("doc_id", "label", "turn").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = stored(sample.withColumn("half", first_32_bits(F.col("turn")) % 2), "sample")

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: tuple[list, list] = ([], [])
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            found[label].append(strings(joined(text_words(text))))
        none = np.zeros(0, np.int64)
        ordinary, toxic = (np.unique(np.concatenate([none, *f]), return_counts=True) for f in found)
        columns = [
            np.concatenate([ordinary[0], toxic[0]]),
            np.concatenate([np.zeros_like(ordinary[1]), toxic[1]]),
            np.concatenate([ordinary[1], np.zeros_like(toxic[1])]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["string", "a", "b"])

    def distinct_words(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [word for text in batch.column("text").to_pylist() for word in set(text_words(text))]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], ["word"])

    first = sample.filter("half = 0")
    size = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    if len(size) < 2:
        return nothing
    counts = stored(
        map_arrow(first.select("label", "text"), counted, "string bigint, a bigint, b bigint")
        .groupBy("string")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        .filter(f"a + b >= {_LEAST_ROWS}")
        .withColumn("g2", F.expr(_g2("a", f"{size[1]}D", "b", f"{size[0]}D")))
        .filter(F.abs("g2") >= LEAST_G2),
        "counts",
    )
    typical = {}
    for label, sign in ((1, 1), (0, -1)):
        top = counts.filter(sign * F.col("g2") > 0).orderBy((sign * F.col("g2")).desc(), "string")
        # No more strings than start in a dictionary's typical bytes.
        best = {r["string"]: abs(r["g2"]) for r in top.limit(len(STRINGS) * TYPICAL_BYTES).collect()}
        typical[label] = dict(sorted(best.items()))
    if not typical[1]:
        return nothing
    known_strings = {label: np.fromiter(best, np.int64, len(best)) for label, best in typical.items()}
    known_g2 = {label: np.fromiter(best.values(), float, len(best)) for label, best in typical.items()}

    def typical_passages(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [
            (label, passage, float(known_g2[label][np.isin(known_strings[label], strings(passage))].max(initial=0)))
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist())
            for passage in passages(joined(text_words(text)), known_strings[label])
        ]
        columns = list(zip(*found)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.float64()))], ["label", "passage", "best"]
        )

    taken = stored(
        map_arrow(first.select("label", "text"), typical_passages, "label int, passage binary, best double")
        .groupBy("label", "passage")
        .agg((F.count(F.lit(1)) * F.max("best")).alias("weight")),
        "passages",
    )

    def content(parts: list[bytes], gap: bytes) -> bytes:
        return gap.join([b"", *reversed(parts), b""])  # what matters most comes last, nearest to the window

    def trained(label: int) -> bytes:
        """The weightiest passages, each with a string that those before it lack."""
        top = taken.filter(F.col("label") == label).orderBy(F.col("weight").desc(), "passage").limit(TYPICAL_BYTES)
        chosen_passages, held, length = [], set(), 1
        for passage in (bytes(r["passage"]) for r in top.collect()):
            new = typical[label].keys() & set(strings(passage).tolist())
            if new - held and length + len(passage) + 1 <= TYPICAL_BYTES:
                chosen_passages.append(passage)
                held |= new
                length += len(passage) + 1
        return content(chosen_passages, b"\0")

    ends = [trained(label) for label in (1, 0)]
    every_typical = typical[0].keys() | typical[1].keys()
    often = map_arrow(first.select("text"), distinct_words, "word binary").groupBy("word").count()
    often = often.filter(f"count >= {_LEAST_ROWS}").orderBy(F.col("count").desc(), "word").limit(COMMON_BYTES)
    common = [bytes(r["word"]) for r in often.collect()]
    shared = content([w for w in common if every_typical.isdisjoint(strings(joined([w])).tolist())], b" ")[-COMMON_BYTES:]

    def built(extra: bytes) -> Model:
        wide = max(map(len, ends))
        contents = (shared + extra + end.rjust(wide, b"\0") + bytes(TAIL_BYTES) for end in ends)
        return Model(*contents, (0.0, 0.0), (flat, 0.0, 0.0))

    model = built(b"")
    wrong = _mistaken(first.filter("label = 0"), model, known_strings[1]).groupBy("window").count()
    wrong = wrong.orderBy(F.col("count").desc(), "window").limit(MISTAKEN_WINDOWS).collect()
    model = built(b"".join(bytes(r["window"]) for r in wrong))
    toxic, ordinary = model.toxic, model.ordinary

    found = _evidence(sample.filter("half = 1"), model, "text", ["label"])
    found = found.select("doc.label", "number", "one", "two").toPandas()  # at most 2 * sample_rows rows
    y = found["label"].to_numpy(float)
    if len(set(y)) < 2:
        return model
    number, one, two = (found[c].to_numpy(float) for c in ("number", "one", "two"))
    plain = y == 0
    chance = tuple(float((hits[plain].sum() + 0.5) / (number[plain].sum() + 1)) for hits in (one, two))
    x = np.stack([np.ones(len(y)), _excess(one, number, chance[0], np), _excess(two, number, chance[1], np)], axis=1)
    # The sample holds as many rows of either label; weights give back their shares.
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(toxic, ordinary, chance, tuple(map(float, _fit_curve(x, y, weight))))


class _Native:
    """The functions of ``_excess`` on columns."""

    log1p, sqrt = staticmethod(F.log1p), staticmethod(F.sqrt)

    @staticmethod
    def maximum(a, b):
        return F.greatest(F.lit(a), b)


def score(docs: DataFrame, model: Model, carry: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """``doc, score``: how likely label 1 is, from 0 to 1."""
    found = _evidence(docs, model, text, docs.columns if carry is None else carry)
    number, x = F.col("number").cast("double"), F.lit(model.curve[0])
    for hits, chance, slope in zip(("one", "two"), model.chance, model.curve[1:]):
        x = x + F.lit(slope) * _excess(F.col(hits).cast("double"), number, chance, _Native)
    return found.select("doc", (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x))))).alias("score"))
