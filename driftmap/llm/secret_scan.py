"""Secret scans: patterns, and sliding-window Shannon entropy per character class.

Candidate strings are runs of one character class (hexadecimal digits, the base-64 alphabet, digits with small letters or
with capitals, letters of two cases or, with the highest bar, of one). A window slides over
each run; its entropy follows from the counts of its characters, which change by one character in and one out per step.
Windows above the class's threshold are joined to spans. Spans that an allow-list pattern covers (identifiers, digests,
placeholders, alphabets) are suppressed. What earlier spans cover is cut out of a span; what is left counts if it is
suspicious by itself.

Every text is scanned whole, in one pass without a shuffle. Defined results: a NULL or empty text has no spans; repeated
rows give repeated results; an empty table gives no rows; columns of any name are carried in the struct ``doc``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmap.llm.common import map_arrow, slices

#: Fixed patterns of the base kinds, and the least length of what must be long.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20


@dataclass(frozen=True)
class CharacterClass:
    """A class of characters with the window and the entropy, in bits, from which a window is suspicious.

    ``needs`` are patterns of which each must occur in a suspicious window: ordinary words lack digits or capitals.
    """

    kind: str
    run: re.Pattern
    width: int
    bits: float
    needs: tuple[re.Pattern, ...] = ()


CLASSES = (
    CharacterClass(
        "entropy_hex",
        re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}"),
        20,
        3.0,
        (re.compile(r"[0-9]"), re.compile(r"[A-Fa-f]")),
    ),
    CharacterClass(
        "entropy_base64",
        re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"),
        20,
        3.6,
        (re.compile(r"[0-9]"), re.compile(r"[A-Z]"), re.compile(r"[a-z]")),
    ),
    CharacterClass(
        "entropy_base36",
        re.compile(r"(?<![0-9a-z])[0-9a-z]{20,}"),
        20,
        3.5,
        (re.compile(r"[0-9]"), re.compile(r"[a-z]")),
    ),
    CharacterClass(
        "entropy_base32",
        re.compile(r"(?<![0-9A-Z])[0-9A-Z]{16,}"),
        16,
        3.2,
        (re.compile(r"[0-9]"), re.compile(r"(?:[A-Z][^A-Z]*+){4}")),
    ),
    CharacterClass(
        "entropy_letters",
        re.compile(r"(?<![A-Za-z])[A-Za-z]{24,}"),
        24,
        3.9,
        (re.compile(r"(?:[A-Z][^A-Z]*+){7}"), re.compile(r"(?:[a-z][^a-z]*+){7}")),
    ),
    CharacterClass("entropy_one_case", re.compile(r"(?<![A-Za-z])(?:[a-z]{32,}|[A-Z]{32,})"), 32, 4.0),
)
#: Strings that look random and are no secrets.
ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"),
    re.compile(r"\b(?:md5|sha(?:1|224|256|384|512))[:=-][A-Za-z0-9+/=]+", re.IGNORECASE),
    re.compile(r"[A-Za-z0-9+/_=-]*(?:EXAMPLE|example)[A-Za-z0-9+/_=-]*"),
    re.compile(r"[A-Za-z]*(?:ABCDEFGH|abcdefgh)[A-Za-z]*"),
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
_ORDER = {kind: i for i, kind in enumerate(KINDS)}

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans ``(start, end, kind)`` of the patterns, leftmost and without overlap within a kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


def window_entropies(run: str, width: int) -> Iterator[float]:
    """Entropy in bits of every window of ``width`` characters, from counts updated by one character at a time."""
    weight = [0.0] + [n * math.log2(n) for n in range(1, width + 2)]
    counts: dict[str, int] = {}
    total = 0.0
    top = math.log2(width)
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += weight[n + 1] - weight[n]
        counts[c] = n + 1
        if i >= width:
            old = run[i - width]
            n = counts[old]
            total += weight[n - 1] - weight[n]
            counts[old] = n - 1
        if i >= width - 1:
            yield top - total / width


def entropy_spans(text: str, cls: CharacterClass) -> list[Span]:
    """Unions of the suspicious windows of one class."""
    found: list[Span] = []
    for m in cls.run.finditer(text):
        run, at = m[0], m.start()
        if not all(p.search(run) for p in cls.needs):
            continue
        start = end = None
        for i, bits in enumerate(window_entropies(run, cls.width)):
            if bits < cls.bits or not all(p.search(run, i, i + cls.width) for p in cls.needs):
                continue
            if end is not None and i > end:
                found.append((at + start, at + end, cls.kind))
                start = None
            start = i if start is None else start
            end = i + cls.width
        if start is not None:
            found.append((at + start, at + end, cls.kind))
    return found


def _left(start: int, end: int, taken: Sequence[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a span that the sorted spans in ``taken`` leave."""
    for a, b in taken:
        if a < end and start < b:
            if start < a:
                yield start, a
            start = b
    if start < end:
        yield start, end


def all_spans(
    text: str, classes: Sequence[CharacterClass] = CLASSES, allowed: Sequence[re.Pattern] = ALLOWED
) -> list[Span]:
    """Base spans, and what they and earlier classes leave of entropy spans that no allowed string holds; in order."""
    found = base_spans(text)
    for cls in classes:
        spans = entropy_spans(text, cls)
        if not spans:
            continue
        known = [m.span() for p in allowed for m in p.finditer(text)]
        taken = sorted((x, y) for x, y, _ in found)
        for a, b, _ in spans:
            if any(x <= a and b <= y for x, y in known):
                continue
            for start, end in _left(a, b, taken):
                if (start, end) == (a, b):
                    found.append((a, b, cls.kind))
                else:
                    found += [
                        (start + x, start + y, kind)
                        for x, y, kind in entropy_spans(text[start:end], cls)
                        if not any(k <= start + x and start + y <= m for k, m in known)
                    ]
    return sorted(found, key=lambda s: (s[0], _ORDER[s[2]]))


def scan(docs: DataFrame, text: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """``doc, spans`` with spans as ``start, end, kind`` in code points, ``end`` exclusive."""
    kept = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"), F.col(f"`{text}`").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = []
        for part in slices(batch, "text"):
            for t in part.column("text").to_pylist():
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in all_spans(t or "")])
        return pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(spans, kind)], ["doc", "spans"])

    doc = rows.schema["doc"].dataType.simpleString()
    return map_arrow(rows, run, f"doc {doc}, spans array<struct<start: int, end: int, kind: string>>")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))
