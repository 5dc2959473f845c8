"""Personal data with offset-preserving deobfuscation (operator 7)."""

from __future__ import annotations

import bisect
import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
# A match can only begin where a run of digits does, so the look-behind changes no match; it keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@label(.label)+, found from each @ so that long words stay linear."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the four base patterns; matches that fail their check are dropped without another try."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters that look like Latin ones (Cyrillic, then Greek), and what they look like.
LOOKALIKES = dict(zip("авеікмнорстухјѕԁһАВЕІКМНОРСТУХЈЅ" + "ορνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abeikmhopctyxjsdhABEIKMHOPCTYXJS" + "opvikABEZHIKMNOPTYX", strict=True))
NUMBERS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
INVISIBLE = "​‌‍⁠﻿­"

_NUM = "(?:" + "|".join(NUMBERS) + ")"
_OPEN, _CLOSE = r"\s?[\[({<]\s?", r"\s?[\])}>]\s?"
_DOT = rf"(?:{_OPEN}(?:dot|\.){_CLOSE}|\s+dot\s+)"
_GAP = r"[\s,-]{1,3}"
# The transducer's moves, first rule first; what none of them takes is copied.
_MOVES = re.compile(
    rf"(?P<number>(?<![A-Za-z])(?:plus{_GAP})?{_NUM}(?:(?:{_GAP}|{_DOT}|\.){_NUM})+(?![A-Za-z]))"
    rf"|(?P<at>{_OPEN}(?:at|@){_CLOSE}|(?<=[A-Za-z0-9_%+-])\s+at\s+(?=[A-Za-z0-9-]+{_DOT}[A-Za-z0-9-]))"
    rf"|(?P<dot>(?<=[A-Za-z0-9-]){_DOT}(?=[A-Za-z0-9-]))"
    rf"|(?P<glyph>[^\x00-\x7f])",
    re.IGNORECASE,
)
_NUMBER_PARTS = re.compile(rf"(?P<plus>plus{_GAP})|(?P<num>{_NUM})|(?P<dot>{_DOT}|\.)|(?P<gap>{_GAP})", re.IGNORECASE)
# What any move but a glyph's must hold: a bracketed sign, ' dot ' in any white space, or two number words in a row.
_BRACKETED = re.compile(r"[\[({<]\s?(?:at|dot|@|\.)\s?[\])}>]")
_SPACED_DOT = re.compile(r"\sdot\s")
_SPELLED = re.compile(rf"{_NUM}(?:{_GAP}|\.){_NUM}")
#: Letters that a pattern takes for i and s when it ignores case, though lower() does not make them so.
_FOLDED = str.maketrans("İıſ", "iis")


@lru_cache(maxsize=1 << 16)
def plain_glyph(c: str) -> str:
    """The ASCII text that a character imitates, '' for invisible ones, itself if it imitates none."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in INVISIBLE:
        return ""
    digit = unicodedata.digit(c, None)
    if digit is not None:
        return str(digit)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() and not folded.isspace() else c


def disguised(text: str) -> bool:
    """Whether any of the transducer's moves could be taken: a cheap look that is never narrower than they are."""
    if not text.isascii():
        if any(plain_glyph(c) != c for c in set(text) if c > "\x7f"):
            return True
        text = text.translate(_FOLDED)
    low = text.lower()
    return bool(_BRACKETED.search(low) or "dot" in low and _SPACED_DOT.search(low) or _SPELLED.search(low))


def transduce(text: str) -> tuple[str, list[int], list[int], list[int]]:
    """Normalised text; and for its pieces where each begins, where its source begins, and where that ends (-1: copied)."""
    out, begins, sources, ends, size, last = [], [], [], [], 0, 0

    def put(piece: str, start: int, end: int) -> None:
        nonlocal size
        if piece:
            out.append(piece)
            begins.append(size)
            sources.append(start)
            ends.append(end)
            size += len(piece)

    for m in _MOVES.finditer(text):
        if m.lastgroup == "glyph" and plain_glyph(m[0]) == m[0]:
            continue
        put(text[last : m.start()], last, -1)
        if m.lastgroup == "number":
            for part in _NUMBER_PARTS.finditer(text, m.start(), m.end()):
                piece = {"plus": "+", "dot": ".", "gap": ""}.get(part.lastgroup) if part.lastgroup != "num" else NUMBERS[part[0].translate(_FOLDED).lower()]
                put(piece, part.start(), part.end())
        else:
            put({"at": "@", "dot": "."}.get(m.lastgroup) or plain_glyph(m[0]), m.start(), m.end())
        last = m.end()
    put(text[last:], last, -1)
    return "".join(out), begins, sources, ends


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of identifiers that show only in the normalised text, in source offsets.

    A span counts if something rewritten or left out lies in it and it is not equal to or
    inside a base span of its kind: a disguise that splits an identifier leaves a base
    span on a part of it, and the whole is added.
    """
    if not disguised(text):
        return []
    plain, begins, sources, ends = transduce(text)
    found = []
    for start, kind, end in base_spans(plain):
        a, b = bisect.bisect_right(begins, start) - 1, bisect.bisect_right(begins, end - 1) - 1
        if a == b and ends[a] < 0:  # two copied pieces meet only where invisible characters were between them
            continue
        source = sources[a] + (start - begins[a] if ends[a] < 0 else 0)
        source_end = ends[b] if ends[b] >= 0 else sources[b] + end - begins[b]
        if not any(k == kind and s <= source and source_end <= e for s, k, e in base):
            found.append((source, kind, source_end))
    return found


def described(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for every row of docs(doc_id, text).

    The counts and base_sha256 are of the base patterns; spans also has the n_added ones
    that deobfuscation finds (look-alike letters and digits, invisible characters,
    spelled digits, at/dot disguises). Offsets are code points of the source text, end
    exclusive. Null counts as empty; texts are taken whole; repeated rows are kept; other
    columns are ignored; an empty table gives an empty result.
    """
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base)
                n = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                rows.append((*n, hashlib.sha256(described(base).encode()).hexdigest(), described(base + more), len(more)))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type(docs)}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every found span of text replaced by [EMAIL], [IP], [CARD] or [PHONE] (overlaps: the first begun, widened).

    Other columns and the column order stay; null text stays null; n_chars, if there, is
    the new length.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redacted(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def redacted(text: str | None) -> str | None:
    if not text:
        return text
    base = base_spans(text)
    out, last, pending = [], 0, None
    for start, kind, end in [*sorted(base + added_spans(text, base)), (len(text) + 1, 0, 0)]:
        if pending and start < pending[2]:
            pending = (pending[0], pending[1], max(end, pending[2]))
            continue
        if pending:
            out += [text[last : pending[0]], f"[{KINDS[pending[1]].upper()}]"]
            last = pending[2]
        pending = (start, kind, end)
    return "".join([*out, text[last:]])
