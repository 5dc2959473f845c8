"""Alignment of two tokenizers over every document by composing fragments (operator 12)."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce
from itertools import chain, count, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import discard, id_type, materialise

#: A text of more bytes is dealt to several tasks, a byte range of this length each.
CHUNK = 1 << 16
#: Fragments that one step of the tree composes.
FAN = 8
#: Pair counts of at most this many pairs (some 60 MB) are broadcast; larger tables are shuffled.
BROADCAST_PAIRS = 1_000_000
#: Characters and entries of known units after which a worker forgets them.
UNIT_SPACE = 96 << 20
#: Units of at most this many characters are aligned together; longer texts than QUICK_LENGTH are left to the file's own library.
BRIEF, QUICK_LENGTH = 64, 10_000
#: Before such a space tokens of both kinds begin: it stands between characters that are no white space.
BREAK = re.compile(r"(?<=\S) (?=\S)")


@dataclass(frozen=True)
class Files:
    """Paths of the byte-level BPE (A) and the piece BPE (B); the driver reads them once."""

    a: str = public_tokenizers.path("byte_bpe_50k.json")
    b: str = public_tokenizers.path("piece_bpe_32k.model")

    def read(self) -> tuple[bytes, bytes]:
        with open(self.a, "rb") as a, open(self.b, "rb") as b:
            return a.read(), b.read()


def byte_alphabet() -> dict[str, int]:
    """The byte for each character in which a byte-level vocabulary writes it: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers in one worker. Texts are encoded as a space and the text."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_buffer(a)
        self.a.encode_special_tokens = True
        self.quick = ranked(json.loads(a))
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        letter = byte_alphabet()
        self.bytes_a = {i: bytes(letter[c] for c in t) if set(t) <= letter.keys() else t.encode() for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}
        self.size_a, self.size_b = (np.array([len(by.get(i, b"")) for i in range(max(by) + 1)]) for by in (self.bytes_a, self.bytes_b))
        # texts may be cut at BREAK only if no piece goes on with a space after something else
        assert not any("▁" in p.lstrip("▁") for _, p in pieces)

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        if self.quick and max(map(len, texts), default=0) <= QUICK_LENGTH:
            return [self.quick.encode_ordinary(" " + t) for t in texts]
        return [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)

    def fits(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the tokens of both give the text's bytes back."""
        return b"".join([self.bytes_a[i] for i in a]) == b" " + text.encode() == b"".join([self.bytes_b[i] for i in b])

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of A, ids of B, and whether they fit."""
        for text, a, b in zip(texts, self.ids_a(texts), self.ids_b(texts), strict=True):
            yield a, b, self.fits(text, a, b)

    def ends(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """The byte offset at which each token ends."""
        return np.cumsum(self.size_a[a]).tolist() if a else [], np.cumsum(self.size_b[b]).tolist() if b else []


def ranked(file: dict) -> tiktoken.Encoding | None:
    """The same byte-level BPE for short texts, where it is faster: only if ids follow the order of merges and words are split by the usual pattern."""
    letter, vocabulary = byte_alphabet(), file["model"]["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
    order = [vocabulary["".join(m)] for m in merges]
    if file["normalizer"] or file["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or order != sorted(order):
        return None
    ranks = {bytes(letter[c] for c in t): i for t, i in vocabulary.items() if set(t) <= letter.keys()}
    return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def tokenizers(a: bytes, b: bytes) -> Pair:
    return Pair(a, b)


def closed_groups(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> tuple[list[tuple[list[int], list[int]]], int, int]:
    """The tokens up to each end that both share, and how many tokens of A and B stand before the last such end."""
    groups, i, k, at = [], 0, 0, dict(zip(ends_b, count(1)))
    for j, end in enumerate(ends_a, 1):
        if m := at.get(end):
            groups.append((a[i:j], b[k:m]))
            i, k = j, m
    return groups, i, k


def written(groups: list[tuple[list[int], list[int]]]) -> str:
    return ";".join([",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups])


def linked(groups: list[tuple[list[int], list[int]]]) -> Counter[int]:
    """Occurrences of each pair of ids (A's in the upper half) that share a group."""
    found: Counter[int] = Counter()
    for a, b in groups:
        if len(a) == 1 == len(b):
            found[a[0] << 32 | b[0]] += 1
        else:
            own = Counter(b).items()
            for i, m in Counter(a).items():
                for j, n in own:
                    found[i << 32 | j] += m * n
    return found


class Units:
    """Stretches between BREAKs, encoded and aligned once: no token and no group reaches over a BREAK."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str] = []  # the groups as written
        self.numbers = array("q")  # tokens of A, tokens of B, groups, fit: four a unit
        self.pairs, self.counts, self.at = array("q"), array("q"), array("q", [0])
        self.space = 0

    def keep(self, text: str, groups: str, numbers: tuple[int, int, int, int]) -> None:
        self.index[text] = len(self.text)
        self.text.append(groups)
        self.numbers.extend(numbers)
        self.space += len(text) + len(groups) + 200

    def add_single(self, text: str, a: list[int], b: list[int]) -> None:
        """A long unit, or one that does not fit."""
        ok = self.pair.fits(text, a, b)
        groups = closed_groups(a, b, *self.pair.ends(a, b))[0] if ok else []
        links = linked(groups)
        self.keep(text, written(groups), (len(a), len(b), len(groups), ok))
        self.pairs.extend(links.keys())
        self.counts.extend(links.values())
        self.at.append(len(self.pairs))

    def add(self, texts: list[str]) -> None:
        """Short units are aligned together, one behind the other: each ends where a token of both ends."""
        pair, brief = self.pair, [t for t in texts if len(t) <= BRIEF]
        for t in texts:
            if len(t) > BRIEF:
                self.add_single(t, pair.ids_a([t])[0], pair.ids_b([t])[0])
        ids_a, ids_b = pair.ids_a(brief), pair.ids_b(brief)
        size = np.array([len(t.encode()) + 1 for t in brief], np.int64)
        odd = [(sum_a, sum_b) != (n, n) for sum_a, sum_b, n in zip(*[self.lengths(ids, by) for ids, by in ((ids_a, pair.size_a), (ids_b, pair.size_b))], size.tolist(), strict=True)]
        whole = b"".join([b" " + t.encode() for t in brief])
        if any(odd) or any(b"".join([by[i] for x in ids for i in x]) != whole for ids, by in ((ids_a, pair.bytes_a), (ids_b, pair.bytes_b))):
            for t, a, b in zip(brief, ids_a, ids_b, strict=True):
                self.add_single(t, a, b)
            return
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (ids_a, ids_b))
        ends_a, ends_b, ends = np.cumsum(pair.size_a[flat_a]), np.cumsum(pair.size_b[flat_b]), np.cumsum(size)
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n_a, n_b = np.bincount(in_a, minlength=len(common)), np.bincount(in_b, minlength=len(common))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        times = n_b[in_a]  # each token of A meets all of B's in its group
        other = np.repeat(first_b[in_a] - np.cumsum(times) + times, times) + np.arange(times.sum())
        of = np.searchsorted(ends, ends_a)  # the unit of each token of A
        links = np.bincount(of, times, len(brief)).astype(np.int64)
        self.pairs.frombytes((np.repeat(flat_a, times) << 32 | flat_b[other]).tobytes())
        self.counts.frombytes(np.ones(len(other), np.int64).tobytes())
        self.at.frombytes((np.cumsum(links) + self.at[-1]).tobytes())
        parts = [f"{a}|{b}" for a, b in zip(flat_a[first_a].tolist(), flat_b[first_b].tolist(), strict=True)]
        for g in np.flatnonzero((n_a > 1) | (n_b > 1)).tolist():
            i, k = first_a[g], first_b[g]
            parts[g] = written([(flat_a[i : i + n_a[g]].tolist(), flat_b[k : k + n_b[g]].tolist())])
        cuts = [0, *np.searchsorted(common, ends, "right").tolist()]
        for t, a, b, i, j in zip(brief, ids_a, ids_b, cuts, cuts[1:], strict=False):
            self.keep(t, ";".join(parts[i:j]), (len(a), len(b), j - i, 1))

    @staticmethod
    def lengths(ids: list[list[int]], size: np.ndarray) -> list[int]:
        """The bytes of the tokens of each unit."""
        total = np.concatenate([[0], np.cumsum(size[np.fromiter(chain.from_iterable(ids), np.int64)])])
        return np.diff(total[np.cumsum([0, *map(len, ids)])]).tolist()

    def documents(self, texts: list[str | None]) -> list[tuple[list[int], str, np.ndarray, np.ndarray] | None]:
        """Numbers of tokens and groups, the groups as written, pairs and their counts; None where a text has no tokens."""
        split = [BREAK.split(t) if t else [] for t in texts]
        if self.space > UNIT_SPACE:
            self.clear()
        if new := list({u: 0 for units in split for u in units if u not in self.index}):
            self.add(new)
        numbers, pairs, counts, at = (np.frombuffer(x, np.int64) if x else np.zeros(0, np.int64) for x in (self.numbers, self.pairs, self.counts, self.at))
        numbers = numbers.reshape(-1, 4)
        found: list[tuple[list[int], str, np.ndarray, np.ndarray] | None] = []
        for units in split:
            of = [self.index[u] for u in units]
            own, times = np.unique(np.array(of, np.int64), return_counts=True)
            rows = numbers[own]
            if not units or not rows[:, 3].all():
                found.append(None)
                continue
            sizes = at[own + 1] - at[own]
            flat = np.repeat(at[own] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            key, place = np.unique(pairs[flat], return_inverse=True)
            total = np.bincount(place, counts[flat] * np.repeat(times, sizes), len(key)).astype(np.int64)
            found.append(((rows[:, :3] * times[:, None]).sum(axis=0).tolist(), ";".join([self.text[k] for k in of]), key, total))
        del numbers, pairs, counts, at  # else the arrays behind could not grow
        return found


@cache
def units(a: bytes, b: bytes) -> Units:
    return Units(tokenizers(a, b))


def ranges(text: str, chunk: int = CHUNK) -> Iterator[tuple[int, str, int, int]]:
    """Chunks of a space and the text: number, the text around a byte range from a BREAK to a BREAK, and the range's borders in that.

    Borders are multiples of `chunk`, wherever in a token they fall; of several in one
    stretch without a BREAK the first counts, so nothing is encoded more than twice.
    """
    parts = BREAK.split(text)
    ends = np.cumsum([len(p.encode()) + 1 for p in parts])
    borders = np.arange(chunk, ends[-1], chunk)
    inside = np.searchsorted(ends, borders, "right")  # the stretch that goes on after the border
    borders = borders[np.append(True, inside[1:] != inside[:-1])] if len(borders) else borders
    for k, (lo, hi) in enumerate(pairwise([0, *borders.tolist(), int(ends[-1])])):
        first, last = int(np.searchsorted(ends, lo, "right")), int(np.searchsorted(ends, hi, "left"))
        start = int(ends[first - 1]) if first else 0
        yield k, " ".join(parts[first : last + 1]), lo - start, hi - start


@dataclass
class Fragment:
    """What a byte range tells of the alignment: tokens before its first common end, and after its last.

    Without a common end all its tokens are in front. `closing` is the number of the
    chunk in which the front ends (-1: in none).
    """

    front_a: list[int]
    front_b: list[int]
    closing: int
    back_a: list[int]
    back_b: list[int]


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, tuple[int, list[int], list[int]] | None]:
    """The fragment of both ranges together (associative), and the group that closes between them with its chunk."""
    if left.closing < 0:
        return Fragment(left.front_a + right.front_a, left.front_b + right.front_b, right.closing, right.back_a, right.back_b), None
    a, b = left.back_a + right.front_a, left.back_b + right.front_b
    if right.closing < 0:
        return Fragment(left.front_a, left.front_b, left.closing, a, b), None
    return Fragment(left.front_a, left.front_b, left.closing, right.back_a, right.back_b), (right.closing, a, b)


def fragment(pair: Pair, chunk: int, text: str, lo: int, hi: int) -> tuple[Fragment, list[tuple[list[int], list[int]]], bool]:
    """The fragment of bytes lo to hi of a space and the text (tokens count where they end), its closed groups, and whether all bytes come back."""
    a: list[int] = []
    b: list[int] = []
    fit, parts = True, BREAK.split(text)
    known = dict(zip(dict.fromkeys(parts), pair.encode(list(dict.fromkeys(parts))), strict=True))
    for p in parts:
        own_a, own_b, ok = known[p]
        a += own_a
        b += own_b
        fit &= ok
    ends_a, ends_b = pair.ends(a, b)
    (i, j), (k, m) = ((bisect_right(e, lo), bisect_right(e, hi)) for e in (ends_a, ends_b))
    groups, in_a, in_b = closed_groups(a[i:j], b[k:m], ends_a[i:j], ends_b[k:m])
    if not groups:
        return Fragment(a[i:j], b[k:m], -1, [], []), [], fit
    return Fragment(*groups[0], chunk, a[i + in_a : j], b[k + in_b : m]), groups[1:], fit


_FRAGMENT = "front_a array<int>, front_b array<int>, closing int, back_a array<int>, back_b array<int>"
_GROUPS = "n_groups long, groups string, pairs array<long>, counts array<long>"


def _closed(groups: list[tuple[list[int], list[int]]]) -> dict:
    links = linked(groups)
    return {"n_groups": len(groups), "groups": written(groups), "pairs": list(links), "counts": list(links.values())}


def long_documents(docs: DataFrame, files: tuple[bytes, bytes], chunk: int) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups, pairs, counts of texts that are dealt to several tasks.

    Each chunk keeps the groups that it closes by itself; only its open ends climb the
    tree, FAN fragments a step, and every step yields the groups that close in it.
    """
    spark, kind = docs.sparkSession, id_type(docs)
    read = spark.sparkContext.broadcast(files)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, doc_id, text in zip(batch["row"], batch["doc_id"], batch["text"], strict=True):
                for k, part, lo, hi in ranges(text, chunk):
                    yield pd.DataFrame({"row": [row], "doc_id": [doc_id if k == 0 else None], "chunk": [k], "part": [part], "lo": [lo], "hi": [hi]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = tokenizers(*read.value)
        for batch in batches:
            for row, k, part, lo, hi in batch.itertuples(index=False):
                found, groups, fit = fragment(pair, k, part, lo, hi)
                n_a, n_b = (len(front) + len(back) + sum(len(g[s]) for g in groups) for s, (front, back) in enumerate(((found.front_a, found.back_a), (found.front_b, found.back_b))))
                yield pd.DataFrame([{"row": row, "chunk": k, "fit": fit, "n_a": n_a, "n_b": n_b} | vars(found) | _closed(groups)])

    def climb(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        none = dict.fromkeys(["row", "node", "chunk", *Fragment.__annotations__, "n_groups", "groups", "pairs", "counts"])
        closed = []

        def step(left: Fragment, right: Fragment) -> Fragment:
            both, group = compose(left, right)
            if group:
                closed.append(none | {"row": key[0], "chunk": group[0]} | _closed([group[1:]]))
            return both

        parts = [Fragment(r.front_a.tolist(), r.front_b.tolist(), r.closing, r.back_a.tolist(), r.back_b.tolist()) for r in rows.sort_values("node").itertuples()]
        both = reduce(step, parts)
        return pd.DataFrame([none | {"row": key[0], "node": key[1]} | vars(both), *closed], dtype=object)

    rows = docs.select((-1 - F.monotonically_increasing_id()).alias("row"), "doc_id", "text")
    chunks = materialise(rows.mapInPandas(cut, f"row long, doc_id {kind}, chunk int, part string, lo long, hi long"), "align-chunks")
    spread = chunks.select("row", "chunk", "part", "lo", "hi").repartition("row", "chunk")
    found = materialise(spread.mapInPandas(encode, f"row long, chunk int, fit boolean, n_a long, n_b long, {_FRAGMENT}, {_GROUPS}"), "align-fragments")
    nodes = found.filter("fit").select("row", F.col("chunk").alias("node"), "front_a", "front_b", "closing", "back_a", "back_b")
    closed, steps = [], []
    while steps == [] or nodes.filter("node > 0").limit(1).count():
        level = nodes.withColumn("up", F.expr(f"node div {FAN}"))
        both = level.groupBy("row", "up").applyInPandas(climb, f"row long, node int, chunk int, {_FRAGMENT}, {_GROUPS}")
        steps.append(materialise(both, "align-nodes"))
        closed.append(steps[-1].filter("node IS NULL").select("row", "chunk", "n_groups", "groups", "pairs", "counts"))
        nodes = steps[-1].filter("node IS NOT NULL").select("row", "node", "front_a", "front_b", "closing", "back_a", "back_b")

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                yield pd.DataFrame([{"row": r.row, "chunk": r.closing} | _closed([(r.front_a.tolist(), r.front_b.tolist())])])

    first = nodes.filter("closing >= 0").select("row", "closing", "front_a", "front_b").mapInPandas(top, f"row long, chunk int, {_GROUPS}")
    between = reduce(DataFrame.unionByName, closed, first)  # one group for each chunk with a common end: the one that its first such end closes
    parts = (
        found.select("row", "chunk", "n_groups", "groups", "pairs", "counts", F.lit(1).alias("k"))
        .filter("n_groups > 0")
        .unionByName(between.withColumn("k", F.lit(0)))
    )
    parts = materialise(parts, "align-groups")
    text = parts.groupBy("row").agg(F.sum("n_groups").alias("n_groups"), F.array_sort(F.collect_list(F.struct("chunk", "k", "groups"))).alias("g"))
    pair = parts.select("row", F.inline(F.arrays_zip("pairs", "counts"))).groupBy("row", "pairs").agg(F.sum("counts").alias("counts"))
    pair = pair.groupBy("row").agg(F.collect_list(F.struct("pairs", "counts")).alias("p"))
    numbers = found.groupBy("row").agg(F.min("fit").alias("fit"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    names = chunks.filter("chunk = 0").select("row", "doc_id")
    whole = (
        names.join(numbers, "row").join(text, "row", "left").join(pair, "row", "left")
        .select(
            "row", "doc_id", *[F.when(F.col("fit"), F.col(c)).otherwise(0).alias(c) for c in ("n_a", "n_b", "n_groups")],
            F.when(F.col("fit"), F.array_join("g.groups", ";")).alias("groups"),
            *[F.when(F.col("fit"), F.col(f"p.{c}")).alias(c) for c in ("pairs", "counts")],
        )
    )
    whole = materialise(whole, "align-long")
    discard(chunks, found, parts, *steps)
    return whole


def short_documents(docs: DataFrame, files: tuple[bytes, bytes], with_groups: bool) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, groups_sha256, pairs, counts (and groups) of texts that fit one chunk, which is one whole fragment."""
    read = docs.sparkSession.sparkContext.broadcast(files)
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts", *["groups"] * with_groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = units(*read.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = known.documents(batch.column(2).to_pylist())
                numbers = np.array([f[0] if f else [0, 0, 0] for f in found], np.int64).reshape(-1, 3)
                offsets = pa.array(np.cumsum([0, *[len(f[2]) if f else 0 for f in found]]), pa.int32())
                flat = [pa.array(np.concatenate([np.zeros(0, np.int64), *[f[c] for f in found if f]])) for c in (2, 3)]
                digest = [hashlib.sha256(f[1].encode()).hexdigest() if f else "" for f in found]
                columns = [*batch.columns[:2], *map(pa.array, np.ascontiguousarray(numbers.T)), pa.array(digest), *[pa.ListArray.from_arrays(offsets, f) for f in flat]]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([f[1] if f else "" for f in found])] * with_groups, names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found = rows.mapInArrow(run, f"row long, doc_id {id_type(docs)}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, counts array<long>" + ", groups string" * with_groups)
    return materialise(found, "align-short")


def align_tokenizers(docs: DataFrame, files: Files | None = None, with_groups: bool = False, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs(doc_id, text, ...); with_groups adds the groups themselves.

    A space and the text are encoded by both tokenizers; byte offsets at which tokens
    of both end cut them into groups (written `a1,a2|b1;a3|b2`), and ids that share a
    group are linked. Of each linked pair the documents that hold it are counted over
    the whole corpus: count_sum adds them up over a document's links, n_best counts the
    links whose pair is the most frequent of its A id. Null and empty texts, and texts
    that a tokenizer does not give back byte by byte, have no tokens: zeros and ''.
    Rows are told apart by number, so repeated rows and shared or missing doc_ids are
    rows of their own; other columns are ignored; no rows give no rows.

    Texts of at least `chunk` bytes are cut into byte ranges, whose fragments are composed by
    a tree of Spark tasks; shorter ones are a fragment by themselves. Words come again
    and again, so a task aligns each stretch between spaces once. Pairs are added up
    before the shuffle; a pair that is in every document is a plain join key, and
    adaptive execution splits its rows where the table of pairs is not broadcast.
    """
    read = (files or Files()).read()
    docs = docs.select("doc_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = short_documents(docs.filter(size < chunk), read, with_groups)
    long = long_documents(docs.filter(size >= chunk), read, chunk)
    digest = F.when(F.col("groups").isNull(), F.lit("")).otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    shown = ["groups"] if with_groups else []
    both = short.unionByName(long.select("row", "doc_id", "n_a", "n_b", "n_groups", digest, "pairs", "counts", *[F.coalesce(c, F.lit("")).alias(c) for c in shown]))
    held = both.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs"))
    held = materialise(held, "align-counts")
    most = held.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("most"))  # at most a row for each id of A
    held = held.join(F.broadcast(most), F.shiftright("pair", 32) == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))
    if held.count() <= BROADCAST_PAIRS:
        held = F.broadcast(held)
    links = both.select("row", F.inline(F.arrays_zip("pairs", "counts"))).join(held, F.col("pairs") == F.col("pair"))
    sums = links.groupBy("row").agg(
        F.sum("counts").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("counts")).otherwise(0)).alias("n_best"),
        F.sum(F.col("counts") * F.col("n_docs")).alias("count_sum"),
    )
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return both.drop("pairs", "counts").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *zero, "groups_sha256", *shown)
