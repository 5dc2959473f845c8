"""Removal of repeated 200-byte strings with two-stage suffix sorting (operator 5).

Every 200-byte window of a document belongs to the span of neighbouring windows that share
an anchor: the least hash of a 32-byte string in them. Equal windows have equal anchors, so
only spans of one anchor need comparison. Spans that are equal as a whole collapse to one;
the others, where repeats begin and end, are compared in suffix arrays that hold whole
anchors. An anchor with more different spans than an array takes is anchored anew by longer
strings, in the end by whole windows, and equal windows collapse again: an array never
holds an unbounded group, and every step runs the same way at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_type, materialise

LENGTH = 200
#: Lengths of the strings that anchor windows: the first for all, each next for anchors with too many spans.
GRAMS = (32, 116, 170, 190, 198, LENGTH)
CHUNK = 1 << 17
#: Different spans of one anchor that go into one suffix array.
ANCHOR_SPANS = 800
#: Bytes of spans that go into one suffix array (an anchor's spans stay together).
BUNDLE_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each position on: polynomials, doubled and extended by a byte."""
    one = data.astype(np.uint64) + np.uint64(1)
    h, n = one, 1
    for bit in bin(size)[3:]:
        h = h[:-n] * np.uint64(pow(_ODD, n, 2**64)) + h[n:]
        n *= 2
        if bit == "1":
            h = h[:-1] * np.uint64(_ODD) + one[n:]
            n += 1
    h = h + np.uint64(size)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def sliding(h: np.ndarray, reach: int, best: np.ufunc, fill: int) -> np.ndarray:
    """Least or greatest of each `reach` neighbours: running values from both sides of blocks of `reach`."""
    n = len(h) - reach + 1
    padded = np.full(-(-len(h) // reach) * reach, fill, np.uint64)
    padded[: len(h)] = h
    block = padded.reshape(-1, reach)
    ahead = best.accumulate(block, axis=1).ravel()
    back = best.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:n], ahead[reach - 1 : reach - 1 + n])


def occurring_twice(h: np.ndarray, least: np.ndarray, reach: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the anchor of windows first..last stands at more than one place in them."""
    edge = np.zeros(reach - 1, np.uint64)
    anchors = np.flatnonzero(sliding(np.concatenate([edge, least, edge]), reach, np.maximum, 0) == h)
    values, code = np.unique(h[anchors], return_inverse=True)
    places = np.sort(code * (len(h) + 1) + anchors)
    base = np.searchsorted(values, least[first]) * (len(h) + 1)
    return np.searchsorted(places, base + last + reach) - np.searchsorted(places, base + first) > 1


def anchored_spans(data: np.ndarray, bounds: np.ndarray, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk of documents data[bounds[k]:bounds[k + 1]]: document, first and last window, anchor hash, whether the anchor is there twice.

    Long documents are cut into chunks of windows; a cut splits a span, which only sends
    its parts to the suffix arrays.
    """
    reach = LENGTH - gram + 1
    cuts = [int(bounds[0])]
    for b in bounds[1:].tolist():
        while b - cuts[-1] > 2 * CHUNK:
            cuts.append(cuts[-1] + CHUNK)
        if b - cuts[-1] >= CHUNK:
            cuts.append(b)
    if cuts[-1] < bounds[-1]:
        cuts.append(int(bounds[-1]))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        part = data[low : min(high + LENGTH - 1, bounds[-1])]
        if len(part) < LENGTH:
            continue
        h = gram_hashes(part, gram)
        least = sliding(h, reach, np.minimum, 2**64 - 1)
        at = np.arange(low, low + min(high - low, len(least)))
        doc = np.searchsorted(bounds, at, side="right") - 1
        fits = at + LENGTH <= bounds[doc + 1]
        here = least[: len(at)]
        edge = np.flatnonzero((here[1:] != here[:-1]) | (doc[1:] != doc[:-1]) | (fits[1:] != fits[:-1])) + 1
        first, last = np.append(0, edge), np.append(edge, len(at)) - 1
        first, last = first[fits[first]], last[fits[first]]
        yield doc[first], first + low, last + low, least[first], occurring_twice(h, least, reach, first, last)


def packed(first: np.ndarray, last: np.ndarray, twice: np.ndarray) -> np.ndarray:
    return twice.astype(np.int64) << 62 | first.astype(np.int64) << 31 | last.astype(np.int64)


def span_first(span: Column) -> Column:
    return F.shiftright(span, 31).bitwiseAND(F.lit((1 << 31) - 1))


def span_last(span: Column) -> Column:
    return span.bitwiseAND(F.lit((1 << 31) - 1))


def span_twice(span: Column) -> Column:
    return F.shiftright(span, 62) > 0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the bounds of each row's."""
    values = column.cast(pa.binary())
    bounds = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    data = values.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), bounds


def digests(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
    """128 bits of hash, as two longs, of the bytes of windows first..last."""
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(view[a : b + LENGTH]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def find_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) -> (h1, h2, h3, row, span): anchor, hash of all bytes, place."""
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        for doc, first, last, h1, twice in anchored_spans(data, bounds, GRAMS[0]):
            base, at = bounds[doc], pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1.view(np.int64)), *digests(data, first, last), batch.column(0).take(at), pa.array(packed(first - base, last - base, twice))],
                ["h1", "h2", "h3", "row", "span"],
            )


def split_spans(gram: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, first, copies, data) -> (h1, h2, h3, row, span, copies, data): spans anchored anew by longer strings.

    In the last step the anchor is the window, so a span is a run of equal windows: it
    is known by one of them, and a run of more counts twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column(3))
            whole, begins = data.tobytes(), batch.column(1).to_numpy()
            for doc, first, last, h1, twice in anchored_spans(data, bounds, gram):
                shown = last
                if gram == LENGTH:
                    doc, first, last, h1 = (np.repeat(x, 1 + twice) for x in (doc, first, last, h1))
                    shown, twice = first, np.zeros(len(doc), bool)
                moved, at = begins[doc] - bounds[doc], pa.array(doc)
                pieces = [whole[a : b + LENGTH] for a, b in zip(first.tolist(), shown.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h1.view(np.int64)), *digests(data, first, shown), batch.column(0).take(at),
                        pa.array(packed(first + moved, last + moved, twice)), batch.column(2).take(at), pa.array(pieces, pa.binary()),
                    ],
                    ["h1", "h2", "h3", "row", "span", "copies", "data"],
                )

    return run


def sorted_windows(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions of all whole windows of spans data[bounds[k]:bounds[k + 1]], in the order of their LENGTH bytes.

    Two-stage sorting. A suffix smaller than its successor is sorted directly (by its
    first LENGTH bytes); any other is placed when a scan over the buckets of first bytes,
    in order, meets its successor. A suffix ends with its span, and an end sorts first.
    Only windows are sorted, and behind a span's last window what induces it.
    """
    n, starts, ends = len(data), bounds[:-1], bounds[1:]
    follows = np.append(data[1:], 0).astype(np.int16)
    follows[ends - 1] = -1
    differs = data != follows
    up = data < follows  # holds where the next byte differs; equal runs take it from their last byte
    run_last = np.flatnonzero(differs)
    up = np.repeat(up[run_last], np.diff(np.append(-1, run_last)))
    last_window = ends - LENGTH
    next_up = np.append(np.where(up, np.arange(n), n), n)
    next_up = np.minimum.accumulate(next_up[::-1])[::-1]
    chain_end = np.minimum(np.maximum(next_up[last_window], last_window), ends - 1)
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, chain_end + 1, -1)
    wanted = np.cumsum(marks[:n]) > 0
    induced = wanted & ~up
    induced_before = np.append(False, induced[:-1])
    induced_before[starts] = False

    direct = np.flatnonzero(wanted & up)
    text = data.tobytes()
    stop = np.minimum(direct + LENGTH, np.repeat(ends, np.diff(bounds))[direct])
    keys = [text[a:b] for a, b in zip(direct.tolist(), stop.tolist(), strict=True)]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    place = np.searchsorted(data[direct], np.arange(257))

    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]

    def put(positions: np.ndarray) -> None:
        for c in np.unique(data[positions]):
            buckets[c].append(positions[data[positions] == c])

    put((ends - 1)[induced[ends - 1]])
    out = []
    for c in range(256):
        wave = np.concatenate(buckets[c]) if buckets[c] else np.zeros(0, np.int64)
        whole = [wave]
        while len(wave):  # predecessors with the same byte join this bucket behind the others
            before = wave[induced_before[wave]] - 1
            wave = before[data[before] == c]
            whole.append(wave)
        whole.append(direct[place[c] : place[c + 1]])
        bucket = np.concatenate(whole)
        out.append(bucket)
        before = bucket[induced_before[bucket]] - 1
        put(before[data[before] > c])
    order = np.concatenate(out)
    return order[order + LENGTH <= np.repeat(ends, np.diff(bounds))[order]]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each window and the one sorted before it, in whole 8-byte words, up to LENGTH."""
    words = np.ndarray((len(data) - 7,), np.uint64, data.tobytes(), strides=(1,))
    out, open_ = np.zeros(max(0, len(order) - 1), np.int64), np.arange(max(0, len(order) - 1))
    for k in range(0, LENGTH, 8):
        open_ = open_[words[order[open_] + k] == words[order[open_ + 1] + k]]
        out[open_] = k + 8
    return out


def repeated_windows(spans: list[bytes]) -> list[np.ndarray]:
    """For each span (of at least LENGTH bytes) the offsets of windows that occur again in any of them."""
    data = np.frombuffer(b"".join(spans), np.uint8)
    bounds = np.append(0, np.cumsum([len(s) for s in spans]))
    order = sorted_windows(data, bounds)
    same = common_prefixes(data, order) >= LENGTH
    again = np.zeros(len(data), bool)
    again[order[:-1][same]] = True
    again[order[1:][same]] = True
    return [np.flatnonzero(again[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def intervals(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(offsets) > 1)
    return (np.append(offsets[:1], offsets[cut + 1]), np.append(offsets[cut], offsets[-1:])) if len(offsets) else (offsets, offsets)


def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that stand in the order of their anchors, cut between anchors into tables of about BUNDLE_BYTES."""
    rest: pa.Table | None = None
    for batch in batches:
        rest = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        h1 = rest["h1"].to_numpy()
        size = np.append(0, np.cumsum(pc.binary_length(rest["data"]).to_numpy()))
        begin = 0
        for at in (np.flatnonzero(h1[1:] != h1[:-1]) + 1).tolist():
            if size[at] - size[begin] >= BUNDLE_BYTES:
                yield rest.slice(begin, at - begin)
                begin = at
        rest = rest.slice(begin)
    if rest is not None and len(rest):
        yield rest


def compare_bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans ordered by anchor -> windows (row, first, last) of spans seen once that occur again."""
    for rows in bundles(batches):
        begins, copies = rows["first"].to_numpy(), rows["copies"].to_numpy()
        at, first, last = [], [], []
        for k, found in enumerate(repeated_windows(rows["data"].to_pylist())):
            if copies[k] == 1:
                a, b = intervals(found)
                at.append(np.full(len(a), k))
                first.append(begins[k] + a)
                last.append(begins[k] + b)
        flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        of = pa.array(flat(at))
        yield pa.RecordBatch.from_arrays([rows["row"].combine_chunks().take(of), pa.array(flat(first)), pa.array(flat(last))], ["row", "first", "last"])


def kinds_of(rows: DataFrame, *more: str) -> DataFrame:
    """h1, h2, h3, copies, and row, span (and more) of one, for every different span."""
    return rows.groupBy("h1", "h2", "h3").agg(F.sum("copies").alias("copies"), F.min(F.struct("row", "span", *more)).alias("one")).select("h1", "h2", "h3", "copies", "one.*")


def open_anchors(kinds: DataFrame) -> DataFrame:
    """h1, kinds: anchors of a span seen once that another span, or the span itself, may repeat in part."""
    groups = kinds.groupBy("h1").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("fewest"), F.max(span_twice(F.col("span"))).alias("twice"))
    return groups.filter("fewest = 1 AND (kinds > 1 OR twice)").select("h1", "kinds")


PLACE = ["h1", "h2", "h3", "row", "span"]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) for every row of docs(doc_id, text).

    A byte goes if a 200-byte string over it starts anywhere else too, in any document.
    Texts are UTF-8 bytes, whole; null and empty texts are 0 bytes; texts under 200 bytes
    stay as they are; equal texts of 200 and more, repeated rows too, go whole; rows are
    told apart by number, so any may share a doc_id or have none; other columns are
    ignored; an empty table gives an empty result.

    Written or shuffled are one row per span (some 90 bytes of text each), the texts of
    spans where repeats begin or end, and the documents: once to number the rows, once by
    number.
    """
    texts = materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "dedup-rows")
    place = "h1 long, h2 long, h3 long, row long, span long"
    found = materialise(texts.select("row", "text").mapInArrow(find_spans, place), "dedup-spans")
    weight = F.when(span_twice(F.col("span")), 2).otherwise(1)
    anchors = found.groupBy("h1").agg(F.sum(weight).alias("n")).filter("n > 1").select("h1")
    shared = materialise(found.join(anchors, "h1").select(*PLACE, F.lit(1).cast("long").alias("copies")), "dedup-shared")
    discard(found)
    kinds = materialise(kinds_of(shared), "dedup-kinds")
    anchors = materialise(open_anchors(kinds), "dedup-anchors")
    where = [span_first(F.col("span")).alias("first"), span_last(F.col("span")).alias("last")]
    open_ = (
        kinds.join(anchors, "h1")
        .select("row", F.struct("h1", "kinds", "copies", *where).alias("s"))
        .groupBy("row")
        .agg(F.collect_list("s").alias("spans"))
    )
    piece = F.expr("substring(bytes, int(s.first) + 1, int(s.last - s.first) + 200)")
    spans = (
        with_rows(texts, open_, "inner")
        .withColumn("bytes", F.encode("text", "UTF-8"))
        .select("row", "bytes", F.explode("spans").alias("s"))
        .select("s.h1", "s.kinds", "s.copies", "s.first", "row", piece.alias("data"))
    )
    spans = materialise(spans, "dedup-open")
    seen, used = shared, [shared, kinds, anchors, spans]
    repeated, sortable = kinds.filter("copies > 1").select("h1", "h2", "h3"), spans.filter(F.col("kinds") <= ANCHOR_SPANS)
    for gram in GRAMS[1:]:
        crowded = spans.filter(F.col("kinds") > ANCHOR_SPANS).select("row", "first", "copies", "data")
        if crowded.isEmpty():
            break
        parts = materialise(crowded.mapInArrow(split_spans(gram), f"{place}, copies long, data binary"), "dedup-parts")
        kinds = materialise(kinds_of(parts, "data"), "dedup-kinds")
        spans = materialise(kinds.join(open_anchors(kinds), "h1").select("h1", "kinds", "copies", where[0], "row", "data"), "dedup-open")
        used += [parts, kinds, spans]
        seen = seen.unionByName(parts.filter("copies = 1").select(*PLACE, "copies"))
        repeated = repeated.unionByName(kinds.filter("copies > 1").select("h1", "h2", "h3"))
        sortable = sortable.unionByName(spans.filter(F.col("kinds") <= ANCHOR_SPANS))
    whole = seen.join(repeated, ["h1", "h2", "h3"]).select("row", *where)
    compared = (
        sortable.select("h1", "row", "first", "copies", "data")
        .repartition("h1")
        .sortWithinPartitions("h1")
        .mapInArrow(compare_bundles, "row long, first long, last long")
    )
    repeats = whole.unionByName(compared).groupBy("row")
    repeats = materialise(repeats.agg(F.collect_set(F.struct("first", "last")).alias("repeats")), "dedup-repeats")
    discard(*used)
    out = f"doc_id {id_type(docs)}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return with_rows(texts, repeats, "left").select("doc_id", "text", "repeats").mapInArrow(cut_out, out)


def with_rows(texts: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """texts joined with rows(row, ...); the rows, the smaller side, are hashed, so texts are not sorted."""
    return texts.join(rows.hint("shuffle_hash"), "row", how)


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = text_bytes(batch.column(1))
        lists = batch.column(2)
        offsets = np.asarray(lists.offsets)
        first, last = (np.asarray(lists.values.field(k)) for k in (0, 1))
        present = np.asarray(lists.is_valid())
        out = []
        for k in range(len(batch)):
            low, high = int(bounds[k]), int(bounds[k + 1])
            gone = np.zeros(high - low + 1, np.int32)
            if present[k]:
                part = slice(offsets[k], offsets[k + 1])
                np.add.at(gone, first[part], 1)
                np.add.at(gone, last[part] + LENGTH, -1)
            removed = np.cumsum(gone[:-1]) > 0
            kept = data[low:high][~removed].tobytes()
            out.append((high - low, int(removed.sum()), int(np.count_nonzero(removed[1:] & ~removed[:-1]) + (removed[:1].sum())), hashlib.sha256(kept).hexdigest(), kept))
        c = list(zip(*out, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(x), t) for x, t in zip(c, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
