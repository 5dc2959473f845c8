"""Benchmark decontamination through a distributed positional inverted index (operator 10).

The benchmark's windows are a table with the hashes of their words. Documents are read
twice: once to count those words, once to post the rarest of each window with their
surroundings, where the next rarest stands near. Postings meet the windows in one join on
the rare word, for a benchmark of any size; what the tasks get beforehand are bit sets of
bounded size that let every wanted word or pair through and few others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_type, materialise

WINDOW = 10
REACH = WINDOW - 1
#: Share of a window's distinct words that ten consecutive words must hold for a proximity match, in hundredths.
NEAR_PERCENT = 80
#: Bits a wanted word in a task's bit set, and the most bits of one (128 MB).
BITS_A_WORD, MOST_BITS = 64, 1 << 30
#: Words that a task remembers from one slice of a batch to the next.
REMEMBERED = 1 << 17
#: Bytes of text that are taken from a batch at a time, and words of them that are searched at a time.
SLICE, CHUNK = 1 << 22, 1 << 18
#: Tables of up to so many anchored windows (some 60 MB) are broadcast; larger ones are shuffled.
BROADCAST_WINDOWS = 200_000
# A-Z lower-cased; 0-9, a-z and every byte of a non-ASCII character stay; the rest separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_WORDS).split()


class Lexicon(dict):
    """Word -> code; hashes and flags (whether a bit set has the hash) by code. Code 0 is no word."""

    def __init__(self, bits: np.ndarray | None = None) -> None:
        self.bits = np.zeros(1, np.uint8) if bits is None else bits
        self.hashes, self.flags = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, bool)
        self[b""] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        if code == len(self.hashes):
            self.hashes, self.flags = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.flags))
        self.hashes[code] = h = xxhash.xxh3_64_intdigest(word)
        at = h & 8 * len(self.bits) - 1
        self.flags[code] = self.bits[at >> 3] >> (at & 7) & 1
        return code

    def codes(self, texts: pa.Array) -> list[np.ndarray]:
        """Codes of the words of each text; codes of earlier calls are void."""
        if len(self) > REMEMBERED:
            self.clear()
            self[b""] = 0
        return [np.fromiter(map(self.__getitem__, words(t.as_py())), np.int32) for t in texts.cast(pa.binary())]


def slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of up to SLICE bytes in column `text`, or of one longer text: what a task holds besides the batch does not grow with it."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    begin = held = 0
    for k, n in enumerate(size.tolist()):
        if k > begin and held + n > SLICE:
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def windows_of(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """windows(window, terms): each different run of ten words of an item, as hashes, numbered; items(window, item): where they stand.

    An item of fewer words is one window, one of none has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for batch in batches:
            of, terms = [], []
            for k, codes in enumerate(lexicon.codes(batch.column(1))):
                h = lexicon.hashes[codes].view(np.int64)
                runs = [h[i : i + WINDOW] for i in range(max(1, len(h) - REACH) if len(h) else 0)]
                of += [k] * len(runs)
                terms += runs
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(terms, pa.list_(pa.int64()))], ["item", "terms"])

    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    all_ = materialise(texts.mapInArrow(run, "item string, terms array<long>"), "decontaminate-items")
    windows = materialise(all_.select("terms").distinct().withColumn("window", F.monotonically_increasing_id()), "decontaminate-windows")
    items = materialise(all_.join(windows, "terms").select("window", "item").distinct(), "decontaminate-where")
    discard(all_)
    return windows, items


def bit_set(terms: DataFrame) -> np.ndarray:
    """A bit set of the hashes in column term, as bytes: at most MOST_BITS, whatever their number."""
    wanted = terms.agg(F.count(F.lit(1))).first()[0]
    bits = min(MOST_BITS, max(1 << 15, 1 << (BITS_A_WORD * max(1, wanted) - 1).bit_length()))
    place = F.col("term").bitwiseAND(F.lit(bits - 1)) + 1  # the bitmap functions count from 1
    parts = terms.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bytes"))
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.toLocalIterator():  # 4 KB each, bits / 2**15 of them
        out[(r.part - 1) << 12 : r.part << 12] = np.frombuffer(r.bytes, np.uint8)
    return out


def wanted(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the terms occurs in all documents, pre-aggregated by slice and by task."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        for batch in (part for whole in batches for part in slices(whole, 0)):
            n = np.bincount(np.concatenate([np.zeros(1, np.int32), *lexicon.codes(batch.column(0))]))
            code = np.flatnonzero((n > 0) & lexicon.flags[: len(n)])
            yield pa.RecordBatch.from_arrays([pa.array(lexicon.hashes[code].view(np.int64)), pa.array(n[code])], ["term", "n"])

    return docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """window, terms, anchor, place (the anchor's offset), others: a row for every anchor of a window.

    A proximity match may lack some of a window's words. The anchors are its rarest words,
    one more than may be lacking, so every match holds one; others are the rarer words
    behind the anchor, one more again, so every match holds one of them beside its first
    anchor. An anchor that no document has is left out.
    """
    each = windows.select("window", F.explode(F.array_distinct("terms")).alias("term")).join(counts, "term", "left")
    rare = each.groupBy("window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("rare"))  # ten at most
    m = F.size("rare")
    spare = m - F.ceil(m * NEAR_PERCENT / 100.0).cast("int")
    rows = windows.join(rare, "window").withColumn("spare", spare).select("*", F.explode(F.sequence(F.lit(0), F.col("spare"))).alias("k"))
    term = lambda k: F.element_at("rare", k + 1)
    behind = F.transform(F.slice("rare", F.col("k") + 2, F.col("spare") + 1 - F.col("k")), lambda x: x["term"])
    anchor = term(F.col("k"))["term"]
    others = F.when(m - F.col("spare") > 1, behind).otherwise(F.array(anchor))
    return rows.filter(term(F.col("k"))["n"] > 0).select("window", "terms", anchor.alias("anchor"), (F.array_position("terms", anchor) - 1).cast("int").alias("place"), others.alias("others"))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a ^ (b << np.uint64(7) | b >> np.uint64(57))


def positional_index(docs: DataFrame, anchors: DataFrame, *keep: str) -> DataFrame:
    """row_id, doc_id, n_words, postings(term, pos, near) and the columns to keep of every document, written to the shared folder.

    Postings are those of the anchors that have one of their other words near (and few
    more, which meet no window); near holds the hashes of the words from 9 places before
    to 9 after, 0 where there is none.
    """
    context = docs.sparkSession.sparkContext
    pairs = anchors.select("anchor", F.explode("others").alias("other"))
    rolled = F.shiftleft("other", 7).bitwiseOR(F.shiftrightunsigned("other", 57))
    singles, doubles = (context.broadcast(bit_set(x.distinct())) for x in (anchors.select(F.col("anchor").alias("term")), pairs.select(F.col("anchor").bitwiseXOR(rolled).alias("term"))))
    kind = pa.list_(pa.struct([("term", pa.int64()), ("pos", pa.int32()), ("near", pa.list_(pa.int64()))]))
    names = ["doc_id", "n_words", "postings", *keep]

    def postings(lexicon: Lexicon, codes: list[np.ndarray]) -> pa.Array:
        """The postings of some texts that follow one another with REACH empty places between."""
        edge, span = np.zeros(REACH, np.int32), np.arange(-REACH, REACH + 1)
        flat = np.concatenate([edge, *[x for c in codes for x in (c, edge)]])
        starts = np.cumsum([REACH, *[len(c) + REACH for c in codes]])
        at = np.flatnonzero(lexicon.flags[flat])
        near = lexicon.hashes[flat[at[:, None] + span]]
        beside = wanted(doubles.value, pair_hash(near[:, REACH : REACH + 1], near)).any(axis=1)
        at, near = at[beside], near[beside].view(np.int64)
        of = np.searchsorted(starts, at, side="right") - 1
        lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * len(span), pa.array(near.ravel()))
        items = pa.StructArray.from_arrays([pa.array(near[:, REACH]), pa.array((at - starts[of]).astype(np.int32)), lists], ["term", "pos", "near"])
        return pa.ListArray.from_arrays(np.searchsorted(of, np.arange(len(codes) + 1)).astype(np.int32), items).cast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(singles.value)
        for batch in (part for whole in batches for part in slices(whole, 1)):
            codes = lexicon.codes(batch.column(1))
            counts = np.array([len(c) for c in codes], np.int64)
            part = (np.cumsum(counts) - counts) // CHUNK
            for a, b in zip(cuts := np.flatnonzero(np.append(True, part[1:] != part[:-1])), np.append(cuts[1:], len(codes)), strict=True):
                there = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([there.column(0), pa.array(counts[a:b]), postings(lexicon, codes[a:b]), *there.columns[2:]], names)

    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    index = docs.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id {id_type(docs)}, n_words long, postings array<struct<term long, pos int, near array<long>>>{kept}")
    return materialise(index.withColumn("row_id", F.monotonically_increasing_id()), "decontaminate-index")


def found_windows(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """row_id, window, start, size, exact: places where a window stands word by word (exact), or ten words hold enough of it.

    Postings of a window's anchors meet the window; one of the others must be near, then
    all words are compared, at their offset-adjusted places or by their share in the ten
    words around the anchor that hold most (the first such).
    """
    posted = index.select("row_id", F.explode("postings").alias("p")).select("row_id", F.col("p.term").alias("anchor"), "p.pos", "p.near")
    whole = F.slice("near", F.lit(WINDOW) - F.col("place"), F.size("terms")) == F.col("terms")
    enough = F.size(F.array_distinct("terms")) * NEAR_PERCENT
    known = F.broadcast(anchors) if anchors.count() <= BROADCAST_WINDOWS else anchors
    met = posted.join(known, "anchor").filter(F.arrays_overlap("near", "others")).withColumn("exact", whole)
    met = met.filter(F.col("exact") | (F.size(F.array_intersect("terms", "near")) * 100 >= enough))
    runs = F.transform(F.sequence(F.lit(0), F.lit(REACH)), lambda i: F.struct((-F.size(F.array_intersect("terms", F.slice("near", i + 1, F.lit(WINDOW))))).alias("lacks"), i.alias("i")))
    met = met.withColumn("best", F.when(~F.col("exact"), F.array_min(runs))).filter(F.col("exact") | (F.col("best.lacks") * -100 >= enough))
    start = F.when(F.col("exact"), F.col("pos") - F.col("place")).otherwise(F.greatest(F.lit(0), F.col("pos") - REACH + F.col("best.i")))
    return met.select("row_id", "window", start.alias("start"), F.when(F.col("exact"), F.size("terms")).otherwise(WINDOW).alias("size"), "exact").distinct()


def searched(docs: DataFrame, benchmark: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The index of docs, the windows found in it, and the items of windows."""
    windows, items = windows_of(benchmark)
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    counts = materialise(term_counts(docs, terms), "decontaminate-counts")
    anchors = materialise(anchored(windows, counts), "decontaminate-anchors")
    index = positional_index(docs, anchors, *keep)
    found = materialise(found_windows(index, anchors), "decontaminate-found")
    discard(windows, counts, anchors)
    return index, found, items


def benchmark_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, size, kind: every place where an item's window stands exactly (phrase) or nearly (proximity), in words.

    A proximity match is ten consecutive words that hold NEAR_PERCENT of a window's
    distinct words but are no phrase of the same item at that place; of the tens around
    a rare word the fullest is given. Cases as for `decontaminate`; rows of equal
    documents repeat.
    """
    index, found, items = searched(docs, benchmark)
    rows = found.join(items, "window").groupBy("row_id", "item", "start", "size").agg(F.max("exact").alias("exact"))
    kind = F.when(F.col("exact"), "phrase").otherwise("proximity")
    return rows.join(index.select("row_id", "doc_id"), "row_id").select("doc_id", F.col("item").alias("item_id"), "start", "size", kind.alias("kind"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *keep: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, near_items, and the columns to keep, for every row of docs(doc_id, text).

    Windows are 10 consecutive words of an item (an item of fewer is one window). n_hit
    counts document words inside exact occurrences, n_items the items with one;
    n_near_items those with an exact or proximity match, near_items their ids, sorted and
    joined by commas. Null and empty texts have no words; repeated rows are kept;
    overlapping occurrences count a word once; items without words match nothing; either
    table may be empty; other columns are ignored. Texts are read twice and never
    shuffled: only postings of the windows' rarest words are.
    """
    index, found, items = searched(docs, benchmark, *keep)
    hits = found.filter("exact").groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("hits"))

    def cover(acc: F.Column, hit: F.Column) -> F.Column:
        end = hit["start"] + hit["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], hit["start"]))).alias("n"))

    n_hit = F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), cover, lambda a: a["n"])
    per_row = found.join(items, "window").groupBy("row_id").agg(F.collect_set(F.when(F.col("exact"), F.col("item"))).alias("exact_items"), F.collect_set("item").alias("near_items"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    listed = lambda c: F.array_join(F.coalesce(F.array_sort(c), F.array().cast("array<string>")), ",")
    count = F.coalesce(n_hit, F.lit(0)).cast("long")
    return index.join(hits, "row_id", "left").join(per_row, "row_id", "left").select(
        "doc_id", "n_words", count.alias("n_hit"), n("exact_items").alias("n_items"), F.sha2(listed("exact_items"), 256).alias("items_sha256"),
        (count > 0).alias("contaminated"), n("near_items").alias("n_near_items"), listed("near_items").alias("near_items"), *keep,
    )
