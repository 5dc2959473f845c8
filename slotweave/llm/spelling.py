"""Spelling variants by Bloom-guided neighbourhoods (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, materialise

#: Least code points and occurrences of a word, and how many times a word's occurrences those of its form are.
LEAST_LENGTH, LEAST_COUNT, FORM_TIMES = 7, 2, 10
#: A run loses a code point if this divides its hash.
THINNING = 31
#: Words of this length and longer share one shard, and are looked up by digest.
LONG = 64
#: A filter's blocks have 512 bits; a word sets PROBES bits of one block, WORDS_A_BLOCK words are meant for one.
WORDS_A_BLOCK, PROBES, SLOTS = 32, 6, 8
#: Blocks of filters that are broadcast at a time: 64 MB. Larger vocabularies take several passes.
PART_BLOCKS = 1 << 20
#: Edits that are hashed at a time, and words that a probing task should have at most.
EDITS, TASK_WORDS = 1 << 19, 20_000
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
_WRAP = (1 << 64) - 1


def corpus_words(docs: DataFrame) -> DataFrame:
    """word, n: the words of docs(doc_id, text, ...) of at least LEAST_LENGTH code points that occur LEAST_COUNT times and more.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; a run whose
    hash with the doc_id (null: empty) is a multiple of THINNING loses one code point.
    Counts are added up before the shuffle.
    """
    # shorter runs can never become words, and from seven letters on the pattern takes the same maximal runs
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.col("h") % F.length("run")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.select(F.when(F.col("h") % THINNING == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def key(word: Column) -> Column:
    """What a word is looked up by: itself, or the digest of a long one."""
    return F.when(F.length(word) < LONG, word).otherwise(F.concat(F.lit("#"), F.sha2(word, 256)))


def key_of(word: str) -> str:
    return word if len(word) < LONG else "#" + hashlib.sha256(word.encode()).hexdigest()


def powers(n: int) -> np.ndarray:
    """BASE ** 0 to n - 1, modulo 2 ** 64."""
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The hashes with every bit spread over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shards:
    """Where the words of each length have their blocks: block `first[n]` and on, `blocks[n]` of them."""

    def __init__(self, words: dict[int, int]):
        self.blocks = np.zeros(LONG + 1, np.int64)
        for n, count in words.items():
            self.blocks[n] = -(-count // WORDS_A_BLOCK)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.total = int(self.blocks.sum())

    def places(self, length: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For hashes of words of one length: the block, and a number whose 9-bit parts are the bits in the block."""
        shard, x = min(length, LONG), mixed(hashes)
        block = ((x >> np.uint64(32)) * np.uint64(self.blocks[shard])) >> np.uint64(32)
        return block.astype(np.int64) + self.first[shard], mixed(x ^ np.uint64(BASE))

    def touched(self, low: int, high: int) -> list[int]:
        """Lengths whose shards have blocks from low to high."""
        return [n for n in range(LONG + 1) if self.blocks[n] and self.first[n] < high and self.first[n] + self.blocks[n] > low]


def bits(places: np.ndarray, probe: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot (a word of 64 bits) within the block and mask of one of the PROBES bits."""
    at = (places >> np.uint64(9 * probe)) & np.uint64(511)
    return (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))


def filters(words: DataFrame, shards: Shards) -> DataFrame:
    """cell, bits: the 64-bit cells of all blocks, made in tasks and joined by OR before and after the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for n, own in batch["word"].groupby(batch["word"].str.len()):
                rows = letters(own.tolist())
                block, places = shards.places(n, (rows * powers(n)).sum(axis=1, dtype=np.uint64))
                cells, masks = zip(*[(block * SLOTS + slot, mask) for slot, mask in (bits(places, k) for k in range(PROBES))], strict=True)
                yield pd.DataFrame({"cell": np.concatenate(cells), "bits": np.concatenate(masks).view(np.int64)})

    return words.select("word").mapInPandas(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits"))


def edits(words: list[str], alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of edits of words of one length, in portions: the edit's length, hashes, word, place, new letter (0: deleted).

    A letter is replaced by later ones of the alphabet only and of equal letters in a row
    the first is deleted, so every pair of near words is tried once, from one of its sides.
    """
    n = len(words[0])
    power, some = powers(n), max(1, EDITS // (n * (len(alphabet) + 1)))
    span = max(1, EDITS // (len(alphabet) + 1))
    for at in range(0, len(words), some):
        rows = letters(words[at : at + some])
        terms = rows * power
        before = np.cumsum(terms, axis=1, dtype=np.uint64)
        total = before[:, -1:]
        w, i = np.nonzero(np.concatenate([np.ones((len(rows), 1), bool), rows[:, 1:] != rows[:, :-1]], axis=1))
        shorter = (before - terms)[w, i] + (total[w, 0] - before[w, i]) * np.uint64(UNBASE)
        yield n - 1, shorter, w + at, i, np.zeros(len(w), np.uint64)
        for left in range(0, n, span):
            w, i, c = np.nonzero(alphabet > rows[:, left : left + span, None])
            new, i = alphabet[c], i + left
            yield n, total[w, 0] + (new - rows[w, i]) * power[i], w + at, i, new


def positives(words: DataFrame, shards: Shards, cells: np.ndarray, low: int, alphabet: list[int]) -> DataFrame:
    """word, n, key: edits of words(word, n) that the broadcast blocks from `low` on may hold."""
    sent = words.sparkSession.sparkContext.broadcast(cells)
    signs = np.array(sorted(alphabet), np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = sent.value
        for batch in batches:
            for _, own in batch.groupby(batch["word"].str.len()):
                names, counts = own["word"].tolist(), own["n"].to_numpy()
                for length, hashes, w, i, new in edits(names, signs):
                    if length < LEAST_LENGTH or not shards.blocks[min(length, LONG)]:
                        continue
                    block, places = shards.places(length, hashes)
                    hit = np.flatnonzero((block >= low) & (block < low + len(table) // SLOTS))
                    for k in range(PROBES):
                        slot, mask = bits(places[hit], k)
                        hit = hit[(table[(block[hit] - low) * SLOTS + slot] & mask) != 0]
                    at = w[hit].tolist()
                    found = [names[a][:b] + (chr(c) if c else "") + names[a][b + 1 :] for a, b, c in zip(at, i[hit].tolist(), new[hit].tolist(), strict=True)]
                    if at:
                        yield pd.DataFrame({"word": np.array([names[a] for a in at], object), "n": counts[at], "key": np.array([key_of(x) for x in found], object)})

    return words.mapInPandas(run, "word string, n long, key string")


def near_words(words: DataFrame, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """word, n, near, near_n: each pair of words(word, n), once, that differ by one code point put in, left out or replaced.

    The vocabulary's Bloom filters are broadcast in parts of part_blocks blocks; every
    word's edits are probed against them, and what passes meets the vocabulary in one
    equi-join, which no false positive survives. A word has few near words (at most some
    180 for each of its letters), so no join key is hot.
    """
    shard = F.least(F.length("word"), F.lit(LONG)).alias("shard")
    sizes = {r["shard"]: r["n"] for r in words.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).collect()}
    none = words.select("word", "n", F.col("word").alias("near"), F.col("n").alias("near_n")).filter(F.lit(False))
    if not sizes:
        return none
    shards = Shards(sizes)
    alphabet = [r[0] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().select(F.expr("ascii(c)")).collect()]  # at most 90
    cells = materialise(filters(words, shards), "spelling-filters")
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, sum(sizes.values()) // TASK_WORDS)
    spread = words.repartition(tasks, "word")
    parts = []
    for low in range(0, shards.total, part_blocks):
        high = min(low + part_blocks, shards.total)
        rows = cells.filter(F.col("cell").between(low * SLOTS, high * SLOTS - 1)).toPandas()
        table = np.zeros((high - low) * SLOTS, np.uint64)
        table[rows["cell"].to_numpy() - low * SLOTS] = rows["bits"].to_numpy().view(np.uint64)
        lengths = {n + k for n in shards.touched(low, high) for k in (0, 1)} | ({LONG} if shards.total else set())
        parts.append(materialise(positives(spread.filter(shard.isin(sorted(lengths))), shards, table, low, alphabet), "spelling-positives"))
    tried = reduce(DataFrame.unionByName, parts)
    known = words.select(key(F.col("word")).alias("key"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = materialise(tried.join(known, "key").select("word", "n", "near", "near_n"), "spelling-pairs")
    discard(cells, *parts)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms that starts at each word of forms(word, form); jumps double every round."""
    links = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("above"))
        jumped = links.join(further, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        jumped = materialise(jumped, "spelling-roots")
        moved = jumped.filter("moved").limit(1).count()
        discard(links)
        links = jumped.select("word", "root")
        if not moved:
            return links


def group_spellings(words: DataFrame, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of words(word, n), whose words are distinct.

    A word's form is its near word of largest n (ties: smallest in code-point order) if
    that n is at least FORM_TIMES its own, else null; root follows forms to the last. A
    word without near words has n_near 0 and is its own root; words may be of any length;
    other columns are ignored; no words give no rows.
    """
    pairs = near_words(words.select("word", "n"), part_blocks)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near"))
    near = both.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = near.withColumn("fits", -F.col("best.order") >= FORM_TIMES * F.col("n"))
    near = materialise(near.select("word", "n_near", F.when(F.col("fits"), F.col("best.near")).alias("form"), F.when(F.col("fits"), -F.col("best.order")).alias("form_n")), "spelling-near")
    ends = roots(near.filter("form IS NOT NULL"))
    return (
        words.select("word", "n").join(near, "word", "left").join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs(doc_id, text, ...) (see corpus_words, group_spellings).

    Null and empty texts have no words; repeated rows count again; a null doc_id counts
    as the empty string; texts are taken whole.
    """
    return group_spellings(materialise(corpus_words(docs), "spelling-words"))
