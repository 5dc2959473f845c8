"""Language identification by interpolated Kneser-Ney character models (operator 2)."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, numbered

ORDER = 4
#: Expected number of sampled documents per language that counts are learned from, and that rejection is calibrated on.
TRAIN_DOCS, CALIBRATION_DOCS = 2000, 600
#: Languages of fewer labelled rows train on all of them and reject nothing.
LEAST_CALIBRATED = 100
#: Bytes of probabilities in one part of the model. More languages make more parts, each scored in a pass of its own.
PART_BYTES = 64 << 20
#: Tables of languages of up to so many rows (some 5 MB) are broadcast; larger ones are shuffled.
BROADCAST_LANGUAGES = 100_000
EDGE = 1  # code that stands ORDER - 1 times before each text
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18
#: Length that a posterior is tempered to, in characters.
TEMPER = 24


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """Code point -> its lower-case letter's code point, or a space for everything that is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, the text each belongs to, and each text's number of letters.

    Letters are lower-cased, runs of other characters become one space; EDGE codes
    separate texts, so no context reaches from one into the next.
    """
    pad = "\0" * (ORDER - 1)
    raw = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) + ORDER - 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    codes = letter_codes()[raw]
    starts = np.cumsum(lengths) - lengths
    for k in range(ORDER - 1):
        codes[starts + k] = EDGE
    letters = np.bincount(owner[codes > 32], minlength=len(texts))
    keep = codes != 32
    keep[1:] |= codes[:-1] != 32
    return codes[keep], owner[keep], letters


def gram_hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the `order` codes that end at each position (the first order - 1 are meaningless)."""
    h = codes.astype(np.uint64)
    out = np.zeros(len(h), np.uint64)
    for back in range(order - 1, -1, -1):
        out *= _MULTIPLIER
        out[back:] += h[: len(h) - back] if back else h
    return out


@dataclass
class Model:
    """keys[k]/rows[k]: sorted hashes of the k-grams seen in any of the languages and their log2 probability in each;
    context_keys[k]/weights[k]: hashes of k-long contexts and the log2 weight left to the shorter history.
    limits: per language (mean, spread) of the entropies that are not rejected."""

    languages: list[str]
    keys: dict[int, np.ndarray] = field(default_factory=dict)
    rows: dict[int, np.ndarray] = field(default_factory=dict)
    context_keys: dict[int, np.ndarray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    limits: dict[str, tuple[float, float]] | None = None


def row_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of codes; rows of no codes have hash 0."""
    size = codes.shape[1]
    return gram_hashes(codes.ravel(), size)[size - 1 :: size] if size else np.zeros(len(codes), np.uint64)


def orders(counts: dict[str, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """k -> the k-grams (a row of codes each) and their counts; lower orders count distinct continuations."""
    codes = np.frombuffer("".join(counts).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
    out = {ORDER: (codes, np.array(list(counts.values()), np.int64))}
    for k in range(ORDER - 1, 0, -1):
        _, at, n = np.unique(row_hashes(codes[:, 1:]), return_index=True, return_counts=True)
        codes = codes[at, 1:]
        out[k] = (codes, n)
    return out


def build(counts: dict[str, dict[str, int]], alphabet: int | None = None) -> Model:
    """Interpolated Kneser-Ney from counts of ORDER-grams by language; `alphabet` is the number of codes, one more for the unseen."""
    model = Model(sorted(counts))
    if not counts:
        return model
    alphabet = alphabet or len({g[-1] for c in counts.values() for g in c}) + 1
    seen = [orders(counts[lang]) for lang in model.languages]
    shorter = None
    for k in range(1, ORDER + 1):
        hashes = [row_hashes(o[k][0]) for o in seen]
        keys, at = np.unique(np.concatenate(hashes), return_index=True)
        codes = np.concatenate([o[k][0] for o in seen])[at]
        contexts, of = np.unique(row_hashes(codes[:, :-1]), return_inverse=True)
        below = shorter[1][np.searchsorted(shorter[0], row_hashes(codes[:, 1:]))] if shorter else np.full((len(keys), len(seen)), 1 / alphabet)
        left, rows = np.ones((len(contexts), len(seen))), np.empty((len(keys), len(seen)))
        for i, o in enumerate(seen):
            n, here = o[k][1], np.searchsorted(keys, hashes[i])
            total, kinds = np.bincount(of[here], n, len(contexts)), np.bincount(of[here], minlength=len(contexts))
            ones, twos = int((n == 1).sum()), int((n == 2).sum())
            discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            left[total > 0, i] = discount * kinds[total > 0] / total[total > 0]
            rows[:, i] = left[of, i] * below[:, i]
            rows[here, i] += np.maximum(n - discount, 0) / total[of[here]]
        model.keys[k], model.rows[k] = keys, np.log2(rows).astype(np.float32)
        model.context_keys[k - 1], model.weights[k - 1] = contexts, np.log2(left).astype(np.float32)
        shorter = (keys, rows)
    model.weights[0] = model.weights[0][0] - np.float32(np.log2(alphabet))
    return model


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return at, (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool)


def log_probabilities(model: Model, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log2 probability in each language of the code at each of the positions, given the codes before it."""
    out = np.zeros((len(at), len(model.languages)), np.float32)
    open_rows, where = np.arange(len(at)), at
    for k in range(ORDER, 0, -1):
        found, hit = _find(model.keys[k], gram_hashes(codes, k)[where])
        out[open_rows[hit]] += model.rows[k][found[hit]]
        open_rows, where = open_rows[~hit], where[~hit]
        if not len(where):
            break
        if k == 1:
            out[open_rows] += model.weights[0]
        else:
            found, hit = _find(model.context_keys[k - 1], gram_hashes(codes, k - 1)[where - 1])
            out[open_rows[hit]] += model.weights[k - 1][found[hit]]
    return out


def entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: cross-entropy in bits a character by language, scored characters, letters."""
    codes, owner, letters = normalise(texts)
    at = np.flatnonzero(codes != EDGE)
    n = np.bincount(owner[at], minlength=len(texts))
    sums = np.zeros((len(texts), len(model.languages)))
    step = max(1 << 12, _CHUNK * 4 // max(4, len(model.languages)))
    for s in range(0, len(at), step):
        part = at[s : s + step]
        base = max(0, part[0] - ORDER)
        lp = log_probabilities(model, codes[base : part[-1] + 1], part - base)
        for i in range(len(model.languages)):
            sums[:, i] += np.bincount(owner[part], weights=lp[:, i], minlength=len(texts))
    return -sums / np.maximum(n, 1)[:, None], n, letters


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of a text column of about _CHUNK characters, and where each begins; only one run is unpacked at a time."""
    at, texts, size = 0, [], 0
    for i, value in enumerate(column):
        texts.append(value.as_py() or "")
        size += len(texts[-1]) + ORDER
        if size >= _CHUNK:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


def train(docs: DataFrame) -> list[Broadcast]:
    """The model of all languages, in parts: counts and rejection limits from labelled rows outside the held-out quarter.

    Per language an expected TRAIN_DOCS + CALIBRATION_DOCS documents are drawn by a hash of
    doc_id and text against the language's count; of equal rows one stays. No ordering, no
    shuffle of other texts. To the driver come the names of the languages and, a part
    after the other, the counts of that sample; a part holds as many languages as fit in
    PART_BYTES (one at least). Without labelled rows there is one part of no language.
    """
    context = docs.sparkSession.sparkContext
    usable = docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = materialise(usable.groupBy("lang").agg(F.count(F.lit(1)).cast("double").alias("n")), "langid-sizes")
    by_language = F.broadcast(sizes) if sizes.count() <= BROADCAST_LANGUAGES else sizes
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") / float(2**53)
    sample = usable.join(by_language, "lang").withColumn("rank", u * F.col("n")).filter(F.col("rank") < TRAIN_DOCS + CALIBRATION_DOCS)
    calibrates = (F.col("n") >= LEAST_CALIBRATED) & (F.col("rank") < F.least(F.lit(float(CALIBRATION_DOCS)), 0.25 * F.col("n")))
    sample = sample.withColumn("calibrates", calibrates)
    sample = materialise(sample.dropDuplicates(["lang", "rank"]).select("lang", "text", "calibrates"), "langid-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                line = "".join(map(chr, normalise([text.as_py()])[0]))
                found[lang].update(line[i : i + ORDER] for i in range(len(line) - ORDER + 1))
            rows = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    grams = sample.filter("NOT calibrates").select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    grams = materialise(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    alphabet = grams.select(F.right("gram", F.lit(1))).distinct().count() + 1
    names: list[list[str]] = []
    room = 0
    for r in grams.groupBy("lang").count().orderBy("lang").toLocalIterator():
        room += r["count"]
        if not names or 8 * room * (len(names[-1]) + 1) > PART_BYTES:  # all orders together are about twice the longest grams
            names.append([])
            room = r["count"]
        names[-1].append(r.lang)
    parts = []
    for part in names:
        counts: dict[str, dict[str, int]] = defaultdict(dict)
        for r in grams.filter(F.col("lang").isin(part)).toLocalIterator():
            counts[r.lang][r.gram] = r.n
        model = build(counts, alphabet)
        own = defaultdict(list)
        for r in own_entropies(sample.filter(F.col("calibrates") & F.col("lang").isin(part)), context.broadcast(model)).toLocalIterator():
            own[r.lang].append((r.entropy, r.n_scored))
        model.limits = {lang: limit(own[lang]) for lang in model.languages}
        parts.append(context.broadcast(model))
    discard(sizes, sample, grams)
    return parts or [context.broadcast(build({}))]


def own_entropies(sample: DataFrame, model: Broadcast) -> DataFrame:
    """lang, entropy, n_scored: each sampled text's entropy in its own language; texts without letters give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {lang: i for i, lang in enumerate(model.value.languages)}
        for batch in batches:
            langs = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for at, texts in _batches(batch.column(1)):
                h, n, letters = entropies(model.value, texts)
                own, known = h[np.arange(len(texts)), langs[at : at + len(texts)]], letters > 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)).filter(pa.array(known)), pa.array(own[known]), pa.array(n[known])], ["lang", "entropy", "n_scored"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, entropy double, n_scored long")


def limit(own: list[tuple[float, int]]) -> tuple[float, float]:
    """(mean, spread): a text of n characters is rejected above mean + spread * sqrt(1 + 200 / n).

    Set so that hardly any calibration text would go, with as much room again, and never
    within a quarter of the mean.
    """
    if not own:
        return 0.0, float("inf")
    h, n = np.array([x[0] for x in own]), np.array([x[1] for x in own])
    mean = float(np.average(h, weights=np.minimum(n, 2000)))
    excess = (h - mean) / np.sqrt(1 + 200 / n)
    return mean, float(max(2 * np.quantile(excess, 0.998), 0.25 * mean))


def judge(model: Model, texts: list[str]) -> tuple[np.ndarray, ...]:
    """Per text: language number, its entropy, odds of all languages against it, whether it is over the limit, letters, scored characters."""
    k = len(texts)
    if not model.languages:
        codes, owner, letters = normalise(texts)
        n = np.bincount(owner[codes != EDGE], minlength=k)
        return np.full(k, -1), np.full(k, np.inf), np.ones(k), np.zeros(k, bool), letters, n
    h, n, letters = entropies(model, texts)
    best = h.argmin(axis=1)
    low = h[np.arange(k), best]
    odds = np.exp2(-(h - low[:, None]) * np.minimum(n, TEMPER)[:, None]).sum(axis=1)
    bounds = np.array([model.limits[x] if model.limits else (0.0, np.inf) for x in model.languages])
    return best, low, odds, low > bounds[best, 0] + bounds[best, 1] * np.sqrt(1 + 200 / np.maximum(n, 1)), letters, n


def part_scores(rows: DataFrame, model: Broadcast) -> DataFrame:
    """key, lang, entropy, odds, over, n_letters, n_scored of rows(key, text), in the languages of one part of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.value.languages, "und"], object)
        for batch in batches:
            for at, texts in _batches(batch.column(1)):
                best, low, odds, over, letters, n = judge(model.value, texts)
                columns = [pa.array(names[best], pa.string()), pa.array(low), pa.array(odds), pa.array(over), pa.array(letters.astype(np.int64)), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *columns], ["key", "lang", "entropy", "odds", "over", "n_letters", "n_scored"])

    key = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {key}, lang string, entropy double, odds double, over boolean, n_letters long, n_scored long")


def verdicts(found: DataFrame, *keep: str) -> DataFrame:
    """keep, lang_pred, score, rejected, n_letters, n_scored from the scores of a whole model."""
    known = F.col("n_letters") > 0
    named = known & (F.col("lang") != "und")
    return found.select(
        *keep, F.when(named, F.col("lang")).otherwise("und").alias("lang_pred"), F.when(named, 1 / F.col("odds")).otherwise(0.0).alias("score"),
        (~known | F.col("over")).alias("rejected"), "n_letters", "n_scored",
    )


def in_all_parts(rows: DataFrame, model: list[Broadcast]) -> DataFrame:
    """As part_scores, for a model of several parts; key is unique. A pass for each part, one small row a text and part is shuffled."""
    found = part_scores(rows, model[0])
    for part in model[1:]:
        found = found.unionByName(part_scores(rows, part))
    each = F.struct("entropy", "lang", "odds", "over", "n_letters", "n_scored")
    best = found.groupBy("key").agg(F.min(each).alias("b"), F.collect_list(F.struct("entropy", "odds")).alias("all"))  # as many as parts
    gap = lambda x: (x["entropy"] - F.col("b.entropy")) * F.least(F.col("b.n_scored"), F.lit(TEMPER))
    odds = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["odds"] * F.pow(F.lit(2.0), -gap(x)))
    return best.select("key", "b.lang", "b.entropy", odds.alias("odds"), "b.over", "b.n_letters", "b.n_scored")


def score(docs: DataFrame, model: list[Broadcast]) -> DataFrame:
    """doc_id, lang_pred, score, rejected, n_letters, n_scored for every row of docs(doc_id, text).

    lang_pred is the language of the lowest cross-entropy (ties: the first by name);
    `und` for null, for texts without a letter and without any model. score is its
    tempered posterior. rejected: no letter, or an entropy above the language's limit.
    """
    if len(model) == 1:
        return verdicts(part_scores(docs.select(F.col("doc_id").alias("key"), "text"), model[0]), F.col("key").alias("doc_id"))
    rows, row = numbered(docs.select("doc_id", "text"), "langid-rows")
    found = in_all_parts(rows.select(F.col(row).alias("key"), "text"), model)
    return rows.select("doc_id", row).join(verdicts(found, "key"), F.col(row) == F.col("key")).drop(row, "key")


def recognised(docs: DataFrame, model: list[Broadcast]) -> DataFrame:
    """Rows of docs whose text is not rejected, with all their columns.

    With one part rows are judged where they are read and nothing is shuffled. Without a
    learned language only texts without letters go.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in _batches(batch.column(at)):
                _, _, _, over, letters, _ = judge(model[0].value, texts)
                yield batch.slice(start, len(texts)).filter(pa.array(~over & (letters > 0)))

    if len(model) == 1:
        return docs.mapInArrow(run, docs.schema)
    rows, row = numbered(docs, "langid-rows")
    kept = verdicts(in_all_parts(rows.select(F.col(row).alias("key"), "text"), model), F.col("key").alias(row)).filter("NOT rejected")
    return rows.join(kept.select(row).hint("shuffle_hash"), row, "left_semi").select(*docs.columns)


def identify(docs: DataFrame, model: list[Broadcast] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of docs(doc_id, text, lang, ...).

    held_out: crc32 of doc_id as text leaves 2 modulo 4 (false for a null doc_id); such
    rows never train. Texts are scored whole; repeated rows are kept; other columns are
    ignored; an empty table gives an empty result; without labelled rows all are `und`.
    """
    model = model or train(docs)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
