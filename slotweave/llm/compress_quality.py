"""Text quality by compression with dictionaries of good and bad text (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, id_type, materialise

#: Every block of so many bytes is compressed by itself, so a dictionary helps throughout a long text.
BLOCK = 2048
DICTIONARY_BYTES = 1 << 18
LEVEL = 3
#: Bounds of the sample of labelled rows, all expected numbers: documents a class for the dictionaries and for the
#: calibration, and blocks of those documents (8 MB) that a dictionary is built from.
TRAIN_DOCS, CALIBRATION_DOCS, TRAIN_BLOCKS = 4000, 2000, 4096
#: A text counts as if so many more bytes of the labelled rows' mean stood behind it: short texts say little.
PRIOR_BYTES = 64
#: The calibration sees the savings a byte, which lie between -2 and 2, to this many steps.
BINS = 2000


@dataclass(frozen=True)
class Model:
    """Dictionaries of bad and good text, the mean of the labelled rows, and slope and offset of the calibration."""

    bad: bytes
    good: bytes
    mean: float
    slope: float
    offset: float

    def score(self, bad: np.ndarray, good: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
        """Probability of label 1 from the compressed sizes with either dictionary and the plain size."""
        x = normalised(bad, good, n_bytes, self.mean)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.offset, -30, 30)))


def normalised(bad: np.ndarray, good: np.ndarray, n_bytes: np.ndarray, mean: float) -> np.ndarray:
    """What the dictionary of good text saves more than that of bad text, a byte of text."""
    return (bad - good + PRIOR_BYTES * mean) / (n_bytes + PRIOR_BYTES)


def learnable(doc_id: Column) -> Column:
    """Whether labels of this doc_id may be learned from; the others are held out. A null one is the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 != 1


def share(seed: int, *keys: str) -> Column:
    """A number in [0, 1) hashed from the keys."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / F.lit(float(1 << 30))


def blocks_of(text: pa.Scalar | bytes) -> list[memoryview]:
    data = memoryview(text.as_buffer() or b"") if isinstance(text, pa.Scalar) else memoryview(text)
    return [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    built = zstandard.ZstdCompressionDict(dictionary)
    if dictionary:
        built.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=built if dictionary else None, write_content_size=False, write_checksum=False, write_dict_id=False)


def sizes(docs: DataFrame, bad: bytes, good: bytes, *keep: str) -> DataFrame:
    """doc_id, n_bytes, size_bad, size_good (compressed bytes over all blocks) and the columns to keep of docs(doc_id, text, ...)."""
    both = docs.sparkSession.sparkContext.broadcast((bad, good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = [compressor(d) for d in both.value]
        for batch in batches:
            found = np.zeros((batch.num_rows, 3), np.int64)
            for i, text in enumerate(batch.column(1).cast(pa.binary())):
                if text.is_valid:
                    parts = blocks_of(text)
                    found[i] = sum(map(len, parts)), *[sum(len(c.compress(p)) for p in parts) for c in by]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.ascontiguousarray(found.T)), *batch.columns[2:]], ["doc_id", "n_bytes", "size_bad", "size_good", *keep])

    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id {id_type(docs)}, n_bytes long, size_bad long, size_good long{kept}")


def chosen(labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """doc_id, quality, fit (else for the calibration) of a bounded random choice of the rows to learn from, and the rows of each class."""
    known = labels.filter(F.col("quality").isin(0, 1) & learnable(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    known = materialise(known, "quality-labels")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for quality, n in counts.items():
        rate = F.when(F.col("quality") == quality, F.lit((TRAIN_DOCS + CALIBRATION_DOCS) / n)).otherwise(rate)
    sample = known.filter(share(1, "doc_id") < rate).withColumn("fit", share(2, "doc_id") < TRAIN_DOCS / (TRAIN_DOCS + CALIBRATION_DOCS))
    return sample, counts


def dictionaries(texts: DataFrame) -> dict[int, bytes]:
    """A dictionary for each quality in texts(quality, text), from about TRAIN_BLOCKS blocks spread over all of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for quality, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                parts = blocks_of(text) if text.is_valid else []
                for at in range(0, len(parts), 1024):
                    own = [bytes(p) for p in parts[at : at + 1024]]
                    yield pa.RecordBatch.from_arrays([pa.array([quality] * len(own), pa.int32()), pa.array(own, pa.binary())], ["quality", "block"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        own = sorted(b for b in rows["block"] if len(b) >= 8)
        try:
            data = zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, own)) // 2), own).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little text for a trained one: the text itself serves
            data = b"".join(own)[-DICTIONARY_BYTES:]
        return pd.DataFrame({"quality": rows["quality"].iloc[:1], "dictionary": [data]})

    cuts = materialise(texts.select("quality", "text").mapInArrow(cut, "quality int, block binary"), "quality-blocks")
    n = {r["quality"]: r["n"] for r in cuts.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for quality, count in n.items():
        rate = F.when(F.col("quality") == quality, F.lit(TRAIN_BLOCKS / count)).otherwise(rate)
    rows = cuts.withColumn("draw", share(3, "block")).filter(F.col("draw") < rate).dropDuplicates(["quality", "block"])
    found = {r["quality"]: bytes(r["dictionary"]) for r in rows.select("quality", "block").groupBy("quality").applyInPandas(build, "quality int, dictionary binary").collect()}
    discard(cuts)
    return found


def calibrated(x: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic regression of label on x, with smoothed targets, by Newton's steps."""
    n1, n0 = weight[label == 1].sum(), weight[label == 0].sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(x).max(initial=0)), 1e-9)
    rows = np.stack([x / scale, np.ones_like(x)])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(w @ rows, -30, 30)))
        step = np.linalg.solve((rows * (weight * p * (1 - p))) @ rows.T + 1e-6 * np.eye(2), rows @ (weight * (target - p)) - 1e-6 * w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model from the texts of docs(doc_id, text, ...) that labels(doc_id, quality, ...) marks 0 or 1.

    Only labels whose doc_id is not held out count; of those a choice of bounded size is
    taken by a hash of doc_id before any text is read, and its doc_ids are all that is
    broadcast. A doc_id marked both ways counts in both classes; without text of both
    classes the score is the share of label 1 (a half without labels).
    """
    sample, counts = chosen(labels)
    sample = materialise(sample, "quality-sample")
    rows = docs.select("doc_id", "text").filter(F.length("text") > 0).join(F.broadcast(sample), "doc_id")
    rows = materialise(rows, "quality-texts")
    found = dictionaries(rows.filter("fit"))
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    none = Model(b"", b"", 0.0, 0.0, float(np.log(prior / (1 - prior))))
    if set(found) == {0, 1}:
        rest = materialise(sizes(rows.filter("NOT fit"), found[0], found[1], "quality"), "quality-sizes")
        of = {r["quality"]: r for r in rest.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size_bad") - F.col("size_good")).alias("saved"), F.sum("n_bytes").alias("bytes")).collect()}
        if set(of) == {0, 1}:
            each = {k: counts[k] / of[k]["n"] for k in of}  # labelled rows that one row of the choice stands for
            mean = sum(each[k] * of[k]["saved"] for k in of) / sum(each[k] * of[k]["bytes"] for k in of)
            x = (F.col("size_bad") - F.col("size_good") + PRIOR_BYTES * mean) / (F.col("n_bytes") + PRIOR_BYTES)
            bins = rest.groupBy("quality", F.round(x * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n")).toPandas()
            label = bins["quality"].to_numpy()
            weight = bins["n"].to_numpy() * np.where(label == 1, each[1], each[0])
            weight *= bins["n"].sum() / weight.sum()
            none = Model(found[0], found[1], mean, *calibrated(bins["bin"].to_numpy() / BINS, label, weight))
        discard(rest)
    discard(sample, rows)
    return none


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, that of quality 1), predicted (1 from a half on), n_bytes, size_bad, size_good of every row of docs(doc_id, text, ...).

    The whole text counts, cut into blocks; equal texts score alike. A null or empty
    text has no bytes and gets the score of the labelled rows' mean, short texts lean
    to it; repeated rows are kept; other columns are ignored; no rows give no rows.
    """
    model = train(docs, labels)
    scored = sizes(docs, model.bad, model.good)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad, good, size = (batch.column(c).to_numpy().astype(float) for c in ("size_bad", "size_good", "n_bytes"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(bad, good, size))], [*batch.schema.names, "score"])

    scored = scored.mapInArrow(run, f"doc_id {id_type(docs)}, n_bytes long, size_bad long, size_good long, score double")
    return scored.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_bytes", "size_bad", "size_good")
