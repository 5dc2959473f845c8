"""SimHash near-duplicates through pivot distance tables (operator 1)."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, id_type, materialise

SHINGLE = 4
DISTANCE = 4
#: Fingerprints meet in cells that share two of six bit ranges: within 4 differing bits at least two ranges are equal.
RANGES = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
CELLS = list(itertools.combinations(range(len(RANGES)), 2))
#: A cell with more members is dealt to pairs of chunks of about this size.
CHUNK = 1024
PIVOTS = 16
_SLICE = 1 << 16


def fingerprint(data: bytes | None) -> int:
    """64-bit SimHash of UTF-8 text: A-Z lower-cased, words between ASCII white space, 4-word shingles.

    Fewer words make one shingle, no words give zero. A bit is set if it is set in over
    half of the shingles' XXH64 values (seed 42).
    """
    words = (data or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - SHINGLE + 1)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        spans = zip(starts[at : min(n, at + _SLICE)], ends[SHINGLE - 1 + at :] if len(words) >= SHINGLE else ends[-1:], strict=False)
        hashes = b"".join([digest(joined[a : b - 1], 42) for a, b in spans])
        set_bits += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 64 // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns to keep of every row of docs(doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *keep])

    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("doc_id", "text", *keep).mapInArrow(run, f"doc_id {id_type(docs)}, fp long{kept}")


def pivot_table(values: np.ndarray) -> np.ndarray:
    """Hamming distances of uint64 values to the reference fingerprints, one column each."""
    pivots = np.random.default_rng(1).integers(0, 2**64, PIVOTS, np.uint64)
    return np.bitwise_count(values[:, None] ^ pivots[None, :])


def linked_roots(values: np.ndarray, left: np.ndarray, right: np.ndarray, within: int = DISTANCE) -> np.ndarray:
    """For each of the distinct values the smallest one it is connected to by links inside this block.

    Pairs are judged where one side is in `left` and the other in `right`. Values stand
    in the order of their distance to the first pivot, so a value meets only a window of
    others; a pair whose pivot distances differ by more than `within` at any pivot cannot
    be a link (triangle inequality) and is dropped; survivors are verified. A value
    already connected is not compared again with its own component.
    """
    table = pivot_table(values)
    order = np.argsort(table[:, 0], kind="stable")
    table, values, left, right = table[order].astype(np.int16), values[order], left[order], right[order]
    label = np.arange(len(values))
    ends = np.searchsorted(table[:, 0], table[:, 0] + within, side="right")
    for i in range(len(values)):
        j = np.arange(i + 1, ends[i])
        j = j[(label[j] != label[i]) & ((left[i] & right[j]) | (right[i] & left[j]))]
        for p in range(1, PIVOTS):
            if len(j) < 64:
                break
            j = j[np.abs(table[j, p] - table[i, p]) <= within]
        j = j[np.abs(table[j, 1:] - table[i, 1:]).max(axis=1, initial=0) <= within]
        j = j[np.bitwise_count(values[j] ^ values[i]) <= within]
        if len(j):
            joined = np.append(np.unique(label[j]), label[i])
            label[np.isin(label, joined)] = joined.min()
    smallest = np.full(len(values), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(smallest, label, values)
    out = np.empty(len(values), np.uint64)
    out[order] = smallest[label]
    return out


def links(distinct: DataFrame) -> DataFrame:
    """edges(a, b) between distinct fingerprints fp that connect exactly what links of at most 4 bits connect.

    Each block yields a star to the smallest member of each of its components, never
    all pairs. A cell of over CHUNK members is dealt to pairs of hashed chunks, so every
    pair of it meets in one block of bounded size.
    """
    part = lambda r: F.shiftrightunsigned("fp", r[0]).bitwiseAND(F.lit((1 << r[1]) - 1))
    keys = F.array(*[F.lit(k).cast("long") + part(RANGES[a]) * 16 + part(RANGES[b]) * (16 << 11) for k, (a, b) in enumerate(CELLS)])
    cells = distinct.select("fp", F.explode(keys).alias("cell"))
    sizes = materialise(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-cells")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    blocks = (
        cells.join(sizes, "cell")
        .withColumn("m", chunks)
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
        .select("cell", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "fp")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None  # the last block of a batch may go on in the next
        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            key = rows[["cell", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))) if len(rows) else np.zeros(1, int)
            yield block_edges(rows.iloc[: starts[-1]], starts)
            rest = rows.iloc[starts[-1] :]
        if rest is not None and len(rest):
            yield block_edges(rest, np.array([0, len(rest)]))

    placed = blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return placed.mapInPandas(run, "a long, b long")


def block_edges(rows: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """Stars of the blocks rows[starts[k]:starts[k + 1]]; blocks of two, the most, are judged together."""
    values, left, right = rows.fp.to_numpy().view(np.uint64), (rows.c == rows.i).to_numpy(), (rows.c == rows.j).to_numpy()
    sizes = np.diff(starts)
    two = starts[:-1][sizes == 2]
    x, y = values[two], values[two + 1]
    keep = np.abs(pivot_table(x).astype(np.int16) - pivot_table(y)).max(axis=1, initial=0) <= DISTANCE
    x, y = x[keep], y[keep]
    keep = np.bitwise_count(x ^ y) <= DISTANCE
    a, b = [np.maximum(x, y)[keep]], [np.minimum(x, y)[keep]]
    for at, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
        block = values[at : at + n]
        root = linked_roots(block, left[at : at + n], right[at : at + n])
        a.append(block[root != block])
        b.append(root[root != block])
    return pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs(doc_id, text, ...).

    Documents link at 4 or fewer differing fingerprint bits; component_id is the smallest
    doc_id reachable over links, the row's own included. Null, empty and blank texts have
    fingerprint zero and link like others; equal texts share a fingerprint; repeated rows
    are kept; texts are taken whole; other columns are ignored; no rows give no rows.
    """
    marked = materialise(fingerprints(docs), "simhash-fp")
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    labels = connected_components(links(distinct))
    # components with over one fingerprint: their smallest doc_id, pre-aggregated by component
    groups = distinct.join(labels.withColumnRenamed("node", "fp"), "fp").withColumnRenamed("component", "group")
    groups = materialise(groups, "simhash-groups")
    least = materialise(groups.groupBy("group").agg(F.min("first").alias("least")), "simhash-least")
    moved = groups.join(least, "group").select("fp", "least")
    owner = materialise(distinct.join(moved, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")), "simhash-owner")
    discard(distinct, groups, least, labels)
    return marked.join(owner, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, row: str) -> DataFrame:
    """The numbers (column `row`, unique) of one row of each component of docs(doc_id, text, row): that of the smallest doc_id, a null one last, then the smallest number."""
    marked = materialise(fingerprints(docs, row), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))).alias("first")
    distinct = materialise(marked.groupBy("fp").agg(first), "simhash-distinct")
    labels = connected_components(links(distinct))
    group = F.coalesce("component", "fp")  # components are named by their smallest fingerprint
    kept = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").groupBy(group.alias("group")).agg(F.min("first").alias("first"))
    kept = materialise(kept.select(F.col("first.row").alias(row)), "simhash-kept")
    discard(marked, distinct, labels)
    return kept
