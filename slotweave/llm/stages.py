"""The operators as corpus stages: documents in, kept or changed documents out.

Stages that drop documents decide row by row: rows are numbered once, so rows that share a
doc_id (or have none) and equal rows are told apart. Every stage keeps the columns it gets,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, mixing, pii, simhash
from .common import materialise, numbered, read_table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the rejected (no letters, or far from every learned language) go.

    Null, empty and letterless texts go; repeated rows are judged alike; without any
    labelled row every text with letters stays.
    """
    return langid.recognised(docs, langid.train(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id (null last), of repeated rows one.

    Texts without words are copies of one another. The numbers of the kept rows grow with
    the corpus, so they are never broadcast: texts are dealt by number once, at any size,
    and not sorted.
    """
    rows, row = numbered(docs, "dedup-rows")
    kept = simhash.one_of_each_group(rows, row).hint("shuffle_hash")
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item; null texts have none and stay, repeated rows go or stay together."""
    rows, row = numbered(docs, "decontaminate-rows")
    marked = decontaminate.decontaminate(rows, read_table(spark, sf_dir, "benchmark"), row)
    bad = materialise(marked.filter("contaminated").select(row), "contaminated")
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their text replaced by its kind; null texts stay null, n_chars follows the text."""
    return pii.redact(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that every source (null is one) has the same expected share, in one global random order.

    Rows of one doc_id and source are drawn alike; a count may be 0.
    """
    return mixing.mix_sources(docs)
