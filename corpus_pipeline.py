"""The corpus pipeline: language ID, near-dedup, decontamination, PII, source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotweave.llm import stages
from slotweave.llm.common import materialise, read_table

STAGES = [
    ("language_id", stages.language_id),
    ("simhash_near_dedup", stages.near_dedup),
    ("benchmark_decontamination", stages.decontamination),
    ("pii", stages.pii_redaction),
    ("source_mixing", stages.source_mixing),
]

#: Character models, SimHash components and deobfuscation have no SQL form; tests/llm/test_pipeline.py checks run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over the table documents; each stage's rows are written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
