"""Approvals, mappings and suggestions as table merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import ids, text

KEY = ["upc", "item"]


def single_approvals(review: DataFrame, readable: Column) -> DataFrame:
    """Approved and selected rows with a state: duplicate (over one in the group: all of them), bad_path, or valid."""
    chosen = review.filter(text.truthy_review("approved") & text.truthy_review("selected"))
    per_group = chosen.groupBy("review_group_id").agg(F.count(F.lit(1)).alias("n"))
    state = F.when(F.col("n") > 1, "duplicate").when(~readable, "bad_path").otherwise("valid")
    return chosen.join(per_group, "review_group_id").withColumn("state", state)


def keyed(rows: DataFrame, upc: str, item: str) -> DataFrame:
    return rows.withColumns({"upc": ids.digits_only(upc), "item": ids.digits_only(item)})


def upsert(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """existing(upc, item, path, created) with changes(upc, item, path, at): new keys are added, known ones get the path and keep `created`.

    `action` says added, updated or kept. Both sides have a key once.
    """
    e = existing.select(*KEY, F.col("path").alias("old_path"), "created")
    return e.join(changes, KEY, "full_outer").select(
        *KEY, F.coalesce("path", "old_path").alias("path"), F.coalesce("created", "at").alias("created"), F.coalesce("at", "created").alias("updated"),
        F.when(F.col("path").isNull(), "kept").when(F.col("old_path").isNull(), "added").otherwise("updated").alias("action"),
    )


def insert_new(existing: DataFrame, rows: DataFrame, order: str = "src_ord") -> DataFrame:
    """Rows whose key is not known yet, the first of each new key."""
    first = rows.withColumn("_k", F.row_number().over(W.partitionBy(*KEY).orderBy(order))).filter("_k = 1").drop("_k")
    return first.join(existing.select(*KEY), KEY, "left_anti")


def delete(mapping: DataFrame, upc: str, item: str | None = None) -> DataFrame:
    gone = F.col("upc") == upc if item is None else (F.col("upc") == upc) & (F.col("item") == item)
    return mapping.filter(~gone)


def distinct_suggestions(rows: DataFrame) -> DataFrame:
    """One per (current, suggested): the highest confidence, the first of equals."""
    w = W.partitionBy("current", "suggested").orderBy(F.desc("confidence"), "ord")
    return rows.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def suggestion_status(rows: DataFrame) -> DataFrame:
    """Adds status: approved, review or ignore, by rank, confidence, lead over the second and reason."""
    w = W.partitionBy("current").orderBy(F.desc("confidence"), "suggested")
    ranked = rows.withColumns({"k": F.row_number().over(w), "n": F.count(F.lit(1)).over(W.partitionBy("current"))})
    second = F.coalesce(F.max(F.when(F.col("k") == 2, F.col("confidence"))).over(W.partitionBy("current")), F.lit(0.0))
    ranked = ranked.withColumn("lead", F.round(F.max("confidence").over(W.partitionBy("current")) - second, 6))
    alone = lambda least: (F.col("n") == 1) | (F.col("lead") >= least)
    status = (
        F.when(F.col("reason") == "numeric", "review")
        .when((F.col("k") == 1) & (F.col("reason") == "near") & (F.col("confidence") >= 0.88) & alone(0.04), "approved")
        .when((F.col("k") == 1) & (F.col("confidence") >= 0.92) & alone(0.025), "approved")
        .when(F.col("confidence") >= 0.84, "review")
        .otherwise("ignore")
    )
    return ranked.withColumn("status", status).drop("k", "n", "lead")
