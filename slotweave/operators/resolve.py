"""Linking placements to products and images by prioritised keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import ids

from .lineage import dealt


def key_index(files: DataFrame, keys: Column, path: str = "path", order: str = "src_ord") -> DataFrame:
    """key, path, conflicts: the first file per key and how many other files claim it."""
    rows = dealt(files, order).select(F.explode(keys).alias("key"), F.col(path).alias("path"), F.col(order).alias("ord"))
    return rows.groupBy("key").agg(F.min_by("path", "ord").alias("path"), (F.count_distinct("path") - 1).alias("conflicts"))


def unambiguous_index(files: DataFrame, keys: Column, path: str = "path", order: str = "src_ord", short: int = 5) -> DataFrame:
    """Like key_index, but keys of at most `short` characters claimed twice are dropped."""
    rows = dealt(files, order).select(F.explode(keys).alias("key"), F.col(path).alias("path"), F.col(order).alias("ord"))
    counted = rows.groupBy("key").agg(F.min_by("path", "ord").alias("path"), F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("key") > short) | (F.col("n") == 1))


def lookup(rows: DataFrame, row_id: str, by: str, keys: Column, index: DataFrame) -> DataFrame:
    """row_id, path, key: the file under the first of the row's keys that the index has.

    Keys are worked out from the column `by`, once per distinct value. An index is rows
    exploded to keys, which are many times what Spark takes them for: the hints keep it from
    collecting them in the driver for a broadcast.
    """
    asked = rows.select(by).filter(F.col(by).isNotNull()).distinct().select(by, F.posexplode(keys).alias("pos", "key"))
    found = asked.join(index.select("key", "path").hint("merge"), "key").groupBy(by).agg(F.min(F.struct("pos", "key", "path")).alias("hit"))
    hits = rows.select(*dict.fromkeys([row_id, by])).join(found.hint("merge"), by)
    return hits.groupBy(row_id).agg(F.min("hit").alias("hit")).select(row_id, "hit.path", "hit.key")


def cascade(rows: DataFrame, row_id: str, by: Sequence[str], steps: Sequence[tuple[str, Column, DataFrame]]) -> DataFrame:
    """row_id, path, source: the first step that resolves a row, keys in their order within a step.

    steps: (source, array of keys, index(key, path)); keys are worked out from the columns
    `by` alone, once per distinct combination. All steps are one equi-join on (step, key)
    and one pre-aggregated minimum, however many there are; the rows then take the answer
    of their combination.
    """
    wanted = F.array(*[F.struct(F.lit(k).alias("step"), keys.alias("keys")) for k, (_, keys, _) in enumerate(steps)])
    asked = rows.select(*by).distinct().select(*by, F.explode(wanted).alias("w")).select(*by, "w.step", F.posexplode("w.keys").alias("pos", "key"))
    known = None
    for k, (_, _, index) in enumerate(steps):
        part = index.select(F.lit(k).alias("step"), "key", "path")
        known = part if known is None else known.unionByName(part)
    best = asked.join(known, ["step", "key"]).groupBy(*by).agg(F.min(F.struct("step", "pos", "path")).alias("hit"))
    names = F.array(*[F.lit(s) for s, _, _ in steps])
    found = best.select(*by, F.col("hit.path").alias("path"), F.element_at(names, F.col("hit.step") + 1).alias("source"))
    return rows.select(*dict.fromkeys([row_id, *by])).join(found, list(by), "left").select(row_id, "path", F.coalesce("source", F.lit("unresolved")).alias("source"))


def basename_keys(path: str) -> Column:
    return F.array_compact(F.array(F.nullif(F.lower(ids.basename(path)), F.lit(""))))


def best_by(rows: DataFrame, by: Sequence[str], order: Sequence[Column], limit: int = 1, rank: str = "rank") -> DataFrame:
    """The first `limit` rows of each group, numbered."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= limit)


def patch_missing(rows: DataFrame, patches: DataFrame) -> DataFrame:
    """Rows with the patch whose key is theirs and all of whose words stand in the row's name.

    rows(last5, norm_name, ...), patches(last5, upc12, patch_name, patch_qty, words array): a
    parameter table of confirmed items that the product list lacks.
    """
    fits = F.forall("words", lambda w: F.contains(F.col("norm_name"), w))
    return rows.join(patches, "last5", "left").withColumns({c: F.when(fits, F.col(c)) for c in ("upc12", "patch_name", "patch_qty")}).drop("words")


def translate_aliases(rows: DataFrame, upc: str, aliases: DataFrame) -> DataFrame:
    """Adds alias_upc by the identifier or its zero-stripped form. aliases(key, alias_upc) as load_aliases gives it."""
    keys = F.array_distinct(F.array(F.col(upc), ids.strip_zeros(F.col(upc))))
    asked = rows.select(upc).distinct().select(upc, F.posexplode(keys).alias("pos", "key"))
    found = asked.join(aliases, "key").groupBy(upc).agg(F.min_by("alias_upc", "pos").alias("alias_upc"))
    return rows.join(found, upc, "left")
