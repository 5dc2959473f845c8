"""Source mixing by Poisson replication (operator 9, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: A mean above this is drawn as a sum of equal parts, each inverted by itself.
PART_MEAN = 8.0
#: Entries of the tabulated distribution; at mean 8 the rest weighs less than 1e-16.
TABLE = 48
#: Rate tables of at most this many sources (some 30 MB) are broadcast; larger ones are shuffled.
BROADCAST_SOURCES = 50_000
#: Columns that replication adds; input columns of these names give way.
ADDED = ("copy_no", "mix_key")


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of MD5 over the keys; null counts as ''."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def mixing_rates(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None) -> DataFrame:
    """mix_source, mix_rate, mix_parts, mix_cdf: mean repetitions per document for the target mix.

    weights(source, weight) are relative; sources without one get weight 0, and without
    a table every source weighs the same. `total` is the expected number of output
    documents (default: as many as came in). A null source is a source of its own.
    """
    sizes = docs.groupBy(F.col("source").alias("mix_source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = weights.groupBy(F.col("source").alias("s")).agg(F.sum("weight").cast("double").alias("weight"))
        sizes = sizes.join(given, F.col("mix_source").eqNullSafe(F.col("s")), "left").drop("s").fillna(0.0, ["weight"])
    sizes = materialise(sizes, "mix-sizes")
    wanted = F.lit(float(total)) if total is not None else sizes.agg(F.sum("n_docs").cast("double")).scalar()
    share = F.col("weight") / F.nullif(sizes.agg(F.sum("weight")).scalar(), F.lit(0.0))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TABLE - 1)),
        F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("c")),
        lambda acc, k: F.struct(
            (acc["p"] * F.col("mean") / k).alias("p"),
            F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * F.col("mean") / k)).alias("c"),
        ),
        lambda acc: acc["c"],
    )
    rates = (
        sizes.withColumn("mix_rate", F.coalesce(wanted * share / F.col("n_docs"), F.lit(0.0)))
        .withColumn("mix_parts", F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / PART_MEAN).cast("int")))
        .withColumn("mean", F.col("mix_rate") / F.col("mix_parts"))
        .withColumn("mix_cdf", cdf)
    )
    return materialise(rates.select("mix_source", "mix_rate", "mix_parts", "mix_cdf"), "mix-rates")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, total: float | None = None, seed: int = 42) -> DataFrame:
    """docs(doc_id, source, ...) replicated to the target mix and shuffled globally.

    Adds copy_no (1, 2, ...) and mix_key (hex, the global order). A document's count is
    the Poisson distribution with its source's mean rate, inverted at a number hashed
    from (seed, doc_id): a recomputed task draws the same copies. Rows with the same
    doc_id and source get the same count; a null doc_id counts as ''; text may be null or
    of any length; other columns pass through, whatever their names, but for those it adds
    (ADDED). An empty table gives an empty result.

    Only counts per source are gathered (pre-aggregated). The text crosses the network
    once, dealt by a hash of doc_id and copy, so neither a large source nor a document
    with many copies fills one task.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    rates = mixing_rates(docs, weights, total)
    keep = docs.columns
    docs = docs.toDF(*[f"in_{c}" for c in keep])  # no name of the rates begins so
    match = F.col("in_source").eqNullSafe(F.col("mix_source"))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    draws = F.transform(F.sequence(F.lit(1), F.col("mix_parts")), lambda j: uniform(F.lit(seed), F.col("in_doc_id"), j))
    count = F.aggregate("mix_draws", F.lit(0), lambda acc, u: acc + F.size(F.filter("mix_cdf", lambda c: c <= u)))
    return (
        docs.join(rates, match)
        .withColumn("mix_draws", draws)
        .withColumn("mix_count", count)
        .filter("mix_count > 0")
        .select(*[F.col(f"in_{c}").alias(c) for c in keep], F.explode(F.sequence(F.lit(1), F.col("mix_count"))).alias("copy_no"))
        .withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "copy_no")))
        .repartition("mix_key")
        .sortWithinPartitions("mix_key", "doc_id", "copy_no")
    )
