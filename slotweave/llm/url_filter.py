"""URL rules by host suffix and path prefix (operator 3, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """Text after the first :// up to / ? # or the end, A-Z lower-cased; '' without :// or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """Text from the end of the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule, verdict for every row of pages(page_id, url, ...).

    rules(host, path, verdict): a rule fits its host and all subdomains when the url's
    path starts with the rule's. The longest fitting rule (host plus path, then host)
    wins; a block beats an allow on the same host and path. No rule: null and `default`.

    Each url becomes host-suffix x path-prefix expressions, prefixes only of lengths
    that occur among the rules. Expressions meet rules on the first 32 bits of SHA-256;
    full digests confirm. Null or malformed urls have empty host and path and fit no
    rule; repeated rows are kept; an empty table gives an empty result.
    """
    book = (
        rules.select(F.coalesce(ascii_lower("host"), F.lit("")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v"))
        .filter("h <> ''")
        .groupBy("h", "p")
        .agg(F.max("v").alias("v"))  # 'block' > 'allow'
        .select(F.concat("h", "p").alias("rule"), F.length("h").alias("rule_host"), F.length("p").alias("rule_path"), "v")
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    lengths = book.agg(F.collect_set("rule_path").alias("lengths")).select("lengths").scalar()
    labels = F.split("host", r"\.")
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    )
    prefixes = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    urls = (
        pages.select("page_id", "url")
        .withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url")), "lengths": lengths})
        .withColumn("expressions", expressions)
        .select("page_id", "url", "host", "path", F.greatest(F.size("expressions"), F.lit(1)).alias("n"), F.explode_outer("expressions").alias("expression"))
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    hit = urls.alias("u").join(book.alias("b"), (F.col("u.prefix") == F.col("b.prefix")) & (F.col("u.digest") == F.col("b.digest")), "left")
    best = F.max(F.when(F.col("b.rule").isNotNull(), F.struct(F.length("b.rule").alias("size"), F.col("b.rule_host"), F.col("b.rule"), F.col("b.v"))))
    return (
        hit.groupBy("page_id", "url", "host", "path", "n")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("rows"))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.expr("int(rows div n)"))))
        .select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
    )
