"""Near identifiers and similar names."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotweave.functions import ids, text

from .lineage import materialise

REASONS = ["same core", "one digit changed, added or dropped", "extra digit at an end", "same middle digits"]


@F.pandas_udf(T.DoubleType())
def name_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two names; not symmetric, so the looked-for name comes first."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, rounded to 6 places: the native similarity."""
    return F.round(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)), 6)


def numeric_near(targets: DataFrame, images: DataFrame) -> DataFrame:
    """target, image, prefix, distance: the nearest image identifier of each target.

    targets(target), images(image). Cores share at least 9 leading digits, and their
    numbers differ by at most 250 (10 or more shared) or 100. The shared digits make it
    an equi-join; ties go to the smaller identifier.
    """
    # a core has 10 digits if the number has; the filter runs below any distinct of the input, so it is the cheaper form
    cores = lambda df, c: df.filter(F.length(ids.bare_digits(c)) >= 10).select(c, ids.upc_core(c).alias(f"{c}_core")).withColumn("block", F.substring(f"{c}_core", 1, 9)).distinct()
    a, b = F.col("target_core"), F.col("image_core")
    same = lambda n: (F.length(a) >= n) & (F.length(b) >= n) & (F.left(a, F.lit(n)) == F.left(b, F.lit(n)))
    prefix = F.when(same(11), 11).when(same(10), 10).otherwise(9)
    pairs = cores(targets, "target").join(cores(images, "image").hint("merge"), "block").withColumns({"prefix": prefix, "distance": F.abs(a.cast("long") - b.cast("long"))})
    near = pairs.filter(((F.col("prefix") >= 10) & (F.col("distance") <= 250)) | (F.col("distance") <= 100))
    best = near.groupBy("target").agg(F.min(F.struct((-F.col("prefix")).alias("p"), "distance", "image", "prefix")).alias("m"))
    return best.select("target", "m.image", "m.prefix", "m.distance")


def near_cores(c: Column | str) -> Column:
    """Distinct cores (10 digits and more) of an identifier's variants."""
    bare = F.transform(F.filter(ids.digit_variants(c), lambda v: F.length(v) >= 10), lambda v: F.regexp_replace(v, "^0+", ""))
    return F.array_distinct(F.filter(F.transform(bare, lambda v: F.when(F.length(v) == 12, F.substring(v, 1, 11)).otherwise(v)), lambda v: F.length(v) >= 10))


def near_rule(a: Column, b: Column) -> Column:
    """The lowest rule (1 to 4, see REASONS) that holds between two cores; null if none does."""
    both = (F.length(a) >= 11) & (F.length(b) >= 11)
    return F.when(a == b, 1).when(F.levenshtein(a, b) <= 1, 2).when(F.contains(a, b) | F.contains(b, a), 3).when(both & (F.substring(a, 2, 9) == F.substring(b, 2, 9)), 4)


def near_reasons(targets: DataFrame, images: DataFrame) -> DataFrame:
    """target, image, rule: every near pair and the lowest rule that holds over their cores (1 to 4, see REASONS).

    Each rule has its own keys: the core; the core and its one-digit deletions; one side's
    whole core among the other's pieces of 10 digits and more, in both directions; digits
    2 to 10. Pairs that meet are verified. Exploded keys are many times what Spark takes
    them for: the hint keeps it from collecting them in the driver for a broadcast.
    """

    def blocked(df: DataFrame, c: str, sides: tuple[str, str]) -> DataFrame:
        core = df.select(c, F.explode(near_cores(c)).alias(f"{c}_core")).distinct()
        v = F.col(f"{c}_core")
        n = F.length(v)
        deletions = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(v, F.lit(1), i - 1), F.substring(v, i + 1, n)))
        pieces = F.flatten(F.transform(F.sequence(F.lit(10), n), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(v, i, size))))
        tag = lambda rule, keys: F.transform(keys, lambda k: F.concat(F.lit(f"{rule}:"), k))
        middle = F.when(n >= 11, F.array(F.concat(F.lit("4:"), F.substring(v, 2, 9)))).otherwise(F.array().cast("array<string>"))
        keys = F.concat(tag("2", F.concat(F.array(v), deletions)), tag(sides[0], F.array(v)), tag(sides[1], pieces), middle)
        return core.select(c, f"{c}_core", F.explode(F.array_distinct(keys)).alias("key"))

    pairs = blocked(targets, "target", ("3a", "3b")).join(blocked(images, "image", ("3b", "3a")).hint("merge"), "key").select("target", "image", "target_core", "image_core").distinct()
    found = pairs.withColumn("rule", near_rule(F.col("target_core"), F.col("image_core"))).filter("rule IS NOT NULL")
    return found.groupBy("target", "image").agg(F.min("rule").alias("rule"))


#: 64-bit words of a name's bag: its 256 most frequent members have a bit each.
BAG_WORDS = 4
#: Names of one member's list that meet as many of the other side in one group of a join.
LIST_CHUNK = 1024
#: Parts into which what is asked of one key is dealt.
KEY_CHUNKS = 8
#: Tables of up to so many names (some 30 MB) are broadcast to the rows that have them; larger ones are shuffled.
BROADCAST_NAMES = 200_000
#: Of the names that are like what is asked, so many (and equals of the last) are looked for at a place before all others.
LEADING = 16
#: Letters of the pieces by which contained names are found.
PIECE = 8


def bag(c: Column) -> Column:
    """The characters of a name, each with the number of its occurrence: 'ABA' has A1, A2 and B1."""
    times = lambda x: F.length(c) - F.length(F.replace(c, x, F.lit("")))
    each = lambda x: F.transform(F.sequence(F.lit(1), (times(x) / F.length(x)).cast("int")), lambda k: F.concat(x, k.cast("string")))
    return F.flatten(F.transform(F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))), each))


def posted_names(df: DataFrame, c: str, rank: Column, least: float, longer: int) -> DataFrame:
    """A row for each member of a name's two prefixes: as the longer of a pair (role `longer`) and as the shorter.

    A pair that is `least` alike shares that part of its mean length. Of a name with n
    letters that leaves out, from the rarest member on, n less the shared ones: the pair's
    rarest shared member is among the one more that are posted.
    """
    n = F.length(c)
    shortest = F.greatest(F.lit(1), F.ceil(n * least / (2 - least) - 1e-9))
    need = lambda other: F.greatest(F.lit(1), F.ceil(least * (n + other) / 2 - 1e-9))
    members = F.array_sort(F.transform(bag(F.col(c)), lambda e: F.struct(F.coalesce(rank[e], F.lit(-1)).alias("rank"), e.alias("member"))))
    rows = df.withColumn("members", members)
    word = lambda w: F.aggregate("members", F.lit(0).cast("long"), lambda s, m: F.when(F.floor(m["rank"] / 64) == w, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (m["rank"] % 64).cast("int")))).otherwise(s))
    prefix = lambda role, need: F.transform(F.slice("members", F.lit(1), (n - need + 1).cast("int")), lambda m: F.struct(F.lit(role).alias("role"), m["rank"].alias("rank"), m["member"].alias("member")))
    words = [word(w).alias(f"{c}_{w}") for w in range(BAG_WORDS)]
    rest = F.size(F.filter("members", lambda m: m["rank"] < 0)).alias(f"{c}_rest")
    return rows.select(c, *words, rest, F.explode(F.concat(prefix(longer, need(shortest)), prefix(1 - longer, need(n)))).alias("p")).select(c, *[f"{c}_{w}" for w in range(BAG_WORDS)], f"{c}_rest", "p.*")


def sharing_names(names: DataFrame, others: DataFrame, least: float, chunk: int = LIST_CHUNK) -> DataFrame:
    """name, known_name: all pairs whose shared characters, repeats counted, are at least `least` of their mean length.

    names(name), others(known_name), distinct and not empty; least over 0. A prefix-filtered
    join of bags: names meet in the list of their rarest shared member only, and there two
    bit sets tell at once how much they share, so pairs that share less are never written.
    With over 256 different members the rarest ones count as shared if both names have as
    many: a few pairs more, never one less. Long lists meet in chunks. The driver reads the
    256 most frequent members.
    """
    if not least > 0:
        raise ValueError("names without a common character are not joined: least must be over 0")
    spark = names.sparkSession
    both = names.unionByName(others.select(F.col("known_name").alias("name")))
    often = both.select(F.explode(bag(F.col("name"))).alias("e")).groupBy("e").count().orderBy(F.desc("count"), "e").limit(64 * BAG_WORDS).collect()
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(reversed(often)) for x in (r.e, k)]) if often else F.lit(None).cast("map<string,int>")
    # few bytes but long work: as many tasks as shuffles have, which adaptive execution must not merge by size
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = posted_names(names.repartition(tasks, "name"), "name", rank, least, 1)
    theirs = posted_names(others.repartition(tasks, "known_name"), "known_name", rank, least, 0)
    key = ["role", "member"]
    count = lambda df, c: df.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias(c))
    chunks = count(mine, "mine").join(count(theirs, "theirs"), key)
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = [*key, "i", "j"]
    a = mine.drop("rank").join(chunks, key).withColumns({"i": cell("name", "mine"), "j": steps("theirs")}).drop("mine", "theirs").repartition(tasks, *at)
    b = theirs.join(chunks, key).withColumns({"i": steps("mine"), "j": cell("known_name", "theirs")}).drop("mine", "theirs")
    # bits of members before this one: a pair that shares one of them is reported there
    bit = F.pmod(F.col("rank"), F.lit(64)).cast("int")
    until = F.when(bit > 0, F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), 64 - bit)).otherwise(F.lit(0).cast("long"))
    before = {f"before_{w}": F.when(F.col("rank") >= 64 * (w + 1), F.lit(-1).cast("long")).when(F.col("rank") < 64 * w, F.lit(0).cast("long")).otherwise(until) for w in range(BAG_WORDS)}
    b = b.withColumns(before).drop("rank").repartition(tasks, *at)
    shared = [F.col(f"name_{w}").bitwiseAND(F.col(f"known_name_{w}")) for w in range(BAG_WORDS)]
    earlier = sum((F.bit_count(s.bitwiseAND(F.col(f"before_{w}"))) for w, s in enumerate(shared)), F.lit(0))
    most = sum((F.bit_count(s) for s in shared), F.least("name_rest", "known_name_rest"))
    n, m = F.length("name"), F.length("known_name")
    pairs = a.join(b, at).filter(((n >= m) == (F.col("role") == 1)) & (earlier == 0) & (2 * most >= F.lit(least) * (n + m) - 1e-9))
    return pairs.select("name", "known_name").distinct()


def contained_names(inner: DataFrame, outer: DataFrame, x: str, y: str) -> DataFrame:
    """x, y: all pairs in which the name x of `inner` stands within the name y of `outer`.

    Names are distinct and not empty. A name asks with the rarest of its pieces of eight
    letters (a shorter one with itself) for the names that have this piece.
    """
    size = F.least(F.length(x), F.lit(PIECE))
    sizes = [r.s for r in inner.select(size.alias("s")).distinct().collect()]
    pieces = lambda c, s: F.when(F.length(c) >= s, F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - s + 1, F.lit(1))), lambda i: F.substring(F.col(c), i, s))).otherwise(F.array().cast("array<string>"))
    listed = outer.select(y, F.explode(F.array_distinct(F.flatten(F.array(*[pieces(y, F.lit(s)) for s in sizes])) if sizes else F.array().cast("array<string>"))).alias("piece"))
    asked = inner.select(x, F.explode(F.array_distinct(pieces(x, size))).alias("piece")).join(listed.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "piece")
    rarest = asked.groupBy(x).agg(F.min(F.struct("n", "piece")).alias("r")).select(x, F.col("r.piece").alias("piece"))
    return rarest.join(listed, "piece").filter(F.contains(y, F.col(x))).select(x, y)


def similar_names(wanted: DataFrame, known: DataFrame, similarity, least: float, lift: float | None = None) -> DataFrame:
    """name, id, known_name, score: all pairs of names that are at least `least` alike.

    wanted(name), known(id, known_name); empty and missing names have no pair. A similarity
    is at most twice the shared characters over both lengths, as the matching-block and the
    edit ratio are; it runs once per distinct pair of names that this bound lets through. A
    contained name counts at least `lift`, whatever its length.
    """
    # read several times below: written once, so that what they come from runs once
    names = materialise(wanted.select("name").filter("name <> ''").distinct(), "names-wanted")
    others = materialise(known.select("known_name").filter("known_name <> ''").distinct(), "names-known")
    # ratios rounded to 6 places may be a little under the bound
    pairs = sharing_names(names, others, least - 1e-6)
    if lift is not None and lift >= least:
        within = contained_names(names, others, "name", "known_name").unionByName(contained_names(others, names, "known_name", "name"))
        pairs = pairs.unionByName(within).distinct()
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name", "known_name")
    scored = pairs.withColumn("score", similarity(F.col("name"), F.col("known_name")))
    if lift is not None:
        inside = F.contains("name", F.col("known_name")) | F.contains("known_name", F.col("name"))
        scored = scored.withColumn("score", F.when(inside, F.greatest("score", F.lit(lift))).otherwise(F.col("score")))
    return scored.filter(F.col("score") >= least).join(known, "known_name").select("name", "id", "known_name", "score")


def name_fallback(labels: DataFrame, products: DataFrame, similarity=name_ratio, least: float = 0.72, margin: float = 0.04) -> DataFrame:
    """row_id, product, score, next: the most similar product of labels without another link, unless a rival is within `margin`.

    labels(row_id, raw_text, name), products(product, name, norm_name, cpp). Labels with
    packaging text have none; products need a cpp over 0 and no packaging text. Prices are
    taken from the label's text before it is compared.
    """
    from .cards import match_rejection, mask_prices, packaging

    cleaned = text.norm_name(mask_prices(F.when(ids.text("name") != "", F.col("name")).otherwise(F.col("raw_text"))))
    rows = labels.filter((ids.text("raw_text") != "") & ~packaging("raw_text")).select("row_id", cleaned.alias("name")).filter("name <> ''")
    usable = products.filter(match_rejection("name", F.col("cpp")).isNull() & (F.col("cpp") > 0)).select(F.col("product").alias("id"), F.col("norm_name").alias("known_name"))
    scored = similar_names(rows, first_ids(usable, 2), similarity, least).groupBy("name", "id").agg(F.max("score").alias("score"))
    w = W.partitionBy("name").orderBy(F.desc("score"), "id")
    top = scored.withColumns({"k": F.row_number().over(w), "next": F.lead("score").over(w)}).filter("k = 1").filter(F.col("next").isNull() | (F.col("next") < F.col("score") - margin))
    return rows.join(top, "name").select("row_id", F.col("id").alias("product"), "score", "next")


def clear_winner(scored: DataFrame, least: float, margin: float, sure: float = 2.0) -> DataFrame:
    """name, id, score, margin: the best of each name if it is at least `least` and `margin` before any other id, or at least `sure`."""
    per_id = scored.groupBy("name", "id").agg(F.max("score").alias("score"))
    w = W.partitionBy("name").orderBy(F.desc("score"), "id")
    top = per_id.withColumns({"k": F.row_number().over(w), "next": F.coalesce(F.lead("score").over(w), F.lit(0.0))}).filter("k = 1").withColumn("margin", F.round(F.col("score") - F.col("next"), 6))
    return top.filter((F.col("score") >= least) & ((F.col("score") >= sure) | (F.col("margin") >= margin))).select("name", "id", "score", "margin")


def scored_near_pairs(wanted: DataFrame, files: DataFrame, similarity) -> DataFrame:
    """target, image, score: names compared only among pairs of near identifiers; a contained name counts at least 0.88.

    wanted(target, name), files(image, known_name); pairs under 0.5 are left out.
    """
    near = near_reasons(wanted.select("target").distinct(), files.select("image").distinct()).select("target", "image")
    pairs = near.join(wanted.hint("merge"), "target").join(files.hint("merge"), "image").filter("name <> '' AND known_name <> ''")
    inside = F.contains("name", F.col("known_name")) | F.contains("known_name", F.col("name"))
    scored = pairs.withColumn("s", similarity(F.col("name"), F.col("known_name"))).withColumn("score", F.when(inside, F.greatest("s", F.lit(0.88))).otherwise(F.col("s")))
    return scored.filter("score >= 0.5").select("target", "image", "score")


def linked_by_name_and_id(wanted: DataFrame, files: DataFrame, similarity, least: float = 0.78, margin: float = 0.08, sure: float = 0.86) -> DataFrame:
    """name (the target), id (the image), score, margin: the best near pair if it is sure, or at least `least` and `margin` before the next image."""
    scored = scored_near_pairs(wanted, files, similarity)
    return clear_winner(scored.select(F.col("target").alias("name"), F.col("image").alias("id"), "score"), least, margin, sure)


def scored_by_key(asked: DataFrame, products: DataFrame, keys: list[str], first: str, similarity) -> DataFrame:
    """The columns of asked(keys, name), norm_name, `first`, score: the first product of each key and name, all that share a key with what is asked.

    Products of one key and name are equally alike, so the others cannot win. Few keys with
    many names are long work on few bytes: what is asked of a key is dealt to chunks, over as
    many tasks as shuffles have, which adaptive execution must not merge by size.
    """
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = products.groupBy(*keys, "norm_name").agg(F.min(first).alias(first)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(KEY_CHUNKS - 1))))
    dealt = asked.withColumn("chunk", F.pmod(F.xxhash64("name"), F.lit(KEY_CHUNKS)).cast("int"))
    at = [*keys, "chunk"]
    met = dealt.repartition(tasks, *at).join(known.repartition(tasks, *at).hint("merge"), at).drop("chunk")
    return met.withColumn("score", similarity(F.col("name"), F.col("norm_name")))


def alike_names(asks: DataFrame, known: DataFrame, similarity, least: float) -> DataFrame:
    """asked, norm_name, first, k: all pairs of different texts that are `least` alike and their rank in `asked`; written once. asks(asked), known(norm_name)."""
    names = known.select(F.col("norm_name").alias("id"), F.col("norm_name").alias("known_name")).distinct()
    pairs = similar_names(asks.select(F.col("asked").alias("name")), names, similarity, least).select(F.col("name").alias("asked"), F.col("id").alias("norm_name"), F.col("score").alias("first"))
    return materialise(pairs.withColumn("k", F.rank().over(W.partitionBy("asked").orderBy(F.desc("first")))), "names-alike")


def best_standing(asks: DataFrame, stand: DataFrame, alike: DataFrame, by: list[str]) -> DataFrame:
    """*by, asked, norm_name, product, first, ties: of the names at a place the most similar to what is asked there, all of equals.

    asks(*by, asked), stand(*by, norm_name, product), alike as alike_names gives it. Ranks
    hold equals together, so where one of the leading names stands no later one can be as
    similar: only other asks meet the rest.
    """
    at, out = [*by, "asked"], None
    for part in (F.col("k") <= LEADING, F.col("k") > LEADING):
        met = asks.join(alike.filter(part).drop("k"), "asked").join(stand, [*by, "norm_name"])
        most = met.withColumn("most", F.max("first").over(W.partitionBy(*at))).filter("first = most").drop("most")
        best = materialise(most.withColumn("ties", F.count(F.lit(1)).over(W.partitionBy(*at))), "names-standing")
        out = best if out is None else out.unionByName(best)
        asks = asks.join(best.select(*at).distinct(), at, "left_anti")
    return out


def first_ids(known: DataFrame, n: int) -> DataFrame:
    """The n first ids of each known_name: of equal names, no other can be among a name's n best."""
    w = W.partitionBy("known_name").orderBy("id")
    return known.select("id", "known_name").distinct().withColumn("k", F.row_number().over(w)).filter(F.col("k") <= n).drop("k")


def best_of_names(rows: DataFrame, products: DataFrame, similarity) -> DataFrame:
    """last5, name, src_ord, score: the product of each different last5 and name of rows that has one, as best_of_key finds it."""
    alike = scored_by_key(rows.select("last5", "name").distinct(), products, ["last5"], "src_ord", similarity)
    best = alike.groupBy("last5", "name").agg(F.max(F.struct("score", (-F.col("src_ord")).alias("o"))).alias("b"))
    return best.select("last5", "name", (-F.col("b.o")).alias("src_ord"), F.col("b.score").alias("score"))


def with_best(rows: DataFrame, best: DataFrame) -> DataFrame:
    """Rows with the columns of best(last5, name, ...), written once.

    Few different names stand in very many rows: up to BROADCAST_NAMES of them go to the
    rows, which are then neither sorted nor dealt by them; more are shuffled.
    """
    best = materialise(best, "best-of-names")
    known = F.broadcast(best) if best.count() <= BROADCAST_NAMES else best.hint("merge")
    return rows.join(known, ["last5", "name"], "left")


def best_of_key(rows: DataFrame, products: DataFrame, similarity) -> DataFrame:
    """row_id, src_ord, score: the product of the row's last5; of several, the most similar name, the first of equals.

    rows(row_id, last5, name), products(last5, src_ord, norm_name).
    """
    return with_best(rows, best_of_names(rows, products, similarity)).select("row_id", "src_ord", "score")


def suggested_aliases(missing: DataFrame, files: DataFrame, numeric: DataFrame, similarity=name_ratio, least: float = 0.72, near: float = 0.86, top: int = 5) -> DataFrame:
    """current, suggested, image_name, confidence, reason: aliases to review for identifiers without an image.

    missing(target, name), files(image, known_name): the `top` most similar names, a
    contained one counts at least 0.88, one whose identifier is near at least `near`;
    equals by name, then identifier. numeric(target, image): numeric neighbours, at 0.5. Of
    equal pairs the most confident stays.
    """
    ids_ = files.select(F.col("image").alias("id"), "known_name")
    names = ids_.select(F.col("known_name").alias("id"), "known_name").distinct()
    alike = materialise(similar_names(missing, names, similarity, least, 0.88).select("name", "known_name", "score"), "names-alike")
    # nearness only raises: a target's best are among its name's best and the near images
    by_score = W.partitionBy("name").orderBy(F.desc("score"), "known_name", "id")
    leading = alike.join(first_ids(ids_, top).hint("merge"), "known_name").withColumn("k", F.row_number().over(by_score)).filter(F.col("k") <= top)
    led = missing.join(leading.hint("merge"), "name").select("target", F.col("id").alias("image"), "known_name", "score")
    near_ids = materialise(near_reasons(missing.select("target").distinct(), files.select("image").distinct()), "near-ids")
    met = near_ids.drop("rule").join(missing.hint("merge"), "target").join(files.select("image", "known_name").hint("merge"), "image").join(alike, ["name", "known_name"])
    pairs = led.unionByName(met.select("target", "image", "known_name", "score")).distinct().join(near_ids.hint("merge"), ["target", "image"], "left")
    pairs = pairs.withColumn("confidence", F.when(F.col("rule").isNotNull(), F.greatest("score", F.lit(near))).otherwise(F.col("score")))
    w = W.partitionBy("target").orderBy(F.desc("confidence"), "known_name", "image")
    names = F.array(*[F.lit(x) for x in REASONS])
    by_name = pairs.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= top).select(
        F.col("target").alias("current"), F.col("image").alias("suggested"), F.col("known_name").alias("image_name"), "confidence",
        F.when(F.col("rule").isNotNull(), F.element_at(names, F.col("rule"))).otherwise("similar name").alias("reason"),
    )
    by_number = numeric.select(F.col("target").alias("current"), F.col("image").alias("suggested"), F.lit("").alias("image_name"), F.lit(0.5).alias("confidence"), F.lit("numeric neighbour").alias("reason"))
    best = by_name.unionByName(by_number).groupBy("current", "suggested").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "image_name", "reason")).alias("b"))
    return best.select("current", "suggested", "b.image_name", F.round(-F.col("b.c"), 4).alias("confidence"), "b.reason")
