"""Row checks, classes, duplicates, groups and counters of placements."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import ids, text

from .lineage import materialise

SLOT = ["pog", "side", "row", "col"]
# The status words and the section that mark rows without an image.
BLANK_STATUS = "INTENTIONAL BLANK"
PENDING_STATUS = ["GCI IMAGE PENDING", "GCI PENDING IMAGE"]
PENDING_TOKEN = "GCI"
BLANK_SECTION = "SAMS FP GFT"
BLANK_IDENTIFIERS = ["SAMTEMP6"]


def either(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def any_filled(columns: Sequence[str]) -> Column:
    return either([ids.text(c) != "" for c in columns])


def drop_blank_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.filter(any_filled(columns or df.columns))


def typed_slots(df: DataFrame) -> DataFrame:
    """pog trimmed; side, row and col as numbers cut toward zero, null where they are none."""
    return df.withColumns({"pog": ids.text("pog"), "side": ids.as_int("side"), "row": ids.as_int("row"), "col": ids.as_int("col")})


def column_limit(side: Column | str) -> Column:
    s = F.col(side) if isinstance(side, str) else side
    return F.when(s.isin(1, 3), 8).when(s.isin(2, 4), 10)


def slot_reason(df: DataFrame) -> DataFrame:
    """Adds reject_reason, the first rule a typed row fails: pog, side, row, column, column_limit; null if none."""
    off = lambda c: c.isNull() | (c <= 0)
    reason = (
        F.when(F.col("pog") == "", "pog")
        .when(F.col("side").isNull() | ~F.col("side").isin(1, 2, 3, 4), "side")
        .when(off(F.col("row")), "row")
        .when(off(F.col("col")), "column")
        .when(F.col("col") > column_limit("side"), "column_limit")
    )
    return df.withColumn("reject_reason", reason)


def valid_strip_row() -> Column:
    """pog filled and side, row, column above zero."""
    return (F.col("pog") != "") & F.coalesce((F.col("side") > 0) & (F.col("row") > 0) & (F.col("col") > 0), F.lit(False))


def intentional_blank(section_fields: Sequence[str] = ("merchant_category", "segment"), section: str = BLANK_SECTION) -> Column:
    named = [text.classify_text(c) == section for c in section_fields]
    known = [text.classify_text(c).isin(BLANK_IDENTIFIERS) for c in ("item_number", "upc")]
    return either([text.truthy("intentional_blank"), text.classify_text("image_status") == BLANK_STATUS, *named, *known])


def pending_image(fields: Sequence[str] = ("merchant_category", "segment", "brand", "desc_1", "desc_2", "description", "item_number")) -> Column:
    """Status says so, or the token stands in any of the fields."""
    haystack = F.split(text.classify_text(F.concat_ws(" ", *[ids.text(c) for c in fields])), " ")
    return text.classify_text("image_status").isin(PENDING_STATUS) | F.array_contains(haystack, PENDING_TOKEN)


def missing_fields(required: Sequence[str], described_by: Sequence[str] = ()) -> Column:
    """array<string> of what is missing."""
    parts = [F.when(ids.text(c) == "", F.lit(f"missing {c}")) for c in required]
    if described_by:
        parts.append(F.when(~any_filled(described_by), F.lit("missing description")))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "copy") -> DataFrame:
    """Adds the row's place among equal keys; 1 is kept, more are duplicates."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def catalog_class(listing_known: Column, failed_first: bool) -> Column:
    """no_path, missing_file, failed or valid; `failed_first` tests the status before the path."""
    failed = F.upper(ids.text("catalog_status")).isin("ERROR", "FAILED", "FAIL") & ~any_filled(["filename_upc", "detected_text", "detected_brand", "detected_denomination", "detected_pack_quantity"])
    no_path, gone = ids.text("file_path") == "", ~listing_known
    if failed_first:
        return F.when(failed, "failed").when(no_path, "no_path").when(gone, "missing_file").otherwise("valid")
    return F.when(no_path, "no_path").when(gone, "missing_file").when(failed, "failed").otherwise("valid")


def product_groups(df: DataFrame) -> DataFrame:
    """One row per (upc, item): attributes of the first row, ordered positions, distinct pogs, group id in first-seen order.

    Group ids need one order over all groups: the ranks come from ranges, each numbered
    by itself, plus the sizes of the ranges before it.
    """
    keyed = df.withColumns({"upc_digits": ids.digits_only("upc"), "item_digits": ids.digits_only("item_number")}).filter("upc_digits <> '' OR item_digits <> ''")
    where = F.concat(F.col("pog"), F.lit(":S"), F.col("side"), F.lit(":R"), F.col("row"), F.lit(":C"), F.col("col"))
    first = F.min_by(F.struct("desc_1", "description", "brand", "cpp", "merchant_category", "segment"), "src_ord")
    groups = keyed.groupBy("upc_digits", "item_digits").agg(
        F.min("src_ord").alias("first_ord"), first.alias("first"), F.array_sort(F.collect_set("pog")).alias("pogs"), F.array_sort(F.collect_list(F.struct("src_ord", where.alias("at")))).alias("positions"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    groups = groups.select(
        "upc_digits", "item_digits", "first_ord", "first.*", F.array_join(F.filter("pogs", lambda p: F.trim(p) != ""), " | ").alias("pogs"),
        F.array_join(F.transform("positions", lambda p: p["at"]), " | ").alias("positions"), "n_rows",
    )
    # ranks come from a light pass over the keys: the range sort reads its input several times
    firsts = keyed.groupBy("upc_digits", "item_digits").agg(F.min("src_ord").alias("ord"))
    ranks = global_rank(firsts, "ord", "rank").select("upc_digits", "item_digits", F.concat(F.lit("RG"), ids.pad_left(F.col("rank").cast("string"), 5)).alias("group_id"))
    return groups.join(ranks, ["upc_digits", "item_digits"])


def global_rank(df: DataFrame, order: str, name: str) -> DataFrame:
    """1, 2, ... by a unique order column, without one task holding all rows.

    Ranges are drawn anew and merged by size each time a plan runs: rows are written once
    with the range they are in, so that sizes and places are those of the same ranges.
    """
    placed = materialise(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row per task
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = placed.withColumn("_k", F.row_number().over(W.partitionBy("_part").orderBy(order)))
    return inside.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_k")).drop("_part", "_before", "_k")


def strip_groups(df: DataFrame) -> DataFrame:
    """Strips (pog, side, row): cards in column order, footer and size from the first filled, conflict flags."""
    card = F.struct("col", "src_ord", "item_number", "retail")
    filled = lambda c: F.when(ids.text(c) != "", ids.text(c))
    first = lambda c: F.min_by(filled(c), F.when(ids.text(c) != "", F.struct("col", "src_ord")))
    several = lambda c: F.coalesce(F.min(filled(c)) != F.max(filled(c)), F.lit(False))  # noqa: E731 - counts of distinct values would shuffle every card once for each count
    size = text.strip_length("first_length")
    return (
        df.groupBy("pog", "side", "row")
        .agg(
            F.sort_array(F.collect_list(card)).alias("cards"), first("footer").alias("footer"), several("footer").alias("footers"),
            first("length").alias("first_length"), several("length").alias("lengths"),
        )
        .select(
            "pog", "side", "row", F.size("cards").alias("n_cards"), F.array_join(F.transform("cards", lambda x: F.concat(x["col"].cast("string"), F.lit("="), x["item_number"])), ",").alias("cards"),
            F.coalesce("footer", F.format_string("Side: %d, Row: %d - POG: %s", "side", "row", "pog")).alias("footer"), F.col("footers").alias("footer_conflict"),
            size["width"].alias("width"), size["height"].alias("height"),
            F.when(F.col("first_length").isNull(), "missing").when(size.isNull(), "unparseable").when(F.col("lengths"), "multiple").otherwise("ok").alias("length_state"),
        )
    )


def densify(df: DataFrame, slots: DataFrame) -> DataFrame:
    """Every slot of each (pog, side, row): the last card of its column, or an empty one; columns past the side are dropped.

    slots(side, slot_count) is the geometry, one row a side. The rows are read once: a
    strip's cards are gathered (the last of each column, at most as many as it has columns)
    and its slots are made from them.
    """
    last = df.groupBy("pog", "side", "row", "col").agg(F.max_by("item_number", "src_ord").alias("item_number"))
    strips = last.groupBy("pog", "side", "row").agg(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), "item_number")).alias("cards"))
    wide = strips.join(F.broadcast(slots), "side").withColumn("cards", F.map_from_entries("cards")).withColumn("col", F.explode(F.sequence(F.lit(1), F.col("slot_count"))))
    item = F.try_element_at("cards", F.col("col"))
    return wide.select("pog", "side", "row", "col", item.alias("item_number"), item.isNull().alias("is_empty"))


def row_count_check(df: DataFrame, geometry: DataFrame) -> DataFrame:
    """(pog, side): priced rows against the expected number; a first row of exactly 9 cards on wide sides is a header.

    geometry(side, slot_count, expected_rows, header_rows), one row a side.
    """
    rows = df.groupBy("pog", "side", "row").agg(F.count(F.lit(1)).alias("cards"), F.max("col").alias("widest"))
    ranked = rows.join(F.broadcast(geometry), "side").withColumn("k", F.row_number().over(W.partitionBy("pog", "side").orderBy("row")))
    head = (F.col("k") <= F.col("header_rows")) & (F.col("cards") == 9)
    odd = (F.col("k") <= F.col("header_rows")) & (F.col("cards") != 9) & (F.col("row") == 1)
    return (
        ranked.withColumns({"head": head, "odd": odd, "wide": ~head & (F.col("widest") > F.col("slot_count"))})
        .groupBy("pog", "side")
        .agg(
            F.count_if(~F.col("head")).alias("priced_rows"), F.max("expected_rows").alias("expected_rows"), F.bool_or("odd").alias("header_warning"), F.count_if(F.col("wide")).alias("overflow_rows")
        )
        .withColumn("count_warning", F.col("priced_rows") != F.col("expected_rows"))
    )


def structure_counts(df: DataFrame) -> DataFrame:
    """Slots, rows and widest row per side, from one two-level aggregation."""
    rows = df.groupBy("pog", "side", "row").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("col").alias("columns"))
    return rows.groupBy("pog", "side").agg(F.sum("n").alias("slots"), F.count(F.lit(1)).alias("rows"), F.max("columns").alias("widest"))


def choose_pog(df: DataFrame, wanted: str | None) -> DataFrame:
    """Rows of the wanted pog if it is there, else of the first by name."""
    names = df.filter("pog <> ''")
    picked = names.agg(F.coalesce(F.max(F.when(F.col("pog") == F.lit(wanted), F.col("pog"))), F.min("pog")).alias("picked"))
    return df.filter(F.col("pog") == picked.scalar())
