"""Label hints, packaging and signage rules, candidate cleaning, box checks and asset choice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import ids, text

# Words of packaging, phrases and words of fixtures and signs.
PACKAGING = ["GCI", "LID", "BOX", "WRAP", "ENV", "ENVELOPE", "SHAPED", "PRESENT SLIDER", "PK CHAR", "2PK", "3PK", "HOLDER", "MESSAGE", "FRAME SIGN", "OCTAGON", "TOP OCTAGON", "PACKAGING"]
SIGN_PHRASES = [
    "MARKETING MESSAGE", "FRAME SIGN", "GIFT CARD HOLDER", "GIFT CARD HOLDERS", "GIFT CARD D", "GIFT CARD IN NEW", "GIFT CARD D IN NEW", "GCI TALL", "GCI THIN", "GCI 3PK", "GCI 3 PK", "TALL LID", "THIN LID",
    "XL PRESENT", "XL ENV", "3 PK WRAP", "3 PK DIECUT", "3PK SHAPED", "2 PK", "BOX TRUCK", "GIFT CARD PKG",
]
PRICES = [r"\$\s*[0-9]+\s*-\s*\$?\s*[0-9]+(?:\.[0-9]{2})?", r"\b[0-9]+\s*-\s*[0-9]+\b", r"\$\s*[0-9]+(?:\.[0-9]{2})?", r"\b[0-9]+\.[0-9]{2}\b"]


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def mask_prices(c: Column) -> Column:
    """Prices and ranges blanked, in the order of the rules."""
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), PRICES, c)


def identity_tokens(c: Column | str) -> Column:
    """Distinct runs of 5 to 14 digits that are no part of a price."""
    return F.array_distinct(F.regexp_extract_all(mask_prices(ids.text(c)), F.lit(r"\b([0-9]{5,14})\b"), 1))


def price_tokens(c: Column | str) -> Column:
    """The prices that were blanked, rule by rule, without spaces."""
    out, t = [], ids.text(c)
    for p in PRICES:
        out.append(F.regexp_extract_all(t, F.lit(f"({p})"), 1))
        t = F.regexp_replace(t, p, " ")
    return F.transform(F.concat(*out), lambda x: F.regexp_replace(x, r"\s+", ""))


def label_hints(c: Column | str) -> Column:
    """struct(upc12s, last5s) of the runs of 4 to 14 digits."""
    runs = F.regexp_extract_all(ids.text(c), F.lit("([0-9]{4,14})"), 1)
    upcs = F.transform(F.filter(runs, lambda d: F.length(d) >= 11), lambda d: F.lpad(F.right(d, F.lit(12)), 12, "0"))
    fives = F.transform(F.filter(runs, lambda d: F.length(d) >= 5), lambda d: F.right(d, F.lit(5)))
    return F.struct(F.array_distinct(upcs).alias("upc12s"), F.array_distinct(fives).alias("last5s"))


def packaging(c: Column | str) -> Column:
    padded = F.concat(F.lit(" "), text.norm_name(c), F.lit(" "))
    return either([F.contains(padded, F.lit(f" {t} ")) for t in PACKAGING])


def signage(c: Column | str) -> Column:
    """Fixture or sign: a phrase anywhere, or words that go together."""
    n = text.norm_name(c)
    tokens = F.split(n, " ")
    has = lambda *ws: either([F.array_contains(tokens, w) for w in ws])
    return (
        either([F.contains(n, F.lit(p)) for p in SIGN_PHRASES])
        | has("GCI", "PKG", "HEADER", "SIGN", "FIXTURE", "GIFTCARD")
        | (has("GIFT") & has("CARD") & has("NEW", "PKG"))
        | (has("WM") & has("NEW", "PKG"))
        | (has("TALL", "LID") & has("BOX", "HARDWARE", "GCI"))
    )


def match_rejection(name: Column | str, cpp: Column) -> Column:
    return F.when(cpp == 0, "cpp_zero").when(packaging(name), "packaging_text")


def candidate_rejection(label: Column | str, upc12: Column, last5: Column, name: Column) -> Column:
    """The first reason against a candidate: signage, unresolved, no identifier, no description."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return F.when(signage(label), "signage").when(blank(upc12), "unresolved").when(blank(last5) & blank(upc12), "missing_id").when(blank(name), "missing_description")


def box_problems(width: Column, height: Column, dx: Column, dy: Column, want_width: Column, want_height: Column, strict: Column) -> Column:
    """array<string> of what makes a box implausible against the expected one, whose middle is dx, dy away.

    Some limits hold only where `strict`. Without a box the one problem is that; without
    an expected box only size and aspect count.
    """
    w, h = F.greatest(width, F.lit(0.0)), F.greatest(height, F.lit(0.0))
    ww, wh = (F.when(x.isNotNull(), F.greatest(x, F.lit(1.0))) for x in (want_width, want_height))
    aspect, area = F.when(h > 0, w / h).otherwise(99.0), w * h / (ww * wh)
    rules = {
        "tiny_bbox": (w < 16) | (h < 16),
        "strip_aspect": (aspect > 3.6) | (aspect < 0.28),
        "off_expected_slot_geometry": strict & (F.hypot(dx, dy) > F.greatest(F.lit(44.0), ww * 1.7, wh * 1.7)),
        "too_wide_for_single_card": strict & (w > ww * 1.95), "too_tall_for_single_card": strict & (h > wh * 1.95),
        "too_narrow_for_single_card": strict & (w < ww * 0.55), "too_short_for_single_card": strict & (h < wh * 0.55),
        "likely_multi_card_group": strict & (area > 2.8), "likely_partial_strip": strict & (area < 0.35),
        "oversized_area": ~strict & (area > 4.5), "undersized_area": ~strict & (area < 0.22),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return F.when(width.isNull() | height.isNull(), F.array(F.lit("missing_mapped_bbox"))).otherwise(found)


def best_asset(spans: DataFrame, assets: DataFrame, reach: int = 2, least_area: int = 2500) -> DataFrame:
    """The asset of each span of columns: in the band of rows first, then not tiny, near in columns, small, near in rows; equals by asset.

    spans(sheet, begin, end, want_row, band_top, band_bottom), assets(sheet, asset, row, col,
    width, height). An empty span takes the best within `reach` columns of its middle.
    Assets meet the spans their column could serve through the columns themselves: an
    equi-join, no range scan.
    """
    middle = F.floor((F.col("begin") + F.col("end")) / 2)
    near = spans.withColumn("middle", middle).withColumn("at", F.explode(F.sequence(F.least("begin", middle - reach), F.greatest("end", middle + reach))))
    pairs = near.join(assets, (near.sheet == assets.sheet) & (near["at"] == assets.col)).drop(assets.sheet)
    within = F.col("col").between(F.col("begin"), F.col("end"))
    far = F.when(within, F.col("col") - F.col("begin")).otherwise(F.abs(F.col("col") - F.col("middle")))
    area, none = F.greatest("width", F.lit(0)).cast("long") * F.greatest("height", F.lit(0)), F.lit(10**9)
    order = F.struct(
        (~within).alias("outside"), (~F.col("row").between(F.col("band_top"), F.col("band_bottom"))).alias("off_band"), (area < least_area).alias("tiny"), far.alias("far"),
        F.when(area > 0, area).otherwise(none).alias("area"), F.when(F.col("row") >= 0, F.abs(F.col("row") - F.col("want_row"))).otherwise(none).alias("off_row"), F.col("asset"),
    )
    best = pairs.filter(within | (F.abs(F.col("col") - F.col("middle")) <= reach)).groupBy("sheet", "begin", "end").agg(F.min(order).alias("b"))
    return best.select("sheet", "begin", "end", "b.asset", (~F.col("b.outside")).alias("in_span"), (~F.col("b.off_band")).alias("in_band"))


def claim_nearest_above(items: DataFrame, cards: DataFrame, height: float) -> DataFrame:
    """page_id, card, item, score: cards in reading order each take the unused item above with the least |dx| + 0.3 dy; null where none is left.

    items(page_id, item, x, bottom), cards(page_id, card, x, top) on pages of `height`. An
    item may hang up to 7 % of the height below the card's top, which counts as no
    distance; cards are read in bands of 5 %, then by x; of equal items the first.
    """
    i = items.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("item", "x", "bottom"))).alias("items"))
    band = F.bround(F.col("top") / (height * 0.05))
    c = cards.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(band.alias("band"), "x", "card", "top"))).alias("cards"))

    def step(acc: Column, card: Column) -> Column:
        free = F.filter("items", lambda t: (t["bottom"] <= card["top"] + height * 0.07) & ~F.exists(acc, lambda a: a["item"].eqNullSafe(t["item"])))
        score = lambda t: F.abs(card["x"] - t["x"]) + 0.3 * F.greatest(F.lit(0.0), card["top"] - t["bottom"])
        best = F.array_min(F.transform(free, lambda t: F.struct(score(t).alias("score"), t["item"].alias("item"))))
        return F.concat(acc, F.array(F.struct(card["card"].alias("card"), best["item"].alias("item"), best["score"].alias("score"))))

    kinds = [d.schema[n].dataType.simpleString() for d, n in ((cards, "card"), (items, "item"))]
    none = F.array().cast(f"array<struct<card: {kinds[0]}, item: {kinds[1]}, score: double>>")
    there = c.join(i, "page_id", "left").withColumn("items", F.coalesce("items", F.slice(F.array(F.lit(None).cast(i.schema["items"].dataType.elementType)), 1, 0)))
    taken = there.withColumn("taken", F.aggregate("cards", none, step))
    return taken.select("page_id", F.explode("taken").alias("t")).select("page_id", "t.card", "t.item", F.round("t.score", 6).alias("score"))


def fullest_slide(slides: DataFrame, top: int = 8, side: int = 6) -> DataFrame:
    """side, slide, n_top, n_side, complete: each side's slide with the most cards, the first of equals; at most `top` and `side` of them count.

    slides(side, slide, n_top, n_side).
    """
    capped = slides.withColumns({"n_top": F.least("n_top", F.lit(top)), "n_side": F.least("n_side", F.lit(side))})
    best = capped.groupBy("side").agg(F.min(F.struct((-F.col("n_top") - F.col("n_side")).alias("fewest"), "slide", "n_top", "n_side")).alias("b"))
    return best.select("side", "b.slide", "b.n_top", "b.n_side", ((F.col("b.n_top") == top) & (F.col("b.n_side") == side)).alias("complete"))


def group_capacity(cells: DataFrame, profile: DataFrame) -> DataFrame:
    """page_id, block, n, most, over, short: cells of each group of a page against its side's profile; groups without a capacity have neither.

    cells(page_id, side, block), profile(side, block, most): a profile has a row a side and group.
    """
    counts = cells.groupBy("page_id", "side", "block").agg(F.count(F.lit(1)).alias("n"))
    expected = cells.select("page_id", "side").distinct().join(F.broadcast(profile), "side")  # a profile: a few rows a side
    both = expected.join(counts, ["page_id", "side", "block"], "full")
    n, most = F.coalesce("n", F.lit(0).cast("long")), F.col("most")
    over, short = (F.coalesce(F.greatest(F.lit(0), x).cast("long"), F.lit(0).cast("long")) for x in (n - most, most - n))
    both = both.withColumns({"over": F.when(most.isNull(), 0).otherwise(over), "short": F.when(most.isNull(), 0).otherwise(short)})
    return both.select("page_id", "side", "block", n.alias("n"), "most", "over", "short")


def structured_rows(cells: DataFrame, left: float = 220.0, right: float = 380.0, rows: int = 3) -> DataFrame:
    """page_id, row_index, slot_in_row, block, cell: two left, four centre and two right cells a row.

    cells(page_id, row, x, cell). Rows of four or more wholly between `left` and `right` are
    centre rows, rows that reach beyond both are side rows; the first `rows` of each pair up,
    the side row gives its two outermost cells on either side.
    """
    x = F.transform("c", lambda c: c["x"])
    lined = cells.groupBy("page_id", "row").agg(F.array_sort(F.collect_list(F.struct("x", "cell"))).alias("c")).filter(F.size("c") >= 4)
    kind = F.when((F.array_min(x) > left) & (F.array_max(x) < right), "center").when((F.array_min(x) < left) & (F.array_max(x) > right), "side")
    lined = lined.withColumn("kind", kind).filter("kind IS NOT NULL")
    lined = lined.withColumn("row_index", F.row_number().over(W.partitionBy("page_id", "kind").orderBy("row")) - 1).filter(F.col("row_index") < rows)
    of = lambda k, name: lined.filter(F.col("kind") == k).select("page_id", "row_index", F.col("c").alias(name))
    slots = F.concat(F.slice("s", 1, 2), F.slice("m", 1, 4), F.slice("s", -2, 2))
    block = F.when(F.col("slot_in_row") <= 1, "left").when(F.col("slot_in_row") <= 5, "center").otherwise("right")
    paired = of("side", "s").join(of("center", "m"), ["page_id", "row_index"])
    return paired.select("page_id", "row_index", F.posexplode(slots).alias("slot_in_row", "c")).select("page_id", "row_index", "slot_in_row", block.alias("block"), "c.cell")


def merge_short_rows(rows: DataFrame, capacity: int = 8, most: int = 3) -> DataFrame:
    """page, row, slot: cells in row order are dealt to at most `most` rows; a row closes once it has `capacity` or more, and keeps that many.

    rows(page_id, row, x, cell): one fold over a page's rows.
    """
    per_row = rows.groupBy("page_id", "row").agg(F.array_sort(F.collect_list(F.struct("x", "cell"))).alias("cells"))
    pages = per_row.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grows = F.coalesce(F.size(last) < capacity, F.lit(False))
        return F.when(grows, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(last, r["cells"])))).otherwise(F.concat(acc, F.array(r["cells"])))

    none = F.array().cast("array<array<struct<x: double, cell: bigint>>>")
    dealt = pages.select("page_id", F.posexplode(F.slice(F.aggregate("rows", none, step), 1, most)).alias("row", "cells"))
    return dealt.select("page_id", "row", F.posexplode(F.slice(F.array_sort("cells"), 1, capacity)).alias("slot", "c")).select("page_id", "row", "slot", "c.cell")


def select_rows(cells: DataFrame, rows: int = 3, capacity: int = 8) -> DataFrame:
    """page, row, slot, cell: `rows` rows of `capacity` cells by x; overflow of a row goes to the earliest rows with room, the rest is left out.

    cells(page_id, row, x, cell). Overflow and room are numbered along the page and meet by number.
    """
    w = W.partitionBy("page_id", "row").orderBy("x", "cell")
    placed = cells.filter(F.col("row") < rows).withColumn("k", F.row_number().over(w))
    over = cells.withColumn("k", F.row_number().over(w)).filter((F.col("row") >= rows) | (F.col("k") > capacity)).withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("row", "x", "cell")))
    used = placed.filter(F.col("k") <= capacity).groupBy("page_id", "row").agg(F.count(F.lit(1)).alias("used"))
    grid = cells.select("page_id").distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).join(used, ["page_id", "row"], "left")
    room = grid.withColumn("k", F.explode(F.sequence(F.coalesce("used", F.lit(0)) + 1, F.lit(capacity + 1)))).filter(F.col("k") <= capacity)
    room = room.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("row", "k"))).select("page_id", "row", "k", "n")
    moved = over.select("page_id", "n", "cell").join(room, ["page_id", "n"]).select("page_id", "row", F.col("k").cast("int").alias("slot"), "cell")
    return placed.filter(F.col("k") <= capacity).select("page_id", "row", F.col("k").alias("slot"), "cell").unionByName(moved)


def detected_rows(cells: DataFrame, least: float = 8.0, share: float = 0.55) -> DataFrame:
    """page_id, row, cell, x: cells in rows by running mean of y, numbered from the top; one fold over a page's cells.

    cells(page_id, cell, x, y). A cell joins the row before it within `share` of the page's
    middle step in y, `least` at least.
    """
    from .layout import quantile

    pages = cells.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "cell"))).alias("c"))
    ys = F.transform("c", lambda c: c["y"])
    n = F.size("c")
    steps = F.array_sort(F.filter(F.zip_with(F.slice(ys, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ys, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: b - a), lambda v: v > 0.001))
    pages = pages.withColumn("steps", steps)
    pages = pages.withColumn("tol", F.when(F.size("steps") > 0, F.greatest(F.lit(least), share * quantile(F.col("steps"), F.lit(0.5)))).otherwise(least))
    kind = cells.schema["cell"].dataType.simpleString()

    def step(acc: Column, c: Column) -> Column:
        joins = F.coalesce(F.abs(c["y"] - acc["s"] / acc["n"]) <= F.col("tol"), F.lit(False))
        row = F.when(joins, acc["row"]).otherwise(acc["row"] + 1)
        item = F.struct(row.alias("row"), c["x"].alias("x"), c["cell"].alias("cell"))
        return F.struct(row.alias("row"), F.when(joins, acc["s"] + c["y"]).otherwise(c["y"]).alias("s"), F.when(joins, acc["n"] + 1).otherwise(1).alias("n"), F.concat(acc["out"], F.array(item)).alias("out"))

    start = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("s"), F.lit(1).alias("n"), F.array().cast(f"array<struct<row: int, x: double, cell: {kind}>>").alias("out"))
    return pages.select("page_id", F.explode(F.aggregate("c", start, step, lambda a: a["out"])).alias("o")).select("page_id", "o.row", "o.cell", "o.x")


def display_selection(cells: DataFrame, rows: int = 3, blocks: tuple[tuple[str, int], ...] = (("left", 2), ("center", 4), ("right", 2))) -> DataFrame:
    """page_id, cell, row, slot, block, moved, reason: where each cell is shown on a page of `rows` rows of these blocks.

    cells(page_id, cell, x, y). More detected rows than `rows` are merged evenly; a row
    keeps as many cells by x as it holds, the others fill the first rows with room (moved),
    and what is left has no row, the last block and a reason.
    """
    capacity = sum(n for _, n in blocks)
    found = detected_rows(cells)
    counts = found.groupBy("page_id").agg((F.max("row") + 1).alias("n"))
    target = F.when(F.col("n") <= rows, F.col("row")).otherwise(F.least(F.lit(rows - 1), F.bround(F.col("row") * (rows - 1) / F.greatest(F.lit(1), F.col("n") - 1)).cast("int")))
    placed = found.join(counts, "page_id").select("page_id", target.alias("row"), "x", "cell")
    shown = select_rows(placed, rows, capacity).select("page_id", "cell", F.col("row").alias("at"), "slot")
    ends, total = [], 0
    for name, n in blocks:
        total += n
        ends.append((name, total))
    block = F.lit(ends[-1][0])
    for name, end in reversed(ends[:-1]):
        block = F.when(F.col("slot") <= end, name).otherwise(block)
    out = placed.join(shown, ["page_id", "cell"], "left")
    return out.select("page_id", "cell", F.col("at").alias("row"), "slot", block.alias("block"), (F.col("at") != F.col("row")).alias("moved"), F.when(F.col("at").isNull(), "group_overflow").alias("reason"))
