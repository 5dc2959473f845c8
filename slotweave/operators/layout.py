"""Ordered and spatial operators over pages, rows and columns. A page or sheet is small; there are many of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import ids

from .spatial import within_boxes

GROUP = "array<struct<s: double, n: int>>"


def center(low: str, high: str) -> Column:
    return (F.col(low) + F.col(high)) / 2


def gap_groups(values: Column, tolerance: Column | float) -> Column:
    """Sums and sizes of groups of sorted values: a value joins while it is within tolerance of its group's running mean."""
    tol = F.lit(tolerance) if isinstance(tolerance, (int, float)) else tolerance

    def step(acc: Column, v: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce(F.abs(v - last["s"] / last["n"]) <= tol, F.lit(False))
        one = F.struct(v.alias("s"), F.lit(1).alias("n"))
        more = F.struct((last["s"] + v).alias("s"), (last["n"] + 1).alias("n"))
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(one)))

    return F.aggregate(F.array_sort(values), F.array().cast(GROUP), step)


def group_centers(groups: Column) -> Column:
    return F.transform(groups, lambda g: g["s"] / g["n"])


def first_fit_groups(values: Column, tolerance: float) -> Column:
    """Like gap_groups, but a value joins the first of all groups whose mean is within tolerance; values in given order."""

    def step(acc: Column, v: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda g: F.abs(g["s"] / g["n"] - v) <= tolerance), F.lit(True))
        grown = F.transform(acc, lambda g, i: F.when(i + 1 == at, F.struct((g["s"] + v).alias("s"), (g["n"] + 1).alias("n"))).otherwise(g))
        return F.when(at > 0, grown).otherwise(F.concat(acc, F.array(F.struct(v.alias("s"), F.lit(1).alias("n")))))

    return F.aggregate(values, F.array().cast(GROUP), step)


def boundaries(centers: Column) -> Column:
    """Midpoints between sorted centers with mirrored ends; one center: 50 to either side; none: none."""
    c, n = F.array_sort(centers), F.size(centers)
    mids = F.zip_with(F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(c, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a + b) / 2)
    left = 2 * F.try_element_at(c, F.lit(1)) - F.try_element_at(mids, F.lit(1))
    right = 2 * F.try_element_at(c, F.lit(-1)) - F.try_element_at(mids, F.lit(-1))
    one = F.try_element_at(c, F.lit(1))
    return F.when(n == 0, c).when(n == 1, F.array(one - 50, one + 50)).otherwise(F.concat(F.array(left), mids, F.array(right)))


def nearest_index(value: Column, centers: Column) -> Column:
    """0-based place of the nearest center, the first on ties."""
    gaps = F.transform(centers, lambda c: F.abs(c - value))
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def quantile(sorted_values: Column, q: Column) -> Column:
    """Linear interpolation between the neighbours of place q * (n - 1)."""
    at = q * (F.size(sorted_values) - 1)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    a, b = F.element_at(sorted_values, low + 1), F.element_at(sorted_values, high + 1)
    return a + (b - a) * (at - F.floor(at))


def kmeans_centers(values: Column, k: int, rounds: int = 40) -> Column:
    """Sorted centers of 1-D k-means from quantile starts; an empty cluster keeps its center; stops when nothing moves."""
    v = F.array_sort(values)
    n = F.least(F.lit(k), F.size(v))
    start = F.transform(F.sequence(F.lit(0), n - 1), lambda i: quantile(v, (i + 0.5) / n))

    def lloyd(c: Column, _: Column) -> Column:
        labels = F.transform(v, lambda x: nearest_index(x, c))
        sums = F.transform(c, lambda old, i: F.aggregate(F.zip_with(v, labels, lambda x, g: F.when(g == i, x)), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), old.alias("old")),
            lambda a, x: F.struct((a["s"] + F.coalesce(x, F.lit(0.0))).alias("s"), (a["n"] + F.when(x.isNotNull(), 1).otherwise(0)).alias("n"), a["old"].alias("old"))))
        return F.transform(sums, lambda a: F.when(a["n"] > 0, a["s"] / a["n"]).otherwise(a["old"]))

    return F.array_sort(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lloyd))


def reading_text(words: Column, tolerance: float = 3.5) -> Column:
    """Text of array<struct<top, x0, text>>: by top and x; a new line where top is off the line's moving middle."""

    def step(acc: Column, w: Column) -> Column:
        same = F.abs(w["top"] - acc["y"]) <= tolerance
        return F.struct(
            F.when(acc["y"].isNull(), w["text"]).when(same, F.concat(acc["t"], F.lit(" "), w["text"])).otherwise(F.concat(acc["t"], F.lit("\n"), w["text"])).alias("t"),
            F.when(same, (acc["y"] + w["top"]) / 2).otherwise(w["top"]).alias("y"),
        )

    return F.aggregate(F.array_sort(words), F.struct(F.lit("").alias("t"), F.lit(None).cast("double").alias("y")), step, lambda a: a["t"])


def template_boxes(anchors: DataFrame, rows: int = 3, columns: int = 8) -> DataFrame:
    """page, row, slot and box of a grid of equal cells inside each anchor(page_id, x0, top, x1, bottom)."""
    r, c = F.explode(F.sequence(F.lit(0), F.lit(rows - 1))), F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))
    w, h = (F.col("x1") - F.col("x0")) / columns, (F.col("bottom") - F.col("top")) / rows
    grid = anchors.withColumns({"w": w, "h": h}).withColumn("row", r).withColumn("slot", c)
    return grid.select(
        "page_id", "row", "slot", (F.col("x0") + F.col("slot") * F.col("w")).alias("bx0"), (F.col("top") + F.col("row") * F.col("h")).alias("btop"),
        (F.col("x0") + (F.col("slot") + 1) * F.col("w")).alias("bx1"), (F.col("top") + (F.col("row") + 1) * F.col("h")).alias("bbottom"),
    )


def words_in_boxes(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose center lies in a box of their page, edges included."""
    return within_boxes(words, boxes, "page_id", center("x0", "x1"), center("top", "bottom"), F.col("bx0"), F.col("btop"), F.col("bx1"), F.col("bbottom"))


def slot_candidates(words: DataFrame, boxes: DataFrame, share: float = 0.75, least: float = 18.0) -> DataFrame:
    """page_id, word_id, row, slot, distance: words within a box's tolerance on both axes, distance in tolerances.

    A box's tolerance is `share` of its width or height, `least` at least, from its middle.
    """
    wide, tall = (F.greatest(F.lit(least), share * F.greatest(F.lit(1.0), F.col(b) - F.col(a))) for a, b in (("bx0", "bx1"), ("btop", "bbottom")))
    x, y = center("bx0", "bx1"), center("btop", "bbottom")
    reach = 1 + 1e-9  # a little more than the tolerance, which is judged below
    close = within_boxes(words, boxes, "page_id", center("x0", "x1"), center("top", "bottom"), x - reach * wide, y - reach * tall, x + reach * wide, y + reach * tall)
    near = close.withColumns({"dx": F.abs(center("x0", "x1") - x) / wide, "dy": F.abs(center("top", "bottom") - y) / tall}).filter((F.col("dx") <= 1) & (F.col("dy") <= 1))
    return near.select("page_id", "word_id", "row", "slot", F.round(F.hypot("dx", "dy"), 9).alias("distance"))


def section_by_marker(cells: DataFrame, markers: DataFrame) -> DataFrame:
    """Adds section from the page's marker heights: above holders, before bonus, bonus, or unknown.

    cells(page_id, y), markers(page_id, holders_y, bonus_y).
    """
    section = F.when(F.col("y") < F.col("holders_y"), "top_or_holder").when(F.col("y") < F.col("bonus_y"), "middle_band").when(F.col("bonus_y").isNotNull(), "bonus").otherwise("unknown")
    return cells.join(markers, "page_id", "left").withColumn("section", section)


def holder_spans(cells: DataFrame, starts: Column, breaks: Column) -> DataFrame:
    """A row per start: segment number, last column, first filled item and first number in its span.

    A span ends before the next start or break; each cell belongs to the last boundary at
    or before it, so no range join is needed.
    """
    w = W.partitionBy("sheet").orderBy("col")
    up_to = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    edge = starts | breaks
    marked = cells.withColumns({"is_start": starts, "segment": F.sum(F.when(breaks, 1).otherwise(0)).over(up_to), "begin": F.last(F.when(edge, F.col("col")), ignorenulls=True).over(up_to)})
    marked = marked.withColumn("max_col", F.max("col").over(W.partitionBy("sheet")))
    filled = F.when(ids.text("item") != "", F.col("item"))
    spans = marked.filter("begin IS NOT NULL").groupBy("sheet", "begin").agg(
        F.max("segment").alias("segment"), F.min_by(F.col("is_start"), "col").alias("is_start"), F.min_by(filled, F.when(filled.isNotNull(), F.col("col"))).alias("item"),
        F.min_by("qty", F.when(F.col("qty").isNotNull(), F.col("col"))).alias("qty"), F.max("max_col").alias("max_col"),
    )
    end = F.coalesce(F.lead("begin").over(W.partitionBy("sheet").orderBy("begin")) - 1, F.col("max_col"))
    return spans.withColumn("end", end).filter("is_start").select("sheet", "begin", "end", "segment", "item", "qty")


def fill_down(rows: DataFrame, by: Sequence[str], order: str, column: str) -> DataFrame:
    """Blank values take the last filled one before them."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn(column, F.last(F.when(ids.text(column) != "", F.col(column)), ignorenulls=True).over(w))


def sides_of_segments(spans: DataFrame, want: int = 5) -> DataFrame:
    """sheet, segment, side, borrowed: the first four segments are A-D; a side under `want` borrows the first later segment that fits whole.

    One fold over a sheet's few segments.
    """
    segs = spans.groupBy("sheet", "segment").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("segment", "n"))).alias("s"))
    segs = segs.withColumns({"own": F.slice("s", 1, 4), "rest": F.slice("s", F.lit(5), F.greatest(F.size("s") - 4, F.lit(0)))})

    def one_side(takers: Column, k: Column) -> Column:
        room = want - F.element_at("own", k + 1)["n"]
        fits = F.zip_with("rest", takers, lambda x, t: (t == -1) & (x["n"] <= room))
        at = F.array_position(fits, F.lit(True))
        return F.transform(takers, lambda t, i: F.when(i + 1 == at, k).otherwise(t))

    takers = F.aggregate(F.sequence(F.lit(0), F.size("own") - 1), F.transform("rest", lambda _: F.lit(-1)), one_side)
    letter = lambda i: F.substring(F.lit("ABCD"), i + 1, F.lit(1))
    part = lambda x, side, borrowed: F.struct(x["segment"].alias("segment"), side.alias("side"), F.lit(borrowed).alias("borrowed"))
    own = F.transform("own", lambda x, i: part(x, letter(i), False))
    lent = F.filter(F.zip_with("rest", "takers", lambda x, t: part(x, F.when(t >= 0, letter(t)), True)), lambda x: x["side"].isNotNull())
    return segs.withColumn("takers", takers).select("sheet", F.explode(F.concat(own, lent)).alias("m")).select("sheet", "m.segment", "m.side", "m.borrowed")


def holders_by_side(spans: DataFrame, want: int = 5) -> DataFrame:
    """Spans with side, borrowed and position: borrowed holders come first, then by column."""
    placed = spans.join(sides_of_segments(spans, want), ["sheet", "segment"])
    return placed.withColumn("position", F.row_number().over(W.partitionBy("sheet", "side").orderBy(F.desc("borrowed"), "begin", "end")))


def copy_single_side(rows: DataFrame, by: str) -> DataFrame:
    """Where only side A has rows they stand for all of A-D."""
    only_a = rows.groupBy(by).agg((F.min("side") == "A").alias("a"), (F.max("side") == "A").alias("z")).select(by, (F.col("a") & F.col("z")).alias("only_a"))
    sides = F.when(F.col("only_a"), F.array(*[F.lit(s) for s in "ABCD"])).otherwise(F.array("side"))
    return rows.join(only_a, by).withColumn("side", F.explode(sides)).drop("only_a")


def column_pitch(cells: DataFrame) -> DataFrame:
    """(page_id, col): gap to the next column in units of the median gap, 1 to 4. cells(page_id, col, x)."""
    means = cells.groupBy("page_id", "col").agg(F.round(F.avg("x"), 6).alias("x"))
    gap = F.lead("x").over(W.partitionBy("page_id").orderBy("x", "col")) - F.col("x")
    gaps = means.withColumn("gap", F.round(gap, 6)).filter("gap IS NOT NULL")
    middle = F.percentile("gap", F.lit(0.5)).over(W.partitionBy("page_id"))
    units = F.when(F.col("middle") <= 1e-6, 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), F.bround(F.col("gap") / F.col("middle")).cast("int"))))
    return gaps.withColumn("middle", middle).select("page_id", "col", "gap", units.alias("units"))


def split_rows(rows: DataFrame) -> DataFrame:
    """(page_id, row, y) with part 0 above and 1 below the marker if both have rows, else the widest gap if it is 1.6 medians."""
    w = W.partitionBy("page_id")
    o = w.orderBy("y", "row")
    gaps = rows.withColumn("gap", F.lead("y").over(o) - F.col("y"))
    gaps = gaps.withColumns({"middle": F.percentile("gap", F.lit(0.5)).over(w), "widest": F.max("gap").over(w), "above": F.max(F.col("y") < F.col("bonus_y")).over(w), "below": F.max(F.col("y") >= F.col("bonus_y")).over(w)})
    cut = F.min(F.when(F.col("gap") == F.col("widest"), F.col("y"))).over(w)
    by_gap = F.when(F.col("widest") >= 1.6 * F.col("middle"), (F.col("y") > F.col("cut")).cast("int")).otherwise(0)
    by_marker = F.coalesce(F.col("above") & F.col("below"), F.lit(False))
    return gaps.withColumn("cut", cut).select("page_id", "row", "y", F.when(by_marker, (F.col("y") >= F.col("bonus_y")).cast("int")).otherwise(F.coalesce(by_gap, F.lit(0))).alias("part"))


def variation(values: Column) -> Column:
    """Standard deviation over the mean, which counts as 1 at least."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n
    spread = F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n)
    return spread / F.greatest(F.lit(1.0), mean)


def regular_cells(cells: DataFrame, size: int = 8) -> DataFrame:
    """page_id, row, y, n, c (array<struct<x, cell, w, h>>): each row's `size` neighbours with the most even gaps, widths and heights.

    cells(page_id, row, cell, x0, top, x1, bottom). The score sums the variation of the
    three; of equals the leftmost; rows of fewer keep all. n is the row's number of cells.
    """
    one = F.struct(center("x0", "x1").alias("x"), "cell", F.greatest(F.lit(1.0), F.col("x1") - F.col("x0")).alias("w"), F.greatest(F.lit(1.0), F.col("bottom") - F.col("top")).alias("h"))
    rows = cells.groupBy("page_id", "row").agg(F.array_sort(F.collect_list(one)).alias("all"), F.round(F.avg(center("top", "bottom")), 6).alias("y")).withColumn("n", F.size("all"))

    def scored(i: Column) -> Column:
        part = F.slice("all", i, F.lit(size))
        xs, ws, hs = F.transform(part, lambda c: c["x"]), F.transform(part, lambda c: c["w"]), F.transform(part, lambda c: c["h"])
        gaps = F.zip_with(F.slice(xs, 2, size - 1), F.slice(xs, 1, size - 1), lambda b, a: b - a)
        return F.struct(F.round(variation(gaps) + variation(ws) + variation(hs), 6).alias("score"), i.alias("i"))

    best = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n") - size + 1)), scored))
    return rows.withColumn("c", F.when(F.col("n") <= size, F.col("all")).otherwise(F.slice("all", best["i"], F.lit(size)))).select("page_id", "row", "y", "n", "c")


def best_three_rows(rows: DataFrame, size: int = 8) -> DataFrame:
    """page_id, row, y, n, place, score: the three neighbouring rows of a page that look most like a grid of `size` columns.

    rows as regular_cells gives them. Missing and surplus cells, uneven spacing and columns
    out of line cost points; of equals the topmost. Pages of under three rows have none.
    """
    o = W.partitionBy("page_id").orderBy("y", "row")
    self = F.struct("row", "y", "n", "c")
    three = rows.withColumns({"r1": self, "r2": F.lead(self, 1).over(o), "r3": F.lead(self, 2).over(o), "at": F.row_number().over(o)}).filter("r3 IS NOT NULL")
    r = [F.col(k) for k in ("r1", "r2", "r3")]
    counts = sum((F.when(x["n"] < size, 10000.0 + (size - x["n"]) * 1000.0).otherwise((x["n"] - size) * 250.0) for x in r), F.lit(0.0))
    a, b = r[1]["y"] - r[0]["y"], r[2]["y"] - r[1]["y"]
    spacing = F.abs(a - b) / F.greatest(F.lit(1.0), (a + b) / 2) * 500.0
    xs = [F.transform(x["c"], lambda c: c["x"]) for x in r]
    column = F.zip_with(F.zip_with(xs[0], xs[1], lambda p, q: F.array(p, q)), xs[2], lambda pq, s: F.array_sort(F.concat(pq, F.array(s))))
    errors = F.aggregate(F.transform(column, lambda v: v[2] - v[0]), F.lit(0.0), lambda acc, v: acc + v) / (3 * size)  # distances from the middle one
    widths = F.array_sort(F.flatten(F.array(*[F.transform(x["c"], lambda c: c["w"]) for x in r])))
    middle = (F.try_element_at(widths, F.lit(3 * size // 2)) + F.try_element_at(widths, F.lit(3 * size // 2 + 1))) / 2
    full = (F.size(r[0]["c"]) >= size) & (F.size(r[1]["c"]) >= size) & (F.size(r[2]["c"]) >= size)
    score = F.round(counts + spacing + F.when(full, errors / F.greatest(F.lit(1.0), middle) * 1000.0).otherwise(0.0), 4)
    best = three.withColumn("score", score).groupBy("page_id").agg(F.min(F.struct("score", "at", "r1", "r2", "r3")).alias("b"))
    return best.select("page_id", "b.score", F.posexplode(F.array("b.r1", "b.r2", "b.r3")).alias("place", "r")).select("page_id", "r.row", "r.y", "r.n", "place", "score")


def pairing_audit(targets: DataFrame, sources: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Each target slot with its source by side, section, row and column, and why it is filled or not.

    targets(side, section, row, col, has_label), sources(side, section, row, col, source),
    sections(side, section): those asked for; one without any target slot has a row of its own.
    """
    grid = sources.select("side", "section").distinct().withColumn("grid", F.lit(True))
    joined = targets.join(sources, ["side", "section", "row", "col"], "left").join(grid, ["side", "section"], "left")
    reason = F.when(F.col("grid").isNull(), "no_source_grid").when(~F.col("has_label"), "blank_target_slot").when(F.col("source").isNull(), "missing_source_slot").otherwise("INSERTED")
    audited = joined.withColumn("reason", reason).drop("grid")
    if sections is None:
        return audited
    empty = sections.join(targets.select("side", "section").distinct(), ["side", "section"], "left_anti").withColumn("reason", F.lit("no_target_slots"))
    return audited.unionByName(empty, allowMissingColumns=True)


def nearest_per_cell(items: DataFrame, grid: DataFrame) -> DataFrame:
    """page_id, row, col, item: each item goes to the nearest row and column centre, each cell keeps its nearest item by x, the first of equals.

    items(page_id, item, x, y), grid(page_id, xs, ys): sorted centres.
    """
    at = items.join(grid, "page_id").withColumns({"row": nearest_index(F.col("y"), F.col("ys")), "col": nearest_index(F.col("x"), F.col("xs"))})
    off = F.round(F.abs(F.element_at("xs", F.col("col") + 1) - F.col("x")), 9)
    return at.groupBy("page_id", "row", "col").agg(F.min(F.struct(off.alias("off"), "item")).alias("b")).select("page_id", "row", "col", "b.item")


def slot_order(cells: DataFrame, kind: str = "MB") -> DataFrame:
    """Adds row_index, slot_in_row, slot_order, block_pos and slot_id (A-MB-R1-S1), numbered from 0 in reading order.

    cells(page_id, side, row, x, cell, block): rows by number, cells by x, equals by cell.
    """
    page, row = W.partitionBy("page_id"), W.partitionBy("page_id", "row")
    out = cells.withColumns(
        {
            "row_index": F.dense_rank().over(page.orderBy("row")) - 1, "slot_in_row": F.row_number().over(row.orderBy("x", "cell")) - 1,
            "slot_order": F.row_number().over(page.orderBy("row", "x", "cell")) - 1, "block_pos": F.row_number().over(W.partitionBy("page_id", "row", "block").orderBy("x", "cell")) - 1,
        }
    )
    return out.withColumn("slot_id", F.concat("side", F.lit(f"-{kind}-R"), (F.col("row_index") + 1).cast("string"), F.lit("-S"), (F.col("slot_in_row") + 1).cast("string")))


def shape_check(slots: DataFrame, rows: int = 3, blocks: Sequence[tuple[str, int]] = (("left", 2), ("center", 4), ("right", 2))) -> DataFrame:
    """page_id, n_slots, counts, grouping, valid: slots a row and block, and whether the page has `rows` rows of just these blocks.

    slots(page_id, row, block).
    """
    names, size = [b for b, _ in blocks], sum(n for _, n in blocks)
    per_row = slots.groupBy("page_id", "row").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.count_if(F.col("block") == b) for b in names]).alias("blocks"))
    pages = per_row.groupBy("page_id").agg(F.sum("n").alias("n_slots"), F.array_sort(F.collect_list(F.struct("row", "n", "blocks"))).alias("r"))
    counts, grouping = F.transform("r", lambda x: x["n"]), F.transform("r", lambda x: x["blocks"])
    whole = (F.size("r") == rows) & F.forall("r", lambda x: (x["n"] == size) & (x["blocks"] == F.array(*[F.lit(n).cast("long") for _, n in blocks])))
    return pages.select("page_id", "n_slots", counts.alias("counts"), grouping.alias("grouping"), whole.alias("valid"))


# Words in a slot's text that make its content doubtful.
SUSPICIOUS = ("WM", "PKG", "GCI", "MARKETING", "FRAUD", "BONUS")


def side_content(slots: DataFrame, patterns: Sequence[str] = SUSPICIOUS) -> DataFrame:
    """side, main_ids, bonus_ids (sorted, distinct), main_slots, bonus_slots, suspicious, suspicious_first_row (slot ids of the main band).

    slots(side, section: main or bonus, row_index, slot_id, last5, label).
    """
    main, label = F.col("section") == "main", F.upper(F.coalesce("label", F.lit("")))
    doubtful = main & reduce(lambda a, b: a | b, [F.contains(label, F.lit(p)) for p in patterns])
    ids_of = lambda c: F.array_sort(F.collect_set(F.when(c & (F.col("last5") != ""), F.col("last5"))))
    listed = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("slot_id"))))
    return slots.groupBy("side").agg(
        ids_of(main).alias("main_ids"), ids_of(~main).alias("bonus_ids"), F.count_if(main).alias("main_slots"), F.count_if(~main).alias("bonus_slots"),
        listed(doubtful).alias("suspicious"), listed(doubtful & (F.col("row_index") == 0)).alias("suspicious_first_row"),
    )


def display_rows(cells: DataFrame, wide: int = 10, full: int = 8) -> DataFrame:
    """page_id, row, display_row: rows that are shown as one.

    cells(page_id, row, col). Two neighbouring short rows with at most `full` cells together
    are one; one or two cells whose columns complete the row before, of `full` to `wide` - 1,
    to a run without gap or repeat join it. One fold over a page's rows.
    """
    rows = cells.groupBy("page_id", "row").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list("col")).alias("cols"))
    pages = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("row", "n", "cols"))).alias("rows"))
    col, row = cells.schema["col"].dataType.simpleString(), cells.schema["row"].dataType.simpleString()

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        short = (r["n"] > 0) & (r["n"] < full)
        pairs = F.coalesce(last["open"] & short & (last["n"] + r["n"] <= full), F.lit(False))
        both = F.array_sort(F.concat(last["cols"], r["cols"]))
        run = (F.size(F.array_distinct(both)) == F.size(both)) & (F.array_max(both) - F.array_min(both) + 1 == F.size(both))
        completes = F.coalesce((r["n"] <= 2) & (last["n"] >= full) & (last["n"] < wide) & (last["n"] + r["n"] <= wide) & run, F.lit(False))
        joined = F.struct(F.concat(last["rows"], F.array(r["row"])).alias("rows"), (last["n"] + r["n"]).alias("n"), both.alias("cols"), F.lit(False).alias("open"))
        alone = F.struct(F.array(r["row"]).alias("rows"), r["n"].alias("n"), r["cols"].alias("cols"), short.alias("open"))
        return F.when(pairs | completes, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(alone)))

    none = F.array().cast(f"array<struct<rows: array<{row}>, n: int, cols: array<{col}>, open: boolean>>")
    shown = pages.select("page_id", F.posexplode(F.aggregate("rows", none, step)).alias("display_row", "g"))
    return shown.select("page_id", F.explode("g.rows").alias("row"), "display_row")


def fit_rows(rows: DataFrame, shapes: DataFrame, centered: bool = False, wide: int = 10, full: int = 8) -> DataFrame:
    """page_id, row_index, slot, x0, top, x1, bottom: source rows fitted to the sizes of target rows.

    rows(page_id, boxes: array<array<struct<x0, top, x1, bottom>>> of rows from the top), shapes(page_id, sizes). A row of
    the wanted size stays, a longer one loses its last boxes, a shorter or missing one is
    split evenly: over the width of the full rows (those of `full` and more, else all), or,
    `centered` and under `full`, in the middle of it with a pitch of a `wide`-th. A missing row
    takes the mean height and its place from the rows there are.
    """
    all_ = F.flatten("boxes")
    broad = F.filter("boxes", lambda r: F.size(r) >= full)
    chosen = F.when(F.size(broad) > 0, F.flatten(broad)).otherwise(all_)
    edge = lambda v, k, f: f(F.transform(v, lambda b: b[k]))
    middle = lambda r: (F.array_min(F.transform(r, lambda b: b["top"])) + F.array_max(F.transform(r, lambda b: b["bottom"]))) / 2
    base = rows.join(shapes, "page_id").withColumns(
        {
            "fx0": F.coalesce(edge(chosen, "x0", F.array_min), F.lit(0.0)), "fx1": F.coalesce(edge(chosen, "x1", F.array_max), F.lit(0.0)),
            "h": F.when(F.size(all_) > 0, F.aggregate(all_, F.lit(0.0), lambda a, b: a + b["bottom"] - b["top"]) / F.size(all_)).otherwise(34.0), "mids": F.transform("boxes", middle),
        }
    )
    each = base.select("*", F.posexplode("sizes").alias("row_index", "want")).filter("want > 0")
    own = F.coalesce(F.try_element_at("boxes", F.col("row_index") + 1), F.slice(all_, 1, 0))
    each = each.withColumn("own", own).withColumn("have", F.size("own"))
    n = F.size("mids")
    last, first = F.try_element_at("mids", F.lit(-1)), F.try_element_at("mids", F.lit(1))
    step = F.when(n > 1, (last - first) / F.greatest(F.lit(1), n - 1)).otherwise(F.col("h") * 1.1)
    cy = F.when(n > 0, last + step * (F.col("row_index") - n + 1)).otherwise(F.col("h") * (F.col("row_index") + 0.5))
    there = F.col("have") > 0
    top = F.when(there, edge(F.col("own"), "top", F.array_min)).otherwise(cy - F.col("h") / 2)
    bottom = F.when(there, edge(F.col("own"), "bottom", F.array_max)).otherwise(cy + F.col("h") / 2)
    pitch = (F.col("fx1") - F.col("fx0")) / wide
    inset = F.col("fx0") + (wide - F.col("want")) * pitch / 2
    mid = F.lit(centered) & (F.col("fx1") > F.col("fx0")) & (F.col("want") < full)
    x0, x1 = F.when(mid, inset).otherwise(F.col("fx0")), F.when(mid, inset + F.col("want") * pitch).otherwise(F.col("fx1"))
    split = F.transform(F.sequence(F.lit(0), F.col("want") - 1), lambda i: F.struct((F.col("sx0") + i * (F.col("sx1") - F.col("sx0")) / F.col("want")).alias("x0"), F.col("stop").alias("top"), (F.col("sx0") + (i + 1) * (F.col("sx1") - F.col("sx0")) / F.col("want")).alias("x1"), F.col("sbottom").alias("bottom")))
    made = each.withColumns({"sx0": x0, "sx1": x1, "stop": top, "sbottom": bottom}).withColumn("fit", F.when(F.col("have") >= F.col("want"), F.slice("own", F.lit(1), F.col("want"))).otherwise(split))
    return made.select("page_id", "row_index", F.posexplode("fit").alias("slot", "b")).select("page_id", "row_index", "slot", *[F.round(f"b.{c}", 6).alias(c) for c in ("x0", "top", "x1", "bottom")])
