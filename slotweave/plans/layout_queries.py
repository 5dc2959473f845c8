"""Queries for pages, rows and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.operators import layout as y
from slotweave.operators import spatial as sp

from .quality_queries import TYPED, kept, valid
from .registry import register
from .resolve_queries import CASCADE, IDENTITY, steps
from .views import sql, view

WORDS = sql("words")
HOLD = sql("holders")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "words").withColumns({"x": y.center("x0", "x1"), "y": y.center("top", "bottom")})


FOLD = "list_reduce(list_transform(list_sort({0}), lambda v: {{'c': []::DOUBLE[], 's': v, 'n': 1}}), lambda a, b: CASE WHEN abs(b.s - a.s / a.n) <= {1} THEN {{'c': a.c, 's': a.s + b.s, 'n': a.n + 1}} ELSE {{'c': list_append(a.c, a.s / a.n), 's': b.s, 'n': 1}} END)"
CLUSTERS = f"g AS (SELECT page_id, {FOLD.format('list((top + bottom) / 2)', 12.0)} AS f FROM {WORDS} GROUP BY 1), c AS (SELECT page_id, list_append(f.c, f.s / f.n) AS centers FROM g)"
ROUNDED = "array_to_string(list_transform({0}, lambda v: CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR)), ',')"


def rounded(c) -> F.Column:
    return F.array_join(F.transform(c, lambda v: F.round(v * 1000).cast("long").cast("string")), ",")


def row_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).groupBy("page_id").agg(F.collect_list("y").alias("ys")).select("page_id", y.group_centers(y.gap_groups(F.col("ys"), 12.0)).alias("centers"))


@register(
    "i02_i03_row_clusters",
    f"""WITH {CLUSTERS}, b AS (SELECT *, list_transform(range(1, len(centers)), lambda i: (centers[i] + centers[i + 1]) / 2) AS m FROM c)
    SELECT page_id, {ROUNDED.format('centers')} AS centers, {ROUNDED.format('CASE WHEN len(centers) = 1 THEN [centers[1] - 50, centers[1] + 50] ELSE list_concat(list_concat([2 * centers[1] - m[1]], m), [2 * centers[-1] - m[-1]]) END')} AS bounds FROM b""",
)
def i02_i03_row_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_centers(spark, sf_dir).select("page_id", rounded("centers").alias("centers"), rounded(y.boundaries(F.col("centers"))).alias("bounds"))


@register(
    "d13_nearest_rows",
    f"WITH {CLUSTERS}, w AS (SELECT page_id, word_id, (top + bottom) / 2 AS y FROM {WORDS}), n AS (SELECT page_id, word_id, list_transform(centers, lambda v: abs(v - y)) AS gaps FROM w JOIN c USING (page_id)) SELECT page_id, word_id, (list_position(gaps, list_min(gaps)) - 1)::INT AS row FROM n",
)
def d13_nearest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).join(row_centers(spark, sf_dir), "page_id").select("page_id", "word_id", y.nearest_index(F.col("y"), F.col("centers")).alias("row"))


@register("i01_i04_kmeans_columns")
def i01_i04_kmeans_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = words(spark, sf_dir).groupBy("page_id").agg(F.collect_list("x").alias("xs"))
    return pages.select("page_id", F.transform(y.kmeans_centers(F.col("xs"), 4), lambda c: F.round(c, 4)).alias("centers"))


@register("i06_first_fit_rows")
def i06_first_fit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = words(spark, sf_dir).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "y"))).alias("w"))
    return pages.select("page_id", F.transform(y.first_fit_groups(F.transform("w", lambda w: w["y"]), 24.0), lambda g: F.round(g["s"] / g["n"], 4)).alias("rows"))


@register(
    "b35_b36_reading_text",
    f"""WITH o AS (SELECT page_id, list({{'t': text, 'y': top}} ORDER BY top, x0, text) AS l FROM {WORDS} GROUP BY 1),
    r AS (SELECT page_id, list_reduce(l, lambda a, b: CASE WHEN abs(b.y - a.y) <= 3.5 THEN {{'t': a.t || ' ' || b.t, 'y': (a.y + b.y) / 2}} ELSE {{'t': a.t || chr(10) || b.t, 'y': b.y}} END) AS f FROM o) SELECT page_id, f.t AS page_text FROM r""",
)
def b35_b36_reading_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = words(spark, sf_dir).groupBy("page_id").agg(F.collect_list(F.struct("top", "x0", "text")).alias("w"))
    return pages.select("page_id", y.reading_text(F.col("w")).alias("page_text"))


BOXES = f"""an AS (SELECT page_id, min(x0) AS ax0, min(top) AS atop, max(x1) AS ax1, max(bottom) AS abottom FROM {WORDS} GROUP BY 1),
bx AS (SELECT page_id, r AS row, s AS slot, ax0 + s * ((ax1 - ax0) / 8) AS bx0, atop + r * ((abottom - atop) / 3) AS btop, ax0 + (s + 1) * ((ax1 - ax0) / 8) AS bx1, atop + (r + 1) * ((abottom - atop) / 3) AS bbottom FROM an, range(3) x(r), range(8) z(s)),
inb AS (SELECT w.page_id, row, slot, word_id, text, (x0 + x1) / 2 AS x, (top + bottom) / 2 AS y, bx0, bx1, btop, bbottom FROM {WORDS.replace('AS words', 'AS w')} JOIN bx ON w.page_id = bx.page_id AND (x0 + x1) / 2 BETWEEN bx0 AND bx1 AND (top + bottom) / 2 BETWEEN btop AND bbottom)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = words(spark, sf_dir).groupBy("page_id").agg(F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"))
    return y.template_boxes(anchors)


@register("i10_d12_slot_words", f"WITH {BOXES} SELECT page_id, row::INT AS row, slot::INT AS slot, count(*) AS n, min(word_id) AS first_word FROM inb GROUP BY ALL")
def i10_d12_slot_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return y.words_in_boxes(words(spark, sf_dir), boxes(spark, sf_dir)).groupBy("page_id", "row", "slot").agg(F.count(F.lit(1)).alias("n"), F.min("word_id").alias("first_word"))


@register("c09_words_outside_boxes", f"WITH {BOXES} SELECT page_id, word_id FROM {WORDS} WHERE (page_id, word_id) NOT IN (SELECT (page_id, word_id) FROM inb WHERE row <> 1)")
def c09_words_outside_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = y.words_in_boxes(words(spark, sf_dir), boxes(spark, sf_dir).filter("row <> 1")).select("page_id", "word_id").distinct()
    return words(spark, sf_dir).select("page_id", "word_id").join(excluded, ["page_id", "word_id"], "left_anti")


CANDIDATES = f"{BOXES}, cd AS (SELECT w.page_id, word_id, row, slot, abs((x0 + x1) / 2 - (bx0 + bx1) / 2) / greatest(18, 0.75 * greatest(1, bx1 - bx0)) AS dx, abs((top + bottom) / 2 - (btop + bbottom) / 2) / greatest(18, 0.75 * greatest(1, bbottom - btop)) AS dy FROM {WORDS.replace('AS words', 'AS w')} JOIN bx ON w.page_id = bx.page_id WHERE regexp_matches(text, '^[0-9]{{5}}$'))"


@register(
    "d15_greedy_assignment",
    f"""WITH {CANDIDATES}, ln AS (SELECT page_id, list([{{'d': round(sqrt(dx * dx + dy * dy), 9), 'w': word_id, 'b': (row * 8 + slot)::INT}}] ORDER BY round(sqrt(dx * dx + dy * dy), 9), word_id, row * 8 + slot) AS l FROM cd WHERE dx <= 1 AND dy <= 1 GROUP BY 1),
    tk AS (SELECT page_id, unnest(list_reduce(l, lambda a, x: CASE WHEN len(list_filter(a, lambda q: q.w = x[1].w OR q.b = x[1].b)) > 0 THEN a ELSE list_concat(a, x) END)) AS p FROM ln) SELECT page_id, p.w AS word_id, p.b AS box, p.d AS distance FROM tk""",
)
def d15_greedy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = words(spark, sf_dir).filter(F.col("text").rlike("^[0-9]{5}$"))
    near = y.slot_candidates(five, boxes(spark, sf_dir)).withColumn("box", F.col("row") * 8 + F.col("slot"))
    return sp.greedy_pairs(near, "page_id", "word_id", "box", "distance")


@register("d15_slot_candidates", f"WITH {CANDIDATES} SELECT page_id, word_id, row::INT AS row, slot::INT AS slot, round(sqrt(dx * dx + dy * dy), 4) AS distance FROM cd WHERE dx <= 1 AND dy <= 1")
def d15_slot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    five = words(spark, sf_dir).filter(F.col("text").rlike("^[0-9]{5}$"))
    return y.slot_candidates(five, boxes(spark, sf_dir)).withColumn("distance", F.round("distance", 4))


MARKERS = f"mk AS (SELECT page_id, avg((top + bottom) / 2) FILTER (event_type = 'error' AND x0 < 300) AS holders_y, max((top + bottom) / 2) FILTER (event_type = 'purchase' AND x0 < 600) AS bonus_y FROM {WORDS} GROUP BY 1)"


def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda e, x: F.when((F.col("event_type") == e) & (F.col("x0") < x), F.col("y"))
    return words(spark, sf_dir).groupBy("page_id").agg(F.avg(kind("error", 300)).alias("holders_y"), F.max(kind("purchase", 600)).alias("bonus_y"))


@register(
    "d14_sections",
    f"WITH {MARKERS} SELECT page_id, CASE WHEN (top + bottom) / 2 < holders_y THEN 'top_or_holder' WHEN (top + bottom) / 2 < bonus_y THEN 'middle_band' WHEN bonus_y IS NOT NULL THEN 'bonus' ELSE 'unknown' END AS section, count(*) AS n FROM {WORDS} JOIN mk USING (page_id) GROUP BY ALL",
)
def d14_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return y.section_by_marker(words(spark, sf_dir), markers(spark, sf_dir)).groupBy("page_id", "section").agg(F.count(F.lit(1)).alias("n"))


START = "item <> '' AND qty % 4 = 0"
SPANS = f"""m AS (SELECT *, {START} AND NOT is_break AS is_start, sum(is_break::INT) OVER w AS segment, max(col) OVER (PARTITION BY sheet) AS max_col, last_value(CASE WHEN is_break OR ({START}) THEN col END IGNORE NULLS) OVER w AS begin FROM {HOLD}
  WINDOW w AS (PARTITION BY sheet ORDER BY col ROWS UNBOUNDED PRECEDING)),
s AS (SELECT sheet, begin, max(segment)::BIGINT AS segment, arg_min(is_start, col) AS is_start, arg_min(item, col) FILTER (item <> '') AS item, arg_min(qty, col) AS qty, max(max_col) AS max_col FROM m WHERE begin IS NOT NULL GROUP BY 1, 2),
spans AS (SELECT sheet, begin, stop AS "end", segment, item, qty FROM (SELECT *, coalesce(lead(begin) OVER (PARTITION BY sheet ORDER BY begin) - 1, max_col) AS stop FROM s) WHERE is_start)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return y.holder_spans(view(spark, sf_dir, "holders"), F.expr(START) & ~F.col("is_break"), F.col("is_break"))


@register("f04_f05_holder_spans", f"WITH {SPANS} SELECT * FROM spans")
def f04_f05_holder_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir)


@register("f06_sides_of_segments")
def f06_sides_of_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return y.sides_of_segments(spans(spark, sf_dir))


SIDES = f"fd AS (SELECT sheet, col, item, last_value(CASE WHEN side <> '' THEN right(side, 1) END IGNORE NULLS) OVER (PARTITION BY sheet ORDER BY col ROWS UNBOUNDED PRECEDING) AS side FROM {HOLD})"


@register("f03_side_fill_down", f"WITH {SIDES} SELECT sheet, col, side FROM fd")
def f03_side_fill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "holders").withColumn("side", F.right("side", F.lit(1)))
    return y.fill_down(rows, ["sheet"], "col", "side").select("sheet", "col", "side")


@register(
    "f12_single_side_copy",
    f"WITH {SIDES}, o AS (SELECT sheet, min(side) = 'A' AND max(side) = 'A' AS only_a FROM fd WHERE side IS NOT NULL GROUP BY 1) SELECT sheet, col, unnest(CASE WHEN only_a THEN ['A', 'B', 'C', 'D'] ELSE [side] END) AS side FROM fd JOIN o USING (sheet) WHERE side IS NOT NULL",
)
def f12_single_side_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return y.copy_single_side(f03_side_fill_down(spark, sf_dir).filter("side IS NOT NULL"), "sheet").select("sheet", "col", "side")


@register(
    "e18_column_pitch",
    f"""WITH m AS (SELECT page_id, CAST(floor(x0 / 100) AS INT) AS col, round(avg((x0 + x1) / 2), 6) AS x FROM {WORDS} GROUP BY 1, 2), g AS (SELECT page_id, col, round(lead(x) OVER (PARTITION BY page_id ORDER BY x, col) - x, 6) AS gap FROM m), d AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY page_id) AS middle FROM g WHERE gap IS NOT NULL)
    SELECT page_id, col, gap, CASE WHEN middle <= 1e-6 THEN 1 ELSE greatest(1, least(4, round_even(gap / middle, 0)::INT)) END AS units FROM d""",
)
def e18_column_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return y.column_pitch(words(spark, sf_dir).withColumn("col", F.floor(F.col("x0") / 100).cast("int")))


@register(
    "f11_row_split",
    f"""WITH {MARKERS}, r AS (SELECT page_id, CAST(floor(top / 120) AS INT) AS row, round(avg((top + bottom) / 2), 6) AS y FROM {WORDS} GROUP BY 1, 2), g AS (SELECT r.*, CASE WHEN page_id % 2 = 0 THEN bonus_y END AS bonus_y, lead(y) OVER (PARTITION BY page_id ORDER BY y, row) - y AS gap FROM r JOIN mk USING (page_id)),
    a AS (SELECT *, quantile_cont(gap, 0.5) OVER w AS middle, max(gap) OVER w AS widest, coalesce(bool_or(y < bonus_y) OVER w AND bool_or(y >= bonus_y) OVER w, false) AS two_sided FROM g WINDOW w AS (PARTITION BY page_id)), c AS (SELECT *, min(CASE WHEN gap = widest THEN y END) OVER (PARTITION BY page_id) AS cut FROM a)
    SELECT page_id, row, y, CASE WHEN two_sided THEN (y >= bonus_y)::INT WHEN widest >= 1.6 * middle THEN (y > cut)::INT ELSE 0 END AS part FROM c""",
)
def f11_row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir).groupBy("page_id", F.floor(F.col("top") / 120).cast("int").alias("row")).agg(F.round(F.avg("y"), 6).alias("y"))
    marked = rows.join(markers(spark, sf_dir).select("page_id", F.when(F.col("page_id") % 2 == 0, F.col("bonus_y")).alias("bonus_y")), "page_id")
    return y.split_rows(marked)


GRID_CELLS = "SELECT page_id, CAST(floor(top / 180) AS INT) AS row, word_id AS cell, x0, top, x1 + word_id % 7 AS x1, bottom + word_id % 5 AS bottom FROM {0}"
CV = "list_stddev_pop({0}) / greatest(1, list_avg({0}))"
REGULAR = f"""gc AS ({GRID_CELLS.format(WORDS)}), rr AS (SELECT page_id, row, count(*)::INT AS n, round(avg((top + bottom) / 2), 6) AS y, list((x0 + x1) / 2 ORDER BY (x0 + x1) / 2, cell) AS xs, list(greatest(1, x1 - x0) ORDER BY (x0 + x1) / 2, cell) AS ws, list(greatest(1, bottom - top) ORDER BY (x0 + x1) / 2, cell) AS hs, list(cell ORDER BY (x0 + x1) / 2, cell) AS cs FROM gc GROUP BY 1, 2),
wi AS (SELECT page_id, row, i, list_transform(range(i, i + 7), lambda j: xs[j + 1] - xs[j]) AS g, ws[i:i + 7] AS w, hs[i:i + 7] AS h FROM rr, unnest(range(1, n - 6)) t(i) WHERE n > 8),
bi AS (SELECT page_id, row, arg_min(i, (round({CV.format('g')} + {CV.format('w')} + {CV.format('h')}, 6), i)) AS i FROM wi GROUP BY 1, 2),
rg AS (SELECT rr.page_id, rr.row, n, y, CASE WHEN n > 8 THEN xs[i:i + 7] ELSE xs END AS kx, CASE WHEN n > 8 THEN ws[i:i + 7] ELSE ws END AS kw, CASE WHEN n > 8 THEN cs[i:i + 7] ELSE cs END AS kc FROM rr LEFT JOIN bi USING (page_id, row))"""


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.floor(F.col("top") / 180).cast("int").alias("row")
    return view(spark, sf_dir, "words").select("page_id", row, F.col("word_id").alias("cell"), "x0", "top", (F.col("x1") + F.col("word_id") % 7).alias("x1"), (F.col("bottom") + F.col("word_id") % 5).alias("bottom"))


@register("f08_regular_cells", f"WITH {REGULAR} SELECT page_id, row, n, array_to_string(kc, ',') AS kept FROM rg")
def f08_regular_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.array_join(F.transform("c", lambda c: c["cell"].cast("string")), ",")
    return y.regular_cells(grid_cells(spark, sf_dir)).select("page_id", "row", "n", kept.alias("kept"))


COUNT_COST = "(CASE WHEN {0} < 8 THEN 10000.0 + (8 - {0}) * 1000.0 ELSE ({0} - 8) * 250.0 END)"


@register(
    "f08_three_rows",
    f"""WITH {REGULAR}, t AS (SELECT page_id, row AS r1, y AS y1, n AS n1, kx AS x1, kw AS w1, lead(row) OVER o AS r2, lead(y) OVER o AS y2, lead(n) OVER o AS n2, lead(kx) OVER o AS x2, lead(kw) OVER o AS w2, lead(row, 2) OVER o AS r3, lead(y, 2) OVER o AS y3, lead(n, 2) OVER o AS n3, lead(kx, 2) OVER o AS x3, lead(kw, 2) OVER o AS w3, row_number() OVER o AS p FROM rg WINDOW o AS (PARTITION BY page_id ORDER BY y, row)),
    s AS (SELECT *, round({COUNT_COST.format('n1')} + {COUNT_COST.format('n2')} + {COUNT_COST.format('n3')} + abs((y2 - y1) - (y3 - y2)) / greatest(1, (y3 - y1) / 2) * 500.0 + CASE WHEN len(x1) >= 8 AND len(x2) >= 8 AND len(x3) >= 8 THEN
      list_sum(list_transform(range(1, 9), lambda j: greatest(x1[j], x2[j], x3[j]) - least(x1[j], x2[j], x3[j]))) / 24 / greatest(1, list_median(list_concat(list_concat(w1, w2), w3))) * 1000.0 ELSE 0 END, 4)::DOUBLE AS score FROM t WHERE r3 IS NOT NULL),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score, p) AS k FROM s)
    SELECT page_id, unnest([r1, r2, r3]) AS row, unnest([y1, y2, y3]) AS y, unnest([n1, n2, n3]) AS n, unnest([0, 1, 2])::INT AS place, score FROM k WHERE k = 1""",
)
def f08_three_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return y.best_three_rows(y.regular_cells(grid_cells(spark, sf_dir)))


SIDE_OF = "substr('ABCD', CAST(1 + page_id % 4 AS INT), 1)"
TOKENS = f"""tk AS (SELECT page_id, {SIDE_OF} AS side, word_id AS cell, (x0 + x1) / 2 AS x, (top + bottom) / 2 AS y FROM {WORDS} WHERE event_type IN ('click', 'view')), tg AS (SELECT page_id, {FOLD.format('list(y)', 40.0)} AS f, quantile_cont(x, 1.0 / 3) AS q1, quantile_cont(x, 2.0 / 3) AS q2 FROM tk GROUP BY 1),
tc AS (SELECT page_id, list_append(f.c, f.s / f.n) AS ys, q1, q2 FROM tg), tn AS (SELECT tk.*, list_transform(ys, lambda v: abs(v - y)) AS gaps, CASE WHEN x <= q1 THEN 'left' WHEN x >= q2 THEN 'right' ELSE 'center' END AS block FROM tk JOIN tc USING (page_id)), tr AS (SELECT *, (list_position(gaps, list_min(gaps)) - 1)::INT AS row FROM tn),
ts AS (SELECT page_id, side, cell, row, block, dense_rank() OVER (PARTITION BY page_id ORDER BY row) - 1 AS row_index, row_number() OVER (PARTITION BY page_id, row ORDER BY x, cell) - 1 AS slot_in_row, row_number() OVER (PARTITION BY page_id ORDER BY row, x, cell) - 1 AS slot_order, row_number() OVER (PARTITION BY page_id, row, block ORDER BY x, cell) - 1 AS block_pos FROM tr)"""


def token_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slotweave.operators.bands import token_slots as placed

    tokens = words(spark, sf_dir).filter("event_type IN ('click', 'view')").select("page_id", F.expr(SIDE_OF).alias("side"), F.col("word_id").alias("token"), "x", "y")
    return placed(tokens, 40.0)


@register(
    "f10_i09_token_slots",
    f"WITH {TOKENS} SELECT page_id, cell, block, row_index::INT AS row_index, slot_in_row::INT AS slot_in_row, slot_order::INT AS slot_order, block_pos::INT AS block_pos, concat(side, '-MB-R', row_index + 1, '-S', slot_in_row + 1) AS slot_id FROM ts",
)
def f10_i09_token_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_slots(spark, sf_dir).select("page_id", "cell", "block", "row_index", "slot_in_row", "slot_order", "block_pos", "slot_id")


@register(
    "e19_shape_of_slots",
    f"""WITH {TOKENS}, r AS (SELECT page_id, row, count(*) AS n, [count(*) FILTER (block = 'left'), count(*) FILTER (block = 'center'), count(*) FILTER (block = 'right')] AS b FROM ts GROUP BY 1, 2)
    SELECT page_id, sum(n)::BIGINT AS n_slots, string_agg(n, ',' ORDER BY row) AS counts, string_agg(array_to_string(b, '-'), ',' ORDER BY row) AS grouping, count(*) = 3 AND bool_and(n = 8 AND b = [2, 4, 2]) AS valid FROM r GROUP BY 1""",
)
def e19_shape_of_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = y.shape_check(token_slots(spark, sf_dir))
    grouping = F.array_join(F.transform("grouping", lambda g: F.array_join(F.transform(g, lambda n: n.cast("string")), "-")), ",")
    return found.withColumns({"counts": F.array_join(F.transform("counts", lambda n: n.cast("string")), ","), "grouping": grouping})


CONTENT = f"sc AS (SELECT {SIDE_OF} AS side, CASE WHEN top < 900 THEN 'main' ELSE 'bonus' END AS section, CAST(floor(top / 300) AS INT) AS row_index, CAST(word_id AS VARCHAR) AS slot_id, CASE WHEN event_type = 'click' THEN text ELSE '' END AS last5, CASE word_id % 50 WHEN 0 THEN 'wm pkg' WHEN 1 THEN 'Bonus' ELSE text END AS label FROM {{0}})"


@register(
    "e20_side_slots",
    f"""WITH {CONTENT.format(WORDS)}, k AS (SELECT *, section = 'main' AND regexp_matches(upper(label), 'WM|PKG|GCI|MARKETING|FRAUD|BONUS') AS odd FROM sc)
    SELECT side, coalesce(string_agg(DISTINCT last5, ',' ORDER BY last5) FILTER (section = 'main' AND last5 <> ''), '') AS main_ids, coalesce(string_agg(DISTINCT last5, ',' ORDER BY last5) FILTER (section = 'bonus' AND last5 <> ''), '') AS bonus_ids, count(*) FILTER (section = 'main') AS main_slots, count(*) FILTER (section = 'bonus') AS bonus_slots,
    coalesce(string_agg(slot_id, ',' ORDER BY slot_id) FILTER (odd), '') AS suspicious, coalesce(string_agg(slot_id, ',' ORDER BY slot_id) FILTER (odd AND row_index = 0), '') AS suspicious_first_row FROM k GROUP BY 1""",
)
def e20_side_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = view(spark, sf_dir, "words").selectExpr(
        f"{SIDE_OF} AS side", "CASE WHEN top < 900 THEN 'main' ELSE 'bonus' END AS section", "CAST(floor(top / 300) AS INT) AS row_index", "CAST(word_id AS STRING) AS slot_id", "CASE WHEN event_type = 'click' THEN text ELSE '' END AS last5",
        "CASE word_id % 50 WHEN 0 THEN 'wm pkg' WHEN 1 THEN 'Bonus' ELSE text END AS label",
    )
    lists = ("main_ids", "bonus_ids", "suspicious", "suspicious_first_row")
    return y.side_content(slots).withColumns({c: F.array_join(c, ",") for c in lists})


@register(
    "d13_nearest_per_cell",
    f"WITH {CLUSTERS}, x AS (SELECT page_id, list_append(f.c, f.s / f.n) AS xs FROM (SELECT page_id, {FOLD.format('list((x0 + x1) / 2)', 36.0)} AS f FROM {WORDS} GROUP BY 1)), w AS (SELECT page_id, word_id, (x0 + x1) / 2 AS wx, list_transform(centers, lambda v: abs(v - (top + bottom) / 2)) AS gy, list_transform(xs, lambda v: abs(v - (x0 + x1) / 2)) AS gx FROM {WORDS} JOIN c USING (page_id) JOIN x USING (page_id)),"
    " k AS (SELECT page_id, list_position(gy, list_min(gy)) - 1 AS row, list_position(gx, list_min(gx)) - 1 AS col, round(list_min(gx), 9) AS off, word_id FROM w) SELECT page_id, row::INT AS row, col::INT AS col, arg_min(word_id, (off, word_id)) AS item FROM k GROUP BY 1, 2, 3",
)
def d13_nearest_per_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    xs = w.groupBy("page_id").agg(y.group_centers(y.gap_groups(F.collect_list("x"), 36.0)).alias("xs"))
    grid = xs.join(row_centers(spark, sf_dir).withColumnRenamed("centers", "ys"), "page_id")
    return y.nearest_per_cell(w.select("page_id", F.col("word_id").alias("item"), "x", "y"), grid)


@register("f09_display_rows")
def f09_display_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = view(spark, sf_dir, "words").select("page_id", F.floor(F.col("top") / 120).cast("int").alias("row"), F.floor(F.col("x0") / 100).cast("int").alias("col")).distinct()
    return y.display_rows(cells)


@register("i16_fitted_rows")
def i16_fitted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_row = view(spark, sf_dir, "words").groupBy("page_id", F.floor(F.col("top") / 200).cast("int").alias("row")).agg(F.array_sort(F.collect_list(F.struct("x0", "top", "x1", "bottom"))).alias("b"))
    rows = per_row.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "b"))), lambda r: r["b"]).alias("boxes"))
    return y.fit_rows(rows, rows.select("page_id", F.array(*[F.lit(n) for n in (8, 8, 8, 6, 10, 4, 8, 8, 5)]).alias("sizes")), True)


@register(
    "f14_position_candidates",
    f"""WITH {TYPED}, m AS (SELECT DISTINCT side, row, col, item_number, brand FROM ok) SELECT side, row, col, string_agg(item_number || ':' || brand, ',' ORDER BY item_number, brand) AS matches FROM m GROUP BY ALL
    UNION ALL SELECT NULL, row, col, string_agg(item_number || ':' || brand, ',' ORDER BY item_number, brand) FROM (SELECT DISTINCT row, col, item_number, brand FROM m) GROUP BY ALL""",
)
def f14_position_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slotweave.operators.bands import position_candidates

    linked = valid(spark, sf_dir).select("side", "row", "col", F.col("item_number").alias("product"), F.col("brand").alias("norm_name"))
    told = F.array_join(F.transform("candidates", lambda c: F.concat(c["product"], F.lit(":"), c["norm_name"])), ",").alias("matches")
    per_side = position_candidates(linked, ["side", "row", "col"]).select("side", "row", "col", told)
    return per_side.unionByName(position_candidates(linked, ["row", "col"]).select(F.lit(None).cast("int").alias("side"), "row", "col", told))


@register(
    "e12_label_audit",
    f"WITH {CASCADE}, a AS (SELECT side, count(*) AS n, count(path) AS resolved FROM ok JOIN resolved USING (src_ord) GROUP BY 1) SELECT side, n, resolved, round(resolved / n, 6) AS rate, n <> max(n) OVER () AS uneven FROM a",
)
def e12_label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slotweave.operators.resolve import cascade

    rows = valid(spark, sf_dir)
    found = cascade(rows, "src_ord", IDENTITY, steps(spark, sf_dir))
    per_side = rows.select("src_ord", "side").join(found, "src_ord").groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count("path").alias("resolved"))
    # four rows at most
    return per_side.withColumns({"rate": F.round(F.col("resolved") / F.col("n"), 6), "uneven": F.col("n") != F.max("n").over(W.partitionBy())})


@register(
    "e13_fullest_pog",
    f"WITH {TYPED}, t AS (SELECT side, pog, count(*) AS n FROM ok GROUP BY 1, 2) SELECT side, arg_max(pog, (n, -(pog[4:])::INT)) AS pog, max(n) AS n FROM t GROUP BY 1",
)
def e13_fullest_pog(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = valid(spark, sf_dir).groupBy("side", "pog").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct("n", -F.substring("pog", 4, 10).cast("int"))
    return totals.groupBy("side").agg(F.max_by("pog", order).alias("pog"), F.max("n").alias("n"))


@register(
    "e19_shape_check",
    f"WITH {TYPED}, p AS (SELECT DISTINCT pog, side, row, col FROM ok), r AS (SELECT pog, side, row, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT pog, side, list(n ORDER BY row) AS shape FROM r GROUP BY 1, 2) SELECT pog, side, array_to_string(shape, ',') AS shape, len(shape) = 3 AND list_min(shape) = 8 AND list_max(shape) = 8 AS is_full FROM s",
)
def e19_shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spark, sf_dir).groupBy("pog", "side", "row").agg(F.count(F.lit(1)).alias("n"))
    shape = F.transform(F.array_sort(F.collect_list(F.struct("row", "n"))), lambda r: r["n"])
    full = F.array(*[F.lit(8).cast("long")] * 3)
    return rows.groupBy("pog", "side").agg(shape.alias("s")).select("pog", "side", F.array_join("s", ",").alias("shape"), (F.col("s") == full).alias("is_full"))


@register(
    "e20_side_content",
    f"WITH {TYPED} SELECT side, count(DISTINCT right(regexp_replace(upc, '[^0-9]', '', 'g'), 5)) FILTER (row <= 3) AS main_ids, count(DISTINCT right(regexp_replace(upc, '[^0-9]', '', 'g'), 5)) FILTER (row > 3) AS bonus_ids, count(*) AS slots, count(*) FILTER (regexp_matches(upper(desc_1), 'GIFT|XBOX')) AS suspicious FROM ok GROUP BY 1",
)
def e20_side_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.right(F.regexp_replace("upc", "[^0-9]", ""), F.lit(5))
    return valid(spark, sf_dir).groupBy("side").agg(
        F.count_distinct(F.when(F.col("row") <= 3, last)).alias("main_ids"), F.count_distinct(F.when(F.col("row") > 3, last)).alias("bonus_ids"), F.count(F.lit(1)).alias("slots"),
        F.count_if(F.upper("desc_1").rlike("GIFT|XBOX")).alias("suspicious"),
    )


SECTION = "CASE WHEN row <= 3 THEN 'middle' ELSE 'bonus' END"
AUDIT = f"""{TYPED}, t AS (SELECT pog, side, {SECTION} AS section, row, col, bool_or(description <> '') AS has_label FROM ok GROUP BY ALL), src AS (SELECT pog, side, {SECTION} AS section, row, col, min(item_number) AS source FROM ok WHERE cpp <> '' AND (side < 3 OR row < 4) GROUP BY ALL), gr AS (SELECT DISTINCT pog, side, section FROM src)"""


@register(
    "d24_pairing_audit",
    f"""WITH {AUDIT.replace("SELECT pog, side, CASE", "SELECT side, CASE").replace("SELECT DISTINCT pog, side, section", "SELECT DISTINCT side, section")} SELECT t.side, t.section, t.row, t.col, has_label, source, CASE WHEN gr.side IS NULL THEN 'no_source_grid' WHEN NOT has_label THEN 'blank_target_slot' WHEN source IS NULL THEN 'missing_source_slot' ELSE 'INSERTED' END AS reason
    FROM t LEFT JOIN src ON src.side = t.side AND src.section = t.section AND src.row = t.row AND src.col = t.col LEFT JOIN gr ON gr.side = t.side AND gr.section = t.section
    UNION ALL SELECT side, section, NULL, NULL, NULL, NULL, 'no_target_slots' FROM range(1, 6) a(side), (VALUES ('middle'), ('bonus')) b(section) WHERE (side, section) NOT IN (SELECT (side, section) FROM t)""",
)
def d24_pairing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(spark, sf_dir).withColumn("section", F.when(F.col("row") <= 3, "middle").otherwise("bonus"))
    slot = ["side", "section", "row", "col"]
    targets = rows.groupBy(*slot).agg(F.bool_or(F.col("description") != "").alias("has_label"))
    sources = rows.filter("cpp <> '' AND (side < 3 OR row < 4)").groupBy(*slot).agg(F.min("item_number").alias("source"))
    sections = spark.createDataFrame([(side, section) for side in range(1, 6) for section in ("middle", "bonus")], "side long, section string")  # side 5 has no slots
    return y.pairing_audit(targets, sources, sections).select(*slot, "has_label", "source", "reason")


@register(
    "d27_rank_pairs",
    f"""WITH a AS (SELECT page_id, word_id, row_number() OVER (PARTITION BY page_id ORDER BY top, word_id) AS k FROM {WORDS} WHERE event_type = 'click'), b AS (SELECT page_id, word_id AS cell, row_number() OVER (PARTITION BY page_id ORDER BY x0, word_id) AS k FROM {WORDS} WHERE event_type = 'view') SELECT page_id, word_id, k::INT AS k, cell FROM a LEFT JOIN b USING (page_id, k)""",
)
def d27_rank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = words(spark, sf_dir)
    rank = lambda by: F.row_number().over(W.partitionBy("page_id").orderBy(by, "word_id"))
    a = w.filter("event_type = 'click'").withColumn("k", rank("top")).select("page_id", "word_id", "k")
    b = w.filter("event_type = 'view'").withColumn("k", rank("x0")).select("page_id", F.col("word_id").alias("cell"), "k")
    return a.join(b, ["page_id", "k"], "left")


@register("i12_slot_centers", "SELECT side, k::INT AS slot, round((k + 0.5) * width / n, 4)::DOUBLE AS center FROM (VALUES (1, 2178.0, 6), (2, 2767.5, 8), (3, 2178.0, 6), (4, 2767.5, 8)) g(side, width, n), range(8) r(k) WHERE k < n AND side IN (SELECT DISTINCT 1 + l_orderkey % 4 FROM lineitem)")
def i12_slot_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((1 + F.col("l_orderkey") % 4).cast("int").alias("side")).distinct()
    n = F.when(F.col("side") % 2 == 1, 6).otherwise(8)
    width = F.when(F.col("side") % 2 == 1, 30.25 * 72).otherwise(38.4375 * 72)
    return sides.withColumns({"n": n, "width": width}).withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("side", "slot", F.round((F.col("slot") + 0.5) * F.col("width") / F.col("n"), 4).alias("center"))
