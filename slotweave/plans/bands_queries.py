"""Queries for word groups, bands, regions and the composite jobs over labels and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import ids, text
from slotweave.operators import bands as b
from slotweave.operators import near as n
from slotweave.operators import quality as q
from slotweave.operators import rank
from slotweave.operators import score as s
from slotweave.operators.layout import holders_by_side
from slotweave.operators.lineage import dealt

from . import duck as d
from .layout_queries import spans
from .near_queries import SIM, all_pairs, labels, matrix
from .quality_queries import TYPED, geometry, valid
from .registry import register
from .resolve_queries import LEGACY, PAIRS, best_images, review_top
from .views import sql, view

WORDS = sql("words")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "words")


@register("i05_proximity_groups")
def i05_proximity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.proximity_groups(words(spark, sf_dir), 20.0, 12.0).groupBy("page_id", "group").agg(F.count(F.lit(1)).alias("n"), F.min("word_id").alias("first_word"))


@register("i11_marker_boxes")
def i11_marker_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.marker_boxes(words(spark, sf_dir), ["GIFT", "HOLDERS", "CARD"], "HOLDERS", 40.0, 20.0)


#: Words as on pages with a bonus line and holders.
SAID = "CASE WHEN event_type = 'purchase' AND top > 900 AND word_id % 3 = 0 THEN 'BONUS' WHEN event_type = 'error' AND top < 500 THEN 'wm' ELSE text END"
ANCHOR = f"""wd AS (SELECT * REPLACE ({SAID} AS text) FROM {WORDS}), pg AS (SELECT page_id, coalesce(min(top) FILTER (upper(trim(text)) = 'BONUS'), 1440 * 0.84) AS bonus, coalesce(max(bottom) FILTER (upper(trim(text)) IN ('WM', 'GIFTCARD', 'GIFTCAR', 'PKG') AND top < 1440 * 0.35) + 8.0, 1440 * 0.31) AS holder FROM wd GROUP BY 1),
tt AS (SELECT *, 3 * 74.88 + 2 * 17.28 + 8.0 AS band, greatest(bonus - 6.0 - band, holder + 24.0) AS t FROM pg), bb AS (SELECT *, CASE WHEN t + band >= bonus - 2.0 THEN bonus - 6.0 ELSE t + band END AS b FROM tt),
fv AS (SELECT page_id, min(x0) - 10 AS fx0, max(x1) + 10 AS fx1 FROM wd JOIN bb USING (page_id) WHERE regexp_matches(text, '^[0-9]{{5}}$') AND top BETWEEN greatest(0, t - 1440 * 0.04) AND least(1440, b + 1440 * 0.03) GROUP BY 1),
an AS (SELECT page_id, greatest(2000 * 0.16, coalesce(fx0, 0)) AS x0, greatest(t, holder + 20.0) AS top, least(2000 * 0.84, coalesce(fx1, 2000)) AS x1, least(b, bonus - 4.0) AS bottom FROM bb LEFT JOIN fv USING (page_id))"""


@register("i14_anchor_bounds", f"WITH {ANCHOR} SELECT page_id, round(x0, 4)::DOUBLE AS x0, round(top, 4)::DOUBLE AS top, round(x1, 4)::DOUBLE AS x1, round(bottom, 4)::DOUBLE AS bottom FROM an WHERE x1 - x0 >= 140 AND bottom - top >= 120")
def i14_anchor_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.anchor_bounds(words(spark, sf_dir).withColumn("text", F.expr(SAID)), 2000.0, 1440.0).select("page_id", *[F.round(c, 4).alias(c) for c in ("x0", "top", "x1", "bottom")])


@register("i07_unique_boxes")
def i07_unique_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.unique_boxes(words(spark, sf_dir).withColumnRenamed("word_id", "box_id"), 15.0).select("page_id", "box_id")


@register("i17_region_rows")
def i17_region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = words(spark, sf_dir).select("page_id", F.col("word_id").alias("box_id"), "x0", "top", "x1", (F.col("bottom") + 14).alias("bottom"))
    regions = boxes.groupBy("page_id").agg(F.min("x0").alias("rx0"), F.lit(200.0).alias("rtop"), F.max("x1").alias("rx1"), F.lit(900.0).alias("rbottom"))
    return b.region_rows(boxes, regions)


@register("i13_placeholders")
def i13_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_type") == "error", "WM").otherwise(F.col("text"))
    return b.placeholder_centers(words(spark, sf_dir).withColumn("text", said))


@register(
    "i09_tertile_blocks",
    f"WITH t AS (SELECT page_id, word_id, (x0 + x1) / 2 AS x FROM {WORDS} WHERE event_type = 'click'), k AS (SELECT *, quantile_cont(x, 1.0 / 3) OVER (PARTITION BY page_id) AS q1, quantile_cont(x, 2.0 / 3) OVER (PARTITION BY page_id) AS q2 FROM t) SELECT page_id, CASE WHEN x <= q1 THEN 'left' WHEN x <= q2 THEN 'center' ELSE 'right' END AS block, count(*) AS n FROM k GROUP BY ALL",
)
def i09_tertile_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = words(spark, sf_dir).filter("event_type = 'click'").withColumn("x", (F.col("x0") + F.col("x1")) / 2)
    return b.tertile_blocks(tokens).groupBy("page_id", "block").agg(F.count(F.lit(1)).alias("n"))


@register(
    "i16_rows_around_marker",
    f"""WITH r AS (SELECT page_id, CAST(floor(top / 120) AS INT) AS row, round(avg(top), 6) AS y, 700.0::DOUBLE AS marker_y FROM {WORDS} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY page_id, y < marker_y ORDER BY y DESC, row DESC) AS k, count(*) FILTER (y < marker_y) OVER (PARTITION BY page_id) AS n FROM r)
    SELECT page_id, row, y, marker_y, CASE WHEN y < marker_y THEN 'middle' ELSE 'bonus' END AS section FROM k WHERE (y < marker_y AND k <= 3 AND n >= 3) OR y > marker_y""",
)
def i16_rows_around_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words(spark, sf_dir).groupBy("page_id", F.floor(F.col("top") / 120).cast("int").alias("row")).agg(F.round(F.avg("top"), 6).alias("y"))
    return b.rows_around_marker(rows.withColumn("marker_y", F.lit(700.0)))


@register(
    "d28_preferred_source",
    f"""WITH c AS (SELECT page_id, substr('ABCD', CAST(1 + page_id % 4 AS INT), 1) AS side, CASE event_type WHEN 'click' THEN 'structured' WHEN 'view' THEN 'section' ELSE 'cell' END AS source, word_id FROM {WORDS}), n AS (SELECT page_id, min(side) AS s, count(*) FILTER (source = 'structured') AS a, count(*) FILTER (source = 'section') AS b FROM c GROUP BY 1),
    k AS (SELECT page_id, CASE WHEN s IN ('B', 'D') AND a >= 14 THEN 'structured' WHEN b >= 14 THEN 'section' ELSE 'cell' END AS source FROM n) SELECT page_id, source, side, word_id FROM c JOIN k USING (page_id, source)""",
)
def d28_preferred_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.when(F.col("event_type") == "click", "structured").when(F.col("event_type") == "view", "section").otherwise("cell")
    side = F.substring(F.lit("ABCD"), (1 + F.col("page_id") % 4).cast("int"), F.lit(1))
    return b.preferred_source(words(spark, sf_dir).select("page_id", side.alias("side"), source.alias("source"), "word_id"), 14)


@register(
    "i04_smallest_grid",
    f"""WITH c AS (SELECT page_id, count(*) AS n, 1.5::DOUBLE AS aspect FROM {WORDS} GROUP BY 1), g AS (SELECT c.*, k, ceil(n / k) AS r FROM c, range(1, 100000) t(k) WHERE k <= n), o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY r * k - n, abs(k / greatest(1, r) - aspect), k) AS q FROM g)
    SELECT page_id, n, aspect, k::INT AS cols, r::INT AS rows FROM o WHERE q = 1""",
)
def i04_smallest_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.smallest_grid(words(spark, sf_dir).groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).withColumn("aspect", F.lit(1.5)))


LABEL_TEXT = "concat(desc_1, ' ', CASE WHEN src_ord % 2 = 0 THEN upc ELSE '' END, ' ', item_number)"
#: The name on a label: brand and product, either of which may lack.
LABEL_NAME = "concat(brand, ' ', desc_2)"
HINTS = f"""lb AS (SELECT src_ord AS row_id, {LABEL_TEXT} AS label, CASE WHEN src_ord % 3 = 0 THEN '' ELSE lpad(CAST((7000 * TRY_CAST(nullif({d.digits('item_number')}, '') AS BIGINT)) % 100000 AS VARCHAR), 5, '0') END AS last5, {d.name(LABEL_NAME)} AS name FROM {sql('placement')}),
mx AS (SELECT src_ord AS product, {d.pad(d.digits('UPC'), 12)} AS upc12, right({d.digits('UPC')}, 5) AS last5, {d.name('NAME')} AS norm_name FROM {sql('matrix')}), rn AS (SELECT *, regexp_extract_all(label, '[0-9]{{4,14}}') AS a FROM lb),
ks AS (SELECT row_id, name, 0 AS tier, 0 AS pos, last5 AS key, 'five' AS kind FROM lb WHERE last5 <> '' UNION ALL SELECT row_id, name, 1, p, x[p], 'upc' FROM (SELECT row_id, name, list_transform(list_filter(a, lambda v: length(v) >= 11), lambda v: lpad(right(v, 12), 12, '0')) AS x FROM rn), unnest(range(1, len(x) + 1)) t(p)
  UNION ALL SELECT row_id, name, 2, p, x[p], 'five' FROM (SELECT row_id, name, list_filter(list_transform(list_filter(a, lambda v: length(v) >= 5), lambda v: right(v, 5)), lambda v: v <> last5) AS x FROM rn), unnest(range(1, len(x) + 1)) t(p)),
ht AS (SELECT row_id, tier, pos, product, {SIM.format('name', 'norm_name')} AS score FROM ks JOIN (SELECT 'five' AS kind, last5 AS key, product, norm_name FROM mx UNION ALL SELECT 'upc', upc12, product, norm_name FROM mx) USING (kind, key)),
bs AS (SELECT row_id, product, tier FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY tier, pos, score DESC, product) AS q FROM ht) WHERE q = 1)"""


PLACES = f"""{HINTS}, nm AS (SELECT DISTINCT name FROM lb WHERE name <> '' AND row_id NOT IN (SELECT row_id FROM bs)), {all_pairs('nm', 'mx', 0.78)}, nb AS (SELECT name, product FROM (SELECT name, product, row_number() OVER (PARTITION BY name ORDER BY score DESC, product) AS q FROM (SELECT name, product, {SIM.format('name', 'norm_name')} AS score FROM pr JOIN mx USING (norm_name)) WHERE score >= 0.78) WHERE q = 1),
ln AS (SELECT row_id, product, tier FROM bs UNION ALL SELECT row_id, product, 3 FROM lb JOIN nb USING (name) WHERE row_id NOT IN (SELECT row_id FROM bs)), pl AS (SELECT src_ord AS row_id, side, row, col FROM {sql('placement')}),
pt AS (SELECT DISTINCT side, row, col, product, norm_name FROM ln JOIN pl USING (row_id) JOIN mx USING (product) WHERE side <> '3'), op AS (SELECT row_id, side, row, col, name, {d.name('label')} AS raw_name, CASE WHEN name <> '' THEN name ELSE {d.name('label')} END AS asked FROM lb JOIN pl USING (row_id) WHERE row_id NOT IN (SELECT row_id FROM ln)),
ps AS (SELECT row_id, product, round({SIM.format('asked', 'norm_name')}, 6) AS f, count(*) OVER (PARTITION BY row_id) AS n, row_number() OVER (PARTITION BY row_id ORDER BY {SIM.format('asked', 'norm_name')} DESC, {SIM.format('raw_name', 'norm_name')} DESC, product) AS q FROM op JOIN pt USING (side, row, col)),
po AS (SELECT op.* FROM op WHERE row_id NOT IN (SELECT row_id FROM ps WHERE q = 1 AND f >= 0.6)), pa AS (SELECT row_id, product, round({SIM.format('asked', 'norm_name')}, 6) AS f, count(*) OVER (PARTITION BY row_id) AS n, row_number() OVER (PARTITION BY row_id ORDER BY {SIM.format('asked', 'norm_name')} DESC, {SIM.format('raw_name', 'norm_name')} DESC, product) AS q FROM po JOIN (SELECT DISTINCT row, col, product, norm_name FROM pt) USING (row, col)),
fd AS (SELECT row_id, product, tier, NULL::INT AS n, NULL::DOUBLE AS f FROM ln UNION ALL SELECT row_id, product, 4, n::INT, f FROM ps WHERE q = 1 AND f >= 0.6 UNION ALL SELECT po.row_id, CASE WHEN f >= 0.6 THEN product END, CASE WHEN f >= 0.6 THEN 5 END, coalesce(n, 0)::INT, f FROM po LEFT JOIN (SELECT * FROM pa WHERE q = 1) z ON z.row_id = po.row_id)"""


def hinted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    five = F.lpad(((F.nullif(ids.digits_only("item_number"), F.lit("")).cast("long") * 7000) % 100000).cast("string"), 5, "0")
    placed = dealt(view(spark, sf_dir, "placement").select("src_ord", "upc", "item_number", "brand", "desc_1", "desc_2", "side", "row", "col"), "src_ord")
    rows = placed.select(
        F.col("src_ord").alias("row_id"), F.expr(LABEL_TEXT).alias("label"), F.when(F.col("src_ord") % 3 == 0, "").otherwise(five).alias("last5"), text.norm_name(F.expr(LABEL_NAME)).alias("name"),
        "side", "row", F.col("col").alias("slot"), (F.col("side") != "3").alias("whole"), text.norm_name(F.expr(LABEL_TEXT)).alias("raw_name"),
    )
    products = view(spark, sf_dir, "matrix").select(F.col("src_ord").alias("product"), ids.coerce_upc12("UPC").alias("upc12"), F.right(ids.digits_only("UPC"), F.lit(5)).alias("last5"), text.norm_name("NAME").alias("norm_name"))
    return rows, products


@register("d18_hint_cascade", f"WITH {PLACES} SELECT row_id, product, CASE tier WHEN 0 THEN 'exact_last5' WHEN 1 THEN 'hint_upc' WHEN 2 THEN 'hint_last5' WHEN 3 THEN 'name' WHEN 4 THEN 'position_side' WHEN 5 THEN 'position_any' ELSE 'unresolved' END AS path, n AS n_candidates, f AS score FROM lb LEFT JOIN fd USING (row_id)")
def d18_hint_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.hint_cascade(*hinted(spark, sf_dir), n.edit_ratio)


@register("d18_hint_cascade_by_blocks")
def d18_hint_cascade_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.hint_cascade(*hinted(spark, sf_dir), n.name_ratio)


@register("p02_review_summary", f"WITH {PAIRS} SELECT count(DISTINCT product) AS with_candidates FROM pairs")
def p02_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.best_confidence(review_top(spark, sf_dir)).agg(F.count(F.lit(1)).alias("with_candidates"))


@register(
    "p03_price_strips",
    f"WITH {TYPED}, r AS (SELECT DISTINCT pog, side, row FROM ok), f AS (SELECT pog, side, row, count(DISTINCT col) AS filled FROM ok WHERE col <= CASE WHEN side IN (1, 3) THEN 6 ELSE 8 END GROUP BY ALL) SELECT pog, side, row, CASE WHEN side IN (1, 3) THEN 6 ELSE 8 END::BIGINT AS slots, CASE WHEN side IN (1, 3) THEN 6 ELSE 8 END - coalesce(filled, 0) AS empty FROM r LEFT JOIN f USING (pog, side, row)",
)
def p03_price_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = q.densify(valid(spark, sf_dir), geometry(spark).select("side", "slot_count"))
    return slots.groupBy("pog", "side", "row").agg(F.count(F.lit(1)).alias("slots"), F.count_if("is_empty").alias("empty")).orderBy("pog", "side", "row")


CPP = f"TRY_CAST(regexp_replace({d.txt('CPP')}, '\\.0$', '') AS BIGINT)"


@register(
    "p04_label_rows",
    f"""WITH mx AS (SELECT src_ord, right({d.pad(d.digits('UPC'), 12)}, 5) AS last5, {d.name('NAME')} AS norm_name, {CPP} AS cpp FROM {sql('matrix')}), lb AS (SELECT src_ord AS row_id, TRY_CAST(nullif(cpp, '') AS BIGINT) AS qty, lpad(CAST((7000 * TRY_CAST(nullif({d.digits('item_number')}, '') AS BIGINT)) % 100000 AS VARCHAR), 5, '0') AS last5, {d.name('desc_1')} AS name FROM {sql('placement')}),
    sc AS (SELECT last5, name, src_ord, {SIM.format('name', 'norm_name')} AS score FROM (SELECT DISTINCT last5, name FROM lb) JOIN mx USING (last5)), bs AS (SELECT last5, name, -(max((score, -src_ord)))[2] AS product FROM sc GROUP BY 1, 2) SELECT row_id, product, coalesce(qty, cpp) AS qty FROM lb LEFT JOIN bs USING (last5, name) LEFT JOIN mx ON mx.src_ord = product""",
)
def p04_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels(spark, sf_dir, F.nullif(F.col("cpp"), F.lit("")).try_cast("long").alias("qty"))
    cpp = view(spark, sf_dir, "matrix").select("src_ord", ids.coerce_int("CPP").alias("cpp"))
    best = n.best_of_names(rows, matrix(spark, sf_dir), n.edit_ratio).join(cpp, "src_ord", "left")
    return n.with_best(rows, best).select("row_id", F.col("src_ord").alias("product"), F.coalesce("qty", "cpp").alias("qty"))


@register("p07_holders_by_side")
def p07_holders_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holders_by_side(spans(spark, sf_dir)).select("sheet", "side", "position", "segment", "borrowed", "begin", "end", "item", "qty")


@register("p09_match_unresolved", f"WITH {LEGACY} SELECT product, count(*) AS candidates, sum(total_score)::BIGINT AS points, sum(entry)::BIGINT AS entries FROM ranked WHERE candidate_rank <= 5 GROUP BY 1")
def p09_match_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = best_images(spark, sf_dir, rank.LEGACY, rank.ALL)
    return top.groupBy("product").agg(F.count(F.lit(1)).alias("candidates"), F.sum("total_score").cast("long").alias("points"), F.sum("entry").alias("entries"))


@register(
    "p10_catalog_images",
    rf"""WITH c AS (SELECT src_ord, {d.stem('file_path')} AS s, {d.low('detected_text')} AS n FROM {sql('catalog')}), k AS (SELECT *, regexp_extract_all(s, '[0-9]+') AS runs FROM c)
    SELECT src_ord, coalesce(list_reduce(runs, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END, ''), '') AS filename_upc, {d.brand('n', text.CATALOG_BRANDS, "''")} AS brand,
    CASE WHEN regexp_matches(n, '\b([234])\s*x\s*\$?[0-9]{{1,3}}\b') THEN regexp_extract(n, '\b([234])\s*x\s*\$?[0-9]{{1,3}}\b', 1) WHEN regexp_matches(n, '\b([234])\s*(?:pack|pk)\b') THEN regexp_extract(n, '\b([234])\s*(?:pack|pk)\b', 1) ELSE '' END AS pack FROM k""",
)
def p10_catalog_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "catalog").select("src_ord", ids.longest_digit_run("file_path").alias("filename_upc"), text.catalog_brand("detected_text").alias("brand"), text.catalog_pack("detected_text").alias("pack"))
