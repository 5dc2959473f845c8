"""Queries for label rules, candidate cleaning, row selection, match reports and the catalog stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slotweave.functions import ids, text
from slotweave.operators import cards as k
from slotweave.operators import near as n
from slotweave.operators import resolve as r
from slotweave.operators.jobs import match_report
from slotweave.operators.lineage import shared_dir
from slotweave.streaming.catalog import read_catalog, run_catalog_stream

from . import duck as d
from .near_queries import LINK, LINK_BASE, SIM, all_pairs, core, cores_sql, named_targets
from .quality_queries import kept, valid
from .registry import register
from .resolve_queries import CASCADE, IDENTITY, LIBRARY, library_index, steps
from .views import sql, view

PLACED = sql("placement")
LABEL = "concat(desc_1, ' ', upc, ' ', retail, ' $10-$25 ', item_number)"
MASKED = LABEL
for rule in k.PRICES:
    MASKED = f"regexp_replace({MASKED}, '{rule}', ' ', 'g')"


def firsts(array: str) -> str:
    return f"list_filter({array}, lambda x, i: list_position({array}, x) = i)"


@register("b31_identity_tokens", rf"""WITH t AS (SELECT DISTINCT {LABEL} AS label, regexp_extract_all({MASKED}, '\b([0-9]{{5,14}})\b') AS a FROM {PLACED}) SELECT label, array_to_string({firsts('a')}, '|') AS tokens FROM t""")
def b31_identity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "placement").selectExpr(f"{LABEL} AS label").distinct()
    return t.select("label", F.array_join(k.identity_tokens("label"), "|").alias("tokens"))


@register("b31_price_tokens")
def b31_price_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "placement").selectExpr(f"{LABEL} AS label").distinct()
    return t.select("label", F.array_join(k.price_tokens("label"), "|").alias("prices"))


@register(
    "b32_label_hints",
    f"""WITH t AS (SELECT DISTINCT {LABEL} AS label, regexp_extract_all({LABEL}, '[0-9]{{4,14}}') AS a FROM {PLACED}), u AS (SELECT label, list_transform(list_filter(a, lambda x: length(x) >= 11), lambda x: lpad(right(x, 12), 12, '0')) AS b, list_transform(list_filter(a, lambda x: length(x) >= 5), lambda x: right(x, 5)) AS c FROM t)
    SELECT label, array_to_string({firsts('b')}, '|') AS upc12s, array_to_string({firsts('c')}, '|') AS last5s FROM u""",
)
def b32_label_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "placement").selectExpr(f"{LABEL} AS label").distinct().withColumn("h", k.label_hints("label"))
    return t.select("label", F.array_join("h.upc12s", "|").alias("upc12s"), F.array_join("h.last5s", "|").alias("last5s"))


NOTE = "concat(description, CASE src_ord % 11 WHEN 0 THEN ' tall box' WHEN 1 THEN ' 2PK' WHEN 2 THEN ' in new' WHEN 3 THEN ' frame sign' WHEN 4 THEN ' envelope' ELSE '' END)"
PACK_SQL = "(" + " OR ".join(f"contains(' ' || n || ' ', ' {t} ')" for t in k.PACKAGING) + ")"
HAS = lambda *ws: "(" + " OR ".join(f"list_contains(tk, '{w}')" for w in ws) + ")"
SIGN_SQL = (
    "(" + " OR ".join(f"contains(n, '{p}')" for p in k.SIGN_PHRASES) + f" OR {HAS('GCI', 'PKG', 'HEADER', 'SIGN', 'FIXTURE', 'GIFTCARD')} OR ({HAS('GIFT')} AND {HAS('CARD')} AND {HAS('NEW', 'PKG')}) OR ({HAS('WM')} AND {HAS('NEW', 'PKG')}) OR ({HAS('TALL', 'LID')} AND {HAS('BOX', 'HARDWARE', 'GCI')}))"
)
NOTES = f"t AS (SELECT *, {NOTE} AS note FROM {PLACED}), u AS (SELECT *, {d.name('note')} AS n FROM t), v AS (SELECT *, string_split(n, ' ') AS tk FROM u)"


@register("b33_packaging_signage", f"WITH {NOTES} SELECT DISTINCT note, {PACK_SQL} AS packaging, {SIGN_SQL} AS signage FROM v")
def b33_packaging_signage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "placement").selectExpr(f"{NOTE} AS note").distinct().select("note", k.packaging("note").alias("packaging"), k.signage("note").alias("signage"))


@register(
    "c11_c12_rejections",
    f"""WITH {NOTES} SELECT src_ord, CASE WHEN TRY_CAST(cpp AS INT) % 7 = 0 THEN 'cpp_zero' WHEN {PACK_SQL} THEN 'packaging_text' END AS match_reason, CASE WHEN {SIGN_SQL} THEN 'signage' WHEN trim(upc) = '' THEN 'unresolved' WHEN trim(description) = '' THEN 'missing_description' END AS reason FROM v""",
)
def c11_c12_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "placement").withColumn("note", F.expr(NOTE))
    return rows.select("src_ord", k.match_rejection("note", F.col("cpp").try_cast("int") % 7).alias("match_reason"), k.candidate_rejection("note", F.col("upc"), ids.last5("upc"), F.col("description")).alias("reason"))


BOX_COLUMNS = ["event_id % 71 AS w", "CASE WHEN event_id % 97 = 0 THEN NULL ELSE event_id % 67 END AS h", "event_id % 101 - 50 AS dx", "event_id % 89 - 44 AS dy", "user_id % 4 IN (1, 3) AS strict"]


@register(
    "c14_box_problems",
    f"""WITH b AS (SELECT user_id AS page_id, event_id AS word_id, {', '.join(BOX_COLUMNS)} FROM events), k AS (SELECT *, CASE WHEN h > 0 THEN w / h ELSE 99 END AS aspect, w * h / 480.0 AS area FROM b)
    SELECT page_id, word_id, CASE WHEN h IS NULL THEN 'missing_mapped_bbox' ELSE concat_ws(',', CASE WHEN w < 16 OR h < 16 THEN 'tiny_bbox' END, CASE WHEN aspect > 3.6 OR aspect < 0.28 THEN 'strip_aspect' END, CASE WHEN strict AND sqrt(dx * dx + dy * dy) > 44 THEN 'off_expected_slot_geometry' END,
      CASE WHEN strict AND w > 24 * 1.95 THEN 'too_wide_for_single_card' END, CASE WHEN strict AND h > 20 * 1.95 THEN 'too_tall_for_single_card' END, CASE WHEN strict AND w < 24 * 0.55 THEN 'too_narrow_for_single_card' END, CASE WHEN strict AND h < 20 * 0.55 THEN 'too_short_for_single_card' END,
      CASE WHEN strict AND area > 2.8 THEN 'likely_multi_card_group' END, CASE WHEN strict AND area < 0.35 THEN 'likely_partial_strip' END, CASE WHEN NOT strict AND area > 4.5 THEN 'oversized_area' END, CASE WHEN NOT strict AND area < 0.22 THEN 'undersized_area' END) END AS problems FROM k""",
)
def c14_box_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS page_id", "event_id AS word_id", *BOX_COLUMNS)
    problems = k.box_problems(*[F.col(c) for c in ("w", "h", "dx", "dy")], F.lit(24.0), F.lit(20.0), F.col("strict"))
    return boxes.select("page_id", "word_id", F.array_join(problems, ",").alias("problems"))


SLIDE = 1440.0


@register("d16_claimed_items")
def d16_claimed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = view(spark, sf_dir, "words").select("page_id", "word_id", "event_type", ((F.col("x0") + F.col("x1")) / 2).alias("x"), "top", "bottom")
    items = w.filter("event_type = 'view'").select("page_id", F.col("word_id").alias("item"), "x", "bottom")
    return k.claim_nearest_above(items, w.filter("event_type = 'click'").select("page_id", F.col("word_id").alias("card"), "x", "top"), SLIDE)


PATCH = "(SELECT lpad(CAST((13 * p_partkey) % 100000 AS STRING), 5, '0') AS last5, min(p_partkey) AS id, min(string_split(upper(p_name), ' ')[1]) AS w1, min(string_split(upper(p_name), ' ')[2]) AS w2 FROM part GROUP BY 1)"


@register(
    "d20_patched_rows",
    f"""WITH l AS (SELECT src_ord, CASE WHEN {d.digits('item_number')} = '' THEN '' ELSE {d.pad(f"right({d.digits('item_number')}, 5)", 5)} END AS last5, {d.name('description')} AS norm_name FROM {PLACED})
    SELECT src_ord, l.last5, CASE WHEN contains(norm_name, w1) AND contains(norm_name, w2) THEN concat('patch', id) END AS patch_name FROM l LEFT JOIN {PATCH} p USING (last5)""",
)
def d20_patched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.upper("p_name"), " ")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.lpad(((13 * F.col("p_partkey")) % 100000).cast("string"), 5, "0").alias("last5"), "p_partkey", words[0].alias("w1"), words[1].alias("w2"))
    patches = part.groupBy("last5").agg(F.min("p_partkey").alias("id"), F.min("w1").alias("w1"), F.min("w2").alias("w2"))
    patches = patches.select("last5", F.lit("").alias("upc12"), F.concat(F.lit("patch"), "id").alias("patch_name"), F.lit(30).alias("patch_qty"), F.array("w1", "w2").alias("words"))
    rows = view(spark, sf_dir, "placement").select("src_ord", ids.last5("item_number").alias("last5"), text.norm_name("description").alias("norm_name"))
    return r.patch_missing(rows, patches).select("src_ord", "last5", "patch_name")


@register("d22_still_unresolved", f"WITH {CASCADE} SELECT DISTINCT upc, item_number FROM ok WHERE (upc, item_number) NOT IN (SELECT (upc, item_number) FROM ok JOIN resolved USING (src_ord) WHERE path IS NOT NULL)")
def d22_still_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(spark, sf_dir)
    found = r.cascade(rows, "src_ord", IDENTITY, steps(spark, sf_dir)).filter("path IS NOT NULL").select("src_ord")
    solved = rows.join(found, "src_ord", "left_semi").select("upc", "item_number").distinct()
    return rows.select("upc", "item_number").distinct().join(solved, ["upc", "item_number"], "left_anti")


ASSETS = ["s_nationkey AS sheet", "s_suppkey AS asset", "s_suppkey % 23 - 1 AS row", "s_suppkey * 7 % 1500 AS col", "s_suppkey * 31 % 173 AS width", "s_suppkey * 17 % 90 AS height"]
SPANS_OF_COLUMNS = ["c_nationkey AS sheet", "c_custkey AS begin", "c_custkey + c_custkey % 5 AS stop", "c_custkey % 9 AS want_row"]


@register(
    "d26_best_assets",
    f"""WITH s AS (SELECT {', '.join(SPANS_OF_COLUMNS)}, (begin + stop) // 2 AS middle FROM customer), a AS (SELECT {', '.join(ASSETS)} FROM supplier),
    p AS (SELECT s.*, asset, a.row AS r, width * height AS area, col BETWEEN begin AND stop AS inside, CASE WHEN col BETWEEN begin AND stop THEN col - begin ELSE abs(col - middle) END AS far FROM s JOIN a ON s.sheet = a.sheet AND (col BETWEEN begin AND stop OR abs(col - middle) <= 2)),
    k AS (SELECT *, row_number() OVER (PARTITION BY sheet, begin, stop ORDER BY NOT inside, NOT (r BETWEEN 2 AND 12), area < 2500, far, CASE WHEN area > 0 THEN area ELSE 1000000000 END, CASE WHEN r >= 0 THEN abs(r - want_row) ELSE 1000000000 END, asset) AS k FROM p)
    SELECT sheet, begin AS "begin", stop AS "end", asset, inside AS in_span, r BETWEEN 2 AND 12 AS in_band FROM k WHERE k = 1""",
)
def d26_best_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier"))
    spans = c.selectExpr(*SPANS_OF_COLUMNS).withColumnRenamed("stop", "end").withColumns({"band_top": F.lit(2), "band_bottom": F.lit(12)})
    return k.best_asset(spans, s.selectExpr(*ASSETS))


CELLS = f"cl AS (SELECT page_id, CAST(floor(top / 300) AS INT) AS row, (x0 + x1) / 2 AS x, word_id AS cell FROM {sql('words')})"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "words").select("page_id", F.floor(F.col("top") / 300).cast("int").alias("row"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), F.col("word_id").alias("cell"))


@register(
    "f07_selected_rows",
    f"""WITH {CELLS}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id, row ORDER BY x, cell) AS k FROM cl), ov AS (SELECT page_id, cell, row_number() OVER (PARTITION BY page_id ORDER BY row, x, cell) AS n FROM k WHERE row >= 3 OR k > 8), g AS (SELECT page_id, r AS row, s AS k FROM (SELECT DISTINCT page_id FROM cl), range(3) a(r), range(1, 9) b(s)),
    fr AS (SELECT g.*, row_number() OVER (PARTITION BY g.page_id ORDER BY g.row, g.k) AS n FROM g LEFT JOIN k ON k.page_id = g.page_id AND k.row = g.row AND k.k = g.k WHERE k.cell IS NULL)
    SELECT page_id, row::INT AS row, k::INT AS slot, cell FROM k WHERE row < 3 AND k <= 8 UNION ALL SELECT page_id, row::INT, k::INT, cell FROM ov JOIN fr USING (page_id, n)""",
)
def f07_selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.select_rows(cells(spark, sf_dir))


@register("f07_display_selection")
def f07_display_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = view(spark, sf_dir, "words").select("page_id", F.col("word_id").alias("cell"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("top") + F.col("bottom")) / 2).alias("y"))
    return k.display_selection(w)


@register("f09_merged_rows")
def f09_merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.merge_short_rows(cells(spark, sf_dir))


#: Rows of 60; of every other row only the middle cells stay.
ZONED = "zc AS (SELECT page_id, CAST(floor(top / 60) AS INT) AS row, (x0 + x1) / 2 AS x, word_id AS cell FROM {words} WHERE CAST(floor(top / 60) AS INT) % 2 = 0 OR (x0 + x1) / 2 BETWEEN 220.5 AND 379.5 OR event_type = 'error')"


@register(
    "f13_structured_rows",
    f"""WITH {ZONED.format(words=sql('words'))}, r AS (SELECT page_id, row, list(cell ORDER BY x, cell) AS c, min(x) AS lo, max(x) AS hi FROM zc GROUP BY 1, 2 HAVING count(*) >= 4),
    k AS (SELECT *, CASE WHEN lo > 220 AND hi < 380 THEN 'center' WHEN lo < 220 AND hi > 380 THEN 'side' END AS kind FROM r), i AS (SELECT *, row_number() OVER (PARTITION BY page_id, kind ORDER BY row) AS place FROM k WHERE kind IS NOT NULL),
    b AS (SELECT s.page_id, s.place - 1 AS row_index, list_concat(list_concat(s.c[1:2], m.c[1:4]), s.c[-2:]) AS slots FROM i s JOIN i m ON s.page_id = m.page_id AND s.place = m.place AND s.kind = 'side' AND m.kind = 'center' WHERE s.place <= 3)
    SELECT page_id, row_index::INT AS row_index, j::INT AS slot_in_row, CASE WHEN j <= 1 THEN 'left' WHEN j <= 5 THEN 'center' ELSE 'right' END AS block, slots[j + 1] AS cell FROM b, range(8) t(j)""",
)
def f13_structured_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row, x = F.floor(F.col("top") / 60).cast("int"), (F.col("x0") + F.col("x1")) / 2
    there = view(spark, sf_dir, "words").filter((row % 2 == 0) | x.between(220.5, 379.5) | (F.col("event_type") == "error"))
    return k.structured_rows(there.select("page_id", row.alias("row"), x.alias("x"), F.col("word_id").alias("cell")))


SIDE_OF = "substr('ABCD', CAST(1 + page_id % 4 AS INT), 1)"


@register(
    "e13_fullest_slide",
    f"""WITH s AS (SELECT {SIDE_OF} AS side, page_id AS slide, least(8, count(*) FILTER (top < {SLIDE} * 0.42 AND event_type = 'click')) AS n_top, least(6, count(*) FILTER (top >= {SLIDE} * 0.42 AND event_type = 'signup')) AS n_side FROM {sql('words')} GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n_top + n_side DESC, slide) AS k FROM s) SELECT side, slide, n_top, n_side, n_top = 8 AND n_side = 6 AS complete FROM k WHERE k = 1""",
)
def e13_fullest_slide(spark: SparkSession, sf_dir: str) -> DataFrame:
    above = F.col("top") < SLIDE * 0.42
    cards = view(spark, sf_dir, "words").groupBy(F.expr(SIDE_OF).alias("side"), F.col("page_id").alias("slide"))
    return k.fullest_slide(cards.agg(F.count_if(above & (F.col("event_type") == "click")).alias("n_top"), F.count_if(~above & (F.col("event_type") == "signup")).alias("n_side")))


@register(
    "e14_group_capacity",
    f"""WITH c AS (SELECT page_id, {SIDE_OF} AS side, CASE WHEN (x0 + x1) / 2 < 220 THEN 'left' WHEN (x0 + x1) / 2 < 380 THEN 'center' WHEN (x0 + x1) / 2 < 1500 THEN 'right' ELSE 'unknown' END AS block FROM {sql('words')}), n AS (SELECT page_id, side, block, count(*) AS n FROM c GROUP BY ALL),
    e AS (SELECT page_id, side, block, most FROM (SELECT DISTINCT page_id, side FROM c), (VALUES ('left', 6), ('center', 12), ('right', 6)) p(block, most))
    SELECT page_id, side, block, coalesce(n, 0) AS n, most, greatest(0, coalesce(n - most, 0)) AS over, greatest(0, coalesce(most - coalesce(n, 0), 0)) AS short FROM e FULL JOIN n USING (page_id, side, block)""",
)
def e14_group_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = (F.col("x0") + F.col("x1")) / 2
    block = F.when(x < 220, "left").when(x < 380, "center").when(x < 1500, "right").otherwise("unknown")
    profile = spark.createDataFrame([(s, g, n) for s in "ABCD" for g, n in (("left", 6), ("center", 12), ("right", 6))], "side string, block string, most int")
    return k.group_capacity(view(spark, sf_dir, "words").select("page_id", F.expr(SIDE_OF).alias("side"), block.alias("block")), profile)


REPORT = rf"""{LIBRARY}, {LINK_BASE}, {LINK}, ids AS (SELECT DISTINCT upc FROM pn), lk AS (SELECT DISTINCT upc FROM ids JOIN (SELECT DISTINCT key FROM lib) ON key IN (upc, upc || {d.check('upc')}, right(upc, 5))), nm AS (SELECT target AS upc FROM tp WHERE k = 1 AND score >= 0.78 AND (score >= 0.86 OR margin >= 0.08)),
nu AS (SELECT DISTINCT upc FROM ids JOIN (SELECT DISTINCT ltrim(image, '0') AS b FROM li) ON length(b) >= 10 AND b[1:9] = upc[1:9] AND ((b[1:10] = upc[1:10] AND abs((CASE WHEN length(b) = 12 THEN b[1:11] ELSE b END)::BIGINT - upc::BIGINT) <= 250) OR abs((CASE WHEN length(b) = 12 THEN b[1:11] ELSE b END)::BIGINT - upc::BIGINT) <= 100))"""


@register(
    "e16_p06_match_report",
    f"WITH {REPORT} SELECT upc, CASE WHEN upc IN (SELECT upc FROM lk) THEN 'FOUND' WHEN upc IN (SELECT upc FROM nm) THEN 'FOUND_NEAR' WHEN upc IN (SELECT upc FROM nu) THEN 'REVIEW_NUMERIC_NEAR' ELSE 'MISSING' END AS status FROM ids",
)
def e16_p06_match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, files = named_targets(spark, sf_dir)
    return match_report(placed, files, library_index(spark, sf_dir), n.edit_ratio).orderBy("status", "upc")


@register("h02_merged_indexes", f"WITH {LIBRARY} SELECT key, CASE WHEN length(key) % 2 = 0 THEN '/new/' || key ELSE path END AS path FROM lib")
def h02_merged_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = library_index(spark, sf_dir).select("key", "path", F.lit(1).alias("ord"))
    later = first.filter(F.length("key") % 2 == 0).select("key", F.concat(F.lit("/new/"), "key").alias("path"), F.lit(2).alias("ord"))
    return first.unionByName(later).groupBy("key").agg(F.max_by("path", "ord").alias("path"))


def missing_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Named identifiers that stand in no file name, the named files, and numeric neighbours of those identifiers."""
    placed, files = named_targets(spark, sf_dir)
    missing = placed.join(files.select(F.col("image").alias("target")).distinct(), "target", "left_anti")
    return missing, files, n.numeric_near(missing.select("target").distinct(), files.select("image").distinct())


SUGGESTED = f"""{LINK_BASE}, ms AS (SELECT upc AS target, name FROM pn WHERE upc NOT IN (SELECT image FROM li)), kn AS (SELECT DISTINCT known AS norm_name FROM li WHERE known <> ''), nz AS (SELECT DISTINCT name FROM ms WHERE name <> ''), {all_pairs('nz', 'kn')},
al AS (SELECT name, norm_name, CASE WHEN contains(name, norm_name) OR contains(norm_name, name) THEN greatest({SIM.format('name', 'norm_name')}, 0.88) ELSE {SIM.format('name', 'norm_name')} END AS score FROM pr),
cd AS (SELECT DISTINCT target, image, norm_name, score FROM ms JOIN al USING (name) JOIN li ON known = norm_name WHERE score >= 0.72), {cores_sql('a', "(SELECT DISTINCT target FROM cd)", 'target')}, {cores_sql('b', "(SELECT DISTINCT image FROM cd)", 'image')},
rl AS (SELECT target, image, min(CASE WHEN a.v = b.v THEN 1 WHEN abs(length(a.v) - length(b.v)) <= 1 AND levenshtein(a.v, b.v) <= 1 THEN 2 WHEN contains(a.v, b.v) OR contains(b.v, a.v) THEN 3 WHEN length(a.v) >= 11 AND length(b.v) >= 11 AND a.v[2:10] = b.v[2:10] THEN 4 END) AS rule FROM (SELECT DISTINCT target, image FROM cd) JOIN a USING (target) JOIN b USING (image) GROUP BY 1, 2),
cf AS (SELECT target, image, norm_name, CASE WHEN rule IS NULL THEN score ELSE greatest(score, 0.86) END AS confidence, CASE rule WHEN 1 THEN '{n.REASONS[0]}' WHEN 2 THEN '{n.REASONS[1]}' WHEN 3 THEN '{n.REASONS[2]}' WHEN 4 THEN '{n.REASONS[3]}' ELSE 'similar name' END AS reason FROM cd LEFT JOIN rl USING (target, image) WHERE target IN (SELECT target FROM a) AND image IN (SELECT image FROM b)),
tk AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY confidence DESC, norm_name, image) AS k FROM (SELECT * FROM cf UNION ALL SELECT target, image, norm_name, score, 'similar name' FROM cd WHERE target NOT IN (SELECT target FROM a) OR image NOT IN (SELECT image FROM b))),
nt AS (SELECT target, {core('target')} AS a FROM (SELECT DISTINCT target FROM ms)), ni AS (SELECT image, {core('image')} AS b FROM (SELECT DISTINCT image FROM li)),
np AS (SELECT target, image, CASE WHEN length(a) >= 11 AND length(b) >= 11 AND a[1:11] = b[1:11] THEN 11 WHEN a[1:10] = b[1:10] THEN 10 ELSE 9 END AS prefix, abs(a::BIGINT - b::BIGINT) AS distance FROM nt JOIN ni ON length(a) >= 10 AND length(b) >= 10 AND a[1:9] = b[1:9]),
nn AS (SELECT target, image, row_number() OVER (PARTITION BY target ORDER BY prefix DESC, distance, image) AS k FROM np WHERE (prefix >= 10 AND distance <= 250) OR distance <= 100)"""


@register("j06_suggestions", f"WITH {SUGGESTED}, g AS (SELECT target, image, norm_name, confidence, reason, row_number() OVER (PARTITION BY target, image ORDER BY confidence DESC, norm_name, reason) AS q FROM (SELECT target, image, norm_name, confidence, reason FROM tk WHERE k <= 5 UNION ALL SELECT target, image, '', 0.5, 'numeric neighbour' FROM nn WHERE k = 1)) SELECT target AS current, image AS suggested, norm_name AS image_name, round(confidence, 4) AS confidence, reason FROM g WHERE q = 1")
def j06_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing, files, numeric = missing_names(spark, sf_dir)
    return n.suggested_aliases(missing, files, numeric, n.edit_ratio)


@register("j06_suggestions_by_blocks")
def j06_suggestions_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.suggested_aliases(*missing_names(spark, sf_dir))


@register("a11_unresolved_list", f"SELECT {d.digits('upc')} AS upc_digits, {d.digits('item_number')} AS item_digits, min(src_ord) AS src_ord FROM {PLACED} WHERE {d.classify('image_status')} <> 'INTENTIONAL BLANK' AND (trim(image_status) = '' OR contains(lower(image_status), 'unresolved')) AND ({d.digits('upc')} <> '' OR {d.digits('item_number')} <> '') GROUP BY 1, 2")
def a11_unresolved_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slotweave.sources.ingest import load_unresolved

    rows = view(spark, sf_dir, "placement").select("src_ord", "upc", "item_number", "image_status")
    return load_unresolved(rows, text.classify_text("image_status") == "INTENTIONAL BLANK", "image_status").select("upc_digits", "item_digits", "src_ord")


@register("a08_incremental_catalog", "SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'process' ELSE 'reuse' END AS action FROM documents")
def a08_incremental_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slotweave.sources.ingest import split_unchanged

    now = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.lit(1).alias("mtime"))
    changed = F.when(F.col("path") % 3 == 0, F.col("size") + 1).otherwise(F.col("size"))
    before = now.filter(F.col("path") % 7 != 0).select("path", changed.alias("size"), "mtime", F.when(F.col("path") % 5 == 0, "error").otherwise("ok").alias("status"))
    reuse, process = split_unchanged(now, before)
    return reuse.select("path", F.lit("reuse").alias("action")).unionByName(process.select("path", F.lit("process").alias("action")))


@register("k01_catalog_stream", "SELECT user_id AS path, arg_max(value, event_id) AS size, max(event_id) AS version FROM events GROUP BY 1")
def k01_catalog_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as catalog rows, streamed in three batches that update one another, with a repeat and an idle restart; the table as the stream left it."""
    work = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("path"), F.col("value").alias("size"), F.col("event_id").alias("version"))
    third = lambda k: rows.filter(F.col("version") % 3 == k)
    for batch in (third(1), third(2), third(0).unionByName(third(1)), None):
        if batch is not None:
            batch.write.mode("append").parquet(f"{work}/in")
        run_catalog_stream(spark, f"{work}/in", "path long, size double, version long", f"{work}/out", f"{work}/state")
    return read_catalog(spark, f"{work}/out").select("path", "size", "version")


@register("p01_build_summary", f"WITH {CASCADE}, b AS (SELECT src_ord, pog, side, row_number() OVER (PARTITION BY pog, side, row, col ORDER BY src_ord) AS copy, {d.classify('image_status')} = 'INTENTIONAL BLANK' AS is_blank FROM ok) SELECT pog, count(*) AS slots, count(*) FILTER (is_blank) AS blanks, count(*) FILTER (NOT is_blank AND source <> 'unresolved') AS resolved, count(*) FILTER (NOT is_blank AND source = 'unresolved') AS unresolved FROM b JOIN resolved USING (src_ord) WHERE copy = 1 GROUP BY 1")
def p01_build_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spark, sf_dir).withColumn("is_blank", text.classify_text("image_status") == "INTENTIONAL BLANK")
    found = r.cascade(rows, "src_ord", IDENTITY, steps(spark, sf_dir))
    open_ = F.col("source") == "unresolved"
    return rows.select("src_ord", "pog", "is_blank").join(found, "src_ord").groupBy("pog").agg(
        F.count(F.lit(1)).alias("slots"), F.count_if("is_blank").alias("blanks"), F.count_if(~F.col("is_blank") & ~open_).alias("resolved"), F.count_if(~F.col("is_blank") & open_).alias("unresolved")
    )

