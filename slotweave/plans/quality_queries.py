"""Queries for checks, classes, duplicates, groups and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import ids, text
from slotweave.operators import quality as q

from . import duck as d
from .registry import register
from .views import sql, view

TYPED = f"""typed AS (SELECT * REPLACE ({d.txt('pog')} AS pog, TRY_CAST(trunc(TRY_CAST(trim(side) AS DOUBLE)) AS BIGINT) AS side, TRY_CAST(trunc(TRY_CAST(trim(row) AS DOUBLE)) AS BIGINT) AS row,
  TRY_CAST(trunc(TRY_CAST(trim(col) AS DOUBLE)) AS BIGINT) AS col) FROM {sql('placement')}),
judged AS (SELECT *, CASE WHEN pog = '' THEN 'pog' WHEN side IS NULL OR side NOT IN (1, 2, 3, 4) THEN 'side' WHEN row IS NULL OR row <= 0 THEN 'row' WHEN col IS NULL OR col <= 0 THEN 'column'
  WHEN col > CASE WHEN side IN (1, 3) THEN 8 ELSE 10 END THEN 'column_limit' END AS reject_reason FROM typed),
ok AS (SELECT * FROM judged WHERE reject_reason IS NULL)"""
FIRST = f"{TYPED}, placed AS (SELECT *, row_number() OVER (PARTITION BY pog, side, row, col ORDER BY src_ord) AS copy FROM ok)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.slot_reason(q.typed_slots(view(spark, sf_dir, "placement")))


def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).filter("reject_reason IS NULL")


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.first_per_key(valid(spark, sf_dir), q.SLOT, ["src_ord"]).filter("copy = 1")


@register("c01_slot_reasons", f"WITH {TYPED} SELECT src_ord, pog, side, row, col, reject_reason FROM judged")
def c01_slot_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("src_ord", "pog", "side", "row", "col", "reject_reason")


@register("c02_strip_rows", f"WITH {TYPED} SELECT coalesce(pog <> '' AND side > 0 AND row > 0 AND col > 0, false) AS included, count(*) AS n FROM typed GROUP BY 1")
def c02_strip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.typed_slots(view(spark, sf_dir, "placement")).groupBy(q.valid_strip_row().alias("included")).agg(F.count(F.lit(1)).alias("n"))


CLASS_SQL = f"""blank AS (SELECT *, {d.classify('intentional_blank')} IN ('TRUE', 'YES', 'Y', '1') OR {d.classify('image_status')} = 'INTENTIONAL BLANK' OR {d.classify('merchant_category')} = 'SAMS FP GFT'
  OR {d.classify('segment')} = 'SAMS FP GFT' OR {d.classify('item_number')} = 'SAMTEMP6' OR {d.classify('upc')} = 'SAMTEMP6' AS is_blank,
  {d.classify('image_status')} IN ('GCI IMAGE PENDING', 'GCI PENDING IMAGE') OR list_contains(string_split({d.classify("concat_ws(' ', merchant_category, segment, brand, desc_1, desc_2, description, item_number)")}, ' '), 'GCI') AS is_pending FROM {{0}})"""


@register("c03_c04_classes", f"WITH {CLASS_SQL.format(sql('placement'))} SELECT src_ord, is_blank, is_pending FROM blank")
def c03_c04_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "placement").select("src_ord", q.intentional_blank().alias("is_blank"), q.pending_image().alias("is_pending"))


@register(
    "c05_missing_fields",
    f"""WITH {TYPED}, m AS (SELECT src_ord, unnest(list_filter([CASE WHEN {d.txt('retail')} = '' THEN 'missing retail' END, CASE WHEN {d.txt('upc')} = '' THEN 'missing upc' END, CASE WHEN {d.txt('cpp')} = '' THEN 'missing cpp' END,
      CASE WHEN {d.filled('description', 'desc_1', 'desc_2', 'brand')} = '' THEN 'missing description' END], lambda x: x IS NOT NULL)) AS warning FROM ok) SELECT src_ord, warning FROM m""",
)
def c05_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid(spark, sf_dir).select("src_ord", F.explode(q.missing_fields(["retail", "upc", "cpp"], ["description", "desc_1", "desc_2", "brand"])).alias("warning"))


@register("c06_blank_rows", f"SELECT src_ord FROM {sql('placement')} WHERE {d.txt('retail')} <> '' OR {d.txt('cpp')} <> '' OR {d.txt('desc_2')} <> ''")
def c06_blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.drop_blank_rows(view(spark, sf_dir, "placement").select("src_ord", "retail", "cpp", "desc_2"), ["retail", "cpp", "desc_2"]).select("src_ord")


@register(
    "c07_approved_selected", f"SELECT src_ord, review_group_id FROM {sql('review')} WHERE {d.norm('approved')} IN ('TRUE', 'YES', 'Y', '1', 'APPROVED', 'SELECTED') AND {d.norm('selected')} IN ('TRUE', 'YES', 'Y', '1', 'APPROVED', 'SELECTED')"
)
def c07_approved_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "review").filter(text.truthy_review("approved") & text.truthy_review("selected")).select("src_ord", "review_group_id")


FAILED = "upper(trim(catalog_status)) IN ('ERROR', 'FAILED', 'FAIL') AND concat(filename_upc, detected_text, detected_brand, detected_denomination, detected_pack_quantity) = ''"


@register(
    "c08_catalog_classes",
    f"""SELECT CASE WHEN file_path = '' THEN 'no_path' WHEN starts_with(file_path, '/gone') THEN 'missing_file' WHEN {FAILED} THEN 'failed' ELSE 'valid' END AS by_path,
    CASE WHEN {FAILED} THEN 'failed' WHEN file_path = '' THEN 'no_path' WHEN starts_with(file_path, '/gone') THEN 'missing_file' ELSE 'valid' END AS by_status, count(*) AS n FROM {sql('catalog')} GROUP BY ALL""",
)
def c08_catalog_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ~F.startswith("file_path", F.lit("/gone"))
    return view(spark, sf_dir, "catalog").groupBy(q.catalog_class(known, False).alias("by_path"), q.catalog_class(known, True).alias("by_status")).agg(F.count(F.lit(1)).alias("n"))


SPAN = r"'^\$([0-9]{1,3})-\$([0-9]{1,3})$'"


def compatible_sql(a: str, b: str) -> str:
    within = lambda s, o: f"coalesce(TRY_CAST(regexp_extract({o}, '^\\$([0-9]{{1,3}})$', 1) AS INT) BETWEEN TRY_CAST(regexp_extract({s}, {SPAN}, 1) AS INT) AND TRY_CAST(regexp_extract({s}, {SPAN}, 2) AS INT), false)"
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR {within(a, b)} OR {within(b, a)}))"


@register(
    "c10_denomination_compatible",
    f"""WITH t AS (SELECT DISTINCT {d.denomination(d.norm('desc_1'))} AS x FROM {sql('placement')}) SELECT a.x AS a, b.x AS b, {compatible_sql('a.x', 'b.x')} AS compatible FROM t a JOIN t b ON length(a.x) = length(b.x) OR contains(a.x, '-') OR contains(b.x, '-')""",
)
def c10_denomination_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "placement").select(text.denomination("desc_1").alias("a")).distinct()
    b = t.withColumnRenamed("a", "b")
    close = (F.length("a") == F.length("b")) | F.contains("a", F.lit("-")) | F.contains("b", F.lit("-"))
    return t.join(b, close).select("a", "b", text.denomination_compatible(F.col("a"), F.col("b")).alias("compatible"))


@register(
    "c13_chosen_pog", f"WITH {TYPED} SELECT src_ord, pog FROM ok WHERE pog = (SELECT coalesce(max(CASE WHEN pog = 'POG0007' THEN pog END), min(pog)) FROM ok)"
)
def c13_chosen_pog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.choose_pog(valid(spark, sf_dir), "POG0007").select("src_ord", "pog")


@register("e01_slot_duplicates", f"WITH {FIRST} SELECT src_ord, copy::INT AS copy FROM placed WHERE copy > 1")
def e01_slot_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.first_per_key(valid(spark, sf_dir), q.SLOT, ["src_ord"]).filter("copy > 1").select("src_ord", "copy")


@register(
    "e02_product_groups",
    f"""WITH k AS (SELECT *, {d.digits('upc')} AS upc_digits, {d.digits('item_number')} AS item_digits FROM {sql('placement')}),
    g AS (SELECT upc_digits, item_digits, min(src_ord) AS first_ord, arg_min(desc_1, src_ord) AS desc_1, arg_min(description, src_ord) AS description, arg_min(brand, src_ord) AS brand, arg_min(cpp, src_ord) AS cpp, arg_min(merchant_category, src_ord) AS merchant_category,
      arg_min(segment, src_ord) AS segment, string_agg(DISTINCT pog, ' | ' ORDER BY pog) FILTER (trim(pog) <> '') AS p, string_agg(concat(pog, ':S', side, ':R', row, ':C', col), ' | ' ORDER BY src_ord, concat(pog, ':S', side, ':R', row, ':C', col)) AS positions, count(*) AS n_rows FROM k WHERE upc_digits <> '' OR item_digits <> '' GROUP BY 1, 2)
    SELECT * EXCLUDE (p), coalesce(p, '') AS pogs, 'RG' || CASE WHEN length(r) < 5 THEN lpad(r, 5, '0') ELSE r END AS group_id FROM (SELECT *, CAST(row_number() OVER (ORDER BY first_ord) AS VARCHAR) AS r FROM g) SELECT_""".replace(") SELECT_", ")").replace("SELECT * EXCLUDE (p)", "SELECT * EXCLUDE (p, r)"),
)
def e02_product_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.product_groups(view(spark, sf_dir, "placement"))


@register("e03_pogs", f"WITH {TYPED} SELECT pog, count(*) AS n FROM ok GROUP BY 1")
def e03_pogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid(spark, sf_dir).groupBy("pog").agg(F.count(F.lit(1)).alias("n")).orderBy("pog")


@register(
    "e04_structure_counts",
    f"WITH {FIRST}, r AS (SELECT pog, side, row, count(*) AS n, count(DISTINCT col) AS c FROM placed WHERE copy = 1 GROUP BY ALL) SELECT pog, side, sum(n)::BIGINT AS slots, count(*) AS rows, max(c) AS widest FROM r GROUP BY 1, 2",
)
def e04_structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.structure_counts(kept(spark, sf_dir))


@register(
    "e07_e08_strip_groups",
    rf"""WITH {TYPED}, s AS (SELECT *, nullif({d.txt('footer')}, '') AS f, nullif({d.txt('length')}, '') AS l FROM ok),
    g AS (SELECT pog, side, row, count(*)::INT AS n_cards, string_agg(col || '=' || item_number, ',' ORDER BY col, src_ord, item_number, retail) AS cards, arg_min(f, (col, src_ord)) FILTER (f IS NOT NULL) AS footer, count(DISTINCT f) AS nf,
      arg_min(l, (col, src_ord)) FILTER (l IS NOT NULL) AS l1, count(DISTINCT l) AS nl FROM s GROUP BY 1, 2, 3),
    h AS (SELECT *, TRY_CAST(regexp_extract(l1, '([0-9]+(?:\.[0-9]+)?)\s*"?\s*[xX×]\s*([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS width, TRY_CAST(regexp_extract(l1, '([0-9]+(?:\.[0-9]+)?)\s*"?\s*[xX×]\s*([0-9]+(?:\.[0-9]+)?)', 2) AS DOUBLE) AS height FROM g)
    SELECT pog, side, row, n_cards, cards, coalesce(footer, 'Side: ' || side || ', Row: ' || row || ' - POG: ' || pog) AS footer, nf > 1 AS footer_conflict, width, height,
    CASE WHEN l1 IS NULL THEN 'missing' WHEN width IS NULL THEN 'unparseable' WHEN nl > 1 THEN 'multiple' ELSE 'ok' END AS length_state FROM h""",
)
def e07_e08_strip_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.strip_groups(valid(spark, sf_dir))


GEOMETRY = [(1, 6, 5, 0), (2, 8, 4, 1), (3, 6, 5, 0), (4, 8, 4, 1)]
GEO_SQL = "geo(side, slot_count, expected_rows, header_rows) AS (VALUES " + ", ".join(map(str, GEOMETRY)) + ")"


def geometry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GEOMETRY, "side long, slot_count int, expected_rows int, header_rows int")


@register(
    "d23_densified_slots",
    f"""WITH {TYPED}, {GEO_SQL}, l AS (SELECT pog, side, row, col, arg_max(item_number, src_ord) AS item_number FROM ok GROUP BY ALL), r AS (SELECT DISTINCT pog, side, row FROM ok)
    SELECT r.pog, r.side, r.row, s.c::INT AS col, item_number, item_number IS NULL AS is_empty FROM r JOIN geo USING (side), unnest(range(1, slot_count + 1)) s(c) LEFT JOIN l ON l.pog = r.pog AND l.side = r.side AND l.row = r.row AND l.col = s.c""",
)
def d23_densified_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.densify(valid(spark, sf_dir), geometry(spark).select("side", "slot_count"))


@register(
    "e15_row_counts",
    f"""WITH {TYPED}, {GEO_SQL}, r AS (SELECT pog, side, row, count(*) AS cards, max(col) AS widest FROM ok GROUP BY ALL), k AS (SELECT r.*, slot_count, expected_rows, header_rows, row_number() OVER (PARTITION BY pog, r.side ORDER BY row) AS k FROM r JOIN geo USING (side)),
    f AS (SELECT *, k <= header_rows AND cards = 9 AS head, k <= header_rows AND cards <> 9 AND row = 1 AS odd FROM k)
    SELECT pog, side, count(*) FILTER (NOT head) AS priced_rows, max(expected_rows) AS expected_rows, bool_or(odd) AS header_warning, count(*) FILTER (NOT head AND widest > slot_count) AS overflow_rows, count(*) FILTER (NOT head) <> max(expected_rows) AS count_warning FROM f GROUP BY 1, 2""",
)
def e15_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.row_count_check(valid(spark, sf_dir), geometry(spark))


@register("g01_ordered_slots", f"WITH {FIRST} SELECT pog, side, row, col, src_ord FROM placed WHERE copy = 1")
def g01_ordered_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).select("pog", "side", "row", "col", "src_ord").orderBy("pog", "side", "row", "col")


@register("g02_first_unresolved", f"SELECT src_ord, image_status FROM {sql('placement')} WHERE image_status = 'unresolved' ORDER BY src_ord LIMIT 10")
def g02_first_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "placement").filter("image_status = 'unresolved'").select("src_ord", "image_status").orderBy("src_ord").limit(10)


@register(
    "h01_append_keep_last",
    f"""WITH a AS (SELECT {d.digits('unresolved_upc')} AS upc, item_number AS item, CASE WHEN src_ord % 4 = 0 THEN '/lib/same.png' ELSE candidate_file_path END AS path, src_ord, confidence FROM {sql('review')}) SELECT upc, item, path, max(src_ord) AS src_ord, arg_max(confidence, src_ord) AS confidence FROM a GROUP BY 1, 2, 3""",
)
def h01_append_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("src_ord") % 4 == 0, "/lib/same.png").otherwise(F.col("candidate_file_path"))
    rows = view(spark, sf_dir, "review").select(ids.digits_only("unresolved_upc").alias("upc"), F.col("item_number").alias("item"), path.alias("path"), "src_ord", "confidence")
    return rows.groupBy("upc", "item", "path").agg(F.max("src_ord").alias("src_ord"), F.max_by("confidence", "src_ord").alias("confidence"))
