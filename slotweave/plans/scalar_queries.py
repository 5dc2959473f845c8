"""Queries for the scalar columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import ids, text

from . import duck as d
from .registry import register
from .views import sql, view

PLACED = sql("placement")
LIB = sql("library")


def joined_array(c) -> F.Column:
    return F.array_join(c, "|")


@register(
    "b01_headers",
    rf"""SELECT DISTINCT description AS header, regexp_replace(regexp_replace(lower({d.txt('description')}), '[_-]', ' ', 'g'), ' +', '', 'g') AS compact,
    coalesce(nullif(regexp_replace(regexp_replace(upper({d.txt('description')}), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'COL') AS canonical FROM {PLACED}""",
)
def b01_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "placement").select(F.col("description").alias("header")).distinct()
    return p.select("header", text.compact_header("header").alias("compact"), text.norm_header("header").alias("canonical"))


@register(
    "b05_b06_normal_forms",
    f"""SELECT src_ord, {d.name('desc_1')} AS norm_name, {d.norm('desc_1')} AS norm_text, {d.low('desc_1')} AS low_text, {d.classify('description')} AS class_text FROM {PLACED}""",
)
def b05_b06_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "placement").select(
        "src_ord", text.norm_name("desc_1").alias("norm_name"), text.normalize_text("desc_1").alias("norm_text"), text.normalize_lower("desc_1").alias("low_text"), text.classify_text("description").alias("class_text")
    )


@register(
    "b07_b14_identifiers",
    rf"""SELECT src_ord, CASE WHEN {d.digits('upc')} <> '' THEN {d.pad(d.digits('upc'), 12)} END AS upc12, TRY_CAST(regexp_replace(regexp_replace({d.txt('retail')}, '\.0$', ''), '[^0-9-]', '', 'g') AS BIGINT) AS retail_int,
    TRY_CAST(trunc(TRY_CAST(side AS DOUBLE)) AS BIGINT) AS side_int, CASE WHEN {d.digits('item_number')} = '' THEN '' ELSE {d.pad(f"right({d.digits('item_number')}, 5)", 5)} END AS last5,
    {d.digits('upc')} AS digits, CASE WHEN {d.digits('item_number')} = '' THEN '' ELSE {d.pad(d.digits('item_number'), 6)} END AS item6, {d.check(d.digits('upc'))} AS check_digit, {d.upc12(d.digits('upc'))} AS calculated,
    {d.classify('intentional_blank')} IN ('TRUE', 'YES', 'Y', '1') AS truthy, {d.norm('intentional_blank')} IN ('TRUE', 'YES', 'Y', '1', 'APPROVED', 'SELECTED') AS truthy_review FROM {PLACED}""",
)
def b07_b14_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "placement").select(
        "src_ord", ids.coerce_upc12("upc").alias("upc12"), ids.coerce_int("retail").alias("retail_int"), ids.as_int("side").alias("side_int"), ids.last5("item_number").alias("last5"),
        ids.digits_only("upc").alias("digits"), ids.item_number6("item_number").alias("item6"), ids.check_digit(ids.digits_only("upc")).alias("check_digit"), ids.calculated_upc12("upc").alias("calculated"),
        text.truthy("intentional_blank").alias("truthy"), text.truthy_review("intentional_blank").alias("truthy_review"),
    )


@register(
    "b15_identifier_keys",
    f"""WITH p AS (SELECT DISTINCT upc, {d.digits('upc')} AS g FROM {PLACED}), k AS (SELECT upc, {d.raw_keys('g')} AS raw FROM p)
    SELECT upc, array_to_string({d.keep_first('raw')}, '|') AS keys FROM k""",
)
def b15_identifier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "placement").select("upc").distinct().select("upc", joined_array(ids.identifier_keys("upc")).alias("keys"))


VARIANT_RAW = (
    f"[g, {d.bare('g')}, CASE WHEN length(g) IN (11, 12) THEN {d.pad('g', 12)} ELSE '' END, CASE WHEN length(g) IN (11, 12) THEN right(g, 11) ELSE '' END, CASE WHEN length(g) > 12 THEN right(g, 12) ELSE '' END, "
    f"CASE WHEN length({d.bare('g')}) = 11 THEN {d.bare('g')} || {d.check(d.bare('g'))} ELSE '' END, CASE WHEN length(g) = 11 THEN g || {d.check('g')} ELSE '' END]"
)


@register(
    "b16_digit_variants",
    f"""WITH p AS (SELECT DISTINCT upc, regexp_replace({d.txt('upc')}, '[^0-9]', '', 'g') AS g FROM {PLACED}), k AS (SELECT upc, {VARIANT_RAW} AS raw FROM p)
    SELECT upc, array_to_string({d.keep_first('raw')}, '|') AS variants FROM k""",
)
def b16_digit_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "placement").select("upc").distinct().select("upc", joined_array(ids.digit_variants("upc")).alias("variants"))


@register(
    "b17_comparison_keys",
    f"""WITH p AS (SELECT DISTINCT upc, col, {d.digits('upc')} AS g, {d.digits('col')} AS c FROM {PLACED}),
    q AS (SELECT upc, col, g, {d.upc12('g')} AS u, CASE WHEN length(g) = 11 AND length(c) = 1 THEN g || c ELSE '' END AS j FROM p),
    k AS (SELECT upc, col, list_concat(list_concat({d.raw_keys('g')}, {d.raw_keys('u')}), {d.raw_keys('j')}) AS raw FROM q) SELECT upc, col, array_to_string({d.keep_first('raw')}, '|') AS keys FROM k""",
)
def b17_comparison_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "placement").select("upc", "col").distinct()
    return p.select("upc", "col", joined_array(ids.comparison_keys("upc", ids.calculated_upc12("upc"), "col")).alias("keys"))


FILE_RAW = f"list_concat([lower(string_split(path, '/')[-1]), lower(s)], list_concat({d.raw_keys('g')}, flatten(list_transform(runs, lambda r: {d.raw_keys('r')}))))"


@register(
    "b18_b20_filenames",
    rf"""WITH f AS (SELECT path, {d.stem('path')} AS s FROM {LIB}), g AS (SELECT *, {d.digits('s')} AS g, regexp_extract_all(s, '[0-9]+') AS runs FROM f), k AS (SELECT *, {FILE_RAW} AS raw FROM g)
    SELECT path, array_to_string({d.keep_first('raw')}, '|') AS keys, coalesce(list_reduce(runs, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END, ''), '') AS longest,
    upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[_\-]+', ' ', 'g'), '(?i)\bUPC\b', ' ', 'g'), '[0-9]{{5,14}}', ' ', 'g'), '\([^)]*\)', ' ', 'g'),
      '\$?[0-9]+(?:\.[0-9]{{2}})?', ' ', 'g'), '[^A-Za-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))) AS name_key FROM k""",
)
def b18_b20_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "library").select(
        "path", joined_array(ids.filename_keys("path")).alias("keys"), ids.longest_digit_run("path").alias("longest"), text.name_from_filename(ids.stem("path")).alias("name_key")
    )


INSIDE = " ".join("WHEN " + " OR ".join(f"contains(n, '{x}')" for x in [b, *names]) + f" THEN '{b}'" for b, names in text.CATALOG_BRANDS)


@register(
    "b21_brands",
    f"""WITH t AS (SELECT DISTINCT desc_1, {d.norm('desc_1')} AS u, {d.low('desc_1')} AS n FROM {PLACED}), c AS (SELECT *, {d.brand('n', text.CATALOG_BRANDS, "''")} AS catalog FROM t)
    SELECT desc_1, {d.brand('u', text.BRANDS, d.first_word('u'))} AS brand, {d.brand('u', text.OCR_BRANDS, d.first_word('u'))} AS ocr, catalog, CASE WHEN catalog <> '' THEN catalog {INSIDE} ELSE {d.first_word('n')} END AS legacy FROM c""",
)
def b21_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "placement").select("desc_1").distinct()
    return p.select("desc_1", text.brand("desc_1").alias("brand"), text.ocr_brand("desc_1").alias("ocr"), text.catalog_brand("desc_1").alias("catalog"), text.legacy_brand("desc_1").alias("legacy"))


CATALOG_ONE = "|".join(map(str, text.CATALOG_AMOUNTS))


@register(
    "b22_b23_denominations_packs",
    rf"""WITH t AS (SELECT DISTINCT desc_1, {d.norm('desc_1')} AS u, {d.low('desc_1')} AS n FROM {PLACED})
    SELECT desc_1, {d.denomination('u')} AS denomination, CASE WHEN regexp_matches(n, '\$([0-9]{{1,3}})\s*\$?\s*(?:to|-)\s*\$?([0-9]{{1,3}})') THEN '$' || regexp_extract(n, '\$([0-9]{{1,3}})\s*\$?\s*(?:to|-)\s*\$?([0-9]{{1,3}})', 1)
      || '-$' || regexp_extract(n, '\$([0-9]{{1,3}})\s*\$?\s*(?:to|-)\s*\$?([0-9]{{1,3}})', 2) WHEN regexp_matches(n, '\b([234])\s*x\s*\$?([0-9]{{1,3}})\b') THEN regexp_extract(n, '\b([234])\s*x\s*\$?([0-9]{{1,3}})\b', 1) || ' x $' ||
      regexp_extract(n, '\b([234])\s*x\s*\$?([0-9]{{1,3}})\b', 2) WHEN regexp_matches(n, '\$({CATALOG_ONE})\b') THEN '$' || regexp_extract(n, '\$({CATALOG_ONE})\b', 1) ELSE '' END AS catalog_denomination,
    {d.pack('u', 'desc_1')} AS pack, {d.ocr_pack('u')} AS ocr_pack, CASE WHEN length({d.digits('desc_1')}) = 1 THEN {d.digits('desc_1')} ELSE {d.ocr_pack('u')} END AS pack_field,
    CASE WHEN regexp_matches(n, '\b([234])\s*x\s*\$?[0-9]{{1,3}}\b') THEN regexp_extract(n, '\b([234])\s*x\s*\$?[0-9]{{1,3}}\b', 1) WHEN regexp_matches(n, '\b([234])\s*(?:pack|pk)\b') THEN regexp_extract(n, '\b([234])\s*(?:pack|pk)\b', 1) ELSE '' END AS catalog_pack FROM t""",
)
def b22_b23_denominations_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "placement").select("desc_1").distinct()
    return p.select(
        "desc_1", text.denomination("desc_1").alias("denomination"), text.catalog_denomination("desc_1").alias("catalog_denomination"), text.pack("desc_1").alias("pack"),
        text.ocr_pack("desc_1").alias("ocr_pack"), text.pack_field("desc_1").alias("pack_field"), text.catalog_pack("desc_1").alias("catalog_pack"),
    )


LEGACY_STOP = ", ".join(f"'{x}'" for x in text.LEGACY_STOP)


@register(
    "b24_b25_tokens",
    f"""WITH t AS (SELECT src_ord, {d.filled('description', 'desc_1', 'brand', 'merchant_category', 'segment')} AS product_text FROM {PLACED}), u AS (SELECT *, {d.norm('product_text')} AS n, string_split({d.low('product_text')}, ' ') AS l FROM t)
    SELECT src_ord, product_text, array_to_string({d.tokens('n')}, '|') AS tokens, array_to_string(list_filter(l, lambda x, i: length(x) >= 4 AND x NOT IN ({LEGACY_STOP}) AND NOT regexp_matches(x, '^[0-9]+$') AND list_position(l, x) = i), '|') AS keywords FROM u""",
)
def b24_b25_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "placement").select("src_ord", text.joined("description", "desc_1", "brand", "merchant_category", "segment").alias("product_text"))
    return p.select("src_ord", "product_text", joined_array(text.useful_tokens("product_text")).alias("tokens"), joined_array(text.legacy_tokens("product_text")).alias("keywords"))



@register(
    "b26_b28_display_formats",
    rf"""WITH t AS (SELECT src_ord, {d.txt('retail')} AS r, {d.txt('cpp')} AS c, length AS len, side, row, pog, footer, description, desc_1, desc_2, brand FROM {PLACED}), u AS (SELECT *, TRY_CAST(trim(translate(r, '$,', '')) AS DOUBLE) AS a, TRY_CAST(replace(c, ',', '') AS DOUBLE) AS q,
      TRY_CAST(regexp_extract(len, '([0-9]+(?:\.[0-9]+)?)\s*"?\s*[xX×]\s*([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS w, TRY_CAST(regexp_extract(len, '([0-9]+(?:\.[0-9]+)?)\s*"?\s*[xX×]\s*([0-9]+(?:\.[0-9]+)?)', 2) AS DOUBLE) AS h FROM t)
    SELECT src_ord, CASE WHEN r = '' THEN '-' WHEN a IS NOT NULL THEN printf('$%.2f', a) WHEN starts_with(r, '$') THEN r ELSE '$' || r END AS retail_text, 'CPP ' || CASE WHEN c = '' THEN '-' WHEN q IS NULL THEN c WHEN q = floor(q) THEN CAST(CAST(q AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.2f', q), '0'), '.') END AS cpp_text,
    CASE WHEN r = '' THEN '-' WHEN a IS NOT NULL THEN CAST(CAST(trunc(a) AS BIGINT) AS VARCHAR) ELSE coalesce(nullif(trim(translate(r, '$,', '')), ''), '-') END AS dollars, CASE WHEN a IS NULL OR r = '' THEN '00' ELSE lpad(CAST(abs(round((a - trunc(a)) * 100))::INT AS VARCHAR), 2, '0') END AS cents,
    CASE WHEN w > 0 AND h > 0 THEN w END AS width, CASE WHEN w > 0 AND h > 0 THEN h END AS height, coalesce(nullif({d.txt('description')}, ''), nullif({d.filled('desc_1', 'desc_2', 'brand')}, ''), 'No description') AS shown,
    CASE WHEN lower({d.txt('footer')}) IN ('', 'nan', 'none', 'null') THEN 'Side: ' || side || ', Row: ' || row || ' - POG: ' || pog ELSE {d.txt('footer')} END AS footer_text FROM u""",
)
def b26_b28_display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, size = text.price_parts("retail", F.col("amount")), F.col("size")
    default = F.concat(F.lit("Side: "), "side", F.lit(", Row: "), "row", F.lit(" - POG: "), "pog")
    rows = view(spark, sf_dir, "placement").withColumns({"amount": text.price_amount("retail"), "size": text.strip_length("length")})  # columns of their own: worked out once a row
    return rows.select(
        "src_ord", text.retail_format("retail").alias("retail_text"), text.cpp_format("cpp").alias("cpp_text"), price["dollars"].alias("dollars"), price["cents"].alias("cents"), size["width"].alias("width"), size["height"].alias("height"),
        F.coalesce(F.nullif(ids.text("description"), F.lit("")), F.nullif(text.joined("desc_1", "desc_2", "brand"), F.lit("")), F.lit("No description")).alias("shown"),
        F.when(F.lower(ids.text("footer")).isin("", "nan", "none", "null"), default).otherwise(ids.text("footer")).alias("footer_text"),
    )




@register(
    "b29_b30_labels",
    rf"""WITH t AS (SELECT src_ord, concat(desc_2, chr(10), desc_1, chr(10), CASE WHEN TRY_CAST(col AS INT) % 3 = 0 THEN concat('WM', chr(10), 'GIFT', chr(10), 'CARD', chr(10)) WHEN TRY_CAST(col AS INT) % 3 = 1 THEN concat('Gift', chr(10), 'Card', chr(10)) ELSE '' END, lpad(regexp_replace(item_number, '[^0-9]', '', 'g'), 5, '0'), chr(10), row) AS label FROM {PLACED}),
    u AS (SELECT src_ord, list_filter(list_transform(string_split(replace(chr(10) || label || chr(10), chr(10) || 'WM' || chr(10) || 'GIFT' || chr(10) || 'CARD' || chr(10), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM t),
    v AS (SELECT *, regexp_extract(array_to_string(ls, ' '), '\b([0-9]{{5}})\b', 1) AS last5, CAST(regexp_extract_all(array_to_string(ls, ' '), '\b([0-9]{{1,3}})\b')[-1] AS INT) AS qty FROM u)
    SELECT src_ord, trim(array_to_string(list_filter(ls, lambda x: NOT (last5 <> '' AND contains(x, last5)) AND NOT coalesce(x = CAST(qty AS VARCHAR), false)), ' ')) AS name, last5, qty FROM v""",
)
def b29_b30_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    third = ids.as_int("col") % 3
    part = F.when(third == 0, "WM\nGIFT\nCARD\n").when(third == 1, "Gift\nCard\n").otherwise("")
    label = F.concat("desc_2", F.lit("\n"), "desc_1", F.lit("\n"), part, F.lpad(F.regexp_replace("item_number", "[^0-9]", ""), 5, "0"), F.lit("\n"), "row")
    return text.parse_labels(view(spark, sf_dir, "placement").select("src_ord", label.alias("label")), "label").select("src_ord", "name", "last5", "qty")


STOP = ", ".join(f"'{x}'" for x in text.NAME_STOP)
IMPORTANT = r"((contains(upper(x), '$') AND regexp_matches(x, '[0-9]')) OR regexp_matches(x, '^[0-9]{1,3}$') OR (regexp_matches(x, '[0-9]') AND regexp_matches(upper(x), 'PK|CT|OZ|LB|MG|ML')) OR regexp_matches(upper(x), '^[A-Z][0-9]{1,3}$'))"


@register(
    "b34_b37_names_sides",
    rf"""WITH t AS (SELECT DISTINCT desc_1, side FROM {PLACED}), u AS (SELECT *, list_filter(string_split(regexp_replace({d.txt('desc_1')}, '\s+', ' ', 'g'), ' '), lambda x: x <> '') AS a FROM t), v AS (SELECT *, list_filter(a, lambda x: upper(x) NOT IN ({STOP})) AS core FROM u),
    w AS (SELECT *, CASE WHEN len(core) > 0 THEN core ELSE a END AS used FROM v), m AS (SELECT *, list_filter(a, lambda x: {IMPORTANT} AND NOT list_contains(used, x)) AS more FROM w)
    SELECT desc_1, side, array_to_string(list_concat(used, list_filter(more, lambda x, i: list_position(more, x) = i)), ' ') AS compact, len(list_filter(a, lambda x: {IMPORTANT}))::INT AS n_important,
    CASE WHEN regexp_matches(side, '^[1-4]$') THEN substr('ABCD', CAST(side AS INT), 1) ELSE '' END AS letter FROM m""",
)
def b34_b37_names_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = view(spark, sf_dir, "placement").select("desc_1", "side").distinct()
    letter = F.when(F.col("side").rlike("^[1-4]$"), F.concat(F.lit("side "), F.translate("side", "1234", "abcd"))).otherwise("none")
    return p.select(
        "desc_1", "side", text.compact_name("desc_1").alias("compact"), F.size(F.filter(F.split("desc_1", " "), text.important_token)).alias("n_important"), text.side_letter(letter).alias("letter")
    )


@register("b38_first_filled", f"""SELECT src_ord, coalesce(nullif({d.txt('description')}, ''), nullif({d.txt('desc_2')}, ''), nullif({d.txt('brand')}, ''), '') AS shown FROM {PLACED}""")
def b38_first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "placement").select("src_ord", text.first_filled("description", "desc_2", "brand").alias("shown"))
