"""Product-placement tables derived from the driver's tables.

Each view is a list of (column, expression) that Spark and DuckDB both read, so that a
query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BRAND = "CASE p_partkey % 7 WHEN 0 THEN 'PlayStation' WHEN 1 THEN 'Xbox' WHEN 2 THEN 'Olive Garden' WHEN 3 THEN 'Dunkin Donuts' WHEN 4 THEN p_brand WHEN 5 THEN 'BWW' ELSE 'Door Dash' END"
AMOUNT = "CAST(5 * (1 + p_partkey % 20) AS STRING)"
OFFER = (
    f"CASE p_partkey % 5 WHEN 0 THEN concat('2 X $', {AMOUNT}) WHEN 1 THEN '$10 TO $50' WHEN 2 THEN concat('$', {AMOUNT}, '.00') "
    f"WHEN 3 THEN concat('3 PACK $', {AMOUNT}) ELSE '$1000' END"
)
UPC11 = "CAST(19674000000 + 7 * p_partkey AS STRING)"

PLACEMENT = [
    ("src_ord", "((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey"),
    ("pog", "CASE WHEN l_orderkey % 97 = 0 THEN ' ' ELSE concat('POG', lpad(CAST(l_suppkey AS STRING), 4, '0')) END"),
    ("side", "CASE WHEN l_orderkey % 89 = 0 THEN '2.7' ELSE CAST(1 + l_orderkey % 5 AS STRING) END"),
    ("row", "CAST(CASE WHEN l_orderkey % 40 = 0 THEN 0 ELSE l_linenumber END AS STRING)"),
    ("col", "CASE WHEN l_partkey % 83 = 0 THEN 'x' ELSE CAST(1 + l_partkey % 11 AS STRING) END"),
    ("item_number", "CASE WHEN l_partkey % 73 = 0 THEN 'SAMTEMP6' ELSE CAST(l_partkey AS STRING) END"),
    ("upc", f"CASE l_partkey % 10 WHEN 3 THEN concat({UPC11}, '.0') WHEN 4 THEN '' ELSE {UPC11} END"),
    ("retail", "CASE WHEN l_orderkey % 13 = 0 THEN '' WHEN l_orderkey % 13 = 1 THEN 'call' ELSE concat('$', CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING), '.5') END"),
    ("cpp", "CASE WHEN l_orderkey % 17 = 0 THEN '' ELSE CAST(CAST(floor(l_quantity) AS INT) AS STRING) END"),
    ("brand", f"CASE WHEN l_orderkey % 19 = 0 THEN '' ELSE {BRAND} END"),
    ("desc_1", f"concat({BRAND}, ' ', {OFFER})"),
    ("desc_2", "CASE WHEN l_linenumber = 1 THEN '' ELSE p_name END"),
    ("description", "CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE concat(p_name, ' Gift_Card') END"),
    ("image_status", "CASE WHEN l_orderkey % 29 = 0 THEN 'intentional_blank' WHEN l_orderkey % 31 = 0 THEN 'GCI Image Pending' WHEN l_orderkey % 31 = 1 THEN 'unresolved' ELSE '' END"),
    ("intentional_blank", "CASE WHEN l_orderkey % 59 = 0 THEN 'Yes' ELSE 'no' END"),
    ("merchant_category", "CASE WHEN l_orderkey % 37 = 0 THEN 'sams_fp_gft' ELSE 'CARDS' END"),
    ("segment", "CASE WHEN l_orderkey % 41 = 0 THEN 'hold gci row' ELSE p_type END"),
    ("length", "CASE l_suppkey % 4 WHEN 0 THEN '6\" x 1.5\"' WHEN 1 THEN '30.25X3.4375' WHEN 2 THEN 'none' ELSE '' END"),
    ("footer", "CASE l_orderkey % 3 WHEN 0 THEN '' ELSE concat('F', CAST(l_suppkey % 2 + l_orderkey % 2 AS STRING)) END"),
    ("file_path", "CASE WHEN l_orderkey % 23 = 0 THEN concat('/own/', CAST(l_partkey AS STRING), '.png') ELSE '' END"),
]

#: Image files; the name's form depends on the part.
LIBRARY = [
    ("src_ord", "p_partkey"),
    (
        "path",
        f"concat('/lib/', CAST(p_partkey % 9 AS STRING), '/', CASE p_partkey % 6 WHEN 0 THEN {UPC11} WHEN 1 THEN concat('0', {UPC11}) WHEN 2 THEN concat('000', {UPC11}) "
        f"WHEN 3 THEN concat(p_name, '_UPC ', {UPC11}, ' ($25.00)') WHEN 4 THEN concat('item ', CAST(p_partkey AS STRING)) ELSE replace(p_name, ' ', '-') END, "
        "CASE p_partkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.jpg' ELSE '.jpeg' END)",
    ),
    ("size", "p_size"),
]

#: Text read from images; some rows failed, lack their file or their path.
CATALOG = [
    ("src_ord", "p_partkey"),
    ("file_path", f"CASE WHEN p_partkey % 47 = 0 THEN '' WHEN p_partkey % 43 = 0 THEN '/gone/x.png' ELSE concat('/lib/', CASE p_partkey % 4 WHEN 0 THEN {UPC11} WHEN 1 THEN CAST(p_partkey AS STRING) ELSE p_name END, '-', CAST(p_partkey AS STRING), '.png') END"),
    ("filename_upc", f"CASE p_partkey % 4 WHEN 0 THEN {UPC11} WHEN 1 THEN CAST(p_partkey AS STRING) ELSE '' END"),
    ("detected_text", f"CASE WHEN p_partkey % 53 = 0 THEN '' ELSE concat({BRAND}, ' ', p_name, ' ', {OFFER}) END"),
    ("detected_brand", f"CASE WHEN p_partkey % 8 = 1 THEN {BRAND} ELSE '' END"),
    ("detected_denomination", f"CASE WHEN p_partkey % 8 = 2 THEN concat('$', {AMOUNT}) ELSE '' END"),
    ("detected_pack_quantity", "CASE WHEN p_partkey % 8 = 3 THEN '2' ELSE '' END"),
    ("catalog_status", "CASE WHEN p_partkey % 53 = 0 THEN 'Failed' WHEN p_partkey % 59 = 0 THEN 'error' ELSE 'ok' END"),
]

#: Words on label pages: one page a user, x from value, y from the time of day.
WORDS = [
    ("page_id", "user_id"),
    ("word_id", "event_id"),
    ("text", "CASE event_type WHEN 'click' THEN lpad(CAST(event_id % 100000 AS STRING), 5, '0') WHEN 'view' THEN CAST(event_id % 40 AS STRING) WHEN 'signup' THEN 'GIFT' WHEN 'error' THEN 'HOLDERS' ELSE 'CARD' END"),
    ("event_type", "event_type"),
    ("x0", "value * 10"),
    ("top", "CAST(hour(ts) * 60 + minute(ts) AS DOUBLE)"),
    ("x1", "value * 10 + 20"),
    ("bottom", "CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) + 8"),
]

#: Review decisions over candidate files.
REVIEW = [
    ("src_ord", "doc_id"),
    ("review_group_id", "concat('RG', lpad(CAST(doc_id % 150 AS STRING), 5, '0'))"),
    ("unresolved_upc", "CAST(19674000000 + 7 * (doc_id % 150) AS STRING)"),
    ("item_number", "CAST(doc_id % 150 AS STRING)"),
    ("candidate_file_path", "concat('/lib/', CAST(doc_id AS STRING), CASE WHEN doc_id % 7 = 0 THEN '.txt' ELSE '.png' END)"),
    ("approved", "CASE quality WHEN 1 THEN 'TRUE' ELSE 'no' END"),
    ("selected", "CASE WHEN toxic = 0 AND doc_id % 2 = 0 THEN 'Selected' ELSE '' END"),
    ("confidence", "CASE WHEN doc_id % 3 = 0 THEN 'High' ELSE 'Low' END"),
    ("review_status", "CASE quality WHEN 1 THEN ' Approved' ELSE 'needs_review' END"),
]

TABLES = {"placement": "lineitem JOIN part ON l_partkey = p_partkey", "library": "part", "catalog": "part", "words": "events", "review": "labels", "matrix": "part", "holders": "orders"}
#: Product list whose five-digit keys are shared by many products.
MATRIX = [
    ("src_ord", "p_partkey"),
    ("UPC", "CAST(19674000000 + 7000 * p_partkey AS STRING)"),
    ("NAME", f"concat({BRAND}, ' ', p_name, ' ', p_type)"),
    ("CPP", "CASE WHEN p_size % 9 = 0 THEN '' ELSE concat(CAST(p_size AS STRING), '.0') END"),
]
#: A sheet of holders: a row a customer, columns in order; some columns break segments, some name a side.
HOLDERS = [
    ("sheet", "o_custkey"),
    ("col", "o_orderkey"),
    ("is_break", "o_orderpriority = '1-URGENT'"),
    ("item", "CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE CAST(o_orderkey AS STRING) END"),
    ("side", "CASE o_orderstatus WHEN 'P' THEN concat('Side ', substr('ABCD', CAST(1 + o_orderkey % 4 AS INT), 1)) ELSE '' END"),
    ("qty", "CAST(floor(o_totalprice / 10000) AS INT)"),
    ("description", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('D', CAST(o_orderkey % 11 AS STRING)) END"),
]
COLUMNS = {"placement": PLACEMENT, "library": LIBRARY, "catalog": CATALOG, "words": WORDS, "review": REVIEW, "matrix": MATRIX, "holders": HOLDERS}


#: Orders up to here have a src_ord that a BIGINT holds, with room for parts of up to nine digits; some orders later the SQL ends in an error.
LAST_ORDER = 2**63 // (8 * 10**11) - 130
#: src_ord of larger tables: the same number, in a type that holds it.
WIDE_ORDER = dict(PLACEMENT)["src_ord"].replace("l_orderkey", "CAST(l_orderkey AS DECIMAL(13, 0))")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view's rows; src_ord of placements is a BIGINT up to LAST_ORDER, as in the SQL, and a DECIMAL in tables that have larger orders."""

    def read(table: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet")

    if name != "placement":
        return read(TABLES[name]).selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS[name]])
    lines = read("lineitem")
    wide = (lines.agg(F.max("l_orderkey")).first()[0] or 0) > LAST_ORDER
    columns = dict(PLACEMENT) | ({"src_ord": f"CAST({WIDE_ORDER} AS DECIMAL(25, 0))"} if wide else {})
    return lines.join(read("part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def sql(name: str) -> str:
    """The view as a DuckDB subquery."""
    return f"(SELECT {', '.join(f'{e} AS {c}' for c, e in COLUMNS[name])} FROM {TABLES[name]}) AS {name}"
