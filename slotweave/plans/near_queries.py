"""Queries for near identifiers, similar names and review merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotweave.functions import ids, text
from slotweave.operators import near as n
from slotweave.operators import review as rv
from slotweave.operators.cards import PACKAGING, PRICES

from . import duck as d
from .registry import register
from .views import sql, view

TARGETS = f"(SELECT DISTINCT CAST(TRY_CAST({d.digits('upc')} AS BIGINT) + 3 AS VARCHAR) AS target FROM {sql('placement')} WHERE {d.digits('upc')} <> '')"
IMAGE_IDS = rf"(SELECT DISTINCT unnest(regexp_extract_all({d.stem('path')}, '[0-9]{{5,14}}')) AS image FROM {sql('library')})"


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    upc = ids.digits_only("upc")
    return view(spark, sf_dir, "placement").filter(upc != "").select((upc.cast("long") + 3).cast("string").alias("target")).distinct()


def image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "library").select(F.explode(F.regexp_extract_all(ids.stem("path"), F.lit("([0-9]{5,14})"), 1)).alias("image")).distinct()


def core(c: str) -> str:
    bare = d.bare(c)
    cut = f"CASE WHEN length({bare}) > 12 THEN right({bare}, 12) ELSE {bare} END"
    return f"CASE WHEN length({cut}) = 12 THEN ({cut})[1:11] ELSE {cut} END"


@register(
    "d10_numeric_near",
    f"""WITH t AS (SELECT target, {core('target')} AS a FROM {TARGETS}), i AS (SELECT image, {core('image')} AS b FROM {IMAGE_IDS}),
    p AS (SELECT target, image, CASE WHEN length(a) >= 11 AND length(b) >= 11 AND a[1:11] = b[1:11] THEN 11 WHEN a[1:10] = b[1:10] THEN 10 ELSE 9 END AS prefix, abs(a::BIGINT - b::BIGINT) AS distance FROM t JOIN i ON length(a) >= 10 AND length(b) >= 10 AND a[1:9] = b[1:9]),
    r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY prefix DESC, distance, image) AS k FROM p WHERE (prefix >= 10 AND distance <= 250) OR distance <= 100) SELECT target, image, prefix, distance FROM r WHERE k = 1""",
)
def d10_numeric_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.numeric_near(targets(spark, sf_dir), image_ids(spark, sf_dir))


def variant_array(c: str) -> str:
    return (
        f"[{c}, {d.bare(c)}, CASE WHEN length({c}) IN (11, 12) THEN {d.pad(c, 12)} ELSE '' END, CASE WHEN length({c}) IN (11, 12) THEN right({c}, 11) ELSE '' END, CASE WHEN length({c}) > 12 THEN right({c}, 12) ELSE '' END, "
        f"CASE WHEN length({d.bare(c)}) = 11 THEN {d.bare(c)} || {d.check(d.bare(c))} ELSE '' END, CASE WHEN length({c}) = 11 THEN {c} || {d.check(c)} ELSE '' END]"
    )


def cores_sql(name: str, table: str, c: str) -> str:
    return f"""{name} AS (SELECT DISTINCT {c}, v FROM (SELECT {c}, CASE WHEN length(ltrim(x, '0')) = 12 THEN ltrim(x, '0')[1:11] ELSE ltrim(x, '0') END AS v FROM (SELECT {c}, unnest({variant_array(c)}) AS x FROM {table}) WHERE length(x) >= 10) WHERE length(v) >= 10)"""


@register(
    "d11_near_reasons",
    f"""WITH {cores_sql('a', TARGETS, 'target')}, {cores_sql('b', IMAGE_IDS, 'image')},
    m AS (SELECT target, image, CASE WHEN a.v = b.v THEN 1 WHEN abs(length(a.v) - length(b.v)) <= 1 AND levenshtein(a.v, b.v) <= 1 THEN 2 WHEN contains(a.v, b.v) OR contains(b.v, a.v) THEN 3 WHEN length(a.v) >= 11 AND length(b.v) >= 11 AND a.v[2:10] = b.v[2:10] THEN 4 END AS rule FROM a, b)
    SELECT target, image, min(rule)::INT AS rule FROM m WHERE rule IS NOT NULL GROUP BY 1, 2""",
)
def d11_near_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.near_reasons(targets(spark, sf_dir), image_ids(spark, sf_dir))


SIM = "round(1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}), 1)::DOUBLE, 6)"
MATRIX = f"mx AS (SELECT src_ord, right({d.pad(d.digits('UPC'), 12)}, 5) AS last5, {d.name('NAME')} AS norm_name FROM {sql('matrix')})"
LABELS = f"lb AS (SELECT src_ord AS row_id, lpad(CAST((7000 * TRY_CAST(nullif({d.digits('item_number')}, '') AS BIGINT)) % 100000 AS VARCHAR), 5, '0') AS last5, {d.name('desc_1')} AS name FROM {sql('placement')})"


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "matrix").select("src_ord", F.right(ids.coerce_upc12("UPC"), F.lit(5)).alias("last5"), text.norm_name("NAME").alias("norm_name"))


def labels(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    five = F.lpad(((F.nullif(ids.digits_only("item_number"), F.lit("")).cast("long") * 7000) % 100000).cast("string"), 5, "0")
    return view(spark, sf_dir, "placement").select(F.col("src_ord").alias("row_id"), five.alias("last5"), text.norm_name("desc_1").alias("name"), *more)


@register("a05_product_matrix", f"SELECT src_ord, {d.pad(d.digits('UPC'), 12)} AS upc12, right({d.pad(d.digits('UPC'), 12)}, 5) AS last5, {d.name('NAME')} AS norm_name, TRY_CAST(regexp_replace({d.txt('CPP')}, '\\.0$', '') AS BIGINT) AS cpp FROM {sql('matrix')}")
def a05_product_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slotweave.sources.ingest import load_matrix

    return load_matrix(view(spark, sf_dir, "matrix"), "UPC", "NAME", "CPP").select("src_ord", "upc12", "last5", "norm_name", "cpp")


@register("a06_product_matrix11", f"SELECT src_ord, {d.pad(d.digits('UPC'), 12)} AS upc12, right({d.digits('UPC')}, 5) AS last5, {d.name('NAME')} AS norm_name, TRY_CAST(regexp_replace({d.txt('CPP')}, '\\.0$', '') AS BIGINT) AS cpp FROM {sql('matrix')}")
def a06_product_matrix11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slotweave.sources.ingest import load_matrix11

    return load_matrix11(view(spark, sf_dir, "matrix"), "UPC", "NAME", "CPP").select("src_ord", "upc12", "last5", "norm_name", "cpp")


@register(
    "d01_last5_best",
    f"""WITH {MATRIX}, {LABELS}, s AS (SELECT last5, name, src_ord, {SIM.format('name', 'norm_name')} AS score FROM (SELECT DISTINCT last5, name FROM lb) JOIN mx USING (last5)), b AS (SELECT last5, name, max((score, -src_ord)) AS b FROM s GROUP BY 1, 2)
    SELECT row_id, -b[2] AS src_ord, b[1] AS score FROM lb LEFT JOIN b USING (last5, name)""",
)
def d01_last5_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.best_of_key(labels(spark, sf_dir), matrix(spark, sf_dir), n.edit_ratio)


@register("l01_last5_best_by_blocks")
def l01_last5_best_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.best_of_key(labels(spark, sf_dir), matrix(spark, sf_dir), n.name_ratio)


def all_pairs(wanted: str, known: str, least: float | None = None) -> str:
    """Table pr: all pairs of names in tables of (name) and (norm_name), but those whose lengths rule out `least`."""
    bound = "" if least is None else f" WHERE 2 * least(length(name), length(norm_name)) >= {least} * (length(name) + length(norm_name))"
    return f"pr AS (SELECT name, norm_name FROM (SELECT DISTINCT name FROM {wanted} WHERE name <> ''), (SELECT DISTINCT norm_name FROM {known} WHERE norm_name <> ''){bound})"


NAMES = f"""{MATRIX}, nm AS (SELECT DISTINCT {d.name('desc_1')} AS name FROM {sql('placement')}), {all_pairs('nm', 'mx')}, sc AS (SELECT name, norm_name, CASE WHEN contains(name, norm_name) OR contains(norm_name, name) THEN greatest({SIM.format('name', 'norm_name')}, 0.88) ELSE {SIM.format('name', 'norm_name')} END AS score FROM pr),
sn AS (SELECT name, last5 AS id, max(score) AS score FROM sc JOIN mx USING (norm_name) WHERE score >= 0.5 GROUP BY 1, 2),
tp AS (SELECT *, row_number() OVER w AS k, round(score - coalesce(lead(score) OVER w, 0), 6) AS margin FROM sn WINDOW w AS (PARTITION BY name ORDER BY score DESC, id))"""


@register("d17_f02_name_fallback", f"WITH {NAMES} SELECT name, id, score, margin FROM tp WHERE k = 1 AND score >= 0.55 AND margin >= 0.0")
def d17_f02_name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = view(spark, sf_dir, "placement").select(text.norm_name("desc_1").alias("name")).distinct()
    known = matrix(spark, sf_dir).select(F.col("last5").alias("id"), F.col("norm_name").alias("known_name"))
    return n.clear_winner(n.similar_names(wanted, n.first_ids(known, 2), n.edit_ratio, 0.5, 0.88), 0.55, 0.0)


CLEAN = "desc_1"
for rule in PRICES:
    CLEAN = f"regexp_replace({CLEAN}, '{rule}', ' ', 'g')"
PACKED = "(" + " OR ".join(f"contains(' ' || {{0}} || ' ', ' {t} ')" for t in PACKAGING) + ")"
FALLBACK = rf"""mx AS (SELECT src_ord AS product, {d.name('NAME')} AS norm_name, TRY_CAST(regexp_replace({d.txt('CPP')}, '\.0$', '') AS BIGINT) AS cpp FROM {sql('matrix')}), ok AS (SELECT * FROM mx WHERE cpp > 0 AND NOT {PACKED.format('norm_name')}),
lb AS (SELECT * FROM (SELECT src_ord AS row_id, {d.name(CLEAN)} AS name FROM {sql('placement')} WHERE NOT {PACKED.format(d.name('desc_1'))}) WHERE name <> ''), {all_pairs('lb', 'ok', 0.3)},
sn AS (SELECT name, product, {SIM.format('name', 'norm_name')} AS score FROM pr JOIN ok USING (norm_name)), tp AS (SELECT name, product, score, lead(score) OVER w AS next, row_number() OVER w AS k FROM sn WHERE score >= 0.3 WINDOW w AS (PARTITION BY name ORDER BY score DESC, product))"""


def fallback_names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = view(spark, sf_dir, "placement").select(F.col("src_ord").alias("row_id"), F.col("desc_1").alias("raw_text"), F.col("desc_1").alias("name"))
    return rows, view(spark, sf_dir, "matrix").select(F.col("src_ord").alias("product"), F.col("NAME").alias("name"), text.norm_name("NAME").alias("norm_name"), ids.coerce_int("CPP").alias("cpp"))


@register("d17_rejections_by_edits", f"WITH {FALLBACK} SELECT row_id, product, score, next FROM lb JOIN tp USING (name) WHERE k = 1 AND (next IS NULL OR next < score - 0.001)")
def d17_rejections_by_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.name_fallback(*fallback_names(spark, sf_dir), n.edit_ratio, 0.3, 0.001)


READ = "detected_text"
for rule in PRICES:
    READ = f"regexp_replace({READ}, '{rule}', ' ', 'g')"
READ_FALLBACK = rf"""mx AS (SELECT src_ord AS product, {d.name('NAME')} AS norm_name, TRY_CAST(regexp_replace({d.txt('CPP')}, '\.0$', '') AS BIGINT) AS cpp FROM {sql('matrix')}), ok AS (SELECT * FROM mx WHERE cpp > 0 AND NOT {PACKED.format('norm_name')}),
lb AS (SELECT * FROM (SELECT src_ord AS row_id, {d.name(READ)} AS name FROM {sql('catalog')} WHERE NOT {PACKED.format(d.name('detected_text'))}) WHERE name <> ''), {all_pairs('lb', 'ok', 0.72)},
sn AS (SELECT name, product, {SIM.format('name', 'norm_name')} AS score FROM pr JOIN ok USING (norm_name)), tp AS (SELECT name, product, score, lead(score) OVER w AS next, row_number() OVER w AS k FROM sn WHERE score >= 0.72 WINDOW w AS (PARTITION BY name ORDER BY score DESC, product))"""


@register("d17_name_fallback_by_edits", f"WITH {READ_FALLBACK} SELECT row_id, product, score, next FROM lb JOIN tp USING (name) WHERE k = 1 AND (next IS NULL OR next < score - 0.04)")
def d17_name_fallback_by_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's own limits with the edit ratio, over the texts read from images."""
    rows = view(spark, sf_dir, "catalog").select(F.col("src_ord").alias("row_id"), F.col("detected_text").alias("raw_text"), F.col("detected_text").alias("name"))
    return n.name_fallback(rows, fallback_names(spark, sf_dir)[1], n.edit_ratio)


@register("d17_name_fallback")
def d17_name_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read from images as labels: they share brand and name with a product, not the rest, so the rule's own limits part links, rivals and strangers."""
    rows = view(spark, sf_dir, "catalog").select(F.col("src_ord").alias("row_id"), F.col("detected_text").alias("raw_text"), F.col("detected_text").alias("name"))
    return n.name_fallback(rows, fallback_names(spark, sf_dir)[1])


LINK = f"""{cores_sql('a', "(SELECT DISTINCT upc AS target FROM pn)", 'target')}, {cores_sql('b', "(SELECT DISTINCT image FROM li)", 'image')},
nr AS (SELECT DISTINCT target, image FROM a, b WHERE a.v = b.v OR (abs(length(a.v) - length(b.v)) <= 1 AND levenshtein(a.v, b.v) <= 1) OR contains(a.v, b.v) OR contains(b.v, a.v) OR (length(a.v) >= 11 AND length(b.v) >= 11 AND a.v[2:10] = b.v[2:10])),
sc AS (SELECT DISTINCT upc AS target, li.image, CASE WHEN contains(name, known) OR contains(known, name) THEN greatest({SIM.format('name', 'known')}, 0.88) ELSE {SIM.format('name', 'known')} END AS score FROM nr JOIN pn ON pn.upc = target JOIN li ON li.image = nr.image WHERE known <> '' AND name <> ''),
pi AS (SELECT target, image, max(score) AS score FROM sc WHERE score >= 0.5 GROUP BY 1, 2), tp AS (SELECT *, row_number() OVER w AS k, round(score - coalesce(lead(score) OVER w, 0), 6) AS margin FROM pi WINDOW w AS (PARTITION BY target ORDER BY score DESC, image))"""
NAME_OF = rf"upper(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({d.stem('path')}, '[_\-]+', ' ', 'g'), '(?i)\bUPC\b', ' ', 'g'), '[0-9]{{5,14}}', ' ', 'g'), '\([^)]*\)', ' ', 'g'), '\$?[0-9]+(?:\.[0-9]{{2}})?', ' ', 'g'), '[^A-Za-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')))"
LINK_BASE = rf"""pn AS (SELECT DISTINCT {d.digits('upc')} AS upc, {d.name('description')} AS name FROM {sql('placement')} WHERE {d.digits('upc')} <> ''), li AS (SELECT DISTINCT unnest(regexp_extract_all({d.stem('path')}, '[0-9]{{5,14}}')) AS image, {NAME_OF} AS known FROM {sql('library')})"""


def named_targets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    placed = view(spark, sf_dir, "placement").select(ids.digits_only("upc").alias("target"), text.norm_name("description").alias("name")).filter("target <> ''").distinct()
    return placed, view(spark, sf_dir, "library").select(F.explode(F.regexp_extract_all(ids.stem("path"), F.lit("([0-9]{5,14})"), 1)).alias("image"), text.name_from_filename(ids.stem("path")).alias("known_name")).distinct()


@register("d19_name_near_link", f"WITH {LINK_BASE}, {LINK} SELECT target AS name, image AS id, score, margin FROM tp WHERE k = 1 AND score >= 0.78 AND (score >= 0.86 OR margin >= 0.08)")
def d19_name_near_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.linked_by_name_and_id(*named_targets(spark, sf_dir), n.edit_ratio)


@register("d19_name_near_link_by_blocks")
def d19_name_near_link_by_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.linked_by_name_and_id(*named_targets(spark, sf_dir), n.name_ratio)


ALIASES = f"al AS (SELECT DISTINCT unnest([k, ltrim(k, '0')]) AS key, a AS alias_upc FROM (SELECT unresolved_upc AS k, min('9' || item_number) AS a FROM {sql('review')} WHERE lower(trim(approved)) IN ('approved', 'approve', 'yes', 'y', 'use', '1', 'true') GROUP BY 1))"


@register(
    "a12_d21_aliases",
    f"WITH {ALIASES}, p AS (SELECT DISTINCT {d.digits('upc')} AS upc FROM {sql('placement')}) SELECT upc, coalesce(x.alias_upc, y.alias_upc) AS alias_upc FROM p LEFT JOIN al x ON x.key = upc LEFT JOIN al y ON y.key = ltrim(upc, '0')",
)
def a12_d21_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from slotweave.operators.resolve import translate_aliases
    from slotweave.sources.ingest import load_aliases

    table = view(spark, sf_dir, "review").select(F.col("unresolved_upc").alias("current_upc"), F.concat(F.lit("9"), "item_number").alias("image_upc"), F.col("approved").alias("status"))
    rows = view(spark, sf_dir, "placement").select(ids.digits_only("upc").alias("upc")).distinct()
    return translate_aliases(rows, "upc", load_aliases(table, "current_upc", "image_upc", "status"))


YES = "('TRUE', 'YES', 'Y', '1', 'APPROVED', 'SELECTED')"
CHOSEN = f"""c AS (SELECT *, {d.digits('unresolved_upc')} AS upc, {d.digits('item_number')} AS item FROM {sql('review')} WHERE {d.norm('approved')} IN {YES} AND {d.norm('selected')} IN {YES}),
s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY review_group_id) > 1 THEN 'duplicate' WHEN NOT ends_with(candidate_file_path, '.png') THEN 'bad_path' ELSE 'valid' END AS state FROM c),
ex AS (SELECT DISTINCT {d.digits('unresolved_upc')} AS upc, {d.digits('item_number')} AS item, '/old/' || item_number AS path, '2024' AS created FROM {sql('review')} WHERE length(item_number) < 3)"""


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rv.keyed(view(spark, sf_dir, "review"), "unresolved_upc", "item_number")
    return rv.single_approvals(rows, F.endswith("candidate_file_path", F.lit(".png")))


def existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "review").filter(F.length("item_number") < 3).withColumns({"path": F.concat(F.lit("/old/"), "item_number"), "created": F.lit("2024")})
    return rv.keyed(rows, "unresolved_upc", "item_number").select("upc", "item", "path", "created").distinct()


@register("j01_e17_approval_states", f"WITH {CHOSEN} SELECT state, count(*) AS n FROM s GROUP BY 1")
def j01_e17_approval_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@register(
    "j01_j03_merged_mapping",
    f"""WITH {CHOSEN}, ch AS (SELECT upc, item, candidate_file_path AS new_path FROM s WHERE state = 'valid') SELECT coalesce(ch.upc, ex.upc) AS upc, coalesce(ch.item, ex.item) AS item, coalesce(new_path, path) AS path, coalesce(created, '2025') AS created, CASE WHEN new_path IS NULL THEN created ELSE '2025' END AS updated,
    CASE WHEN new_path IS NULL THEN 'kept' WHEN path IS NULL THEN 'added' ELSE 'updated' END AS action FROM ex FULL JOIN ch ON ch.upc = ex.upc AND ch.item = ex.item""",
)
def j01_j03_merged_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = chosen(spark, sf_dir).filter("state = 'valid'").select("upc", "item", F.col("candidate_file_path").alias("path"), F.lit("2025").alias("at"))
    return rv.upsert(existing(spark, sf_dir), changes)


@register("j02_inserted_mappings", f"WITH {CHOSEN}, a AS (SELECT *, {d.digits('unresolved_upc')} AS u, {d.digits('item_number')} AS i FROM {sql('review')} WHERE lower(trim(review_status)) = 'approved') SELECT u AS upc, i AS item, min(src_ord) AS src_ord FROM a WHERE (u, i) NOT IN (SELECT (upc, item) FROM ex) GROUP BY 1, 2")
def j02_inserted_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rv.keyed(view(spark, sf_dir, "review").filter(F.lower(F.trim("review_status")) == "approved"), "unresolved_upc", "item_number")
    return rv.insert_new(existing(spark, sf_dir), rows).select("upc", "item", "src_ord")


@register("j04_deleted_mappings", f"WITH {CHOSEN} SELECT upc, item, path FROM ex WHERE NOT (upc = '19674000049')")
def j04_deleted_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.delete(existing(spark, sf_dir), "19674000049").select("upc", "item", "path")


SUGGEST = f"""g AS (SELECT review_group_id AS current, unresolved_upc || CAST(src_ord % 3 AS VARCHAR) AS suggested, round(0.8 + (src_ord % 19) / 100.0, 4)::DOUBLE AS confidence, src_ord AS ord, CASE src_ord % 5 WHEN 0 THEN 'numeric' WHEN 1 THEN 'near' ELSE '' END AS reason FROM {sql('review')}),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY current, suggested ORDER BY confidence DESC, ord) AS q FROM g) WHERE q = 1)"""


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("src_ord") % 5 == 0, "numeric").when(F.col("src_ord") % 5 == 1, "near").otherwise("")
    return rv.distinct_suggestions(
        view(spark, sf_dir, "review").select(
            F.col("review_group_id").alias("current"), F.concat("unresolved_upc", (F.col("src_ord") % 3).cast("string")).alias("suggested"), F.round(F.lit(0.8) + F.col("src_ord") % 19 / 100, 4).alias("confidence"), F.col("src_ord").alias("ord"), reason.alias("reason")
        )
    )


@register("h04_suggestions", f"WITH {SUGGEST} SELECT current, suggested, confidence, ord, reason FROM u")
def h04_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggestions(spark, sf_dir)


@register(
    "j05_suggestion_status",
    f"""WITH {SUGGEST}, k AS (SELECT *, row_number() OVER (PARTITION BY current ORDER BY confidence DESC, suggested) AS k, count(*) OVER (PARTITION BY current) AS n, max(confidence) OVER (PARTITION BY current) AS top FROM u), l AS (SELECT *, round(top - coalesce(max(CASE WHEN k = 2 THEN confidence END) OVER (PARTITION BY current), 0), 6) AS ld FROM k)
    SELECT current, suggested, confidence, ord, reason, CASE WHEN reason = 'numeric' THEN 'review' WHEN k = 1 AND reason = 'near' AND confidence >= 0.88 AND (n = 1 OR ld >= 0.04) THEN 'approved' WHEN k = 1 AND confidence >= 0.92 AND (n = 1 OR ld >= 0.025) THEN 'approved' WHEN confidence >= 0.84 THEN 'review' ELSE 'ignore' END AS status FROM l""",
)
def j05_suggestion_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rv.suggestion_status(suggestions(spark, sf_dir))
