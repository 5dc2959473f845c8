"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compress_quality, decontaminate, html_text, langid, license_scan, mixing, mpeg_audio, pii, simhash, spelling, substring_dedup, token_alignment, url_filter
from .common import read_table

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = mpeg_audio.audio_features(mpeg_audio.store_texts(read_table(spark, sf_dir, "documents")))
    seek = F.sha2(F.array_join(F.col("frame_offsets").cast("array<string>"), ","), 256)
    feature = F.concat_ws(
        " ", F.lit("mpeg1-layer3"), F.concat("sample_rate", F.lit("Hz")), F.concat(F.lit("samples="), "n_samples"), F.concat(F.lit("frames="), "n_frames"),
        F.concat(F.lit("vbr="), "vbr_frames"), F.concat(F.lit("crc="), "crc_ok", F.lit("/"), F.col("crc_ok") + F.col("crc_bad")), F.concat(F.lit("seek="), seek),
    )
    return f.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"),
        (F.col("played_samples") * 1000 / F.col("sample_rate")).alias("duration_ms"), "n_frames",
    )


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    templates = spark.createDataFrame(license_scan.TEMPLATES, "template_id string, text string")
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents"), templates)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(read_table(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("n_near_items", "near_items")


def near_benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_items", "n_near_items", "near_items")


def benchmark_match_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokenizers(read_table(spark, sf_dir, "documents"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress_quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_url_filters": op3_url_filters,
    "op4_mpeg_audio": op4_mpeg_audio,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_license_scan": op6_license_scan,
    "op7_pii": op7_pii,
    "op8_html_text": op8_html_text,
    "op9_source_mixing": op9_source_mixing,
    "op10_decontamination": op10_decontamination,
    "near_benchmark_items": near_benchmark_items,
    "benchmark_match_places": benchmark_match_places,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_quality_classifier": op13_quality_classifier,
}

ORACLES = {
    "op3_url_filters": r"""
WITH rules(h, p, verdict) AS (VALUES ('com','/en/','block'),('example.com','/en/7','allow'),('net','/de/','allow'),('example.net','/de/8','block'),('org','/es/','block')),
u AS (SELECT page_id, row_number() OVER () AS k,
  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT k, h || p AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC) AS r
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE r = 1) USING (k)
""",
    "op9_source_mixing": r"""
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT source, (SELECT sum(n) FROM s) / (SELECT count(*) FROM s)::DOUBLE / n AS rate FROM s),
r2 AS (SELECT source, greatest(1, ceil(rate / 8.0)::INT) AS parts, rate / greatest(1, ceil(rate / 8.0)::INT) AS mean FROM r),
c AS (SELECT source, parts, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM r2, range(0, 48) t(k)),
d AS (SELECT *, row_number() OVER () AS key FROM documents),
u AS (SELECT key, d.source, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || j), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM d JOIN r2 ON d.source IS NOT DISTINCT FROM r2.source, range(1, 100000) t(j) WHERE j <= parts),
n AS (SELECT key, count(*) AS n FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source AND c.cdf <= u.u GROUP BY 1)
SELECT doc_id, text, lang, d.source, n_chars, copy_no::INT AS copy_no, md5('order42:' || coalesce(doc_id::VARCHAR, '') || ':' || copy_no) AS mix_key
FROM d JOIN n USING (key), unnest(range(1, n + 1)) t(copy_no)
""",
    "op10_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g FROM b, unnest(range(1, greatest(2, len(w) - 8))) t(i) WHERE len(w) > 0),
dw AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) + 1)) t(i) WHERE i + n - 1 <= len(w)),
m AS (SELECT k, i, n, item_id FROM dw JOIN bw USING (n, g)),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) t(p) GROUP BY 1),
s AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT k, item_id::VARCHAR AS item_id FROM m) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN s USING (k)
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE
crc0(k, v, step) AS (SELECT k, k, 0 FROM range(0, 256) t(k) UNION ALL SELECT k, xor(v >> 1, (v & 1) * 3988292384), step + 1 FROM crc0 WHERE step < 8),
tab AS (SELECT k, v FROM crc0 WHERE step = 8),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS run FROM documents),
r AS (SELECT row_number() OVER () AS key, *, hex(encode(id || ':' || run)) AS hx FROM (SELECT id, run, count(*) AS c FROM d GROUP BY id, run)),
far(d, k, v) AS (SELECT 1, k, v FROM tab UNION ALL SELECT d + 1, f.k, xor(f.v >> 8, t.v) FROM far f JOIN tab t ON t.k = (f.v & 255) WHERE d < (SELECT max(length(hx)) // 2 FROM r)),
start(d, v) AS (SELECT 0, 4294967295 UNION ALL SELECT d + 1, xor(s.v >> 8, t.v) FROM start s JOIN tab t ON t.k = (s.v & 255) WHERE d < (SELECT max(length(hx)) // 2 FROM r)),
bytes AS (SELECT key, length(hx) // 2 - i AS d, ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT AS k FROM r, unnest(range(0, length(hx) // 2)) t(i)),
sums AS (SELECT key, bit_xor(v) AS v FROM bytes JOIN far USING (d, k) GROUP BY key),
h AS (SELECT run, c, xor(xor(sums.v, start.v), 4294967295) AS h FROM r JOIN sums USING (key) JOIN start ON start.d = length(hx) // 2),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
e AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) t(i)),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM e a JOIN e b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT DISTINCT e.word, e.n, w.word, w.n FROM e JOIN w ON e.rest = w.word UNION SELECT DISTINCT w.word, w.n, e.word, e.n FROM e JOIN w ON e.rest = w.word),
best AS (SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word, n),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain(word, last, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NOT NULL),
root AS (SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM f JOIN root USING (word)
""",
}
