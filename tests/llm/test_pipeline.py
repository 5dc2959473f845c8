import hashlib
import math
import os
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from slotweave.llm import langid, pii, simhash
from tests.llm.test_decontaminate import plain as contaminated
from tests.llm.test_simhash import components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def poisson(rate, doc_id):
    parts = max(1, math.ceil(rate / 8))
    total = 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"42:{doc_id}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u and k < 60:
            k += 1
            p *= rate / parts / k
            c += p
            total += 1
    return total


def corpus():
    rnd = random.Random(11)
    vocab = {"aa": [f"{a}{b}m" for a in "btkp" for b in "aeiou"], "cc": [f"{a}{b}x" for a in "zqjw" for b in "aeiou"]}
    rows = []
    for i in range(300):
        lang = "aa" if i % 2 else "cc"
        rows.append([i, " ".join(rnd.choice(vocab[lang]) for _ in range(rnd.randrange(60, 200))), lang, f"s{i % 3 if i % 9 else 0}"])
    item = " ".join(rnd.choice(vocab["aa"]) for _ in range(14))
    for i in range(0, 300, 25):
        rows[i][1] += " " + item.upper()
    for i in range(1, 300, 30):
        rows[i][1] += " mail x.y@example.com or +1 (555) 123-4567"
    for i in range(20):
        rows.append([400 + i, rows[i * 7 + 2][1].upper() if i % 2 else rows[i * 7 + 2][1] + " bam", "aa", "s1"])
    rows += [[500, None, "aa", "s1"], [501, "", None, None], [502, "123 456", "cc", "s2"], [503, "Щ" * 300, None, "s2"]]
    return [(*r, len(r[1] or "")) for r in rows], [(1, item), (2, None)]


def test_run_matches_the_stages_applied_by_hand(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {r[0]: r for r in rows if r[0] < 500}  # the four last rows have no letters, or letters of no learned language
    groups = components([(i, r[1]) for i, r in kept.items()])
    kept = {i: r for i, r in kept.items() if groups[i][1] == i}
    dirty = {x[0] for x in contaminated([(i, r[1]) for i, r in kept.items()], bench) if x[5]}
    assert len(dirty) > 5
    kept = {i: r for i, r in kept.items() if i not in dirty}
    clean = {i: pii.redacted(r[1]) for i, r in kept.items()}
    assert any("[EMAIL]" in t and "[PHONE]" in t for t in clean.values())
    sizes = {}
    for r in kept.values():
        sizes[r[3]] = sizes.get(r[3], 0) + 1
    want = sorted((i, clean[i], r[2], r[3], len(clean[i]), c + 1) for i, r in kept.items() for c in range(poisson(len(kept) / len(sizes) / sizes[r[3]], i)))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.copy_no) for r in out.collect())
    assert got == want


def test_stage_contract(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows[:40] + rows[-4:], COLUMNS)
    for name in ("kept_id", "bad_id", "fp", "component_id", "lang_pred", "n_docs", "mix_rate", "copy_no", "tag"):
        docs = docs.withColumn(name, F.lit("clash"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert re.fullmatch(r"\w+", name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        assert 0 < out.count() < 80
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert os.path.exists(corpus_pipeline.__file__) and langid and simhash


def test_stages_decide_row_by_row(spark, tmp_path):
    rnd = random.Random(4)
    text = lambda n: " ".join(rnd.choice(["bam", "tok", "pim", "kel", "dor", "sun", "fig"]) + rnd.choice("xyz") for _ in range(n))
    one, two, three, item = text(50), text(50), text(50), text(12)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    dedup, clean = corpus_pipeline.STAGES[1][1], corpus_pipeline.STAGES[2][1]
    near = [(1, one), (1, one), (1, one), (2, one), (5, one), (5, two), (None, two), (None, three), (None, three), (6, None), (7, "")]
    got = dedup(spark, spark.createDataFrame(near, "doc_id long, text string"), str(tmp_path)).collect()
    # one row of `one` (id 1), `two` with an id before the null one, one `three`, one of the wordless
    assert sorted(map(tuple, got), key=str) == sorted([(1, one), (5, two), (None, three), (6, None)], key=str)
    dirty = [(None, f"a {item} b"), (None, two), (3, item), (3, three), (None, None), (None, two)]
    got = clean(spark, spark.createDataFrame(dirty, "doc_id long, text string"), str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, two), (3, three), (None, None), (None, two)], key=str)


def test_without_labels_only_texts_without_letters_go(spark):
    rows = [(1, "abc", None), (2, "12 34", None), (3, None, None), (4, "Ж", None)]
    got = corpus_pipeline.STAGES[0][1](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 4]
