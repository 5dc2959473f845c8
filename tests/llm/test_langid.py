import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from slotweave.llm import langid


def plain_probability(counts, gram, alphabet):
    """Interpolated Kneser-Ney straight from its definition."""
    levels = {langid.ORDER: counts}
    for k in range(langid.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    p = 1 / alphabet
    for k in range(1, langid.ORDER + 1):
        g, c = gram[-k:], levels[k]
        total = sum(n for x, n in c.items() if x[:-1] == g[:-1])
        if not total:
            continue
        ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
        d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        kinds = sum(x[:-1] == g[:-1] for x in c)
        p = max(c.get(g, 0) - d, 0) / total + d * kinds / total * p
    return p


def test_entropy_matches_definition():
    rnd = random.Random(1)
    texts = {"xx": "abca bcab abba cab " * 3, "yy": "dedf fed deaf fade " * 2}
    counts = {}
    for lang, t in texts.items():
        line = "".join(map(chr, langid.normalise([t])[0]))
        counts[lang] = dict(Counter(line[i : i + 4] for i in range(len(line) - 3)))
    model = langid.build(counts)
    alphabet = len({g[-1] for c in counts.values() for g in c}) + 1
    probe = ["".join(rnd.choice("abcdefz 1.") for _ in range(40)), "Q", "", "abca"]
    h, n, _ = langid.entropies(model, probe)
    for i, t in enumerate(probe):
        line = "".join(map(chr, langid.normalise([t])[0]))
        for j, lang in enumerate(model.languages):
            want = [-math.log2(plain_probability(counts[lang], line[k - 3 : k + 1], alphabet)) for k in range(3, len(line))]
            assert n[i] == len(want)
            if want:
                assert np.isclose(h[i, j], sum(want) / len(want), atol=1e-4)
    assert np.allclose(langid.entropies(model, probe[::-1])[0][::-1], h, atol=1e-6)


def test_identify(spark):
    rnd = random.Random(2)
    words = {"aa": ["bim", "bam", "bom", "the"], "cc": ["zuk", "xix", "qod", "the"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(["aa", "cc"] * 150)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !!", "cc"), (903, "ВСЁ ПРОПАЛО " * 40, None), (904, "bim bam " * 200000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(7))
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, _, lang in rows[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and not got[i].rejected and 0 <= got[i].score <= 1
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (900, 901, 902))
    assert got[903].rejected and got[903].lang_pred in ("aa", "cc")
    assert got[904].lang_pred == "aa"
    assert langid.identify(docs.unionAll(docs)).count() == 2 * len(rows)
    assert langid.identify(docs.limit(0)).count() == 0
    none = langid.identify(docs.limit(3).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in none] == [("und", 0.0, False)] * 3


def test_parts_of_a_model_agree_with_the_whole(spark, monkeypatch):
    rnd = random.Random(7)
    names = [f"l{k:03}" for k in range(7)]
    letters = {x: [chr(97 + (5 * k + j) % 26) for j in range(9)] for k, x in enumerate(names)}
    rows = [(i, "".join(rnd.choice([*letters[x], " "]) for _ in range(rnd.randrange(5, 120))), x) for i, x in enumerate(names * 30)]
    rows += [(900, None, "l000"), (901, "77", "l001"), (902, "Щ" * 90, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, kept = langid.identify(docs).collect(), langid.recognised(docs, langid.train(docs)).collect()
    monkeypatch.setattr(langid, "PART_BYTES", 30_000)
    model = langid.train(docs)
    assert len(model) > 2 and sorted(x for p in model for x in p.value.languages) == names
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for r in whole:
        assert (got[r.doc_id].lang_pred, got[r.doc_id].rejected) == (r.lang_pred, r.rejected) and abs(got[r.doc_id].score - r.score) < 1e-6
    assert sorted(map(tuple, langid.recognised(docs, model).collect())) == sorted(map(tuple, kept))


def test_every_language_is_learned_and_null_ids_train(spark):
    rows = [(None, f"{chr(0x4E00 + k) * 3} {chr(0x4E00 + k)}{chr(0x5E00 + k + j)} " * 6, f"l{k}") for k in range(520) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs).collect()
    assert {r.lang_pred for r in found} == {f"l{k}" for k in range(520)}
    copies = spark.createDataFrame([(7, "same text of one row", "x")] * 500 + [(None, "other text", "x")] * 500, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(copies).collect()} == {"x"}
