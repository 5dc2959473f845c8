import random

import numpy as np
from pyspark.sql import functions as F

from slotweave.llm import license_scan as ls


def full_alignment(template, doc):
    """Best fit of the template into doc over all cells; the matches of the best score, most first."""
    none = (-(10**9), 0)
    row = [(0, 0)] * (len(doc) + 1)
    for t in template:
        new = [(row[0][0] + ls.GAP, row[0][1])]
        for j, d in enumerate(doc, 1):
            step = (row[j - 1][0] + ls.MATCH, row[j - 1][1] + 1) if t == d else (row[j - 1][0] + ls.MISS, row[j - 1][1])
            new.append(max(step, (row[j][0] + ls.GAP, row[j][1]), (new[-1][0] + ls.GAP, new[-1][1]), none))
        row = new
    return max(row)


def test_banded_alignment_scores_like_the_full_one():
    rnd = random.Random(8)
    for _ in range(60):
        t = [rnd.randrange(1, 30) for _ in range(rnd.randrange(5, 40))]
        d = [x if rnd.random() > 0.1 else 99 for x in t if rnd.random() > 0.05]
        pre = [77] * rnd.randrange(0, 6)
        n, first, last = ls.align(np.array(t), np.array(pre + d + [66] * 3), (-8, 8))
        assert abs(n - full_alignment(t, pre + d + [66] * 3)[1]) <= 1
        assert n == 0 or len(pre) <= first <= last < len(pre) + len(d)


def test_scan(spark):
    long = dict(ls.TEMPLATES)["mit-permission"]
    edited = long.replace("free of charge", "at no cost at all").replace("merge, ", "")
    rows = [(1, "Ünd so. RELEASED under\nthe MIT license! x"), (2, None), (3, ""), (4, "z " * 100000 + edited), (5, "released under some license"), (6, f"{long} {long}"), (7, "All rights reserved. " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("coverage", F.lit("x")).withColumn("template_id", F.lit(1))
    templates = spark.createDataFrame([*ls.TEMPLATES, ("empty", ""), ("null", None)], "template_id string, text string")
    got = {}
    for r in ls.scan_licenses(docs, templates).collect():
        got.setdefault(r.doc_id, []).append(r)
    texts = dict(rows)
    one = got[1][0]
    assert (one.template_id, one.coverage, texts[1][one.span_start : one.span_end]) == ("mit-line", 1.0, "RELEASED under\nthe MIT license")
    near = got[4][0]
    assert near.template_id == "mit-permission" and 0.9 < near.coverage < 1 and texts[4][near.span_start : near.span_end] == edited[:-1]
    assert [r.template_id for r in got[6]] == ["mit-permission"] * 2 and [r.coverage for r in got[6]] == [1.0, 1.0]
    assert [r.span_start for r in got[7]] == [0, 21, 42]
    assert set(got) == {1, 4, 6, 7}
    assert ls.scan_licenses(docs, templates.limit(0)).count() == 0 and ls.scan_licenses(docs.limit(0), templates).count() == 0
    assert ls.scan_licenses(docs.unionAll(docs), templates).count() == 2 * sum(map(len, got.values()))


def test_slices_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0. Released under the MIT License.")], "doc_id long, text string")
    templates = spark.createDataFrame(ls.TEMPLATES, "template_id string, text string")
    want = sorted(ls.scan_licenses(docs, templates).collect())
    monkeypatch.setattr(ls, "SLICE_BYTES", 50)
    assert sorted(ls.scan_licenses(docs, templates).collect()) == want and len(want) == 2


def index_of(*texts):
    index = ls.Index()
    for k, t in enumerate(texts):
        index.add(str(k), t.encode())
    return index


def test_changed_notices_are_found(spark):
    long = dict(ls.TEMPLATES)["gpl-3.0-header"].split()
    fifth = " ".join("x" if k % 5 == 4 else w for k, w in enumerate(long))
    split = " ".join([*long[:40], *["x"] * 30, *long[40:]])
    rows = [(1, "a. Released under an MIT license b"), (2, "Licensed under the Apache Licence, Version 2.0"), (3, f"y {fifth} y"), (4, f"y {split} y"), (5, f"{fifth} {split} {fifth}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in ls.scan_licenses(docs, spark.createDataFrame(ls.TEMPLATES, "template_id string, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.template_id, r.matched_words, r.template_words))
    m = got[4][0][2]
    assert got[1] == [("mit-line", 4, 5)] and got[2] == [("apache-2.0-line", 7, 8)]
    assert [x[0] for x in got[3]] == ["gpl-3.0-header"] and got[3][0][1] >= 0.8 * m and got[4] == [("gpl-3.0-header", m, m)]
    assert len(got[5]) == 3


def test_scan_finds_what_the_full_alignment_does():
    rnd = random.Random(9)
    both = [0, 0]
    for _ in range(1500):
        m = rnd.choice([1, 2, 3, 4, 5, 8, 13, 21, 40])
        t = [rnd.randrange(1, rnd.choice([4, 60])) for _ in range(m)]
        index = index_of(" ".join(f"w{x}" for x in t))
        number = index.vocabulary
        changed, added = rnd.choice([0, 0.1, 0.2, 0.3]), rnd.choice([0, 0.2, 0.6])
        d = [rnd.choice([0, rnd.randrange(1, 60)]) for _ in range(rnd.randrange(8))]
        gap_at = rnd.randrange(m)
        for k, x in enumerate(t):
            d += [0] * rnd.choice([0, 0, 10, 25]) if k == gap_at else [0] * (rnd.random() < added)
            if rnd.random() >= changed / 2:
                d.append(0 if rnd.random() < changed / 2 else x)
        d += [rnd.randrange(60) for _ in range(rnd.randrange(8))]
        ids = [number.get(f"w{x}".encode(), 0) for x in d]
        score, n = full_alignment(index.texts[0].tolist(), ids)
        want = n >= ls.MIN_COVERAGE * m and score > 0
        got = ls.scan(index, np.array(ids, np.int64))
        assert not want or max((x[1] for x in got), default=0) >= n, (t, d, n, got)
        assert want or not got or m < 5 or max(x[1] for x in got) >= ls.MIN_COVERAGE * m, (t, d, n, got)
        both[want] += 1
    assert min(both) > 100
