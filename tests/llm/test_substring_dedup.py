import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from slotweave.llm import substring_dedup as sd


def plain(rows):
    seen = Counter(d[i : i + 200] for _, t in rows for d in [(t or "").encode()] for i in range(len(d) - 199))
    out = []
    for doc_id, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "ärger", "of", "x" * rnd.randrange(1, 9), f"w{rnd.randrange(500)}"])
    text = lambda n: " ".join(word() for _ in range(n))
    common = [text(50) for _ in range(4)]
    rows = [(i, text(rnd.randrange(0, 120))) for i in range(40)]
    for i in range(40):
        parts = [text(rnd.randrange(0, 30)), rnd.choice(common), text(rnd.randrange(0, 30))]
        if i % 3 == 0:
            cut = rnd.randrange(100)
            parts[1] = parts[1][:cut] + "Q" + parts[1][cut:]
        rows.append((100 + i, " ".join(parts)))
    base = text(200)
    rows += [(200 + i, base[: rnd.randrange(500)] + "#" + base[rnd.randrange(500) :]) for i in range(12)]
    rows += [(300, None), (301, ""), (302, "a" * 199), (303, "a" * 200), (304, "a" * 201 + "b"), (305, "ab" * 400), (306, base), (307, base), (308, text(60) * 3), (309, "z" * 3000), (310, "zy" + "z" * 500)]
    return rows


def result(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit("clash")).withColumn("n_bytes", F.lit(-1))
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(docs).drop("kept").collect())


def test_suffix_order_and_prefixes():
    rnd = random.Random(9)
    for alphabet in ("ab", "abc", "a", "zyxwv"):
        spans = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(200, 420))).encode() for _ in range(6)]
        spans += [spans[0][20:260], b"ab" * 150, b"b" * 210, b"ba" * 110 + b"c"]
        data = np.frombuffer(b"".join(spans), np.uint8)
        bounds = np.append(0, np.cumsum([len(s) for s in spans]))
        order = sd.sorted_windows(data, bounds)
        whole = data.tobytes()
        windows = [i for a, b in zip(bounds[:-1], bounds[1:]) for i in range(a, b - 199)]
        assert sorted(order.tolist()) == windows
        got = [whole[i : i + 200] for i in order]
        assert got == sorted(got)
        same = sd.common_prefixes(data, order) >= 200
        assert [x == y for x, y in zip(got, got[1:])] == same.tolist()


def test_matches_brute_force(spark):
    for seed in (1, 2):
        assert result(spark, corpus(seed)) == plain(corpus(seed))


def test_crowded_anchors_are_anchored_anew(spark, monkeypatch):
    monkeypatch.setattr(sd, "ANCHOR_SPANS", 1)
    monkeypatch.setattr(sd, "CHUNK", 700)
    assert result(spark, corpus(3)) == plain(corpus(3))


def test_hot_passage_in_many_contexts(spark, monkeypatch):
    """A passage of 260 bytes and a line of 60 in contexts of their own: every copy's edges share anchors with all others."""
    monkeypatch.setattr(sd, "ANCHOR_SPANS", 20)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(50)[:260], text(20)[:60]
    rows = [(i, f"{text(25)} {passage} {text(25)} {line} {text(20)}") for i in range(150)]
    assert result(spark, rows) == plain(rows)


def test_spans_of_every_gram_cover_each_window_once():
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"ab") for _ in range(n)) for n in (199, 200, 201, 640, 0, 900)] + [b"x" * 500]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    whole = data.tobytes()
    for gram in sd.GRAMS:
        seen = np.zeros(len(data), int)
        for _, first, last, h1, twice in sd.anchored_spans(data, bounds, gram):
            for a, b, anchor, more in zip(first, last, h1, twice):
                seen[a : b + 1] += 1
                h = sd.gram_hashes(data[a : b + 200], gram)
                assert h.min() == anchor and more == (np.count_nonzero(h == anchor) > 1)
                assert len(set(whole[a + i : a + i + gram] for i in np.flatnonzero(h == anchor))) == 1
        want = np.zeros(len(data), int)
        for a, b in zip(bounds[:-1], bounds[1:]):
            want[a : max(a, b - 199)] = 1
        assert (seen == want).all()


def test_cut_documents(spark, monkeypatch):
    docs = corpus(4)
    data = np.frombuffer("".join(t or "" for _, t in docs).encode(), np.uint8)
    bounds = np.append(0, np.cumsum([len((t or "").encode()) for _, t in docs]))
    monkeypatch.setattr(sd, "CHUNK", 300)
    seen = np.zeros(len(data), int)
    for _, first, last, _, _ in sd.anchored_spans(data, bounds, 32):
        for a, b in zip(first, last):
            seen[a : b + 1] += 1
    want = np.zeros(len(data), int)
    for a, b in zip(bounds[:-1], bounds[1:]):
        want[a : max(a, b - 199)] = 1
    assert (seen == want).all()


def test_repeated_and_shared_ids(spark):
    rows = [(1, "abc " * 60 + "end"), (1, "other text"), (2, "q" + "".join(chr(97 + i * i % 26) for i in range(250))), (None, "x y z")]
    twice = rows + rows[2:3]
    assert result(spark, [r for r in twice if r[0] is not None]) == plain([r for r in twice if r[0] is not None])
    assert spark.createDataFrame(rows[3:], "doc_id long, text string").transform(sd.remove_repeats).count() == 1
    assert result(spark, []) == []


def test_rows_without_or_with_one_doc_id(spark):
    rnd = random.Random(21)
    texts = ["".join(rnd.choice("abcdefghij ") for _ in range(256)) for _ in range(40)]
    rows = [(None, t) for t in texts] + [(None, texts[0]), (7, texts[1]), (7, "Q" + texts[2]), (7, texts[3] + texts[3][:10])]
    got = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).repartition(5)
    got = sorted((r.n_bytes, r.n_removed) for r in sd.remove_repeats(got).collect())
    where = {}
    for k, (_, t) in enumerate(rows):
        for i in range(len(t) - 199):
            where.setdefault(t[i : i + 200], []).append((k, i))
    gone = [set() for _ in rows]
    for places in where.values():
        for k, i in places if len(places) > 1 else []:
            gone[k] |= set(range(i, i + 200))
    assert got == sorted((len(t), len(g)) for (_, t), g in zip(rows, gone, strict=True)) and sum(not g for g in gone) == 36
