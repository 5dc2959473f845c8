import hashlib
import random
import re

from pyspark.sql import functions as F

from slotweave.llm import decontaminate as dc


def plain_words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def plain(docs, bench):
    wins = {}
    for i, t in bench:
        w = plain_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, items = plain_words(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                found = wins.get(tuple(w[k : k + n])) if k + n <= len(w) else None
                if found:
                    hit |= set(range(k, k + n))
                    items |= found
        out.append((d, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def run(spark, docs, bench):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")).withColumn("term", F.lit(0))
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit(5))
    r = dc.decontaminate(d, b)
    return sorted((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in r.collect())


def test_matches_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    vocab = ["the", "of", "École", "x1", "a"] + [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    bench = [(i, text(rnd.choice([1, 3, 9, 10, 11, 30]) if i else 25)) for i in range(12)] + [(90, None), (91, ""), (92, "the the the the the the the the the the the"), (10, text(15))]
    docs = [(i, text(rnd.randrange(0, 60))) for i in range(40)] + [(100, None), (101, ""), (102, "the " * 3000), (103, "!!")]
    for i in range(30):
        t = rnd.choice([b for _, b in bench if b]).upper().replace(" ", rnd.choice([", ", " - ", "\n"]))
        docs.append((200 + i, f"{text(5)} {t} {text(4)} {t}"))
    assert run(spark, docs, bench) == plain(docs, bench)
    monkeypatch.setattr(dc, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(dc, "REMEMBERED", 3)
    monkeypatch.setattr(dc, "CHUNK", 50)
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    assert run(spark, docs, bench) == plain(docs, bench)
    assert run(spark, docs[:3] * 2, bench) == sorted(plain(docs[:3], bench) * 2)


def test_empty_tables(spark):
    assert run(spark, [(1, "a b")], []) == plain([(1, "a b")], [])
    assert run(spark, [], [(1, "a b")]) == []


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    moved = "beta alpha gamma delta zeta epsilon eta theta kappa iota"
    d = spark.createDataFrame([(1, moved), (2, item)], "doc_id long, text string")
    got = {r.doc_id: (r.contaminated, r.n_near_items) for r in dc.decontaminate(d, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (False, 1), 2: (True, 1)}


def test_proximity_hangs_on_no_single_word(spark):
    item = [f"w{k}" for k in range(14)]
    docs = [(k, " ".join(["a", *item[:k], "new", *item[k + 1 :], "b"])) for k in range(14)]  # the rarest word is another one in every row
    docs += [(20, " ".join([*item[:4], "x", "y", *item[6:10]])), (21, " ".join([*item[:4], "x", "y", "z", *item[7:10]])), (22, " ".join(item)), (23, " ".join(["new"] * 30))]
    docs += [(24, "gone of this"), (25, "only")]
    b = [(7, " ".join(item)), (8, "only"), (9, "never seen of this at all gone or so there")]
    got = dc.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string")).collect()
    near = {r.doc_id: (r.n_near_items, r.near_items) for r in got}
    assert near == {k: (1, "7") for k in [*range(14), 20, 22]} | {21: (0, ""), 23: (0, ""), 24: (0, ""), 25: (1, "8")}
    alone = dc.decontaminate(spark.createDataFrame(docs[7:8], "doc_id long, text string"), spark.createDataFrame(b, "item_id long, text string")).first()
    assert (alone.contaminated, alone.near_items) == (False, "7")


def test_every_match_of_many_items_over_shuffled_input(spark):
    """Phrases and proximity matches of 400 items, of which many share windows, against all pairs of tens."""
    rnd = random.Random(3)
    text = lambda n: [f"w{rnd.randrange(60)}" for _ in range(n)]
    bench = [(i, text(rnd.choice([1, 3, 6, 10, 14]))) for i in range(60)]
    bench += [(100 + i, rnd.choice(bench)[1]) for i in range(340)]
    docs = []
    for d in range(120):
        w = list(rnd.choice(bench)[1])
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(80)}"
        docs.append((d, text(3) + w + text(3)))
    docs += [(500, w) for _, w in docs[:2]]
    frames = [spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} long, text string").repartition(7) for name, rows in (("doc_id", docs), ("item_id", bench))]
    out = dc.decontaminate(*frames)
    got, near = sorted((x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in out.collect()), {}
    plain_docs, plain_bench = [(d, " ".join(w)) for d, w in docs], [(i, " ".join(w)) for i, w in bench]
    assert got == plain(plain_docs, plain_bench)
    for r in out.collect():
        near.setdefault(r.doc_id, []).append(set(filter(None, r.near_items.split(","))))
    phrases, tens = set(), {}
    for r in dc.benchmark_matches(*frames).collect():
        if r.kind == "phrase":
            phrases.add((r.doc_id, r.item_id, r.start, r["size"]))
        else:
            tens.setdefault((r.doc_id, r.item_id), []).append(r.start)
    want_phrases, want_near = set(), {}
    for d, w in docs:
        mine = set()
        for i, b in bench:
            windows = [b[k : k + 10] for k in range(max(1, len(b) - 9))]
            exact = {(d, str(i), k, len(x)) for x in windows for k in range(len(w)) if w[k : k + len(x)] == x}
            want_phrases |= exact
            full = [k for k in range(len(w)) if any(10 * len(set(x) & set(w[k : k + 10])) >= 8 * len(set(x)) for x in windows)]
            if full:
                mine.add(str(i))
            assert set(tens.get((d, str(i)), ())) <= set(full) or d == 500
        want_near.setdefault(d, []).append(mine)
    assert phrases == want_phrases
    assert all(sorted(map(sorted, near[d])) == sorted(map(sorted, want_near[d])) for d in want_near)
    assert {(d, i) for d, i in tens} | {(d, i) for d, i, _, _ in phrases} == {(d, i) for d, sets in want_near.items() for x in sets for i in x}


def test_ids_of_any_type_and_kept_columns(spark):
    d = spark.createDataFrame([("x", "a b c", 1), (None, "a b c", 2), ("x", None, 3)], "doc_id string, text string, row long")
    got = dc.decontaminate(d, spark.createDataFrame([(7, "b")], "item_id long, text string"), "row").collect()
    assert {(r.row, r.doc_id, r.contaminated) for r in got} == {(1, "x", True), (2, None, True), (3, "x", False)}


def test_what_a_task_remembers_does_not_grow_with_the_batch(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dc, "REMEMBERED", 50)
    monkeypatch.setattr(dc, "SLICE", 100)
    texts = [None, "", *[f"w{k} v{k} u{k}" for k in range(500)], "x" * 300, "end"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    lexicon, most, parts = dc.Lexicon(), 0, list(dc.slices(batch, 1))
    for part in parts:
        lexicon.codes(part.column(1))
        most = max(most, len(lexicon))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert most < 100 and max(sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts if p.num_rows > 1) <= 100
    assert list(dc.slices(batch.slice(0, 0), 1)) == []
