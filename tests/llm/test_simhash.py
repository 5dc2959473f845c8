import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from slotweave.llm import simhash


def brute(text):
    import re

    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows):
    fp = {i: brute(t) for i, t in rows}
    ids = sorted(fp)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(3)
    words = [f"Wö{k}" for k in range(200)] + ["THE", "and x"]
    rows, base = [], [rnd.choice(words) for _ in range(300)]
    for i in range(120):
        t = list(base)
        for _ in range(i % 7):
            t[rnd.randrange(300)] = rnd.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(200 + i, " \n\t".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60)))) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \t "), (303, "one two three"), (304, "one two THREE"), (305, "x " * 200000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == components(rows)
    again = simhash.near_duplicates(docs.unionAll(docs))
    assert again.count() == 2 * len(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_chunked_blocks_lose_no_link(spark, monkeypatch):
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = set()
    while len(fps) < 60:
        x = base
        for _ in range(rnd.randrange(0, 9)):
            x ^= 1 << rnd.randrange(0, 40)
        fps.add(x)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    signed = [(int(np.uint64(x).view(np.int64)),) for x in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"))
    got = {(r.node, r.component) for r in simhash.connected_components(edges).collect()}
    parent = {x: x for (x,) in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (x,) in signed:
        for (y,) in signed:
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 4:
                a, b = find(x), find(y)
                parent[max(a, b)] = min(a, b)
    linked = {x for (x,) in signed if any(x != y and ((x ^ y) & (2**64 - 1)).bit_count() <= 4 for (y,) in signed)}
    assert got == {(x, find(x)) for x in linked}
