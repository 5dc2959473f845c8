import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotweave.llm import spelling


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a of b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(words):
    """The contract by all pairs."""
    found = {}
    for w, n in words.items():
        others = [x for x in words if abs(len(x) - len(w)) < 2 and near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        found[w] = (form, n, len(others), words[form] if form else None)
    for w in words:
        root = w
        while found[root][0]:
            root = found[root][0]
        yield (w, found[w][0], root, *found[w][1:])


@pytest.mark.parametrize("part_blocks", [1, spelling.PART_BLOCKS])
def test_groups_against_all_pairs(spark, part_blocks):
    rnd = random.Random(2)
    words = {}
    for _ in range(120):
        w = "".join(rnd.choice("aabéÿ") for _ in range(rnd.choice([7, 7, 8, 9, 12, 63, 64, 65, 130])))
        words[w] = rnd.choice([2, 3, 30, 400, 5000, 60000])
        for _ in range(4):
            i, c = rnd.randrange(len(w)), rnd.choice("aab×Þ")
            w = rnd.choice([w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i + 1 :]])
            if len(w) >= 7:
                words.setdefault(w, rnd.choice([2, 3, 30, 400, 5000, 60000]))
    words |= {"chainaaa": 10000, "chainaab": 1000, "chainabb": 100, "chainbbb": 10, "a" * 3000: 2, "a" * 3001: 20}
    table = spark.createDataFrame(list(words.items()), "word string, n long").withColumn("near", F.lit("clash")).repartition(3)
    got = spelling.group_spellings(table, part_blocks).collect()
    want = sorted(plain(words), key=lambda r: r[0])
    assert sorted((tuple(r) for r in got), key=lambda r: r[0]) == [(w, f, root, n, k, m) for w, f, root, n, k, m in want]
    assert {r.root for r in got if r.word.startswith("chain")} == {"chainaaa"} and any(r.root != (r.form or r.word) for r in got)


def test_words_of_documents(spark):
    rnd = random.Random(3)
    pieces = ["Straßenbahn", "straßenbahn", "ÉCLAIRS", "Éclairs", "shortly", "letters7", "don't", "×÷ÿÀàbcd", "aaaaaaa", "short", "naïveté_words"]
    texts = [" ".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 60))) for _ in range(80)] + ["", None, "x" * 20000 + " " + "x" * 20000]
    rows = [(None if k % 9 == 0 else str(k // 2), x) for k, x in enumerate(texts)]
    want = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{i or ''}:{run}".encode())
            want[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r.word: r.n for r in spelling.corpus_words(docs).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2} and len(got) >= 10
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
    assert {r.word for r in spelling.spelling_variants(docs).collect()} == set(got)


def test_filters_lose_no_word_and_few_edits_pass(spark):
    rnd = random.Random(4)
    words = list({"".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(3000)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    shards = spelling.Shards({9: len(words)})
    cells = np.zeros(shards.total * spelling.SLOTS, np.uint64)
    for r in spelling.filters(table, shards).collect():
        cells[r.cell] = np.int64(r.bits).view(np.uint64)

    def passes(names):
        block, places = shards.places(9, (spelling.letters(names) * spelling.powers(9)).sum(axis=1, dtype=np.uint64))
        return np.all([(cells[block * spelling.SLOTS + s] & m) != 0 for s, m in (spelling.bits(places, k) for k in range(spelling.PROBES))], axis=0)

    assert passes(words).all()
    others = list({"".join(rnd.choice("ijklmnop") for _ in range(9)) for _ in range(20000)})
    assert passes(others).mean() < 0.01


def test_hashes_of_edits_are_those_of_the_edited_words():
    alphabet = np.array([ord(c) for c in "abé"], np.uint64)
    words = ["aabbaéa", "bbbbbbb", "éaaaaab"]
    tried = set()
    for length, hashes, w, i, new in spelling.edits(words, alphabet):
        for h, k, at, c in zip(hashes.tolist(), w.tolist(), i.tolist(), new.tolist(), strict=True):
            made = words[k][:at] + (chr(c) if c else "") + words[k][at + 1 :]
            assert len(made) == length and int((spelling.letters([made]) * spelling.powers(length)).sum(dtype=np.uint64)) == h
            assert (words[k], made) not in tried
            tried.add((words[k], made))
    assert len(tried) == sum(len({x[:i] + x[i + 1 :] for i in range(7)}) + sum(c > ord(d) for d in x for c in alphabet.tolist()) for x in words)
