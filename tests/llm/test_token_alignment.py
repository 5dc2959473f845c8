import hashlib
import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import functions as F

from slotweave.llm import token_alignment as t

PAIR = t.tokenizers(*t.Files().read())


def plain(texts):
    """The contract, document by document, without chunks or units."""
    aligned = []
    for text in texts:
        groups = []
        if text:
            (a, b, ok), want = next(iter(PAIR.encode([text]))), b" " + text.encode()
            if ok:
                ends = []
                for ids, by in ((a, PAIR.bytes_a), (b, PAIR.bytes_b)):
                    at, found = 0, []
                    for i in ids:
                        at += len(by[i])
                        found.append(at)
                    assert at == len(want)
                    ends.append(found)
                common = set(ends[0]) & set(ends[1])
                group = {}
                for side, (ids, xs) in enumerate(((a, ends[0]), (b, ends[1]))):
                    done = 0
                    for i, x in zip(ids, xs, strict=True):
                        group.setdefault(done, ([], []))[side].append(i)
                        done += x in common
                groups = [group[k] for k in sorted(group)]
        aligned.append(groups)
    links = [Counter((i, j) for a, b in groups for i in a for j in b) for groups in aligned]
    held = Counter(p for found in links for p in found)
    most = {}
    for (i, _), n in held.items():
        most[i] = max(most.get(i, 0), n)
    for groups, found in zip(aligned, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(found.values()),
            sum(n for p, n in found.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in found.items()),
            hashlib.sha256(text.encode()).hexdigest() if groups else "", text,
        )


def test_quick_encoder_gives_the_same_ids():
    texts = [x for x in odd_texts() if x] + ["it's WE'LL 'tis 12 345 - --", "\u180e \u2003x", "a" * 9000]
    assert PAIR.quick is not None
    assert PAIR.ids_a(texts) == [e.ids for e in PAIR.a.encode_batch([" " + x for x in texts], add_special_tokens=False)]


def odd_texts():
    rnd = random.Random(3)
    parts = ["the", "The", "Ünïcode", "don't", "x" * 40, "東京都", "🙂🙂", "12345", "!?", "\t", "\n\n", "  ", "a  b", "\x00", "\x1c", "　", "é", "<|endoftext|>", "<s>", "<0x41>", "antidisestablishmentarianism", "᠎", " "]
    texts = [None, "", " ", "  ", "a", "a ▁b", "▁", " lead", "trail ", "aaaa" * 700, "no▁", "日本語" * 300, "Hello world", "Hello world"]
    texts += ["".join(rnd.choice(parts) + rnd.choice(["", " ", " ", "  "]) for _ in range(rnd.randint(1, 120))) for _ in range(60)]
    return texts


@pytest.mark.parametrize("chunk", [t.CHUNK, 37])
def test_alignment_against_plain_code(spark, chunk):
    texts = odd_texts()
    docs = spark.createDataFrame([(f"d{k // 2}" if k % 7 else None, x) for k, x in enumerate(texts)], "doc_id string, text string").withColumn("n_a", F.lit("clash")).repartition(3)
    got = t.align_tokenizers(docs, with_groups=True, chunk=chunk).collect()
    want = list(plain(texts))
    rows = [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in got]
    assert sorted(rows) == sorted(want)
    assert sorted((r.doc_id or "", r.groups_sha256) for r in got) == sorted((f"d{k // 2}" if k % 7 else "", w[6]) for k, w in enumerate(want))


def test_fragments_compose_in_any_order():
    rnd = random.Random(4)
    for text in [x for x in odd_texts() if x and "▁" not in x]:
        size = len(text.encode()) + 1
        borders = sorted({0, size, *(rnd.randrange(size) for _ in range(8))})
        parts = [t.fragment(PAIR, k, text, lo, hi) for k, (lo, hi) in enumerate(zip(borders, borders[1:], strict=False))]
        whole, groups, fit = t.fragment(PAIR, 0, text, 0, size)
        assert fit and whole.back_a == whole.back_b == []

        def run(order):
            nodes, closed = [p[0] for p in parts], [(k, 1, g) for k, p in enumerate(parts) for g in [p[1]]]
            while len(nodes) > 1:
                at = order(len(nodes) - 1)
                both, group = t.compose(nodes[at], nodes[at + 1])
                nodes[at : at + 2] = [both]
                if group:
                    closed.append((group[0], 0, [group[1:]]))
            top = nodes[0]
            closed.append((top.closing, 0, [(top.front_a, top.front_b)]))
            return top.back_a, [list(map(list, g)) for _, _, gs in sorted(closed, key=lambda c: c[:2]) for g in gs]

        want = [list(map(list, g)) for g in [(whole.front_a, whole.front_b), *groups]]
        assert run(lambda n: 0) == run(lambda n: n - 1) == run(lambda n: rnd.randrange(n)) == ([], want)


def test_ranges_cover_every_byte_once():
    for text in [x for x in odd_texts() if x]:
        for chunk in (5, 64):
            found = list(t.ranges(text, chunk))
            assert [k for k, *_ in found] == list(range(len(found)))
            assert b"".join((b" " + part.encode())[lo:hi] for _, part, lo, hi in found) == b" " + text.encode()


def test_long_texts_and_empty_tables(spark):
    text = "".join(f"word{k % 977} and naïve {k}.\n" for k in range(20000))
    assert len(text) > 5 * t.CHUNK
    docs = spark.createDataFrame([(1, text), (1, text), (2, "z" * 200000), (3, text + "▁")], "doc_id long, text string")
    got = sorted(t.align_tokenizers(docs).collect(), key=lambda r: (r.doc_id, r.n_a))
    assert [tuple(r)[1:] for r in got] == [w[:7] for w in plain([text, text, "z" * 200000, text + "▁"])]
    assert t.align_tokenizers(docs.limit(0)).count() == 0
    assert reduce(lambda a, b: t.compose(a, b)[0], [t.Fragment([1], [], -1, [], []), t.Fragment([], [2], 1, [3], [])]) == t.Fragment([1], [2], 1, [3], [])
