import random
import re
import time

from pyspark.sql import functions as F

from slotweave.llm import pii


def plain(text):
    """The contract's patterns as they stand."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_equals_plain_patterns():
    rnd = random.Random(4)
    for _ in range(20000):
        t = "".join(rnd.choice("ab@@..-+ 0011234567()é") for _ in range(rnd.randrange(40)))
        assert pii.base_spans(t) == plain(t), t
    for d in ("4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005"):
        assert pii.base_spans(f"x {d} y") == plain(f"x {d} y")
    began = time.time()
    for t in ("1" * 300000, "a" * 300000 + "@", "1." * 100000, "+1" * 100000, "@" * 100000):
        pii.base_spans(t)
    assert time.time() - began < 10


def spans(text):
    base = pii.base_spans(text)
    return [(pii.KINDS[k], text[s:e]) for s, k, e in sorted(pii.added_spans(text, base))]


def test_disguises_map_back_to_source():
    assert spans("write to jane [at] mail [dot] example (dot) com now") == [("email", "jane [at] mail [dot] example (dot) com")]
    assert spans("see bob at example dot org, please") == [("email", "bob at example dot org")]
    assert spans("é jane＠exаmple.com!") == [("email", "jane＠exаmple.com")]
    assert spans("ip １９２.168.0.1 here") == [("ip", "１９２.168.0.1")]
    assert spans("card four one one one one one one one one one one one one one one one.") == [("card", "four one one one one one one one one one one one one one one one")]
    assert spans("call plus four nine three zero one two three four five six") == [("phone", "plus four nine three zero one two three four five six")]
    assert spans("one two dot one dot zero dot nine") == [("ip", "one two dot one dot zero dot nine")]
    assert spans("a​b@ex.com") == [("email", "a​b@ex.com")] or pii.base_spans("a​b@ex.com")
    assert spans("meet me at example.com at noon; one of two. Überall élève dot") == []
    assert spans("plain jane@example.com and 10.0.0.1") == []


def test_disguises_that_split_an_identifier():
    for text in ("j\u043ehn@example.com", "jo\u200bhn@example.com", "john@exam\u200bple.com", "jo@mail.exam[dot]com", "a\u200bb@ex.com", "jo@mail\u200b.com", "4111 1111 1111 111\u0661", "+49 30 123456\u0667 89"):
        kind = "email" if "@" in text else "phone" if "+" in text else "card"
        assert (kind, text) in spans(text), text
        assert pii.redacted(f"see {text}!") == f"see [{kind.upper()}]!"
    assert spans("\u043e jo@mail.example.com \u200b") == []


def test_cheap_look_loses_nothing(monkeypatch):
    for text in ("bob at example dot\norg", "a@b\tdot\tcom", "a@b(\tdot)com", "a@b\u00a0dot\u00a0com", "bob (\u00a0at\t) example.com", "(one,one.one.one.one)", "1one dot two.three dot four"):
        assert pii.disguised(text) and pii.transduce(text)[0] != text, text
    assert spans("bob at example dot\norg") == [("email", "bob at example dot\norg")]
    assert pii.transduce("f\u0131ve \u017fix")[0] == "56"
    assert not pii.disguised("One of two: look at example.com. Überall élève dot")
    rnd = random.Random(5)
    parts = [*"@.()[]<>{}-+,aZ19éо\u0130\u0131\u017f\u200b", " ", "\t", "\n", "\u00a0", "\u2003", "at", "dot", "DOT", "com", "one", "Two", "oh", "plus", "f\u0131ve", "\u017fix"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(60000)]
    gated = [pii.added_spans(t, pii.base_spans(t)) for t in texts]
    looks = [pii.disguised(t) for t in texts]
    assert all(look or pii.transduce(t)[0] == t for t, look in zip(texts, looks, strict=True)) and not all(looks)
    monkeypatch.setattr(pii, "disguised", lambda text: True)
    assert [pii.added_spans(t, pii.base_spans(t)) for t in texts] == gated


def test_find_and_redact(spark):
    rows = [(1, None), (2, ""), (3, "a@b.co and a@b.co, 1.2.3.4"), (4, "x" * 500000 + " j [at] e [dot] com"), (5, "1.2.3.400 +1 (555) 123-4567")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    assert got[1].spans == got[2].spans == "" and got[3].n_email == 2 and got[3].n_ip == 1
    assert got[3].spans == "email:0:6,email:11:17,ip:19:26"
    assert got[4].spans == "email:500001:500019" and got[4].n_email == 0 and got[4].n_added == 1
    assert got[5].n_ip == 0 and got[5].n_phone == 1
    clean = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert clean[1].text is None and clean[3].text == "[EMAIL] and [EMAIL], [IP]" and clean[3].n_chars == 25
    assert clean[4].text.endswith("x [EMAIL]") and clean[5].text == "1.2.3.400 [PHONE]"
    assert pii.find_pii(docs.unionAll(docs)).count() == 10 and pii.find_pii(docs.limit(0)).count() == 0
    assert pii.redact(docs).columns == docs.columns
