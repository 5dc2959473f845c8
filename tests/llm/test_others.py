import hashlib
import random
import zlib

from pyspark.sql import functions as F

from slotweave.llm import license_scan, mixing, mpeg_audio, pii, url_filter


def fits(host, path, h, p):
    return (host == h or host.endswith("." + h)) and path.startswith(p)


def test_url_rules_against_brute_force(spark):
    rnd = random.Random(7)
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "", "block"), ("a.net", "/x", "allow"), ("a.net", "/x", "block")]
    urls = [None, "", "no scheme", "http://", "http://COM/en/", "x://example.com", "ftp://b.Example.com:80/en/77?x#y", "http://com?/en/", "http://a.net/x/y#z", "http://xcom/en/1", "http://com.evil/en/1", "a://b://com/en/"]
    urls += [f"http{rnd.choice(['', 's'])}://{rnd.choice(['', 'www.', 'm.a.'])}{rnd.choice(['com', 'net', 'example.com', 'a.net', 'org'])}{rnd.choice(['', '/', '/en/', '/en/7', '/x', '/EN/'])}{rnd.choice(['', '?q', '#f', '5'])}" for _ in range(200)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
        assert (r.host, r.path) == (host, path)
        best = max(((len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if fits(host, path, h, p)), default=None)
        assert (r.rule, r.verdict) == ((best[3], best[4]) if best else (None, "allow")), u
    assert url_filter.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_mpeg_round_trip(spark):
    rows = [(1, None), (2, ""), (3, "ä" * 96), (4, "x" * 193), (5, "Grüße " * 200000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = {r.doc_id: r for r in mpeg_audio.audio_features(mpeg_audio.store_texts(docs), with_payload=True).collect()}
    for i, t in rows:
        data = (t or "").encode()
        padded = data.ljust(max(1, -(-len(data) // 192)) * 192)
        r = got[i]
        assert bytes(r.payload) == padded and r.n_bytes == len(data) and r.tail_crc32 == zlib.crc32(padded[-16:]) and r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.crc_bad == 0 and r.crc_ok == r.n_frames == r.vbr_frames == len(r.frame_offsets) and r.n_samples == 1152 * r.n_frames
    assert mpeg_audio.store_texts(docs.unionAll(docs)).count() == 10 and mpeg_audio.store_texts(docs.limit(0)).count() == 0


def test_mpeg_resynchronises():
    data = mpeg_audio.encode(b"a" * 192 * 9, 1700)
    clean = mpeg_audio.parse(data)
    assert len(clean["offsets"]) == 3 and clean["table"]["frames"] == 3 and clean["table"]["toc"][0] < clean["table"]["toc"][99]
    cut = clean["offsets"][1]
    noisy = mpeg_audio.parse(data[:cut] + b"\xff\xfb noise \xff" + data[cut:] + b"TAG".ljust(128, b"\0"))
    assert len(noisy["offsets"]) == 3 and noisy["skipped"] == 10 and noisy["crc_bad"] == 0
    broken = bytearray(data)
    broken[cut + 8] ^= 1
    assert mpeg_audio.parse(bytes(broken))["crc_bad"] == 1
    assert mpeg_audio.parse(b"")["offsets"] == [] and mpeg_audio.parse(b"\xff" * 1000)["offsets"] == []


def test_mixing_hits_the_target(spark):
    rows = [(i, None if i % 50 == 0 else "t", "big" if i % 3 else ("mid" if i % 2 else None)) for i in range(6000)] + [(9000 + i, "s", "tiny") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("weight", F.lit("clash"))
    got = {r.source: r["count"] for r in mixing.mix_sources(docs).groupBy("source").count().collect()}
    assert all(abs(n - 6005 / 4) < 200 for n in got.values()) and set(got) == {"big", "mid", None, "tiny"}
    weights = spark.createDataFrame([("big", 3.0), ("tiny", 1.0)], "source string, weight double")
    got = {r.source: r["count"] for r in mixing.mix_sources(docs, weights, 4000).groupBy("source").count().collect()}
    assert set(got) == {"big", "tiny"} and abs(got["big"] - 3000) < 250 and abs(got["tiny"] - 1000) < 150
    twice = mixing.mix_sources(docs)
    assert sorted((r.doc_id, r.copy_no) for r in twice.collect()) == sorted((r.doc_id, r.copy_no) for r in mixing.mix_sources(docs.repartition(13)).collect())
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_text_that_looks_like_a_trailing_tag_keeps_its_frame():
    for units in (1, 2, 3, 4, 5, 7):
        payload = bytearray(b"x" * 192 * units)
        payload[-103:-100] = b"TAG"  # bytes 89-91 of the last unit
        data = mpeg_audio.encode(bytes(payload), len(payload))
        assert mpeg_audio.stored_payload(data, mpeg_audio.parse(data)) == payload, units
        assert units % 4 == 0 or data[-128:-125] == b"TAG"
        tagged = mpeg_audio.parse(data + b"TAG".ljust(128, b"\xff"))
        assert mpeg_audio.stored_payload(data, tagged) == payload and tagged["skipped"] == 0


def tag(version, name, size, body, flags=0):
    frame = name + size + (b"" if version == 2 else b"\0\0") + body
    return b"ID3" + bytes([version, 0, flags]) + mpeg_audio.syncsafe(len(frame)) + frame


def test_tags_of_all_versions():
    text = "x" * 300
    body = b"\0" + text.encode()
    for version, name, size in ((4, b"TIT2", mpeg_audio.syncsafe(301)), (3, b"TIT2", (301).to_bytes(4, "big")), (2, b"TT2", (301).to_bytes(3, "big"))):
        assert mpeg_audio.tag_texts(tag(version, name, size, body) + b"rest") == ({name.decode(): text}, len(tag(version, name, size, body))), version
    wide = tag(3, b"TXXX", (12).to_bytes(4, "big"), b"\3key\0value12")
    assert mpeg_audio.tag_texts(wide)[0] == {"key": "value12"}
    synced = tag(3, b"TALB", (4).to_bytes(4, "big"), b"\0a\xff\0\xe0", 0x80)
    assert mpeg_audio.tag_texts(synced)[0] == {"TALB": "a\xff\xe0"}


def plain_crc(bits):
    crc = 0xFFFF
    for bit in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ bit else 0)) & 0xFFFF
    return crc


def bits_of(data):
    return [byte >> (7 - k) & 1 for byte in data for k in range(8)]


def with_checksum(head, body, covered):
    return head + plain_crc(bits_of(head[2:]) + bits_of(body)[:covered]).to_bytes(2, "big") + body


def test_checksums_of_all_layers():
    rnd = random.Random(2)
    layer1_stereo, layer1_joint = bytes([0xFF, 0xFE, 0xC4, 0x00]), bytes([0xFF, 0xFE, 0xC4, 0x50])  # 384 kbit/s, 48 kHz; joint from subband 8 on
    layer2_stereo, layer2_joint, layer2_mono = bytes([0xFF, 0xFC, 0xA4, 0x00]), bytes([0xFF, 0xFC, 0xA4, 0x50]), bytes([0xFF, 0xFC, 0x84, 0xC0])  # 192 kbit/s, mono 128
    widths = [4] * 11 + [3] * 12 + [2] * 4  # 48 kHz at 56 kbit/s a channel and more
    for head in (layer1_stereo, layer1_joint, layer2_stereo, layer2_joint, layer2_mono):
        h = mpeg_audio.frame_header(head)
        for _ in range(20):
            body = bytes(rnd.choice([0, rnd.randrange(256)]) for _ in range(h.length - 6))
            if h.layer == 1:
                want = {layer1_stereo: 256, layer1_joint: 4 * (2 * 8 + 24)}[head]
            else:
                bits, at, want = bits_of(body), 0, 0
                for band, width in enumerate(widths):
                    joint = head == layer2_joint and band >= 8
                    for _ in range(1 if joint or head == layer2_mono else 2):
                        want += width + 2 * any(bits[at : at + width]) * (2 if joint else 1)
                        at += width
            frame = with_checksum(head, body, want)
            assert len(frame) == h.length and mpeg_audio.covered_bits(h, body) == want
            broken = frame[:6] + bytes([frame[6] ^ 0x80]) + frame[7:]
            assert mpeg_audio.parse(frame * 3)["crc_ok"] == 3 and mpeg_audio.parse(broken * 3)["crc_bad"] == 3


def test_rate_tables_and_exact_durations():
    plain = bytes([0xFF, 0xFB, 0x64, 0xC4]).ljust(240, b"\0")  # 80 kbit/s, 48 kHz, mono, no checksum
    vbri = b"VBRI" + b"".join(n.to_bytes(size, "big") for n, size in ((1, 2), (1105, 2), (75, 2), (5000, 4), (20, 4), (3, 2), (2, 2), (2, 2), (5, 2))) + bytes([0, 10, 0, 20, 1, 0])
    first = bytearray(plain)
    first[36 : 36 + len(vbri)] = vbri
    got = mpeg_audio.parse(bytes(first) + plain * 20)
    assert got["table"] == {"kind": "VBRI", "frames": 20, "bytes": 5000, "toc": [20, 60, 572], "delay": 1105, "padding": 0}
    assert len(got["offsets"]) == 20 and got["samples"] == 20 * 1152 and got["played"] == 20 * 1152 - 1105
    lame = b"Info" + (1).to_bytes(4, "big") + (20).to_bytes(4, "big") + b"LAME3.100".ljust(21, b"\0") + (576 << 12 | 1000).to_bytes(3, "big")
    first = bytearray(plain)
    first[21 : 21 + len(lame)] = lame
    got = mpeg_audio.parse(bytes(first) + plain * 20)
    assert (got["table"]["frames"], got["table"]["delay"], got["table"]["padding"], got["played"]) == (20, 576, 1000, 20 * 1152 - 1576)


def test_columns_pass_and_ids_of_any_type(spark):
    docs = spark.createDataFrame([(f"k{i}", "Mail jane@example.com now", "s", i) for i in range(40)] + [(None, None, None, None)], "doc_id string, text string, source string, mix_rate int").withColumn("mix_source", F.lit("own")).withColumn("mix_count", F.lit(7))
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*docs.columns, "copy_no", "mix_key"] and {(r.mix_source, r.mix_count) for r in mixed.collect()} == {("own", 7)}
    assert {r.doc_id: r.mix_rate for r in mixed.collect() if r.doc_id} == {f"k{i}": i for i in range(40) if f"k{i}" in {r.doc_id for r in mixed.collect()}}
    assert {(r.doc_id, r.n_email) for r in pii.find_pii(docs).collect()} == {(f"k{i}", 1) for i in range(40)} | {(None, 0)}
    texts = [t for _, t in license_scan.TEMPLATES]
    marked = spark.createDataFrame([("a", texts[0]), (None, texts[0]), ("b", "none")], "doc_id string, text string")
    templates = spark.createDataFrame(license_scan.TEMPLATES, "template_id string, text string")
    assert {r.doc_id for r in license_scan.scan_licenses(marked, templates).collect()} == {"a", None}
