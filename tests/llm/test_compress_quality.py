import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from slotweave.llm import compress_quality as q


def corpus(n, seed=5):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeiou") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    for i in range(n):
        good = rnd.random() < 0.7
        text = " ".join(rnd.choice(words) + ("" if good else rnd.choice(["***", "!!", " |"])) for _ in range(rnd.randint(40, 400)))
        yield i, text, int(good)


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_quality_held_out_and_odd_rows(spark):
    rows = list(corpus(600))
    odd = [(None, "abc"), (1001, None), (1002, ""), (1003, "x"), (1004, "!! ** " * 300000), (0, rows[0][1]), (0, rows[0][1])]
    docs = spark.createDataFrame([r[:2] for r in rows] + odd, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("quality", F.lit(1)).repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (7, 9), (99999, 0)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    got = q.score_quality(docs, labels).collect()
    assert len(got) == len(rows) + len(odd)
    truth = {i: y for i, _, y in rows}
    right = [r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth and held_out(r.doc_id)]
    assert len(right) > 150 and np.mean(right) >= 0.97
    by = {r.doc_id: r for r in got}
    for r in got:
        assert r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    assert by[1001].score == by[1002].score and by[1001].n_bytes == 0 and by[1004].n_bytes == 1800000
    assert len({r.score for r in got if r.doc_id == 0}) == 1


def test_labels_of_held_out_documents_change_nothing(spark):
    rows = list(corpus(300, 6))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    true, lies = ([(i, y if not (lie and held_out(i)) else 1 - y) for i, _, y in rows] for lie in (False, True))
    a, b = (q.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (true, lies))
    assert a == b and len(a.good) > 1000 and a.slope > 0


def test_sizes_and_scores_by_plain_code(spark):
    rows = list(corpus(300, 7)) + [(1000, "ä" * 3000, 1), (1001, None, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    model = q.train(docs, labels)
    got = {r.doc_id: r for r in q.score_quality(docs, labels).collect()}
    for i, text, _ in rows:
        data, sizes = (text or "").encode(), []
        for d in (model.bad, model.good):
            c = zstandard.ZstdCompressor(level=q.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[k : k + q.BLOCK])) for k in range(0, len(data), q.BLOCK)))
        assert abs(got[i].size_bad - sizes[0]) <= 0.02 * sizes[0] + 4 and abs(got[i].size_good - sizes[1]) <= 0.02 * sizes[1] + 4
        x = (got[i].size_bad - got[i].size_good + q.PRIOR_BYTES * model.mean) / (len(data) + q.PRIOR_BYTES)
        assert abs(got[i].score - 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -30, 30)))) < 1e-9


def test_little_to_learn_from(spark):
    docs = spark.createDataFrame([("a", "some text"), ("b", "***"), (None, None)], "doc_id string, text string")
    none = spark.createDataFrame([], "doc_id string, quality int")
    assert {r.score for r in q.score_quality(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "doc_id string, quality int")
    assert all(r.score > 0.5 for r in q.score_quality(docs, one).collect())
    both = spark.createDataFrame([(str(k), "good words here" if k % 2 else "*** !!! ###") for k in range(60)], "doc_id string, text string")
    marks = spark.createDataFrame([(str(k), k % 2) for k in range(60)], "doc_id string, quality int")
    assert all(r.predicted == int(r.doc_id) % 2 for r in q.score_quality(both, marks).collect())
    assert q.score_quality(docs.limit(0), one).count() == 0


def test_calibration_is_the_likelihood_maximum():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=4000)
    y = (rnd.random(4000) < 1 / (1 + np.exp(-(3 * x - 1)))).astype(int)
    slope, offset = q.calibrated(x, y, np.ones(4000))
    assert abs(slope - 3) < 0.3 and abs(offset + 1) < 0.2
    slope, offset = q.calibrated(np.sign(x), (x > 0).astype(int), np.ones(4000))
    assert slope > 5
