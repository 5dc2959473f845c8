import difflib

from pyspark.sql import functions as F

from slotweave.functions import ids
from slotweave.operators import layout, near, quality, resolve, review, score, spatial
from slotweave.sources import ingest


def test_slot_reasons_in_order(spark):
    rows = [(1, " ", "9", "0", "x"), (2, "P", "5", "0", "1"), (3, "P", "1", "0", "1"), (4, "P", "1", "1", "x"), (5, "P", "1", "1", "9"), (6, "P", "2.7", "1", "10")]
    df = quality.slot_reason(quality.typed_slots(spark.createDataFrame(rows, "k int, pog string, side string, row string, col string")))
    assert {r.k: r.reject_reason for r in df.collect()} == {1: "pog", 2: "side", 3: "row", 4: "column", 5: "column_limit", 6: None}


def test_global_rank_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    got = [(r.v, r.k) for r in quality.global_rank(df.repartition(7), "v", "k").collect()]
    assert sorted(got) == [(v, i + 1) for i, v in enumerate(sorted(x for x, _ in got))]


def test_densify_thin_side(spark):
    rows = [("P", 1, 1, 1, "a", 1), ("P", 1, 1, 3, "b", 2), ("P", 1, 1, 3, "c", 3), ("P", 1, 1, 9, "d", 4)]
    df = spark.createDataFrame(rows, "pog string, side long, row long, col long, item_number string, src_ord long")
    got = quality.densify(df, spark.createDataFrame([(1, 6)], "side long, slot_count int")).orderBy("col").collect()
    assert [r.item_number for r in got] == ["a", None, "c", None, None, None]


def test_wide_side_header_row(spark):
    rows = [("P", 2, 1, c) for c in range(1, 10)] + [("P", 2, r, c) for r in range(2, 6) for c in range(1, 9)]
    geometry = spark.createDataFrame([(2, 8, 4, 1)], "side long, slot_count int, expected_rows int, header_rows int")
    r = quality.row_count_check(spark.createDataFrame(rows, "pog string, side long, row long, col long"), geometry).first()
    assert (r.priced_rows, r.header_warning, r.count_warning, r.overflow_rows) == (4, False, False, 0)


def test_cascade_takes_steps_in_order(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, "z", "b"), (3, "z", "z")], "id long, x string, y string")
    index = lambda *kv: spark.createDataFrame(list(kv), "key string, path string")
    got = resolve.cascade(rows, "id", ["x", "y"], [("first", F.array("x"), index(("a", "/1"))), ("second", F.array("y"), index(("b", "/2")))]).collect()
    assert {r.id: (r.path, r.source) for r in got} == {1: ("/1", "first"), 2: ("/2", "second"), 3: (None, "unresolved")}


def product(spark, **over):
    base = {"product": 1, "upc": "19674217114", "item_number": "12345", "t": "PlayStation Store 2 X $25 Gift Card", "brand": "PlayStation"} | over
    return score.prepared_products(spark.createDataFrame([tuple(base.values())], "product long, upc string, item_number string, t string, brand string"), F.col("t"))


def image(spark, **over):
    base = {"entry": 1, "file_path": "/i/x.png", "filename_upc": "", "detected_text": "", "detected_brand": "", "detected_denomination": "", "detected_pack_quantity": ""} | over
    return score.prepared_images(spark.createDataFrame([tuple(base.values())], ", ".join(f"{k} {'long' if k == 'entry' else 'string'}" for k in base)))


def scored(p, i):
    return score.review_scores(p.crossJoin(i)).first()


def test_review_scores(spark):
    p = product(spark)
    assert scored(p, image(spark, filename_upc="19674217114")).identifier_score == 100
    assert scored(p, image(spark, file_path="/i/12345.png")).identifier_score == 90
    r = scored(p, image(spark, detected_text="Xbox 3 X $50"))
    assert (r.brand_score, r.denomination_score, r.pack_score, r.confidence) == (-60, -60, -35, "Low")
    r = scored(p, image(spark, detected_text="PSN 2 X $25"))
    assert (r.brand_score, r.denomination_score, r.pack_score) == (40, 40, 25)


def test_at_most_five_candidates(spark):
    rows = spark.createDataFrame([(1, e, e % 3) for e in range(9)], "product long, entry long, total long")
    got = [(r.candidate_rank, r.entry) for r in score.top_candidates(rows, ["total"]).orderBy("candidate_rank").collect()]
    assert got == [(1, 2), (2, 5), (3, 8), (4, 1), (5, 4)]


def test_two_approvals_in_a_group_reject_both(spark):
    rows = [("g", "TRUE", "yes", "/a.png"), ("g", "1", "selected", "/b.png"), ("h", "y", "y", "/c.png"), ("i", "y", "y", "/d.txt"), ("j", "no", "y", "/e.png")]
    df = spark.createDataFrame(rows, "review_group_id string, approved string, selected string, path string")
    got = review.single_approvals(df, F.endswith("path", F.lit(".png"))).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in got} == {"duplicate": 2, "valid": 1, "bad_path": 1}


def test_upsert_keeps_created(spark):
    old = spark.createDataFrame([("1", "a", "/x", "2020"), ("2", "b", "/y", "2021")], "upc string, item string, path string, created string")
    new = spark.createDataFrame([("1", "a", "/z", "2024"), ("3", "c", "/w", "2024")], "upc string, item string, path string, at string")
    got = {r.upc: (r.path, r.created, r.action) for r in review.upsert(old, new).collect()}
    assert got == {"1": ("/z", "2020", "updated"), "2": ("/y", "2021", "kept"), "3": ("/w", "2024", "added")}


def test_names_by_matching_blocks(spark):
    pairs = [("GIFT CARD", "CARD GIFT"), ("ABC", ""), ("", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", near.name_ratio("a", "b").alias("r")).collect()
    assert all(abs(r.r - difflib.SequenceMatcher(None, r.a, r.b).ratio()) < 1e-12 for r in got)


def test_near_reasons(spark):
    t = spark.createDataFrame([("19674217114",)], "target string")
    i = spark.createDataFrame([("196742171143",), ("19674217115",), ("1967421711477",), ("29674217199",), ("55555555555",)], "image string")
    got = {r.image: r.rule for r in near.near_reasons(t, i).collect()}
    assert got["196742171143"] == 1 and got["19674217115"] == 2 and "55555555555" not in got


def test_running_mean_groups(spark):
    df = spark.createDataFrame([([1.0, 2.0, 9.0, 10.0, 30.0],), ([],), ([5.0],)], "v array<double>")
    c = layout.group_centers(layout.gap_groups(F.col("v"), 3.0))
    got = df.select(c.alias("c"), layout.boundaries(c).alias("b")).collect()
    assert [r.c for r in got] == [[1.5, 9.5, 30.0], [], [5.0]]
    assert got[0].b == [-2.5, 5.5, 19.75, 40.25] and got[1].b == [] and got[2].b == [-45.0, 55.0]


def test_kmeans_against_plain_loop(spark):
    import numpy as np

    v = [1.0, 2.0, 3.0, 50.0, 51.0, 52.0, 200.0, 210.0]
    c = np.quantile(v, (np.arange(3) + 0.5) / 3)
    for _ in range(40):
        g = np.abs(np.array(v)[:, None] - c[None, :]).argmin(axis=1)
        c = np.array([np.array(v)[g == k].mean() if (g == k).any() else c[k] for k in range(3)])
    got = spark.createDataFrame([(v,)], "v array<double>").select(layout.kmeans_centers(F.col("v"), 3).alias("c")).first().c
    assert np.allclose(got, np.sort(c))


def test_greedy_pairs(spark):
    rows = [("p", 1, 1, 1.0), ("p", 1, 2, 0.5), ("p", 2, 2, 0.6), ("p", 2, 1, 3.0), ("q", 1, 1, 2.0)]
    got = spatial.greedy_pairs(spark.createDataFrame(rows, "g string, a int, b int, d double"), "g", "a", "b", "d").collect()
    assert sorted((r.g, r.a, r.b) for r in got) == [("p", 1, 2), ("p", 2, 1), ("q", 1, 1)]


def test_sides_borrow_whole_later_segments(spark):
    sizes = {0: 3, 1: 5, 2: 5, 3: 4, 4: 4, 5: 2, 6: 1}
    rows = [("s", k) for k, n in sizes.items() for _ in range(n)]
    got = {r.segment: r.side for r in layout.sides_of_segments(spark.createDataFrame(rows, "sheet string, segment int")).collect()}
    assert got == {0: "A", 1: "B", 2: "C", 3: "D", 5: "A", 6: "D"}


def test_column_binding():
    aliases = {"side": ["SIDE", "SEGMENT"], "segment": ["MERCHANT SEGMENT", "SEGMENT"], "upc": ["UPC", "UPC 11"]}
    assert ingest.bind_columns(["upc_11", "Segment"], aliases, once=True) == {"side": "Segment", "upc": "upc_11"}
    assert ingest.bind_columns(["Side", "SIDE"], aliases)["side"] == "Side"
    assert ingest.bind_columns(["Side", "SIDE"], aliases, last_wins=True)["side"] == "SIDE"
    assert ingest.unique_headers(["A", "B", "A"]) == ["A", "B", "A_2"]
    assert ingest.pick_column(["x", "My UPC"], ["UPC"], 0) == "My UPC" and ingest.pick_column(["x"], ["UPC"], 3) == "x"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('POG,Side,UPC 11\nP1,1,"19674217114"\n,,\nP2,2,5\n')
    aliases = {"pog": ["POG"], "side": ["SIDE"], "upc": ["UPC", "UPC 11"], "row": ["ROW"]}
    rows, mapping, missing = ingest.read_placements(spark, str(tmp_path / "a.csv"), aliases, ["pog", "row"])
    assert rows.count() == 2 and mapping["upc"] == "UPC 11" and missing == ["row"]
    good, bad = spark.createDataFrame([("P", "1")], "POG string, SIDE string"), spark.createDataFrame([("x",)], "other string")
    both, first, skipped = ingest.union_tables({"good": good, "bad": bad}, aliases, ["pog"])
    assert both.count() == 1 and first == {"pog": "POG", "side": "SIDE"} and skipped == ["bad"]
    assert ingest.select_table({"bad": bad, "good": good}, aliases, ["pog"]) == ("good", "complete schema")
    assert ingest.select_table({"t1": good, "Price Strip Data": good}, aliases, ["pog"]) == ("Price Strip Data", "normalised name")
    raw = spark.createDataFrame([(0, ["x"]), (1, ["UPC", "Description"]), (2, ["1", "2"])], "row_no int, cells array<string>")
    assert raw.limit(1).select(ingest.find_header(raw).alias("h")).first().h == 1
    for name in ("a.PNG", "b.txt", "sub/c.jpeg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    assert ingest.scan_library(spark, str(tmp_path)).count() == 2


def test_incremental_catalog(spark):
    old = spark.createDataFrame([("a", 1, 1, "ok"), ("b", 1, 1, "error"), ("c", 1, 1, "ok")], "path string, size int, mtime int, status string")
    new = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", 1, 1)], "path string, size int, mtime int")
    reuse, process = ingest.split_unchanged(new, old)
    assert [r.path for r in reuse.collect()] == ["a"] and sorted(r.path for r in process.collect()) == ["b", "c", "d"]


def test_match_report_takes_the_first_that_holds(spark):
    """Key before name, name before number; a target with several names counts once."""
    from slotweave.operators import jobs

    placed = [("19674000017", "RED GEAR"), ("19674000017", ""), ("19674000108", "BLUE GEAR CARD"), ("19674009999", "GOLD"), ("555", "")]
    files = [("19674000107", "BLUE GEAR CARD"), ("19674009990", "SILVER"), ("19674009990", "")]
    index = spark.createDataFrame([("00017", "/lib/a.png", 1)], "key string, path string, src_ord int")
    got = jobs.match_report(spark.createDataFrame(placed, "target string, name string"), spark.createDataFrame(files, "image string, known_name string"), index)
    assert {r.upc: r.status for r in got.collect()} == {"19674000017": "FOUND", "19674000108": "FOUND_NEAR", "19674009999": "REVIEW_NUMERIC_NEAR", "555": "MISSING"} and got.count() == 4


def test_global_rank_counts_every_row_of_many_ranges(spark):
    rows = spark.range(300000, numPartitions=6).select(((F.col("id") * 7919) % 300000).alias("ord"), F.repeat(F.col("id").cast("string"), 20).alias("load"))
    small = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    kept = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        ranked = quality.global_rank(rows, "ord", "rank")
        assert ranked.agg(F.count("load"), F.count_if(F.col("rank") != F.col("ord") + 1), F.count_if(F.length("load") > 120)).first() == (300000, 0, 0)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def broadcasts(df) -> bool:
    return "BroadcastExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_lookup_does_not_broadcast_the_index(spark, tmp_path):
    spark.range(50).selectExpr("id AS src_ord", "concat('/lib/', 19674000000 + 7 * id, '.png') AS path").write.parquet(f"{tmp_path}/files")
    index = resolve.key_index(spark.read.parquet(f"{tmp_path}/files"), ids.filename_keys("path"))
    rows = spark.createDataFrame([(1, "19674000007"), (2, "19674000014"), (2, "x"), (3, None), (4, "5")], "k int, upc string")
    got = resolve.lookup(rows, "k", "upc", ids.identifier_keys("upc"), index)
    assert sorted((r.k, r.path) for r in got.collect()) == [(1, "/lib/19674000007.png"), (2, "/lib/19674000014.png")]
    assert not broadcasts(got)


def test_near_joins_do_not_broadcast_exploded_keys(spark, tmp_path):
    spark.range(40).selectExpr("concat('/lib/', 19674000000 + 7 * id, ' RED CARD.png') AS path").write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files").select(F.explode(F.regexp_extract_all("path", F.lit("([0-9]{5,14})"), 1)).alias("image"), F.lit("RED CARD").alias("known_name")).distinct()
    wanted = spark.createDataFrame([("19674000007", "RED CARD")], "target string, name string")
    for got in (near.near_reasons(wanted.select("target"), files.select("image")), near.numeric_near(wanted.select("target"), files.select("image")), near.scored_near_pairs(wanted, files, near.edit_ratio)):
        assert got.filter("target = image").count() <= 1 and not broadcasts(got)


def counting(spark):
    """A similarity that counts the pairs it is asked."""
    asked = spark.sparkContext.accumulator(0)

    def ratio(a, b):
        asked.add(1)
        return difflib.SequenceMatcher(None, a, b).ratio()

    return F.udf(ratio, "double").asNondeterministic(), asked


def test_products_of_equal_names_are_compared_once(spark):
    similarity, asked = counting(spark)
    products = spark.createDataFrame([("00001", k, "RED CARD" if k % 2 else "BLUE CARD") for k in range(100)], "last5 string, src_ord long, norm_name string")
    rows = spark.createDataFrame([(1, "00001", "RED CARDS"), (2, "00001", "BLUE"), (3, "00002", "RED"), (4, "00001", None)], "row_id int, last5 string, name string").filter("row_id < 4")
    got = {r.row_id: r.src_ord for r in near.best_of_key(rows, products, similarity).collect()}
    assert got == {1: 1, 2: 0, 3: None} and asked.value == 4


def test_suggestions_keep_near_images_past_the_first_names(spark):
    files = [(str(19674000000 + 7000 * k), "RED CARD") for k in range(30)] + [("19674900001", "RED CARD"), ("19674900005", "BLUE CARDS")]
    missing = spark.createDataFrame([("19674900009", "RED CARDS"), ("19999999999", "RED CARDS")], "target string, name string")
    numeric = spark.createDataFrame([], "target string, image string")
    got = near.suggested_aliases(missing, spark.createDataFrame(files, "image string, known_name string"), numeric, near.edit_ratio).collect()
    mine = {t: sorted((-r.confidence, r.image_name, r.suggested, r.reason) for r in got if r.current == t) for t in ("19674900009", "19999999999")}
    assert all(len(v) == 5 for v in mine.values())
    # equal confidence (a contained name, 0.88): the first identifiers; the near one differs only in its reason
    assert [x[2] for x in mine["19999999999"]] == [i for i, _ in sorted(files)[:5]]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_repeated_products_carry_only_what_is_read(spark):
    rows = [("19674000001", "B c", "7", 5), ("19674000001", None, "8", 2), ("4711", "x", "1", 1)]
    got = ingest.load_matrix11(spark.createDataFrame(rows, "upc string, name string, cpp string, src_ord long"), "upc", "name", "cpp")
    assert [tuple(r) for r in got.select("last5", "upc12", "src_ord", "norm_name", "cpp").collect()] == [("00001", "019674000001", 2, "", 8)]
    assert "display_name" not in plan_of(got.select("last5", "upc12", "src_ord", "norm_name"))


def test_files_are_dealt_before_their_keys_are_exploded(spark):
    files = spark.createDataFrame([(2, "/b/0123.png"), (1, "/a/123.png")], "src_ord long, path string").coalesce(1)
    got = resolve.key_index(files, ids.filename_keys("path"))
    assert {r.key: (r.path, r.conflicts) for r in got.collect()}["123"] == ("/a/123.png", 1)
    plan = plan_of(got)
    assert "RepartitionByExpression" in plan and plan.index("Generate") < plan.index("RepartitionByExpression"), plan


def test_images_are_dealt_before_they_are_prepared(spark):
    one = spark.createDataFrame([(1, "/a/x.png", "", "Xbox $10", "", "", "")], "entry long, file_path string, filename_upc string, detected_text string, detected_brand string, detected_denomination string, detected_pack_quantity string")
    assert "RepartitionByExpression" in plan_of(score.inverted_index(score.prepared_images(one.coalesce(1))))


def test_best_products_go_to_the_rows(spark):
    """Very many rows have few different names: the rows are not sorted by them, whatever Spark takes the names for."""
    products = spark.createDataFrame([("00001", k, f"CARD {k}") for k in range(9)], "last5 string, src_ord long, norm_name string")
    rows = spark.range(1000).selectExpr("id AS row_id", "'00001' AS last5", "concat('CARD ', id % 10) AS name")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = near.best_of_key(rows, products, near.edit_ratio)
        plan = got._jdf.queryExecution().executedPlan().toString()
        found = {(r.row_id % 10, r.src_ord) for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert found == {(k, k) for k in range(9)} | {(9, 0)}
    assert "Sort" not in plan and "hashpartitioning" not in plan, plan


def test_more_names_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(near, "BROADCAST_NAMES", 1)
    products = spark.createDataFrame([("00001", 1, "RED"), ("00001", 2, "BLUE")], "last5 string, src_ord long, norm_name string")
    rows = spark.createDataFrame([(1, "00001", "REDS"), (2, "00001", "BLUE"), (3, "00002", "RED"), (4, None, "RED")], "row_id int, last5 string, name string")
    assert {r.row_id: r.src_ord for r in near.best_of_key(rows, products, near.edit_ratio).collect()} == {1: 1, 2: 2, 3: None, 4: None}


def test_only_the_chosen_planograms_rows_are_compared(spark, monkeypatch):
    from slotweave.operators import jobs

    text_columns = ["item_number", "intentional_blank", "image_status", "merchant_category", "segment", "brand", "desc_1", "desc_2", "description", "retail", "cpp"]
    schema = "src_ord long, pog string, side string, row string, col string, upc string, " + ", ".join(f"{c} string" for c in text_columns)
    row = lambda k, pog, side, col, upc: (k, pog, side, "1", col, upc, *["x"] * len(text_columns))
    rows = spark.createDataFrame([row(3, "B", "1", "1", "7"), row(1, " B", "1", "1", "8"), row(2, "B", "1", "2", "9"), row(4, "A", "1", "1", "7"), row(5, "A", "9", "1", "7"), row(6, "", "1", "1", "7"), row(7, "AA", "7", "1", "7")], schema)
    index = spark.createDataFrame([("7", "/7.png"), ("8", "/8.png")], "key string, path string")
    steps, compared, whole = [("library", F.array("upc"), index)], [], jobs.q.first_per_key
    monkeypatch.setattr(jobs.q, "first_per_key", lambda df, *a: compared.append({r.pog for r in df.select("pog").distinct().collect()}) or whole(df, *a))
    got = lambda pog: sorted((r.src_ord, r.col, r.status, r.path) for r in jobs.build_planogram(rows, ["upc"], steps, steps, pog).collect())
    assert got("B") == [(1, 1, "resolved", "/8.png"), (2, 2, "unresolved", None)] and got("AA") == got(None) == [(4, 1, "resolved", "/7.png")]
    assert compared == [{"B"}, {"A"}, {"A"}]
