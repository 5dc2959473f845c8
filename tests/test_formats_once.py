from slotweave.operators import quality
from slotweave.plans.scalar_queries import b26_b28_display_formats


def test_price_is_worked_out_once_a_row(spark):
    plan = b26_b28_display_formats(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("bround") == 1
    assert plan.count("[xX") == 4  # width and height, each as a condition and a value


def test_cards_of_strips_are_shuffled_once(spark):
    rows = [("P", 1, 1, k, 10 * k, str(k), "$1", footer, length) for k, (footer, length) in enumerate([("", None), ("A", "2 x 1"), (" A ", "2 x 1"), ("B", None)], 1)]
    rows += [("P", 1, 2, 1, 7, "7", "$2", None, "")]
    df = spark.createDataFrame(rows, "pog string, side long, row long, col long, src_ord long, item_number string, retail string, footer string, length string")
    out = quality.strip_groups(df)
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.row: (r.n_cards, r.footer, r.footer_conflict, r.length_state) for r in out.collect()}
    assert got == {1: (4, "A", True, "ok"), 2: (1, "Side: 1, Row: 2 - POG: P", False, "missing")}
