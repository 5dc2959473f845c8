from pyspark.sql import functions as F

from slotweave.functions import ids, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first().x


def test_check_digits(spark):
    for body, digit in (("19674217114", "3"), ("19674217113", "6"), ("19674208510", "5"), ("123", "")):
        assert one(spark, body, ids.check_digit(F.col("v"))) == digit
    assert one(spark, "19674217114", ids.calculated_upc12("v")) == "196742171143"
    assert one(spark, "19674217114.0", ids.digits_only("v")) == "19674217114"
    assert one(spark, None, ids.digits_only("v")) == ""


def test_identifier_keys(spark):
    keys = one(spark, "087458605402", ids.identifier_keys("v"))
    assert keys[:2] == ["087458605402", "87458605402"] and "08745860540" in keys
    assert one(spark, "19674217114", ids.identifier_keys("v")) == ["19674217114", "196742171143"]
    assert one(spark, "", ids.identifier_keys("v")) == []


def test_padding_never_truncates(spark):
    assert one(spark, "1234567890123", ids.coerce_upc12("v")) == "1234567890123"
    assert one(spark, "42", ids.coerce_upc12("v")) == "000000000042"
    assert one(spark, "2.7", ids.as_int("v")) == 2
    assert one(spark, "x", ids.as_int("v")) is None


def test_denominations_and_packs(spark):
    assert one(spark, "PSN 2 X $25 Gift", text.denomination("v")) == "2 X $25"
    assert one(spark, "$25-$500", text.denomination("v")) == "$25"  # a hyphen is gone before the range is looked for
    assert one(spark, "$25 TO $50", text.denomination("v")) == "$25-$50"
    assert one(spark, "$1000", text.denomination("v")) == ""
    assert one(spark, "$25.00", text.denomination("v")) == "$25"
    assert one(spark, "$5", text.pack("v")) == "5"
    assert one(spark, "3 PK", text.pack("v")) == "3"
    assert one(spark, "$60 card", text.catalog_denomination("v")) == ""
    compatible = text.denomination_compatible(F.lit("$25-$50"), F.col("v"))
    assert one(spark, "$30", compatible) and not one(spark, "$60", compatible)


def test_brands(spark):
    assert one(spark, "PSN Store", text.brand("v")) == "PLAYSTATION"
    assert one(spark, "Applebee's card", text.brand("v")) == "APPLEBEES"
    assert one(spark, "Foo bar", text.brand("v")) == "FOO"
    assert one(spark, "Olive Garden", text.ocr_brand("v")) == "DARDEN"
    assert one(spark, "Foo bar", text.catalog_brand("v")) == ""


def test_prices(spark):
    parts = lambda v: tuple(one(spark, v, text.price_parts("v")))
    assert parts("$1,234.5") == ("1234", "50") and parts("") == ("-", "00") and parts("12x45") == ("12", "45") and parts("free") == ("free", "00")
    assert one(spark, "9.5", text.retail_format("v")) == "$9.50" and one(spark, "call", text.retail_format("v")) == "$call"
    assert one(spark, "6.0", text.cpp_format("v")) == "CPP 6" and one(spark, "", text.cpp_format("v")) == "CPP -"


def test_labels(spark):
    rows = [(1, "Foo Card\nWM\nGIFT\nCARD\n12345\n6"), (2, "GIFT\nCARD\n12345"), (3, None)]
    got = {r.k: (r.name, r.last5, r.qty) for r in text.parse_labels(spark.createDataFrame(rows, "k int, l string"), "l").collect()}
    assert got == {1: ("Foo Card", "12345", 6), 2: ("GIFT CARD", "12345", None), 3: ("", "", None)}
    assert one(spark, "The $25 card for you 3", text.compact_name("v")) == "$25 card you 3"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shared_parts_of_expressions_are_worked_out_once(spark):
    """nullif gave every copy of first_filled a name of its own: the normal form stood in the plan once for each phrase."""
    df = spark.createDataFrame([(" ", "x box 2 X $10"), ("Door_Dash", None)], "a string, b string")
    plan = plan_of(df.select(text.brand(text.first_filled("a", "b")).alias("x")))
    assert "_common_expr_" not in plan
    assert [r[0] for r in df.select(text.brand(text.first_filled("a", "b"))).collect()] == ["X", "DOORDASH"]
    assert [r[0] for r in df.select(text.joined("a", "b")).collect()] == ["x box 2 X $10", "Door_Dash"]
    plan = plan_of(df.select(ids.identifier_keys("a").alias("x")))
    assert plan.count(r"\.0$") == 1, plan


def test_normal_forms_join_runs(spark):
    df = spark.createDataFrame([(" $25 . 00_a--B\u00e9c!",), ("...",), (None,)], "a string")
    rows = [tuple(r) for r in df.select(text.normalize_text("a"), text.normalize_lower("a"), text.norm_name("a")).collect()]
    assert rows == [("$25 A B C", "$25 00 a b c", "25 00 A B C"), ("", "", ""), ("", "", "")]


def folded(lines):
    """Lines without the placeholder, one after the other."""
    kept, held, word = [], [], ""
    for line in lines:
        token = "".join(c for c in line.upper() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
        joined = word + token
        if token not in ("WM", "GIFT", "GIFTCARD", "GIFTCA", "CARD", "RD"):
            kept, held, word = [*kept, *held, line], [], ""
        elif joined == "WMGIFTCARD":
            held, word = [], ""
        elif "WMGIFTCARD".startswith(joined):
            held, word = [*held, line], joined
        else:
            kept, held, word = [*kept, *held, line], [], ""
    return kept + held


def test_placeholder_runs_as_read_line_by_line(spark):
    import itertools
    import random

    draw = random.Random(7)
    words = ["WM", "w-m", "Gift", "GIFT", "GiftCard", "gift ca", "CARD", "Card!", "RD", "x", "-", "WMGIFTCARD", "5"]
    rows = [list(x) for n in range(5) for x in itertools.product(["WM", "GIFT", "GIFTCARD", "GIFTCA", "CARD", "RD", "x"], repeat=n)] + [[draw.choice(words) for _ in range(draw.randint(5, 14))] for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, l array<string>")
    got = {r.k: r.x for r in df.select("k", text.without_placeholder(F.col("l")).alias("x")).collect()}
    assert [got[k] for k in range(len(rows))] == [folded(x) for x in rows]
    assert sum(folded(x) != x for x in rows) > 100


def test_lines_are_not_folded_at_every_label(spark):
    """A fold took the letters of each line five times over; without the placeholder's letters in a row nothing is taken."""
    plan = plan_of(text.parse_labels(spark.createDataFrame([("a",)], "l string"), "l"))
    assert "aggregate(" not in plan and plan.count("[^A-Z0-9],") == 1, plan
