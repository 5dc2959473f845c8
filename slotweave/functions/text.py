"""Text columns: normal forms, brands, denominations, packs, tokens, prices, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import digits_only, text

# Brands and the phrases that mean them, in matching order.
BRANDS = [
    ("PLAYSTATION", ["PLAYSTATION", "PSN", "PS"]),
    ("XBOX", ["XBOX"]),
    ("APPLEBEES", ["APPLEBEE", "APPLEBEES", "APPLEBEE S"]),
    ("MCDONALDS", ["MCDONALD", "MCDONALDS", "MCDONALD S"]),
    ("DUNKIN", ["DUNKIN", "DUNKIN DONUTS"]),
    ("AMC", ["AMC"]),
    ("NINTENDO", ["NINTENDO"]),
    ("ROBLOX", ["ROBLOX"]),
    ("STEAM", ["STEAM"]),
    ("VISA", ["VISA"]),
    ("MASTERCARD", ["MASTERCARD", "MASTER CARD"]),
    ("DISNEY", ["DISNEY"]),
    ("STARBUCKS", ["STARBUCKS"]),
    ("PANERA", ["PANERA"]),
    ("OUTBACK", ["OUTBACK"]),
    ("DOORDASH", ["DOORDASH", "DOOR DASH"]),
    ("UBER", ["UBER"]),
    ("BUFFALO WILD WINGS", ["BUFFALO WILD WINGS", "BWW"]),
    ("TEXAS ROADHOUSE", ["TEXAS ROADHOUSE"]),
]
OCR_BRANDS = [(b, [a for a in names if a not in ("PS", "APPLEBEE S", "MCDONALD S")]) for b, names in BRANDS] + [("DARDEN", ["DARDEN", "OLIVE GARDEN"])]
CATALOG_BRANDS = [(b.lower(), [a.lower() for a in names if a not in ("APPLEBEE S", "MCDONALD S")]) for b, names in BRANDS]
# Words and amounts that results must agree on.
GENERIC_TOKENS = ["GIFT", "CARD", "CARDS", "HOLIDAY", "DIGITAL", "EGIFT", "VALUE", "VARIABLE", "ASSORTED", "ONLINE", "EXCHANGE", "BARCODE"]
LEGACY_STOP = ["gift", "card", "cards", "digital", "egift", "the", "and", "for", "with"]
NAME_STOP = ["A", "AN", "AND", "FOR", "IN", "OF", "ON", "OR", "THE", "TO", "WITH"]
TRUE_WORDS = ["TRUE", "YES", "Y", "1"]
TRUE_REVIEW_WORDS = [*TRUE_WORDS, "APPROVED", "SELECTED"]
CATALOG_AMOUNTS = [5, 10, 15, 20, 25, 30, 40, 45, 50, 75, 100]


def runs_of(c: Column, pattern: str) -> Column:
    """The runs of letters that the pattern takes; finding them costs a third of replacing all that stands between them."""
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def norm_name(c: Column | str) -> Column:
    return F.array_join(runs_of(F.upper(text(c)), "[A-Z0-9]+"), " ")


def norm_header(c: Column | str) -> Column:
    h = F.regexp_replace(F.regexp_replace(F.upper(text(c)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(h == "", "COL").otherwise(h)


def compact_header(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[_-]", " "), " +", "")


def words_of_text(c: Column | str) -> Column:
    t = F.regexp_replace(F.replace(F.upper(text(c)), F.lit("_"), F.lit(" ")), r"\$([0-9]+)\s*\.\s*00\b", r"\$$1")
    return runs_of(t, "[A-Z0-9$]+")


def words_of_lower(c: Column | str) -> Column:
    return runs_of(F.lower(text(c)), "[a-z0-9$]+")


def normalize_text(c: Column | str) -> Column:
    """Upper case; _ as space; $N.00 as $N; letters, digits and $ only, single-spaced."""
    return F.array_join(words_of_text(c), " ")


def normalize_lower(c: Column | str) -> Column:
    return F.array_join(words_of_lower(c), " ")


def classify_text(c: Column | str) -> Column:
    """Upper case; _ as space; single-spaced; punctuation kept."""
    return F.trim(F.regexp_replace(F.replace(F.upper(text(c)), F.lit("_"), F.lit(" ")), r"\s+", " "))


def truthy(c: Column | str) -> Column:
    return classify_text(c).isin(TRUE_WORDS)


def truthy_review(c: Column | str) -> Column:
    return normalize_text(c).isin(TRUE_REVIEW_WORDS)


def has_phrase(padded: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(padded, F.lit(f" {p} "))
    return out


def first_word(c: Column) -> Column:
    return F.element_at(F.split(c, " "), 1)


def _brand(norm: Column, table: list, last: Column) -> Column:
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    out = F.when(has_phrase(padded, table[0][1]), table[0][0])
    for brand, phrases in table[1:]:
        out = out.when(has_phrase(padded, phrases), brand)
    return out.otherwise(last)


def brand(c: Column | str) -> Column:
    """The brand whose phrase stands in the text as whole words; else the first word."""
    n = normalize_text(c)
    return _brand(n, BRANDS, first_word(n))


def ocr_brand(c: Column | str) -> Column:
    n = normalize_text(c)
    return _brand(n, OCR_BRANDS, first_word(n))


def catalog_brand(c: Column | str) -> Column:
    return _brand(normalize_lower(c), CATALOG_BRANDS, F.lit(""))


def legacy_brand(c: Column | str) -> Column:
    """Catalog brand; else one whose name or phrase is anywhere inside the text; else the first word."""
    n = normalize_lower(c)
    inside = None
    for b, phrases in CATALOG_BRANDS:
        hit = F.contains(n, F.lit(b))
        for p in phrases:
            hit = hit | F.contains(n, F.lit(p))
        inside = F.when(hit, b) if inside is None else inside.when(hit, b)
    found = catalog_brand(c)
    return F.when(found != "", found).otherwise(inside.otherwise(first_word(n)))


def denomination(c: Column | str) -> Column:
    """$A-$B of 'A TO B', else 'N X $A', else $A; amounts of at most three digits."""
    n = normalize_text(c)
    span, multi, one = r"\$([0-9]{1,3})\s*(?:TO|-)\s*\$?([0-9]{1,3})", r"\b([23456])\s*X\s*\$?([0-9]{1,3})\b", r"\$([0-9]{1,3})\b"
    g = lambda p, k: F.regexp_extract(n, p, k)
    return (
        F.when(n.rlike(span), F.concat(F.lit("$"), g(span, 1), F.lit("-$"), g(span, 2)))
        .when(n.rlike(multi), F.concat(g(multi, 1), F.lit(" X $"), g(multi, 2)))
        .when(n.rlike(one), F.concat(F.lit("$"), g(one, 1)))
        .otherwise("")
    )


def catalog_denomination(c: Column | str) -> Column:
    n = normalize_lower(c)
    span, multi = r"\$([0-9]{1,3})\s*\$?\s*(?:to|-)\s*\$?([0-9]{1,3})", r"\b([234])\s*x\s*\$?([0-9]{1,3})\b"
    one = rf"\$({'|'.join(map(str, CATALOG_AMOUNTS))})\b"
    g = lambda p, k: F.regexp_extract(n, p, k)
    return (
        F.when(n.rlike(span), F.concat(F.lit("$"), g(span, 1), F.lit("-$"), g(span, 2)))
        .when(n.rlike(multi), F.concat(g(multi, 1), F.lit(" x $"), g(multi, 2)))
        .when(n.rlike(one), F.concat(F.lit("$"), g(one, 1)))
        .otherwise("")
    )


def _pack(n: Column, multi: str, pack: str) -> Column:
    return F.when(n.rlike(multi), F.regexp_extract(n, multi, 1)).when(n.rlike(pack), F.regexp_extract(n, pack, 1)).otherwise("")


def ocr_pack(c: Column | str) -> Column:
    return _pack(normalize_text(c), r"\b([23456])\s*X\s*\$?[0-9]{1,3}\b", r"\b([23456])\s*(?:PACK|PK)\b")


def catalog_pack(c: Column | str) -> Column:
    return _pack(normalize_lower(c), r"\b([234])\s*x\s*\$?[0-9]{1,3}\b", r"\b([234])\s*(?:pack|pk)\b")


def pack(c: Column | str) -> Column:
    """ocr_pack; else the only digit of the whole value."""
    found, d = ocr_pack(c), digits_only(c)
    return F.when(found != "", found).when(F.length(d) == 1, d).otherwise("")


def pack_field(c: Column | str) -> Column:
    """A value of one digit as it is; else ocr_pack."""
    d = digits_only(c)
    return F.when(F.length(d) == 1, d).otherwise(ocr_pack(c))


def useful_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(words_of_text(c), lambda t: (F.length(t) >= 3) & ~t.isin(GENERIC_TOKENS) & ~t.rlike("^[0-9]+$")))


def legacy_tokens(c: Column | str) -> Column:
    return F.array_distinct(F.filter(words_of_lower(c), lambda t: (F.length(t) >= 4) & ~t.isin(LEGACY_STOP) & ~t.rlike("^[0-9]+$")))


def filled(columns: tuple[Column | str, ...]) -> Column:
    """The values that are not blank; not by nullif, whose copies in one expression are not seen to be equal and are all worked out."""
    return F.array_remove(F.array(*[text(c) for c in columns]), "")


def joined(*columns: Column | str) -> Column:
    """Non-blank values joined by a space."""
    return F.array_join(filled(columns), " ")


def first_filled(*columns: Column | str) -> Column:
    return F.coalesce(F.get(filled(columns), F.lit(0)), F.lit(""))


def retail_format(c: Column | str) -> Column:
    t = text(c)
    amount = F.trim(F.translate(t, "$,", "")).try_cast("double")
    return F.when(t == "", "-").when(amount.isNotNull(), F.format_string("$%.2f", amount)).when(F.startswith(t, F.lit("$")), t).otherwise(F.concat(F.lit("$"), t))


def cpp_format(c: Column | str) -> Column:
    t = text(c)
    amount = F.replace(t, F.lit(",")).try_cast("double")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", amount), "0+$", ""), r"\.$", "")
    return F.concat(F.lit("CPP "), F.when(t == "", "-").when(amount.isNull(), t).when(amount == F.floor(amount), F.floor(amount).cast("string")).otherwise(short))


def price_amount(c: Column | str) -> Column:
    """The number of a price, half-even to two places; null where it is none."""
    n = F.trim(F.translate(text(c), "$,", ""))
    return F.when(n.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$"), F.bround(n.try_cast("decimal(38,10)"), 2).cast("decimal(18,2)"))


def price_parts(c: Column | str, amount: Column | None = None) -> Column:
    """struct(dollars, cents) of a price; half-even cents; digits of anything else, the last two as cents.

    amount: price_amount as a column of its own, for callers that take both parts of many rows.
    """
    t = text(c)
    n = F.trim(F.translate(t, "$,", ""))
    amount = price_amount(c) if amount is None else amount
    whole = F.when(amount >= 0, F.floor(amount)).otherwise(F.ceil(amount)).cast("long")
    cents = F.lpad(F.abs((amount - whole) * 100).cast("int").cast("string"), 2, "0")
    d = F.regexp_replace(n, "[^0-9]", "")
    dollars = F.when(t == "", "-").when(amount.isNotNull(), whole.cast("string")).when(F.length(d) >= 3, F.expr("''")).otherwise(F.when(d != "", d).otherwise(F.coalesce(F.nullif(n, F.lit("")), F.lit("-"))))
    dollars = F.when((t != "") & amount.isNull() & (F.length(d) >= 3), F.substring(d, F.lit(1), F.length(d) - 2)).otherwise(dollars)
    small = F.when(t == "", "00").when(amount.isNotNull(), cents).when(F.length(d) >= 3, F.right(d, F.lit(2))).otherwise("00")
    return F.struct(dollars.alias("dollars"), small.alias("cents"))


def strip_length(c: Column | str) -> Column:
    """struct(width, height) in inches of 'W x H'; null unless both are above zero."""
    pattern = "([0-9]+(?:\\.[0-9]+)?)\\s*\"?\\s*[xX×]\\s*([0-9]+(?:\\.[0-9]+)?)\\s*\"?"
    w, h = (F.regexp_extract(text(c), pattern, k).try_cast("double") for k in (1, 2))
    return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))


def important_token(t: Column) -> Column:
    u = F.upper(F.trim(t))
    unit = u.rlike("[0-9]") & u.rlike("PK|CT|OZ|LB|MG|ML")
    return (u != "") & ((F.contains(u, F.lit("$")) & u.rlike("[0-9]")) | u.rlike("^[0-9]{1,3}$") | unit | u.rlike("^[A-Z][0-9]{1,3}$"))


def compact_name(c: Column | str) -> Column:
    """Name without stop words; important tokens that went with them come back at the end."""
    tokens = F.filter(F.split(F.regexp_replace(text(c), r"\s+", " "), " "), lambda t: t != "")
    core = F.filter(tokens, lambda t: ~F.upper(t).isin(NAME_STOP))
    use = F.when(F.size(core) > 0, core).otherwise(tokens)
    more = F.array_distinct(F.filter(tokens, lambda t: important_token(t) & ~F.array_contains(use, t)))
    return F.array_join(F.concat(use, more), " ")


def name_from_filename(stem: Column) -> Column:
    """Upper-case words of a file stem without the word UPC, long digit runs, parentheses and prices."""
    t = F.regexp_replace(stem, r"[_\-]+", " ")
    for pattern in (r"(?i)\bUPC\b", r"[0-9]{5,14}", r"\([^)]*\)", r"\$?[0-9]+(?:\.[0-9]{2})?", r"[^A-Za-z0-9 ]+", r"\s+"):
        t = F.regexp_replace(t, pattern, " ")
    return F.upper(F.trim(t))


PLACEHOLDER = "WMGIFTCARD"
#: Lines that the placeholder is read in, with a letter for each.
PLACEHOLDER_PARTS = {"WM": "W", "GIFT": "G", "GIFTCARD": "F", "GIFTCA": "A", "CARD": "C", "RD": "R"}


def without_placeholder(lines: Column) -> Column:
    """Lines without runs whose letters join to the placeholder; runs that break off are kept with the line that ends them.

    Where the placeholder's letters stand in a row, lines become one letter each (- for
    those that are no part), and runs of three and of two letters are marked from left to
    right. The column is read several times: let it be one of its own.
    """
    token = lambda x: F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")
    letters = F.create_map(*[F.lit(x) for part in PLACEHOLDER_PARTS.items() for x in part])
    codes = F.array_join(F.transform(lines, lambda x: F.coalesce(F.try_element_at(letters, token(x)), F.lit("-"))), "")
    # what stands before the run: broken runs and single lines, never taken apart again
    before = lambda run: rf"\G((?>(?!{run})(?:W[GA].|W.|.))*+)"
    marked = F.regexp_replace(codes, before("WGC|WAR") + "(?:WGC|WAR)", "$1___")
    marked = F.regexp_replace(marked, before("WF") + "WF", "$1__")
    rest = F.flatten(F.transform(F.array(marked), lambda m: F.filter(lines, lambda x, i: F.substring(m, i + 1, F.lit(1)) != "_")))  # marked once, not for each line
    return F.when(F.upper(F.array_join(lines, "\n")).rlike("[^A-Z0-9]*".join(PLACEHOLDER)), rest).otherwise(lines)


def parse_labels(df: DataFrame, label: str) -> DataFrame:
    """Adds name, last5, qty: lines that hold neither number, first five-digit word, last word of 1-3 digits.

    Each step is a column of its own, so that no fold runs again inside another's lambda.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(label, F.lit("")), "\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    keep = lambda x: ~((F.col("last5") != "") & F.contains(x, F.col("last5"))) & ~(F.col("_qty").isNotNull() & (x == F.col("_qty")))
    return (
        df.withColumn("_all", lines)
        .withColumn("_lines", without_placeholder(F.col("_all")))
        .withColumn("_whole", F.array_join("_lines", " "))
        .withColumn("last5", F.regexp_extract("_whole", r"\b([0-9]{5})\b", 1))
        .withColumn("qty", F.try_element_at(F.regexp_extract_all("_whole", F.lit(r"\b([0-9]{1,3})\b"), 1), F.lit(-1)).cast("int"))
        .withColumn("_qty", F.col("qty").cast("string"))
        .withColumn("name", F.trim(F.array_join(F.filter("_lines", keep), " ")))
        .drop("_all", "_lines", "_whole", "_qty")
    )


def side_letter(c: Column | str) -> Column:
    """A-D of 'SIDE X', or of a bare letter."""
    u = F.upper(text(c))
    said = F.regexp_extract(u, r"\bSIDE\s*([A-D])\b", 1)
    return F.when(said != "", said).when(u.rlike("^[A-D]$"), u).otherwise("")


def denomination_compatible(a: Column, b: Column) -> Column:
    """Equal, or one a range that holds the other."""

    def within(span: Column, one: Column) -> Column:
        pattern, amount = r"^\$([0-9]{1,3})-\$([0-9]{1,3})$", F.regexp_extract(one, r"^\$([0-9]{1,3})$", 1).try_cast("int")
        return F.coalesce(amount.between(F.regexp_extract(span, pattern, 1).try_cast("int"), F.regexp_extract(span, pattern, 2).try_cast("int")), F.lit(False))

    return (a != "") & (b != "") & ((a == b) | within(a, b) | within(b, a))
