"""Identifier columns: digits, check digits, keys. Blank stands for missing, as in the sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: Column | str) -> Column:
    """Trimmed string, '' for null."""
    return F.coalesce(F.trim((F.col(c) if isinstance(c, str) else c).cast("string")), F.lit(""))


def digits_only(c: Column | str) -> Column:
    """Digits of a value whose trailing .0 is dropped."""
    return F.regexp_replace(F.regexp_replace(text(c), r"\.0$", ""), "[^0-9]", "")


def strip_zeros(c: Column) -> Column:
    return F.regexp_replace(c, "^0+", "")


def pad_left(c: Column, size: int) -> Column:
    """Zero-padded, never truncated."""
    return F.when(F.length(c) < size, F.lpad(c, size, "0")).otherwise(c)


def coerce_upc12(c: Column | str) -> Column:
    """Digits padded to 12; null where there is none."""
    d = digits_only(c)
    return F.when(d != "", pad_left(d, 12))


def coerce_int(c: Column | str) -> Column:
    """Digits and minus signs as a number; null where that is none."""
    return F.regexp_replace(F.regexp_replace(text(c), r"\.0$", ""), "[^0-9-]", "").try_cast("long")


def as_int(c: Column | str) -> Column:
    """Number text truncated toward zero."""
    return text(c).try_cast("double").try_cast("long")


def last5(c: Column | str) -> Column:
    d = F.regexp_replace(text(c), "[^0-9]", "")
    return F.when(d == "", "").otherwise(pad_left(F.right(d, F.lit(5)), 5))


def item_number6(c: Column | str) -> Column:
    d = digits_only(c)
    return F.when(d == "", "").otherwise(pad_left(d, 6))


def check_digit(c: Column) -> Column:
    """UPC-A check digit of 11 digits: (10 - (3 * odd + even places) mod 10) mod 10; '' for other lengths."""

    def digit(x: Column) -> Column:
        place = lambda i: F.coalesce(F.substring(x, i, 1).try_cast("int"), F.lit(0))
        total = sum((place(i) for i in range(3, 12, 2)), place(1)) * 3 + sum((place(i) for i in range(4, 12, 2)), place(2))
        return F.when(F.length(x) == 11, ((10 - total % 10) % 10).cast("string")).otherwise("")

    return F.transform(F.array(c), digit)[0]  # c is worked out once, not for each place


def with_check(c: Column) -> Column:
    return F.concat(c, check_digit(c))


def calculated_upc12(c: Column | str) -> Column:
    d = digits_only(c)
    return F.when(F.length(d) == 11, with_check(d)).when(F.length(d) >= 12, F.right(d, F.lit(12))).otherwise("")


def distinct_keys(keys: Column) -> Column:
    """First occurrences, without blanks."""
    return F.array_distinct(F.filter(keys, lambda k: k != ""))


def _variants(d: Column) -> Column:
    full = with_check(d)
    body = F.substring(d, 1, 11)
    n = F.length(d)
    blank = F.lit("")
    return F.array(
        d, strip_zeros(d), F.when(n == 11, full).otherwise(blank), F.when(n == 11, strip_zeros(full)).otherwise(blank),
        F.when(n == 12, body).otherwise(blank), F.when(n == 12, strip_zeros(body)).otherwise(blank),
    )


def keys_of_digits(d: Column) -> Column:
    """Lookup keys in priority order: the identifier and its variants, then those of its last 14, 13, 12 and 11 digits."""
    ends = lambda x: F.array(x, *[F.when(F.length(x) >= n, F.right(x, F.lit(n))).otherwise("") for n in (14, 13, 12, 11)])
    once = F.transform(F.array(d), lambda x: F.flatten(F.transform(ends(x), _variants)))  # d is worked out once, not for each of its ends
    return distinct_keys(F.flatten(once))


def identifier_keys(c: Column | str) -> Column:
    return keys_of_digits(digits_only(c))


def comparison_keys(upc: Column | str, upc12: Column | str, check: Column | str) -> Column:
    """Keys of the identifier, of its 12-digit form and of an 11-digit body with a given check digit."""
    body, digit = digits_only(upc), digits_only(check)
    joined = F.when((F.length(body) == 11) & (F.length(digit) == 1), F.concat(body, digit)).otherwise("")
    return distinct_keys(F.concat(keys_of_digits(body), identifier_keys(upc12), keys_of_digits(joined)))


def digit_variants(c: Column | str) -> Column:
    """The second rule set: digits, stripped, padded to 12, last 11, last 12, and with a check digit."""
    d = F.regexp_replace(text(c), "[^0-9]", "")
    bare, n, blank = strip_zeros(d), F.length(d), F.lit("")
    return distinct_keys(
        F.array(
            d, bare, F.when(n.isin(11, 12), pad_left(d, 12)).otherwise(blank), F.when(n.isin(11, 12), F.right(d, F.lit(11))).otherwise(blank),
            F.when(n > 12, F.right(d, F.lit(12))).otherwise(blank), F.when(F.length(bare) == 11, with_check(bare)).otherwise(blank), F.when(n == 11, with_check(d)).otherwise(blank),
        )
    )


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(text(path), "/"), -1)


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"^(.+)\.[^.]*$", "$1")


def filename_keys(path: Column | str) -> Column:
    """Lower-case keys of a file: its name, its stem, the stem's digits, each run of digits."""
    runs = F.regexp_extract_all(stem(path), F.lit("([0-9]+)"), 1)
    return distinct_keys(F.concat(F.array(F.lower(basename(path)), F.lower(stem(path))), identifier_keys(stem(path)), F.flatten(F.transform(runs, keys_of_digits))))


def image_name_keys(path: Column | str) -> Column:
    """Digit variants and last five of each run of 5 to 14 digits."""
    runs = F.regexp_extract_all(stem(path), F.lit("([0-9]{5,14})"), 1)
    return distinct_keys(F.flatten(F.transform(runs, lambda d: F.concat(digit_variants(d), F.array(F.right(d, F.lit(5)))))))


def longest_digit_run(path: Column | str) -> Column:
    """The longest run of digits in the stem, the first of equals."""
    runs = F.regexp_extract_all(stem(path), F.lit("([0-9]+)"), 1)
    return F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))


def bare_digits(c: Column | str) -> Column:
    """All digits without leading zeros."""
    return strip_zeros(F.regexp_replace(text(c), "[^0-9]", ""))


def upc_core(c: Column | str) -> Column:
    """Leading zeros dropped, at most the last 12 digits, without the 12th (check) digit."""
    d = bare_digits(c)
    return F.when(F.length(d) >= 12, F.left(F.right(d, F.lit(12)), F.lit(11))).otherwise(d)
