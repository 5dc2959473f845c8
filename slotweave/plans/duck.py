"""Fragments of DuckDB SQL that the oracles share."""

from __future__ import annotations

from slotweave.functions import text as t


def txt(c: str) -> str:
    return f"coalesce(trim(CAST({c} AS VARCHAR)), '')"


def digits(c: str) -> str:
    return rf"regexp_replace(regexp_replace({txt(c)}, '\.0$', ''), '[^0-9]', '', 'g')"


def check(d: str) -> str:
    total = " + ".join(f"coalesce(TRY_CAST(substr({d}, {i}, 1) AS INT), 0) * {3 if i % 2 else 1}" for i in range(1, 12))
    return f"CASE WHEN length({d}) = 11 THEN CAST((10 - ({total}) % 10) % 10 AS VARCHAR) ELSE '' END"


def pad(d: str, n: int) -> str:
    return f"CASE WHEN length({d}) < {n} THEN lpad({d}, {n}, '0') ELSE {d} END"


def bare(d: str) -> str:
    return f"ltrim({d}, '0')"


def upc12(d: str) -> str:
    return f"CASE WHEN length({d}) = 11 THEN {d} || {check(d)} WHEN length({d}) >= 12 THEN right({d}, 12) ELSE '' END"


def keep_first(array: str) -> str:
    return f"list_filter({array}, lambda x, i: x <> '' AND list_position({array}, x) = i)"


def variants(d: str) -> str:
    full = f"({d} || {check(d)})"
    return (
        f"[{d}, {bare(d)}, CASE WHEN length({d}) = 11 THEN {full} ELSE '' END, CASE WHEN length({d}) = 11 THEN {bare(full)} ELSE '' END, "
        f"CASE WHEN length({d}) = 12 THEN {d}[1:11] ELSE '' END, CASE WHEN length({d}) = 12 THEN {bare(f'{d}[1:11]')} ELSE '' END]"
    )


def raw_keys(d: str) -> str:
    """All key candidates of digits, in order, repeats and blanks included."""
    ends = f"[{d}, " + ", ".join(f"CASE WHEN length({d}) >= {n} THEN right({d}, {n}) ELSE '' END" for n in (14, 13, 12, 11)) + "]"
    return f"flatten(list_transform({ends}, lambda d: {variants('d')}))"


def norm(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(replace(upper({txt(c)}), '_', ' '), '\$([0-9]+)\s*\.\s*00\b', '$\1', 'g'), '[^A-Z0-9$]+', ' ', 'g'))"


def low(c: str) -> str:
    return f"trim(regexp_replace(lower({txt(c)}), '[^a-z0-9$]+', ' ', 'g'))"


def name(c: str) -> str:
    return f"trim(regexp_replace(upper({txt(c)}), '[^A-Z0-9]+', ' ', 'g'))"


def classify(c: str) -> str:
    return rf"trim(regexp_replace(replace(upper({txt(c)}), '_', ' '), '\s+', ' ', 'g'))"


def brand(n: str, table: list, last: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(' ' || {n} || ' ', ' {p} ')" for p in phrases) + f" THEN '{b}'" for b, phrases in table)
    return f"CASE {cases} ELSE {last} END"


def first_word(n: str) -> str:
    return f"string_split({n}, ' ')[1]"


def denomination(n: str) -> str:
    span, multi, one = r"\$([0-9]{1,3})\s*(?:TO|-)\s*\$?([0-9]{1,3})", r"\b([23456])\s*X\s*\$?([0-9]{1,3})\b", r"\$([0-9]{1,3})\b"
    g = lambda p, k: f"regexp_extract({n}, '{p}', {k})"
    return (
        f"CASE WHEN regexp_matches({n}, '{span}') THEN '$' || {g(span, 1)} || '-$' || {g(span, 2)} WHEN regexp_matches({n}, '{multi}') THEN {g(multi, 1)} || ' X $' || {g(multi, 2)} "
        f"WHEN regexp_matches({n}, '{one}') THEN '$' || {g(one, 1)} ELSE '' END"
    )


def ocr_pack(n: str) -> str:
    multi, pack = r"\b([23456])\s*X\s*\$?[0-9]{1,3}\b", r"\b([23456])\s*(?:PACK|PK)\b"
    return f"CASE WHEN regexp_matches({n}, '{multi}') THEN regexp_extract({n}, '{multi}', 1) WHEN regexp_matches({n}, '{pack}') THEN regexp_extract({n}, '{pack}', 1) ELSE '' END"


def pack(n: str, raw: str) -> str:
    d = digits(raw)
    return f"CASE WHEN {ocr_pack(n)} <> '' THEN {ocr_pack(n)} WHEN length({d}) = 1 THEN {d} ELSE '' END"


def tokens(n: str) -> str:
    stop = ", ".join(f"'{x}'" for x in t.GENERIC_TOKENS)
    array = f"string_split({n}, ' ')"
    return f"list_filter({array}, lambda x, i: length(x) >= 3 AND x NOT IN ({stop}) AND NOT regexp_matches(x, '^[0-9]+$') AND list_position({array}, x) = i)"


def filled(*columns: str) -> str:
    """Non-blank values joined by a space."""
    return "concat_ws(' ', " + ", ".join(f"nullif({txt(c)}, '')" for c in columns) + ")"


def stem(path: str) -> str:
    return rf"regexp_replace(string_split({txt(path)}, '/')[-1], '^(.+)\.[^.]*$', '\1')"
