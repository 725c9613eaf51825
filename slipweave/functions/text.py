"""Text normalisation for comparing and searching slip fields; every function maps a column to a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of the web platform, inside a character class.
WS = "\\s\\u000b\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
THAI = "\\u0e00-\\u0e7f"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+\\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WS}]+", " ")


def non_empty(c: Column) -> Column:
    """False for null and blank."""
    return F.coalesce(F.length(trim(c)) > 0, F.lit(False))


def basic(c: Column) -> Column:
    """Trimmed, lower case, one blank between words; null gives an empty text."""
    return collapse(F.lower(trim(F.coalesce(c, F.lit("")))))


def note(c: Column, limit: int = 500) -> Column:
    """Trimmed, collapsed and cut review note; blank becomes null."""
    cut = F.substring(collapse(trim(c)), 1, limit)
    return F.when(F.length(cut) > 0, cut)


def reference_key(c: Column) -> Column:
    """Comparable form of a transaction reference; null gives an empty text.

    A bank reference is digits, a code of three to five letters and digits. Letters misread for digits are digits in
    both number parts, leading zeros go while eight digits follow, the code is upper case. Anything else is lower case.
    """
    v = trim(F.coalesce(c, F.lit("")))
    pattern = "^([0-9OIl]{9,20})([A-Za-z]{3,5}?)([0-9OIl]{4,})\\z"
    digits = lambda g: F.translate(F.upper(F.regexp_extract(v, pattern, g)), "OIL", "011")
    bank = F.concat(F.regexp_replace(digits(1), "^0+(?=\\d{8,})", ""), F.upper(F.regexp_extract(v, pattern, 2)), digits(3))
    return F.when(v.rlike(pattern), bank).otherwise(collapse(F.lower(v)))


def thai_name_key(c: Column) -> Column:
    """Comparable form of a name: no blanks between Thai letters, no Thai title, no punctuation around, lower case."""
    v = trim(F.coalesce(c, F.lit("")))
    v = F.regexp_replace(v, "\\u0e4d ?\\u0e32", "ำ")
    v = F.regexp_replace(v, f"(?<=[{THAI}])[{WS}]+(?=[{THAI}])", "")
    for title in (f"^น[{WS}]*\\.[{WS}]*ส[{WS}]*\\.[{WS}]*", f"^นางสาว[{WS}]*", f"^นาง[{WS}]*", f"^นาย[{WS}]*"):
        v = F.regexp_replace(v, title, "")
    edge = f"[{WS}\\-.,;:'\"()\\[\\]]+"
    return F.lower(trim(collapse(F.regexp_replace(v, f"^{edge}|{edge}\\z", ""))))


def compare_names(a: Column, b: Column) -> Column:
    """EXACT, CLOSE (one is a beginning of the other, four characters at least), DIFFERENT or INSUFFICIENT."""
    return compare_keys(thai_name_key(a), thai_name_key(b))


def compare_keys(x: Column, y: Column) -> Column:
    """compare_names of names in their comparable form."""
    shorter, longer = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    return (
        F.when((x == "") | (y == ""), "INSUFFICIENT").when(x == y, "EXACT").when((F.length(shorter) >= 4) & F.startswith(longer, shorter), "CLOSE").otherwise("DIFFERENT")
    )


def date_time_key(c: Column) -> Column:
    """Comparable form of a printed time: no blanks around Thai letters and dots."""
    v = F.regexp_replace(trim(F.coalesce(c, F.lit(""))), f"[{WS}]*([{THAI}])[{WS}]*", "$1")
    return F.lower(trim(collapse(F.regexp_replace(v, f"[{WS}]*\\.[{WS}]*", "."))))


def amount_number(c: Column) -> Column:
    """Value of the leading number among the digits and dots of an amount; null if there is none."""
    return F.regexp_extract(F.regexp_replace(c, "[^0-9.]", ""), "^(\\d+\\.?\\d*|\\.\\d+)", 1).try_cast("double")


def amount_key(c: Column) -> Column:
    """Comparable form of an amount: the number, else the text."""
    return F.coalesce(amount_number(c).cast("string"), basic(c))


def amount_search_key(c: Column) -> Column:
    """Two decimals for a number (digits and dots that read as one), else the trimmed lower-case text."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9.]", "")
    number = F.when(kept.rlike("^(\\d+\\.?\\d*|\\.\\d+)\\z"), kept.try_cast("double"))
    return F.coalesce(F.when(number.isNotNull(), F.format_string("%.2f", number)), F.lower(trim(F.coalesce(c, F.lit("")))))


def values_match(a: Column, b: Column) -> Column:
    """Both null, or equal after trimming and lower-casing."""
    return F.lower(trim(a)).eqNullSafe(F.lower(trim(b)))


def csv_cell(c: Column) -> Column:
    """A cell quoted only where it must be."""
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(v.rlike("[\",\\r\\n]"), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *map(csv_cell, cells))


def file_size_label(size: Column) -> Column:
    return F.when(size < 1024, F.format_string("%d B", size)).when(size < 1024 * 1024, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", size / (1024 * 1024)))


def key_segment(c: Column) -> Column:
    """A path segment of an object key; an empty one is `unknown`."""
    v = F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9_-]", "_")
    return F.when(v == "", "unknown").otherwise(v)
