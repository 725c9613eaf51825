"""Problem 4: one stored form for texts that read the same.

A text is exploded to positioned code points; a broadcast table maps each code point to its decomposition with
look-alike letters replaced, blanks of any width made one blank and characters without width removed; combining marks
are ordered by class behind their base; the text is rebuilt and recomposed. Texts of ASCII letters already have that
form, except for control characters, and skip the explosion. Letter case, the number of blanks and the spelling stay.

Look-alike letters of all scripts come from the Unicode table of confusable characters, which the ICU library on Spark's
class path holds; letters of other scripts stand for the one Latin letter that looks the same.
"""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The commonest letters of other scripts and the Latin letter that looks the same; these go before the table.
CYRILLIC = dict(zip("АВЕКМНОРСТХУЅІЈԚԜԌаеорсухѕіјһԁԛԝѵӏ", "ABEKMHOPCTXYSIJQWGaeopcyxsijhdqwvl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳ", "ABEZHIKMNOPTYXovpcj", strict=True))
OTHER = dict(zip("օսոհɡɑ", "ounhga", strict=True))
# Marks and signs that look the same.
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "’": "'", "‘": "'", "ʼ": "'", "ʹ": "'", "“": '"', "”": '"', "⁄": "/", "∕": "/", "∶": ":", "․": "."}
LOOKALIKES = CYRILLIC | GREEK | OTHER | SIGNS
# Compatibility decompositions that do not look like their parts.
DISTINCT_TAGS = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>")
# Class of Thai marks, which Unicode leaves at 0: vowel above and nikhahit before tone, then thanthakhat.
THAI_CLASS = dict.fromkeys("ัิีึื็ํ", 104) | {"์": 108, "๎": 108}
# Letters misread for a digit in references.
MISREAD_FROM, MISREAD_TO = "OIl", "011"

BLANK = " "
_INVISIBLE_MARKS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x180F, 0x3164, 0xFFA0}


def _decompose(ch: str) -> str:
    parts = unicodedata.decomposition(ch).split()
    if not parts or parts[0] in DISTINCT_TAGS:
        return unicodedata.normalize("NFD", ch) if not parts else ch
    return "".join(_decompose(chr(int(p, 16))) for p in parts if p[0] != "<")


def latin_letter(ch: str, skeleton: str) -> str | None:
    """The Latin letter that a letter stands for by its skeleton in the table of confusables; None if it is none.

    Letters of one case stay in it: the table has one skeleton for I, l and 1. Small capitals and kra are small letters.
    """
    if len(skeleton) != 1 or ch == skeleton or ch.isascii() or not unicodedata.category(ch).startswith("L"):
        return None
    if not skeleton.isascii():
        name = unicodedata.name(skeleton, "")
        small = name.removeprefix("LATIN LETTER SMALL CAPITAL ")
        return small.lower() if len(small) == 1 and small != name else "k" if name == "LATIN SMALL LETTER KRA" else None
    if not skeleton.isalpha():
        return None
    return "I" if skeleton == "l" and ch.isupper() else skeleton


def confusables(spark: SparkSession) -> dict[str, str]:
    """Latin letter by look-alike letter, from the table of confusables of the ICU library."""
    letters = [chr(cp) for cp in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(cp))[0] == "L" and not (0x2E80 <= cp <= 0xA4CF or 0xAC00 <= cp <= 0xD7FF) and not 0x17000 <= cp <= 0x18DFF and not 0x20000 <= cp <= 0x3FFFF]
    letters = [c for c in letters if unicodedata.normalize("NFKD", c) == c]
    checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
    skeletons = checker.getSkeleton("\n".join(letters)).split("\n")
    found = {c: latin_letter(c, x) for c, x in zip(letters, skeletons, strict=True)}
    return {c: x for c, x in found.items() if x}


def map_code_point(ch: str, looks: dict[str, str] = LOOKALIKES) -> str:
    """What one code point becomes: nothing, a blank, or decomposed look-alikes."""
    cp, category = ord(ch), unicodedata.category(ch)
    if category in ("Zs", "Zl", "Zp") or ch in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85":
        return BLANK
    if category in ("Cf", "Cc") or cp in _INVISIBLE_MARKS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return ""
    return "".join(looks.get(c, c) for c in _decompose(ch))


def mark_class(ch: str) -> int:
    return THAI_CLASS.get(ch) or unicodedata.combining(ch)


#: Rows of the mapping once made; they depend on nothing but the versions of Python and ICU.
_MADE: list[list[tuple[str, list[tuple[str, int]]]]] = []


def _rows(looks: dict[str, str]) -> list[tuple[str, list[tuple[str, int]]]]:
    rows = []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp <= 0xDFFF or 0x20000 <= cp <= 0x2F7FF or 0x30000 <= cp <= 0xDFFFF or cp >= 0xE0200:
            continue
        ch = chr(cp)
        to = map_code_point(ch, looks)
        if to != ch or mark_class(ch):
            rows.append((ch, [(c, mark_class(c)) for c in to]))
    return rows


def mapping(spark: SparkSession) -> DataFrame:
    """(ch, parts array<struct<c, k>>) for each code point that changes or is a mark; bounded by Unicode itself."""
    if not _MADE:
        _MADE.append(_rows(confusables(spark) | LOOKALIKES))
    return spark.createDataFrame(_MADE[0], "ch string, parts array<struct<c:string,k:int>>")


@F.pandas_udf(T.StringType())
def _recompose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x))


def _finish(text: Column) -> Column:
    """Recompose, with the two Thai vowels that have look-alike spellings of two letters."""
    text = F.regexp_replace(text, "เเ", "แ")
    return _recompose(F.regexp_replace(text, "ํ([่-๋]?)า", "$1ำ"))


def with_one_form(df: DataFrame, col: str, out: str) -> DataFrame:
    """Distinct rows of df plus `out`, the one form of `col`. Null texts give null; empty texts stay empty.

    Repeated rows count once; further columns are kept and may have any name but those of this operator (`_1f_...`).
    """
    keys = df.columns
    rows = df.distinct()
    plain = F.coalesce(F.col(col).rlike("^[\\x00-\\x7f]*\\z"), F.lit(True))
    ascii_form = F.regexp_replace(F.regexp_replace(F.col(col), "[\\t-\\r\\x1c-\\x1f]", " "), "[\\x00-\\x08\\x0e-\\x1b\\x7f]", "")
    simple = rows.where(plain).withColumn(out, ascii_form)
    exploded = rows.where(~plain).select(*keys, F.posexplode(F.split(F.col(col), "")).alias("_1f_pos", "ch"))
    mapped = exploded.join(F.broadcast(mapping(df.sparkSession)), "ch", "left")
    parts = F.coalesce("parts", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("k"))))
    # One list of (position, parts) per text; the rows of a text never leave its partition.
    listed = mapped.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_1f_pos").alias("p"), parts.alias("q")))).alias("_1f_l"))
    points = F.flatten(F.transform("_1f_l", lambda x: x["q"]))
    rebuilt = listed.withColumn("_1f_s", points).withColumn("_1f_t", F.array_join(F.transform("_1f_s", lambda x: x["c"]), ""))
    # Marks behind one base are ordered by class only where two marks meet.
    meet = F.exists(F.transform("_1f_s", lambda x, i: (x["k"] > 0) & (F.try_element_at("_1f_s", i + 2)["k"] > 0)), lambda x: F.coalesce(x, F.lit(False)))
    ordered = F.when(meet, _ordered(F.col("_1f_s"))).otherwise(F.col("_1f_t"))
    rebuilt = rebuilt.withColumn("_1f_o", ordered).withColumn(out, _finish(F.col("_1f_o")))
    return simple.unionByName(rebuilt.select(*keys, out))


@F.pandas_udf(T.StringType())
def _ordered(s: pd.Series) -> pd.Series:
    """Code points with every run of marks in the order of their classes."""

    def one(points) -> str:
        out, run = [], []
        for p in points:
            if p["k"]:
                run.append((p["k"], len(run), p["c"]))
                continue
            if run:
                out.extend(c for _, _, c in sorted(run))
                run = []
            out.append(p["c"])
        out.extend(c for _, _, c in sorted(run))
        return "".join(out)

    return s.map(lambda x: "" if x is None else one(x))


def reference_form(form: Column) -> Column:
    """The form of a reference: letters misread for a digit become that digit."""
    return F.translate(form, MISREAD_FROM, MISREAD_TO)


def equal_looking_pairs(forms: DataFrame, keys: list[str], value: str, form: str) -> DataFrame:
    """Pairs of different values with one form under the same keys: keys, value_a < value_b.

    Only forms that several values share are joined, so values without a partner cost no join.
    """
    shared = forms.groupBy(*keys, form).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    left = shared.join(forms.select(*keys, form, F.col(value).alias("value_a")), [*keys, form])
    pairs = left.join(forms.select(*keys, form, F.col(value).alias("value_b")), [*keys, form])
    return pairs.where(F.col("value_a") < F.col("value_b")).select(*keys, "value_a", "value_b")


def slip_forms(reads: DataFrame) -> DataFrame:
    """(user_id, field_name, value, form) of receiver names and transaction references; null values are left out."""
    field = lambda f: reads.select("user_id", F.lit(f).alias("field_name"), F.col(f)["value"].alias("value"))
    both = field("receiver_name").unionByName(field("transaction_reference")).where(F.col("value").isNotNull() & F.col("user_id").isNotNull())
    formed = with_one_form(both, "value", "form")
    return formed.withColumn("form", F.when(F.col("field_name") == "transaction_reference", reference_form(F.col("form"))).otherwise(F.col("form")))
