import unicodedata

from pyspark.sql import functions as F

from slipweave.llm import lookalike

SAME = [
    ("Marine Co.", "Мarіne Cо."), ("น้ำ", "น้ํา"), ("น้ำ", "นํ้า"), ("แก้ว", "เเก้ว"), ("ปิ่น", "ป่ิน"), ("Sjöberg", "Sjöberg"), ("Ltd", "Ｌｔｄ"), ("a b", "a　b"), ("ab", "a​­﻿b"), ("REF-1", "REF‑1"), ("12", "𝟷２"),
    ("Ёж", "Ëж"), ("Ôn", "Ôn"), ("ệ", "ệ"),
]
OTHER = [("ab", "aB"), ("a b", "a  b"), ("ab", "a b"), ("11", "l1"), ("x2", "x²"), ("cafe", "café")]


def forms(spark, values):
    df = spark.createDataFrame([(v, "x") for v in values], "v string, form string")
    return {r.v: r.out for r in lookalike.with_one_form(df, "v", "out").collect()}


def test_equal_looking_texts_have_one_form(spark):
    f = forms(spark, [x for p in SAME + OTHER for x in p])
    assert [(a, b) for a, b in SAME if f[a] != f[b]] == []
    assert [(a, b) for a, b in OTHER if f[a] == f[b]] == []
    assert all(unicodedata.is_normalized("NFC", x) for x in f.values())


def test_a_form_is_its_own_form(spark):
    first = forms(spark, [x for p in SAME for x in p])
    again = forms(spark, list(set(first.values())))
    assert all(k == v for k, v in again.items())


# Letters of many scripts, each with the Latin letter it is read as.
LETTERS = [("α", "a"), ("ι", "i"), ("κ", "k"), ("τ", "t"), ("υ", "u"), ("γ", "y"), ("к", "k"), ("т", "t"), ("ү", "y"), ("ı", "i"), ("ᴏ", "o"), ("Ꭺ", "A"), ("Ꭼ", "E"), ("ꓐ", "B"), ("ꓢ", "S"), ("Ⲟ", "O"), ("𐐄", "O"), ("І", "I"), ("ӏ", "l")]


def test_letters_of_many_scripts(spark):
    f = forms(spark, [f"{a}x" for a, _ in LETTERS] + ["ดต", "ขฃ", "口ロ", "Øł"])
    assert {a: f[f"{a}x"] for a, _ in LETTERS} == {a: f"{b}x" for a, b in LETTERS}
    assert all(f[x] == x for x in ("ดต", "ขฃ", "口ロ", "Øł"))  # letters of one script are never made one


def test_nulls_empty_long_and_repeated(spark):
    long = "น้ํา" * 4000
    f = forms(spark, [None, "", " ", "​", long, long, "\ta"])
    assert f == {None: None, "": "", " ": " ", "​": "", long: "น้ำ" * 4000, "\ta": " a"}
    assert forms(spark, []) == {}


def test_pairs(spark):
    field = "struct<value:string>"
    rows = [("u", ("Co.",), ("O1lI",)), ("u", ("Cо.",), ("0111",)), ("v", ("Cо.",), ("0111",)), ("u", ("Co.",), (None,)), (None, ("Co.",), ("0111",))]
    forms = lookalike.slip_forms(spark.createDataFrame(rows, f"user_id string, receiver_name {field}, transaction_reference {field}"))
    got = {tuple(r) for r in lookalike.equal_looking_pairs(forms, ["user_id", "field_name"], "value", "form").collect()}
    assert got == {("u", "receiver_name", "Co.", "Cо."), ("u", "transaction_reference", "0111", "O1lI")}
    assert forms.where(F.col("value").isNull()).count() == 0
