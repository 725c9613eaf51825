import random

import pytest
from pyspark.sql import functions as F

from slipweave.functions import hashing, labels, qr, quality, slips, text
from slipweave.sources import files


def each(spark, f, values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_reference_key(spark):
    got = each(spark, text.reference_key, ["01612I214623BTF04629", "O16126175244BTF00250", "16126175244BTF00250", "16126175244BTFO0250", "REF-ABC123", "  a   B ", None])
    assert got == ["16121214623BTF04629", "16126175244BTF00250", "16126175244BTF00250", "16126175244BTF00250", "ref-abc123", "a b", ""]


def test_names_and_times(spark):
    assert each(spark, text.thai_name_key, ["น า ย สมชาย ใจดี", "น.ส. มาลี", "นางสาวมาลี", " (John  DOE). ", "จํานวน", None]) == ["สมชายใจดี", "มาลี", "มาลี", "john doe", "จำนวน", ""]
    assert each(spark, text.date_time_key, ["6 พ . ค . 69 17:52", "6 พ.ค.69 17:52", "2026-05-11  10:21:00"]) == ["6พ.ค.69 17:52", "6พ.ค.69 17:52", "2026-05-11 10:21:00"]
    pairs = spark.createDataFrame([("นายสมชาย ใจดี", "สมชาย ใจดี"), ("สมชาย ใจ", "สมชาย ใจดี"), ("a", "b"), (None, "b")], "a string, b string")
    assert [r[0] for r in pairs.select(text.compare_names(F.col("a"), F.col("b"))).collect()] == ["EXACT", "CLOSE", "DIFFERENT", "INSUFFICIENT"]


def test_amounts_notes_cells(spark):
    assert each(spark, text.amount_search_key, ["1,250.5", "THB 20", "abc ", "1.2.3", "", None]) == ["1250.50", "20.00", "abc", "1.2.3", "", ""]
    assert each(spark, text.amount_number, ["1,250.50", "1.2.3", "x", None]) == [1250.5, 1.2, None, None]
    assert each(spark, text.note, ["  a \n b\t", "  ", None, "x" * 600]) == ["a b", None, None, "x" * 500]
    assert each(spark, text.csv_cell, ['a"b', "a,b", "a\r\n", "plain", None]) == ['"a""b"', '"a,b"', '"a\r\n"', "plain", ""]
    assert each(spark, text.file_size_label, [10, 2048, 3 * 1024 * 1024], "long") == ["10 B", "2.0 KB", "3.0 MB"]


def test_hamming_similarity_and_dhash(spark):
    assert each(spark, lambda c: hashing.similarity(c), [0, 4, 6, 8], "int") == [1.0, 0.9375, 0.9063, 0.875]
    assert each(spark, hashing.hash_bits, ["0" * 16, "F" * 16, "f" * 15, "zz", None]) == [0, -1, None, None, None]
    assert each(spark, hashing.dhash, [list(range(72, 0, -1)), list(range(72)), [1, 2], None], "array<int>") == ["f" * 16, "0" * 16, None, None]


def payload(body: str, crc: str) -> str:
    return body + "6304" + crc


def tlv(tag: str, value: str) -> str:
    return f"{tag}{len(value):02d}{value}"


def crc16(data: str) -> str:
    crc = 0xFFFF
    for c in data:
        crc ^= ord(c) << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    return f"{crc:04X}"


def test_checksum_and_payloads(spark):
    assert each(spark, qr.crc16, ["123456789", ""]) == ["29B1", "FFFF"]
    account = tlv("29", tlv("00", qr.PROMPTPAY_AID) + tlv("01", "0066812345678"))
    body = tlv("00", "01") + tlv("01", "12") + account + tlv("53", "764") + tlv("54", "10.50") + tlv("58", "TH")
    good, bad = payload(body, crc16(body + "63040000")), payload(body, "ABCD")
    rows = [(i, v) for i, v in enumerate([good, bad, body, "https://x.example", "plain note", "é", "", "0002", None, good + "99"])]
    out = {r.i: r for r in qr.payment_fields(spark.createDataFrame(rows, "i int, p string"), "p").collect()}
    assert [out[i].qr_format for i in range(10)] == ["THAI_QR_PAYMENT"] * 3 + ["GENERIC_URL", "PLAIN_TEXT", "UNKNOWN_FORMAT", "UNKNOWN_FORMAT", "PLAIN_TEXT", None, "PLAIN_TEXT"]
    assert (out[0].qr_amount, out[0].qr_target, out[0].qr_target_type, out[0].qr_subtype, out[0].qr_consistent) == ("10.50", "0066812345678", "PROMPTPAY_MOBILE", "PROMPTPAY", True)
    assert not out[1].qr_consistent and "mismatch" in out[1].qr_issues[0]
    assert out[2].qr_issues == [qr.ISSUES["crc_missing"]]


@pytest.mark.parametrize(
    ("ocr", "field", "value", "confidence"),
    [
        ("Amount: 1,250.00", "amount", "1250.00", "HIGH"), ("จ ำ น ว น เ ง ิ น 500.00 บาท", "amount", "500.00", "HIGH"), ("ค่าธรรมเนียม\n0.00\n99.50\n1,000.25", "amount", "1000.25", "MEDIUM"),
        ("To: Anna Kell\nFrom: Peter Marlow", "receiver_name", "Anna Kell", "HIGH"), ("From: Peter Marlow", "sender_name", "Peter Marlow", "HIGH"), ("x\nนายสมชาย ใจดี", "receiver_name", "นายสมชาย ใจดี", "LOW"),
        ("2026-05-11T10:21:00", "date_time", "2026-05-11 10:21:00", "HIGH"), ("11/05/2026 10:21", "date_time", "11/05/2026 10:21", "HIGH"), ("at 10:21:00 today", "date_time", "10:21:00", "LOW"),
        ("Reference: 016126175244BTF00250", "transaction_reference", "016126175244BTF00250", "HIGH"), ("016126175244BTF00250 [=]", "transaction_reference", "016126175244BTF00250", "MEDIUM"),
        ("From: A\nKBANK", "sender_bank", "KBANK", "HIGH"), ("KBANK only", "receiver_bank", "KBANK", "LOW"), ("From: A\nxxx-x-x1234-x", "sender_account_tail", "1234", "HIGH"), ("nothing here", "amount", None, "NONE"),
    ],
)
def test_slip_fields(spark, ocr, field, value, confidence):
    out = slips.extract_fields(spark.createDataFrame([(ocr,)], "t string"), "t").first()
    assert (out[field]["value"], out[field]["confidence"]) == (value, confidence)


def test_slip_fields_of_nothing(spark):
    rows = slips.extract_fields(spark.createDataFrame([(None,), ("",), (" \n ",), ("ก" * 3000,)], "t string"), "t").collect()
    assert [r.n_fields for r in rows] == [0, 0, 0, 0] and {r.level for r in rows} == {"NONE"}


def test_quality_and_sources(spark):
    df = spark.createDataFrame([(100, 900, 90.0, 100.0), (900, 900, 10.0, 20.0), (900, 900, 90.0, 100.0), (500, 900, 90.0, 240.0)], "w int, h int, s double, l double")
    got = [(r[0].status, list(r[0].warnings)) for r in df.select(quality.assess(*map(F.col, "whsl"))).collect()]
    assert got == [("FAIL", ["IMAGE_TOO_SMALL"]), ("WARN", ["BLURRY_IMAGE", "TOO_DARK"]), ("PASS", []), ("WARN", ["IMAGE_TOO_SMALL", "TOO_BRIGHT"])]
    r = random.Random(0)
    px = [r.randrange(256) for _ in range(64)]
    one = spark.createDataFrame([(px, 8), ([5] * 64, 8), ([], 8), (None, 8)], "p array<int>, w int").select(quality.sharpness("p", "w"), quality.text_like_parts("p", "w"), quality.code_candidates("p", "w")).collect()
    assert one[0][0] > 0 and one[1][0] == 0.0 and one[2][0] == 0.0 and one[3][0] is None and one[1][1] == 1 and one[3][2] == []
    kinds = each(spark, files.sniff, [bytearray(b"\xff\xd8\xff\xe0"), bytearray(b"\x89PNG\r\n\x1a\n"), bytearray(b"RIFF1234WEBP"), bytearray(b"text"), None], "binary")
    assert kinds == ["image/jpeg", "image/png", "image/webp", None, None]
    assert each(spark, lambda c: labels.label(c, labels.DOCUMENT_TYPES), ["CHEQUE", "SOME_CODE", None]) == ["Cheque", "Some Code", None]


def test_best_reading(spark):
    good = "Amount: 1,250.00\nReference: 016126175244BTF00250"
    rows = [(1, ["short", "Amount: 1,250.00 ###", good, good]), (2, ["short"]), (3, None), (4, [])]
    out = {r.k: r for r in slips.best_reading(spark.createDataFrame(rows, "k int, v array<string>"), "k", "v").collect()}
    assert set(out) == {1} and out[1].text == good and out[1].variant == 2


def test_result_summary(spark):
    df = spark.createDataFrame([("NEW", "SUPPRESSED_NEAR_DUPLICATE", "PENDING", "FAIL", ["AMOUNT_MISMATCH"]), (None,) * 5], "a string, b string, c string, d string, e array<string>")
    got = [[(i.label, i.value) for i in r[0]] for r in df.select(labels.result_summary(*map(F.col, "abcde"))).collect()]
    assert got[0][:2] == [("Duplicate check", "Near-duplicate suppressed"), ("Why", "different amount")] and len(got[0]) == 4
    assert got[1] == [("Duplicate check", "New upload")]
