"""Payment QR payloads: TLV fields, kind of payload, checksum and structural check, without Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from slipweave.functions.text import non_empty, trim

# Fixed values of the payment QR standard.
PROMPTPAY_AID, BILL_PAYMENT_AID = "A000000677010111", "A000000677010112"
CRC_INIT, CRC_POLY = 0xFFFF, 0x1021
# Texts of structural issues, in the order of the checks.
ISSUES = {
    "version": "EMV payload format indicator is present and equals 01.", "country": "Country code is present and equals TH.",
    "currency": "Currency code is present and equals 764.", "merchant": "Thai QR merchant account information is present.",
    "crc_missing": "CRC tag (63) is missing from the payload.", "amount": "Amount is present but is not a decimal value with up to two fractional digits.",
    "promptpay": "PromptPay target identifier is present.", "bill": "Bill payment biller id and reference 1 are present.",
}
AMOUNT_FORMAT = "^\\d+(\\.\\d{1,2})?\\z"
_ENTRIES = "array<struct<tag:string,value:string>>"


def tlv(payload: Column) -> Column:
    """Entries (tag, value) of a payload in order; null if any entry is malformed or runs past the end."""
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"), F.array().cast(_ENTRIES).alias("entries"))
    sub = lambda s, at, n: s.substr(at, n)

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        head = sub(payload, at, F.lit(4))
        size = F.coalesce(sub(payload, at + 2, F.lit(2)).try_cast("int"), F.lit(0))
        fits = head.rlike("^\\d{4}\\z") & (at + 3 + size <= F.length(payload))
        entry = F.array(F.struct(sub(payload, at, F.lit(2)).alias("tag"), sub(payload, at + 4, size).alias("value")))
        read = F.struct((at + 4 + size).alias("at"), F.lit(True).alias("ok"), F.concat(s["entries"], entry).alias("entries"))
        failed = F.struct(at.alias("at"), F.lit(False).alias("ok"), s["entries"].alias("entries"))
        return F.when(~s["ok"] | (at > F.length(payload)), s).when(fits, read).otherwise(failed)

    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.length(payload) / 4).cast("int") + 1))
    return F.aggregate(steps, start, step, lambda s: F.when(s["ok"] & (s["at"] > F.length(payload)), s["entries"]))


def tag(entries: Column, name: str) -> Column:
    """Value of the last entry with a tag, or null."""
    return F.element_at(F.filter(F.concat(F.array(F.struct(F.lit(name).alias("tag"), F.lit(None).cast("string").alias("value"))), entries), lambda e: e["tag"] == name), -1)["value"]


def merchant(entries: Column) -> Column:
    """The first merchant account (tags 26 to 51) of a known application: (tag, aid, nested entries); null without one."""
    known = F.filter(
        F.transform(F.filter(entries, lambda e: e["tag"].try_cast("int").between(26, 51)), lambda e: F.struct(e["tag"].alias("tag"), tlv(e["value"]).alias("nested"))),
        lambda m: F.coalesce(tag(m["nested"], "00").isin(PROMPTPAY_AID, BILL_PAYMENT_AID), F.lit(False)),
    )
    return F.get(known, F.lit(0))


def payload_format(payload: Column, entries: Column, account: Column) -> Column:
    p = trim(payload)
    thai = (tag(entries, "00") == "01") & (tag(entries, "58") == "TH") & (tag(entries, "53") == "764") & account.isNotNull()
    return (
        F.when(payload.isNull(), None).when(p.rlike("(?i)^https?://"), "GENERIC_URL").when(F.coalesce(thai, F.lit(False)), "THAI_QR_PAYMENT")
        .when(p.rlike("^[\\x20-\\x7e\\r\\n\\t]+\\z"), "PLAIN_TEXT").otherwise("UNKNOWN_FORMAT")
    )


def _crc_table() -> list[int]:
    """The remainder that each leading byte leaves, from the polynomial."""
    out = []
    for byte in range(256):
        rest = byte << 8
        for _ in range(8):
            rest = (rest << 1 ^ CRC_POLY if rest & 0x8000 else rest << 1) & 0xFFFF
        out.append(rest)
    return out


def crc16(text: Column) -> Column:
    """CRC-16 with initial value FFFF and polynomial 1021 over the characters of an ASCII text, four upper hex digits."""

    table = F.expr(f"array({', '.join(map(str, _crc_table()))})")  # one literal, folded once

    def byte(crc: Column, ch: Column) -> Column:
        at = F.shiftright(crc, 8).bitwiseXOR(F.ascii(ch)).bitwiseAND(F.lit(0xFF))
        return F.shiftleft(crc, 8).bitwiseAND(F.lit(0xFFFF)).bitwiseXOR(F.get(table, at))

    return F.lpad(F.hex(F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(CRC_INIT), byte)), 4, "0")


def crc_state(payload: Column, value: Column) -> Column:
    """(state, computed): MISSING, VALID or INVALID by the last 6304 + value of the payload."""
    mark = F.concat(F.lit("6304"), value)
    # The last occurrence is the first one in the reversed text.
    last = F.length(payload) - F.position(F.reverse(mark), F.reverse(payload)) - F.length(mark) + 2
    computed = crc16(F.concat(payload.substr(F.lit(1), last + 3), F.lit("0000"), payload.substr(last + 8, F.length(payload))))
    there = non_empty(value) & F.contains(payload, mark)
    return F.struct(F.when(~F.coalesce(there, F.lit(False)), "MISSING").when(computed == value, "VALID").otherwise("INVALID").alias("state"), F.when(there, computed).alias("computed"))


def payment_fields(df, payload: str, prefix: str = "qr_"):
    """Add the parsed payload: {prefix}format, amount, subtype, target, target_type, reference1..3, merchant_name, crc, issues, consistent.

    A null payload gives nulls; a payload that is no payment QR has only a format. The text is trimmed first.
    """
    p = lambda n: F.col(prefix + n)
    df = df.withColumn(prefix + "text", trim(F.col(payload)))
    df = df.withColumn(prefix + "entries", tlv(p("text")))
    df = df.withColumn(prefix + "account", merchant(p("entries")))
    df = df.withColumn(prefix + "format", payload_format(p("text"), p("entries"), p("account")))
    paid = p("format") == "THAI_QR_PAYMENT"
    nested = p("account")["nested"]
    sub = lambda n: F.when(paid, tag(nested, n))
    top = lambda n: F.when(paid, tag(p("entries"), n))
    bill = tag(nested, "00") == BILL_PAYMENT_AID
    df = df.withColumns({
        prefix + "subtype": F.when(paid, F.when(bill, "BILL_PAYMENT").otherwise("PROMPTPAY")), prefix + "amount": top("54"), prefix + "merchant_name": top("59"), prefix + "crc": top("63"),
        prefix + "target": F.when(bill, sub("01")).otherwise(F.coalesce(sub("01"), sub("02"), sub("03"))),
        prefix + "target_type": F.when(paid & bill, F.when(F.length(sub("01")) > 0, "BILLER_ID").otherwise("UNKNOWN")).when(
            paid, F.when(F.length(sub("01")) > 0, "PROMPTPAY_MOBILE").when(F.length(sub("02")) > 0, "PROMPTPAY_NATIONAL_ID_OR_TAX_ID").when(F.length(sub("03")) > 0, "PROMPTPAY_EWALLET").otherwise("UNKNOWN")),
        prefix + "reference1": F.when(bill, sub("02")), prefix + "reference2": F.when(bill, sub("03")), prefix + "reference3": F.when(bill, sub("04")),
        prefix + "version": top("00"), prefix + "country": top("58"), prefix + "currency": top("53"),
    })
    df = df.withColumn(prefix + "checksum", F.when(paid, crc_state(p("text"), p("crc"))))
    issue = lambda bad, text: F.when(F.coalesce(bad, F.lit(True)), text)
    issues = F.array_compact(F.array(
        issue(p("version") != "01", ISSUES["version"]), issue(p("country") != "TH", ISSUES["country"]), issue(p("currency") != "764", ISSUES["currency"]), issue(p("account").isNull(), ISSUES["merchant"]),
        F.when(p("checksum")["state"] == "MISSING", ISSUES["crc_missing"]).when(p("checksum")["state"] == "INVALID", F.concat(F.lit("CRC checksum mismatch: computed "), p("checksum")["computed"], F.lit(", expected "), p("crc"), F.lit("."))),
        F.when(p("amount").isNotNull() & ~p("amount").rlike(AMOUNT_FORMAT), ISSUES["amount"]),
        F.when((p("subtype") == "PROMPTPAY") & ~(non_empty(p("target")) & (p("target_type") != "UNKNOWN")), ISSUES["promptpay"]).when((p("subtype") == "BILL_PAYMENT") & ~(non_empty(p("target")) & non_empty(p("reference1"))), ISSUES["bill"]),
    ))
    df = df.withColumn(prefix + "issues", F.when(paid, issues))
    return df.withColumn(prefix + "consistent", F.size(p("issues")) == 0).drop(prefix + "entries", prefix + "account", prefix + "text")
