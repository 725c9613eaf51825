"""Fields of a transfer slip from its OCR text: rules as data, tried in order, compiled to one SQL expression a field."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipweave.functions.text import THAI, WS, collapse, trim

# Labels of the fields, as alternatives of a pattern, and the banks in the order in which they are tried.
AMOUNT_LABELS = "จำนวน|จำนวนเงิน|Amount|ยอด|ยอดโอน"
RECEIVER_LABELS = "To|Receiver|Recipient|Pay\\s*(?:to|ee)?|ผู้รับ|โอนเข้า|ไปที่"
SENDER_LABELS = "From|Sender|Remitter|ผู้โอน|โอนจาก|จ่ายจาก"
REFERENCE_LABELS = "Reference|Transaction\\s*ID|Trace\\s*No\\.?|Ref\\.?|เลขที่รายการ|เลขอ้างอิง|หมายเลขอ้างอิง|รายการ"
LABELS_AS_NAMES = ["to", "from", "sender", "receiver", "amount", "date", "ref", "reference"]
BANKS = [
    "KBANK", "SCB", "BBL", "KTB", "BAY", "TTB", "GSB", "CIMB", "UOB", "TMB", "Thanachart", "Krungsri", "Kasikorn", "Siam Commercial", "Bangkok Bank", "Krung Thai", "Bank of Ayudhya", "TThanachart",
    "Government Savings Bank", "ธนาคารกสิกรไทย", "ธนาคารไทยพาณิชย์", "ธนาคารกรุงเทพ", "ธนาคารกรุงไทย", "ธนาคารกรุงศรี", "ธนาคารทหารไทย", "ธนาคารออมสิน", "ธนาคารซีไอเอ็มบี", "ธนาคารยูโอบี",
    "กสิกร", "กรุงเทพ", "กรุงไทย", "กรุงศรี", "ทหารไทย", "ออมสิน", "ไทยพาณิชย์", "ธ.กสิกร", "ธ.กรุงเทพ", "ธ.กรุงไทย",
]
FIELDS = ["amount", "sender_name", "receiver_name", "date_time", "transaction_reference", "sender_bank", "receiver_bank", "sender_account_tail", "receiver_account_tail"]

_SP = f"[{WS}:]*"
_NUM = "([\\d,]+(?:\\.\\d{1,2})?)"
_DATE = "(\\d{1,2}[/-]\\d{1,2}[/-]\\d{4})"
_CLOCK = "(\\d{2}:\\d{2}(?::\\d{2})?)"
_PERSON = "((?:น\\.ส\\.|นางสาว|นาย|นาง|บริษัท|ร้าน|ร\\.ร\\.)[^\\n]{1,60})"

Clean = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """One way to a value: `where` is flat, line, below (a label line, then the next `reach` lines) or near (from it on)."""

    where: str
    pattern: str
    confidence: str
    source: str
    label: str = ""
    reach: int = 0
    groups: tuple[int, ...] = (1,)


def _amount(raw: Column) -> Column:
    kept = F.regexp_replace(raw, "[^0-9.]", "")
    number = F.regexp_extract(kept, "^(\\d+\\.?\\d*|\\.\\d+)", 1).try_cast("double")
    return F.when(number > 0, kept)


def _name(raw: Column) -> Column:
    kept = trim(F.regexp_replace(collapse(raw), f"[^{THAI}a-zA-Z0-9{WS}\\-.]", ""))
    return F.when((F.length(kept) >= 3) & ~F.lower(kept).isin(LABELS_AS_NAMES), kept)


def _code(raw: Column) -> Column:
    v = trim(raw)
    return F.when(~v.rlike("^\\d*\\z") | (F.length(v) >= 15), v)


def _plain(raw: Column) -> Column:
    return F.when(F.length(raw) > 0, raw)


def _name_rules(labels: str, near: str, again: str, kind: str, label_line: str) -> list[Rule]:
    return [
        Rule("flat", f"(?i)(?:{labels}){_SP}(.{{2,80}})", "HIGH", f"regex-{kind}-line"),
        Rule("flat", f"(?i)(?:{near}[:{WS}]+)([^\\n]{{2,80}})", "HIGH", f"regex-{kind}-line"),
        Rule("flat", f"(?:{again}){_SP}(.{{2,80}})", "HIGH", f"regex-{kind}-line"),
        Rule("below", "^(.*)$", "MEDIUM", f"regex-{kind}-contextual", f"(?i)^(?:{label_line})[:{WS}]*$", 1),
    ]


RULES: dict[str, tuple[list[Rule], Clean]] = {
    "amount": ([
        Rule("flat", f"(?i)(?:Amount|จำนวนเงิน|ยอด|ยอดโอน|Amount\\s*\\(?THB\\)?){_SP}{_NUM}", "HIGH", "regex-amount-line"),
        Rule("flat", f"(?i)(?:THB|Baht|บาท){_SP}{_NUM}", "HIGH", "regex-amount-line"),
        Rule("flat", f"฿[{WS}]*{_NUM}", "HIGH", "regex-amount-line"),
        Rule("flat", f"(?i)^([\\d,]+(?:\\.\\d{{2}})[{WS}]*(?:Baht|บาท))", "HIGH", "regex-amount-line"),
        Rule("below", "([\\d,]+\\.\\d{2})", "MEDIUM", "regex-amount-contextual", f"(?i)^(?:{AMOUNT_LABELS})", 3),
        Rule("largest", f"^[{WS}:]*([\\d,]+\\.\\d{{2}})[{WS}]*$", "MEDIUM", "regex-amount-standalone"),
    ], _amount),
    "receiver_name": ([*_name_rules(RECEIVER_LABELS, "To", "ผู้รับเงิน|ชื่อผู้รับ", "receiver", "To|ผู้รับ|Receiver|โอนเข้า|ไปที่"), Rule("line", _PERSON, "LOW", "regex-receiver-title")], _name),
    "sender_name": ([*_name_rules(SENDER_LABELS, "From", "ผู้โอนเงิน|ชื่อผู้โอน", "sender", "From|ผู้โอน|Sender|โอนจาก|จ่ายจาก"), Rule("near", _PERSON, "MEDIUM", "regex-sender-title-near-label", "จาก", 2)], _name),
    "date_time": ([
        Rule("flat", f"(\\d{{4}}-\\d{{2}}-\\d{{2}})[{WS}T](\\d{{2}}:\\d{{2}}:\\d{{2}})", "HIGH", "regex-datetime-iso", groups=(1, 2)),
        Rule("flat", f"(\\d{{1,2}}(?:[{WS}]*[{THAI}][{WS}]*\\.?[{WS}]*){{1,5}}\\d{{2,4}})(?:[,{WS}]+{_CLOCK})?", "HIGH", "regex-datetime-thai-buddhist", groups=(1, 2)),
        Rule("flat", f"{_DATE}(?:[{WS},]+{_CLOCK})?", "HIGH", "regex-datetime-thai", groups=(1, 2)),
        Rule("pair", _CLOCK, "MEDIUM", "regex-datetime-adjacent", f"{_DATE}|(\\d{{1,2}}\\s*[ก-ะาำเ-ๆ]+\\.\\s*\\d{{2,4}})", 1),
        Rule("flat", "(\\d{2}:\\d{2}:\\d{2})", "LOW", "regex-time-only"),
    ], _plain),
    "transaction_reference": ([
        Rule("flat", f"(?i)(?:{REFERENCE_LABELS}){_SP}([0-9]{{9,20}}[A-Z]{{3}}\\d{{4,}})", "HIGH", "regex-reference-full"),
        Rule("flat", f"(?i)(?:{REFERENCE_LABELS})[{WS}:.,-]*([A-Za-z0-9-]{{4,40}})", "HIGH", "regex-reference-line"),
        Rule("flat", f"(?i)(?:Ref[:{WS}]+)([A-Za-z0-9-]{{4,40}})", "HIGH", "regex-reference-line"),
        Rule("flat", f"(?:เลขที่รายการ)[{WS}:.,-]*([A-Za-z0-9-]{{4,40}})", "HIGH", "regex-reference-line"),
        Rule("below", "^([0-9]{9,20}[A-Za-z]{3}[A-Za-z0-9]{4,})", "MEDIUM", "regex-reference-contextual", "(?i)เลขที่รายการ|เลขอ้างอิง|หมายเลขอ้างอิง|Reference|Ref\\.?", 3),
        Rule("line", "^(\\d{9,20}[A-Z]{3}\\d{4,})", "MEDIUM", "regex-reference-line-start"),
        Rule("flat", "(\\d{9,20}[A-Z]{3}\\d{4,})", "MEDIUM", "regex-reference-anywhere"),
        Rule("below", "^(\\d{15,20})(?!\\d)", "MEDIUM", "regex-reference-contextual-numeric", "(?i)เลขที่รายการ|เลขอ้างอิง|หมายเลขอ้างอิง|Reference|Ref\\.?", 3),
    ], _code),
}


def clean_text(text: Column) -> Column:
    """One line end, no characters without width, no blanks between spaced-out Thai letters."""
    t = F.regexp_replace(F.regexp_replace(text, "\\r", "\n"), "[\\u200b-\\u200d\\ufeff]", "")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    spaced = f"[{THAI}][{WS}][{THAI}][{WS}][{THAI}]"  # as readers of fragmented text print it
    t = F.when(t.rlike(spaced), F.regexp_replace(t, f"(?<=[{THAI}])[{WS}]+(?=[{THAI}])", "")).otherwise(t)
    return F.regexp_replace(t, "\\u0e4d ?\\u0e32", "ำ")


def _take(text: Column, rule: Rule) -> Column:
    """What a rule's pattern captures in a text; null without a match."""
    groups = [F.nullif(F.regexp_extract(text, rule.pattern, g), F.lit("")) for g in rule.groups]
    return groups[0] if len(groups) == 1 else F.when(groups[0].isNotNull(), F.concat_ws(" ", *groups))


def _value(rule: Rule, flat: Column, lines: Column, clean: Clean) -> Column:
    if rule.where == "flat":
        return clean(_take(flat, rule))
    if rule.where == "line":
        return F.get(F.filter(F.transform(lines, lambda x: clean(_take(x, rule))), lambda v: v.isNotNull()), F.lit(0))
    if rule.where == "largest":
        found = F.filter(F.transform(lines, lambda x: clean(_take(x, rule))), lambda v: v.isNotNull())
        ranked = F.transform(found, lambda v, i: F.struct(v.try_cast("double").alias("n"), (-i).alias("first"), v.alias("v")))
        return F.array_max(ranked)["v"]
    first = 0 if rule.where == "near" else 1

    def below(line: Column, i: Column) -> Column:
        after = F.slice(lines, i + 1 + first, rule.reach + 1 - first)
        value = F.get(F.filter(F.transform(after, lambda x: clean(_take(x, rule))), lambda v: v.isNotNull()), F.lit(0))
        if rule.where == "pair":
            date = F.coalesce(F.nullif(F.regexp_extract(line, rule.label, 1), F.lit("")), F.regexp_extract(line, rule.label, 2))
            value = F.when(value.isNotNull(), F.concat_ws(" ", date, value))
        return F.when(line.rlike(rule.label), value)

    return F.get(F.filter(F.transform(lines, below), lambda v: v.isNotNull()), F.lit(0))


def _field(value: Column, confidence: Column, source: Column) -> Column:
    return F.struct(value.alias("value"), confidence.alias("confidence"), source.alias("source"))


def _first(options: list[tuple[Column, str, str]]) -> Column:
    """The first option with a value. A lambda names each value once, so no rule is evaluated more than once."""

    def tried(value: Column, confidence: str, source: str) -> Column:
        return F.get(F.transform(F.array(value), lambda x: F.when(x.isNotNull(), _field(x, F.lit(confidence), F.lit(source)))), F.lit(0))

    return F.coalesce(*[tried(*o) for o in options], _field(F.lit(None).cast("string"), F.lit("NONE"), F.lit("no-match")))


def bank(text: Column) -> Column:
    """The first bank of the list that a text names."""
    named = lambda upper: F.coalesce(*[F.when(F.contains(upper, F.lit(b.upper())), F.lit(b)) for b in BANKS])
    return F.get(F.transform(F.array(F.upper(text)), named), F.lit(0))


def account_tail(text: Column) -> Column:
    patterns = ["[xX*•]+(\\d{3,4})", f"(?:Account[{WS}]*No\\.?[{WS}]*[:{WS}]*)\\d+[{WS}]*(\\d{{3,4}})", f"(?:\\d{{3,}}-)?(\\d{{3,4}})[{WS}]*\\z"]
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def _near(lines: Column, label: str, match: Clean) -> Column:
    """The first match on a label line or the two lines after it."""
    hit = lambda line, i: F.when(line.rlike(label), F.get(F.filter(F.transform(F.slice(lines, i + 1, 3), match), lambda v: v.isNotNull()), F.lit(0)))
    return F.get(F.filter(F.transform(lines, hit), lambda v: v.isNotNull()), F.lit(0))


def extract_fields(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Add the nine fields as struct<value, confidence, source>, {prefix}n_fields and {prefix}level (NONE, PARTIAL, EXTRACTED).

    The rules of a field are tried in order and the first value wins. Null and blank texts have no field. Columns of the
    same names are replaced.
    """
    df = df.withColumn("_flat", clean_text(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("_lines", F.filter(F.transform(F.split("_flat", "\n"), trim), lambda x: F.length(x) > 0))
    flat, lines = F.col("_flat"), F.col("_lines")
    fields = {f: _first([(_value(r, flat, lines, clean), r.confidence, r.source) for r in rules]) for f, (rules, clean) in RULES.items()}
    for side, labels in (("sender", "From|ผู้โอน|Sender|โอนจาก"), ("receiver", "To|ผู้รับ|Receiver|โอนเข้า")):
        fields[f"{side}_bank"] = _first([(_near(lines, f"(?i){labels}", bank), "HIGH", f"regex-{side}-bank-near-label"), (bank(flat), "LOW", "regex-bank-global")])
        fields[f"{side}_account_tail"] = _first([
            (_near(lines, f"(?i){labels}|Account", account_tail), "HIGH", f"regex-{side}-account-near-label"), (account_tail(flat), "LOW", "regex-account-global"),
        ])
    df = df.withColumns({prefix + f: fields[f] for f in FIELDS}).drop("_flat", "_lines")
    n = sum((F.col(prefix + f)["value"].isNotNull().cast("int") for f in FIELDS), F.lit(0))
    df = df.withColumn(prefix + "n_fields", n)
    return df.withColumn(prefix + "level", F.when(F.col(prefix + "n_fields") == 0, "NONE").when(F.col(prefix + "n_fields") >= 4, "EXTRACTED").otherwise("PARTIAL"))


# What a field adds to the score of a reading, and the shortest text that is a reading.
WEIGHTS = {
    "amount": 4, "transaction_reference": 3, "date_time": 3, "receiver_name": 2, "sender_name": 2, "receiver_bank": 1, "sender_bank": 1, "receiver_account_tail": 1, "sender_account_tail": 1,
}
HIGH_BONUS, REFERENCE_BONUS, DATE_BONUS, GARBAGE_COST, LEAST_LENGTH = 0.5, 1.5, 3, 0.2, 10


def reading_score(df: DataFrame, text: str, out: str = "score") -> DataFrame:
    """Add the score of a reading whose fields are columns of df: populated fields, trust, a readable date, less garbage."""
    score = F.lit(0.0)
    for f, weight in WEIGHTS.items():
        there = F.col(f)["value"].isNotNull() & (F.col(f)["confidence"] != "NONE")
        score = score + F.when(there, weight + F.when(F.col(f)["confidence"] == "HIGH", HIGH_BONUS).otherwise(0.0)).otherwise(0.0)
    bank_like = F.col("transaction_reference")["value"].rlike("(?i)^[0-9OIl]+[A-Za-z]{3}[A-Za-z0-9]+\\z")
    score = score + F.when(bank_like, REFERENCE_BONUS).otherwise(0.0)
    score = score + F.when(F.col(text).rlike(f"\\d{{1,2}}\\s*[{THAI}]\\s*\\.?\\s*[{THAI}]\\s*\\.?\\s*\\d{{2,4}}"), DATE_BONUS).otherwise(0.0)
    garbage = F.length(F.regexp_replace(F.col(text), f"[\\w{WS}{THAI}.,:;!?@%&*()/฿-]", ""))
    return df.withColumn(out, score - garbage * GARBAGE_COST)


def best_reading(df: DataFrame, key: str, variants: str) -> DataFrame:
    """(key, text, variant, score): the best of several readings of one picture; the earlier one of equals.

    Readings of LEAST_LENGTH characters or fewer are dropped; a picture without a longer one has no row. Only the score
    and the text travel to the comparison.
    """
    each = df.select(key, F.posexplode(variants).alias("variant", "text")).where(F.length("text") > LEAST_LENGTH)
    scored = reading_score(extract_fields(each, "text"), "text").select(key, "variant", "text", "score")
    best = scored.groupBy(key).agg(F.max(F.struct("score", (-F.col("variant")).alias("first"), "text")).alias("b"))
    return best.select(key, F.col("b.text").alias("text"), (-F.col("b.first")).alias("variant"), F.col("b.score").alias("score"))
