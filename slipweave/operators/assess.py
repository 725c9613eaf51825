"""Evidence for and against a near duplicate: compares the fields of two slips and resolves a record's candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipweave.functions import hashing, text
from slipweave.functions.labels import REASONS

# Conflicts by name and their reason codes.
CODES = {v: k for k, v in REASONS.items()}


#: Forms in which fields are compared, made once a document.
FORMS = {
    "amount": text.amount_key, "transaction_reference": text.reference_key, "receiver_name": text.thai_name_key, "sender_name": text.thai_name_key, "date_time": text.date_time_key, "receiver_bank": text.basic,
}
# Texts of conflicts by field.
PAYLOADS = {"qr_text": ("identical QR payload", "different raw QR payload"), "payload": ("identical transfer metadata payload", "different transfer metadata payload")}
PARTS = {"qr_amount": "different amount", "qr_target": "different recipient", "qr_reference": "different transaction reference"}
STRONG = {"amount": "image-read different amount", "transaction_reference": "image-read different transaction reference"}
OTHERS = {
    "receiver_name": "image-read different recipient", "sender_name": "image-read different sender", "date_time": "image-read different date/time", "receiver_bank": "image-read different receiver bank",
}


def keyed(field: str, column: Column) -> Column:
    """What is compared of a field: a text (null if blank), or struct<key, level> with level 2 HIGH, 1 MEDIUM, 0 no evidence."""
    if field not in FORMS:
        return F.when(text.non_empty(column), column)
    level = F.when(column["value"].isNull(), 0).when(column["confidence"] == "HIGH", 2).when(column["confidence"] == "MEDIUM", 1).otherwise(0)
    return F.struct(FORMS[field](column["value"]).alias("key"), F.coalesce(level, F.lit(0)).alias("level"))


def _conflict(name: str, when: Column) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(name))


def _unlike(field: str, x: Column, y: Column) -> Column:
    return text.compare_keys(x, y) == "DIFFERENT" if field in ("receiver_name", "sender_name") else x != y


def judge(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """struct<result, conflicts, reasons> of two documents by their keyed fields; see assess."""
    have = lambda k: k in a and k in b
    matches = [F.when(a[k] == b[k], F.lit(same)) for k, (same, _) in PAYLOADS.items() if have(k)]
    conflicts = [_conflict(differ, a[k] != b[k]) for k, (_, differ) in PAYLOADS.items() if have(k)] + [_conflict(differ, a[k] != b[k]) for k, differ in PARTS.items() if have(k)]
    both = lambda k, level: (a[k]["level"] >= level) & (b[k]["level"] >= level)
    firm = [_conflict(differ, both(k, 1) & (a[k]["key"] != b[k]["key"])) for k, differ in STRONG.items() if have(k)]
    firm += [_conflict(differ, both(k, 2) & _unlike(k, a[k]["key"], b[k]["key"])) for k, differ in OTHERS.items() if have(k)]
    # Two medium readings tell less: they count only where something else differs too.
    soft = [_conflict(differ, (a[k]["level"] == 1) & (b[k]["level"] == 1) & _unlike(k, a[k]["key"], b[k]["key"])) for k, differ in OTHERS.items() if have(k)]
    array = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    code = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    # One struct of the three lists first, so that none of them is made again by each use.
    found = F.struct(array(matches).alias("supports"), array(conflicts).alias("plain"), array(firm).alias("firm"), array(soft).alias("soft"))

    def told(f: Column) -> Column:
        counted = (F.size(f["soft"]) >= 2) | ((F.size(f["soft"]) >= 1) & (F.size(f["firm"]) > 0))
        against = F.concat(f["plain"], f["firm"], F.when(counted, f["soft"]).otherwise(F.array().cast("array<string>")))
        return F.struct(f["supports"].alias("supports"), against.alias("against"))

    def result(t: Column) -> Column:
        supports, against = F.size(t["supports"]) > 0, F.size(t["against"]) > 0
        named = F.transform(F.when(supports, t["supports"]).otherwise(t["against"]), lambda x: code[x])
        return F.struct(
            F.when(supports, "MATCH").when(against, "CONFLICT").otherwise("INSUFFICIENT_EVIDENCE").alias("result"), t["against"].alias("conflicts"), F.when(supports | against, named).otherwise(F.array(F.lit("IMAGE_SIMILARITY_ONLY"))).alias("reasons")
        )

    return F.transform(F.transform(F.array(found), told), result)[0]


def assess(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """struct<result, conflicts, reasons> of two documents.

    a and b may have qr_text, payload, qr_amount, qr_target, qr_reference (texts) and the image-read structs amount,
    transaction_reference, receiver_name, sender_name, date_time, receiver_bank; a missing one is no evidence. Equal QR
    texts or payloads are a MATCH whatever else differs; any conflict is a CONFLICT; else INSUFFICIENT_EVIDENCE.
    """
    return judge({k: keyed(k, c) for k, c in a.items()}, {k: keyed(k, c) for k, c in b.items()})


def resolve(pairs: DataFrame, evidence: DataFrame, fields: list[str]) -> DataFrame:
    """One row per record with candidates: the nearest one that no evidence contradicts, else the nearest as suppressed.

    evidence has document_id, document_type and the named fields, one row per document, and may have has_evidence: only
    bank transfer slips of which something was read or parsed are judged; any other record keeps its nearest candidate.
    Fields are brought to their compared form once a document. One minimum per record gives both answers.
    """
    gate = F.col("document_type") == "BANK_TRANSFER_SLIP"
    if "has_evidence" in evidence.columns:
        gate = gate & F.coalesce("has_evidence", F.lit(False))
    keys = evidence.select("document_id", F.coalesce(gate, F.lit(False)).alias("judged"), *[keyed(f, F.col(f)).alias(f) for f in fields])
    side = lambda x: keys.select(F.col("document_id").alias(f"_{x}"), F.col("judged").alias(f"_{x}_judged"), *[F.col(f).alias(f"_{x}_{f}") for f in fields])
    joined = pairs.join(side("a"), F.col("document_id") == F.col("_a"), "left").join(side("b"), F.col("candidate_id") == F.col("_b"), "left")
    found = judge({f: F.col(f"_a_{f}") for f in fields}, {f: F.col(f"_b_{f}") for f in fields})
    judged = joined.withColumn("_e", F.when(F.col("_a_judged"), found))
    against = F.coalesce(F.col("_e.result") == "CONFLICT", F.lit(False))
    best = judged.groupBy("document_id", "user_id").agg(F.min(F.struct(against.alias("against"), "distance", "candidate_created", "candidate_id", F.col("_e.reasons").alias("reasons"))).alias("b"))
    return best.select(
        "document_id", "user_id", F.when(~F.col("b.against"), F.col("b.candidate_id")).alias("matched_id"), F.when(~F.col("b.against"), hashing.similarity(F.col("b.distance"))).alias("similarity"),
        F.col("b.against").alias("suppressed"), F.when(F.col("b.against"), F.col("b.reasons")).alias("reasons"),
    )
