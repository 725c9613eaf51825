"""Enumerations of the registry and their English labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations and texts.
DOCUMENT_TYPES = {"BANK_TRANSFER_SLIP": "Bank transfer slip", "DEPOSIT_PAYMENT_SLIP": "Deposit / payment slip", "CHEQUE": "Cheque", "UNKNOWN": "Unknown"}
REASONS = {
    "IMAGE_SIMILARITY_ONLY": "image similarity only", "IDENTICAL_QR_PAYLOAD": "identical QR payload", "IDENTICAL_TRANSFER_METADATA_PAYLOAD": "identical transfer metadata payload",
    "AMOUNT_MISMATCH": "different amount", "RECIPIENT_MISMATCH": "different recipient", "REFERENCE_MISMATCH": "different transaction reference", "QR_PAYLOAD_MISMATCH": "different raw QR payload",
    "TRANSFER_METADATA_PAYLOAD_MISMATCH": "different transfer metadata payload", "IMAGE_READ_AMOUNT_MISMATCH": "image-read different amount",
    "IMAGE_READ_RECIPIENT_MISMATCH": "image-read different recipient", "IMAGE_READ_SENDER_MISMATCH": "image-read different sender",
    "IMAGE_READ_REFERENCE_MISMATCH": "image-read different transaction reference", "IMAGE_READ_DATETIME_MISMATCH": "image-read different date/time", "IMAGE_READ_BANK_MISMATCH": "image-read different receiver bank",
}


def label(code: Column, table: dict[str, str] | None = None) -> Column:
    """Label of a code; a code that is not in the table is shown in words."""
    words = F.initcap(F.lower(F.replace(code, F.lit("_"), F.lit(" "))))
    if not table:
        return words
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[code], words)


def reasons_text(codes: Column, separator: str = "; ") -> Column:
    return F.array_join(F.transform(F.coalesce(codes, F.array().cast("array<string>")), lambda c: label(c, REASONS)), separator)


def result_summary(duplicate_status: Column, decision: Column, review_status: Column, quality_status: Column, reasons: Column) -> Column:
    """Ordered array of struct<label, value, tone> of what is known about a record."""
    is_ = lambda c, v: F.coalesce(c == v, F.lit(False))
    item = lambda name, value, tone: F.struct(F.lit(name).alias("label"), (value if isinstance(value, Column) else F.lit(value)).alias("value"), F.lit(tone).alias("tone"))
    held = is_(decision, "SUPPRESSED_NEAR_DUPLICATE")
    exact, likely = is_(decision, "EXACT_DUPLICATE") | is_(duplicate_status, "EXACT_DUPLICATE"), is_(decision, "LIKELY_DUPLICATE_REVIEW") | is_(duplicate_status, "LIKELY_DUPLICATE")
    first = (
        F.when(exact, item("Duplicate check", "Exact duplicate found", "info")).when(likely, item("Duplicate check", "Likely duplicate, review needed", "warning"))
        .when(held, item("Duplicate check", "Near-duplicate suppressed", "info")).otherwise(item("Duplicate check", "New upload", "positive"))
    )
    why = F.when(~exact & ~likely & held, item("Why", reasons_text(reasons, ", "), "info"))
    review = (
        F.when(is_(review_status, "PENDING"), item("Review", "Pending your review", "warning")).when(is_(review_status, "CONFIRMED_DUPLICATE"), item("Review", "Confirmed duplicate", "info"))
        .when(is_(review_status, "CONFIRMED_DISTINCT"), item("Review", "Confirmed distinct", "positive"))
    )
    quality = F.when(is_(quality_status, "WARN"), item("Quality", "Warnings detected", "warning")).when(is_(quality_status, "FAIL"), item("Quality", "Image rejected", "warning"))
    return F.array_compact(F.array(first, why, review, quality))
