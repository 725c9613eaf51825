"""Image files as rows: bytes, type by content, checks before intake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipweave.functions.text import key_segment

MIME_TYPES = {"image/jpeg": "jpg", "image/png": "png", "image/webp": "webp"}
MAX_MEGABYTES = 10


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content, mime_type (by content) and exact_hash of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.withColumns({"mime_type": sniff(F.col("content")), "exact_hash": F.sha2("content", 256)})


def sniff(content: Column) -> Column:
    """Type of an image by its first bytes; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.rlike("^52494646.{8}57454250"), "image/webp")


def upload_error(declared: Column, size: Column, content_type: Column, limit: int = MAX_MEGABYTES) -> Column:
    """The first check that fails, or null."""
    return (
        F.when(~F.coalesce(declared.isin(*MIME_TYPES), F.lit(False)), "UNSUPPORTED_TYPE").when(F.coalesce(size, F.lit(0)) <= 0, "EMPTY_FILE").when(size > limit * 1024 * 1024, "TOO_LARGE")
        .when(~declared.eqNullSafe(content_type), "CONTENT_MISMATCH")
    )


def object_key(user: Column, document: Column, mime: Column) -> Column:
    ending = F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv])[mime]
    return F.concat(F.lit("documents/"), key_segment(user), F.lit("/"), key_segment(document), F.lit("/original."), F.coalesce(ending, F.lit("bin")))
