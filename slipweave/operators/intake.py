"""Taking in a batch against a registry: decisions, the records to store and the audit rows they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.operators import assess, dedup

# Actions of the audit log by duplicate status.
ACTIONS = {"EXACT_DUPLICATE": "DOCUMENT_EXACT_DUPLICATE_UPLOADED", "LIKELY_DUPLICATE": "DOCUMENT_LIKELY_DUPLICATE_UPLOADED"}
NEW_ACTION = "DOCUMENT_NEW_UPLOADED"


def accept(registry: DataFrame, batch: DataFrame, evidence: DataFrame | None = None, fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, audit rows) of a batch whose records the registry holds already, in order of creation.

    Only the batch searches; every earlier record of the owner is a candidate. Without evidence the nearest candidate
    stands. Records have the decision (see dedup.decide) and status: READY with a picture hash, UPLOADED without. Audit
    rows have user_id, action, target_type, target_id, metadata (JSON) and created_at. An empty batch gives no rows.
    """
    pairs = dedup.near_pairs(registry, probes=batch)
    if evidence is None:
        resolved = dedup.best_match(pairs).select("*", F.lit(False).alias("suppressed"), F.array().cast("array<string>").alias("reasons"))
    else:
        resolved = assess.resolve(pairs, evidence, fields or [])
    decided = dedup.decide(batch, dedup.exact_first_seen(registry), resolved)
    own = batch.select("document_id", "user_id", "document_type", "exact_hash", "perceptual_hash", "created_at")
    records = own.join(decided, ["document_id", "user_id"]).withColumn("status", F.when(F.col("perceptual_hash").isNotNull(), "READY").otherwise("UPLOADED"))
    action = F.coalesce(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.col("duplicate_status")], F.lit(NEW_ACTION))
    told = F.to_json(F.struct(F.col("exact_hash").alias("exactHash"), F.col("document_type").alias("documentType"), F.col("perceptual_hash").alias("perceptualHash"), F.col("matched_id").alias("matchedDocumentId")))
    audit = records.select("user_id", action.alias("action"), F.lit("document").alias("target_type"), F.col("document_id").alias("target_id"), told.alias("metadata"), "created_at")
    return records, audit


def append_by_owner(records: DataFrame, path: str, buckets: int = 64) -> None:
    """Append to a table laid out by bucket of owners, so that a reader of some owners reads their buckets only."""
    records.withColumn("owner_bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")).hint("rebalance", "owner_bucket").write.mode("append").partitionBy("owner_bucket").parquet(path)


def read_owner(spark, path: str, owner: str, buckets: int = 64) -> DataFrame:
    """The records of one owner of a table that append_by_owner wrote; only its bucket is read."""
    bucket = F.pmod(F.xxhash64(F.lit(owner)), F.lit(buckets)).cast("int")
    return spark.read.parquet(path).where((F.col("owner_bucket") == bucket) & (F.col("user_id") == owner)).drop("owner_bucket")
