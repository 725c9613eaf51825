"""Memory of reviewed pairs, history and changes as snapshots: old table plus changes gives the new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import text
from slipweave.operators.skew import lookup

HISTORY_LIMIT, MAX_HISTORY = 5, 20


def merge_pairs(pairs: DataFrame, changes: DataFrame) -> DataFrame:
    """Pair memory after changes: the latest decision of a pair stands, created_at is the earliest.

    Both have user_id, document_a_id, document_b_id (any order), decision, reviewed_by_user_id, reviewed_at, created_at,
    updated_at. Repeated rows count once; pairs with a null id are left out.
    """
    columns = ["decision", "reviewed_by_user_id", "reviewed_at", "updated_at"]
    both = pairs.select("user_id", "document_a_id", "document_b_id", *columns, "created_at").unionByName(changes.select("user_id", "document_a_id", "document_b_id", *columns, "created_at"))
    both = both.where(F.col("document_a_id").isNotNull() & F.col("document_b_id").isNotNull())
    keyed = both.withColumns({"a": F.least("document_a_id", "document_b_id"), "b": F.greatest("document_a_id", "document_b_id")})
    merged = keyed.groupBy("user_id", "a", "b").agg(F.max(F.struct("updated_at", "reviewed_at", "decision", "reviewed_by_user_id")).alias("l"), F.min("created_at").alias("created_at"))
    return merged.select("user_id", F.col("a").alias("document_a_id"), F.col("b").alias("document_b_id"), *[F.col("l")[c].alias(c) for c in columns], "created_at")


def history(entries: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The latest entries of each document (1 to 20 of them), newest first, with their place; repeated entries count once."""
    limit = min(max(limit, 1), MAX_HISTORY)
    once = entries.dropDuplicates(["entry_id"])
    w = Window.partitionBy("document_id").orderBy(F.col("reviewed_at").desc_nulls_last(), F.col("entry_id").desc())
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def apply_changes(registry: DataFrame, changes: DataFrame, columns: list[str], key: str = "document_id") -> DataFrame:
    """Snapshot after changes: a non-null value of a change replaces the old one. Changes have one row per key."""
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = registry.join(new, key, "left")
    return joined.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).select(*registry.columns)


def correct_type(registry: DataFrame, corrections: DataFrame, cleared: list[str]) -> DataFrame:
    """Documents with a new type: the type is set and the analyses of the old type are cleared; the same type changes nothing."""
    new = corrections.select("document_id", F.col("document_type").alias("_type"))
    joined = registry.join(new, "document_id", "left")
    changed = F.coalesce(F.col("_type") != F.col("document_type"), F.lit(False))
    return joined.withColumns({"document_type": F.when(changed, F.col("_type")).otherwise(F.col("document_type")), **{c: F.when(~changed, F.col(c)) for c in cleared}}).select(*registry.columns)


def judged_requests(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """requests with status: updated, skipped (not a pending likely duplicate, or its match is gone) or not_found.

    requests has user_id, document_id, decision and may have note and reviewed_at, one row per document; records of
    another owner are not found. matched_document_id and similarity_score of the record come along.
    """
    own = registry.select("document_id", "user_id", "matched_document_id", "duplicate_status", "review_status", "similarity_score")
    found = lookup(requests, own.withColumn("_here", F.lit(True)), ["document_id", "user_id"])
    matched = registry.select("user_id", F.col("document_id").alias("matched_document_id"), F.lit(True).alias("_there"))
    joined = lookup(found, matched, ["user_id", "matched_document_id"])
    open_ = (F.col("duplicate_status") == "LIKELY_DUPLICATE") & (F.col("review_status") == "PENDING") & F.col("_there")
    status = F.when(F.col("_here").isNull(), "not_found").when(F.coalesce(open_, F.lit(False)), "updated").otherwise("skipped")
    return joined.withColumn("status", status).drop("_here", "_there", "review_status")


def outcome_counts(judged: DataFrame) -> DataFrame:
    """requested, updated, skipped and not_found per owner."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return judged.groupBy("user_id").agg(F.count("*").alias("requested"), n("updated"), n("skipped"), n("not_found"))


def changes(judged: DataFrame) -> DataFrame:
    """What the updated requests set (see apply_changes): review_status, reviewed_at, reviewed_match_id."""
    at = F.col("reviewed_at") if "reviewed_at" in judged.columns else F.current_timestamp().alias("reviewed_at")
    return judged.where("status = 'updated'").select("document_id", "user_id", F.col("decision").alias("review_status"), at, F.col("matched_document_id").alias("reviewed_match_id"))


def audit_rows(judged: DataFrame, batch_id: str | None = None) -> DataFrame:
    """One audit row per updated request, with what was decided in its metadata."""
    said = text.note(F.col("note")) if "note" in judged.columns else F.lit(None).cast("string")
    told = F.to_json(
        F.struct(
            F.col("matched_document_id").alias("matchedDocumentId"), F.col("duplicate_status").alias("machineDuplicateStatus"), F.col("similarity_score").alias("similarityScore"), F.col("decision").alias("reviewDecision"),
            said.alias("reviewNote"), F.col("user_id").alias("reviewedByUserId"), F.lit(batch_id).cast("string").alias("bulkReviewBatchId"),
        )
    )
    at = F.col("reviewed_at") if "reviewed_at" in judged.columns else F.current_timestamp()
    return judged.where("status = 'updated'").select(
        "user_id", F.concat(F.lit("DOCUMENT_REVIEW_"), "decision").alias("action"), F.lit("document").alias("target_type"), F.col("document_id").alias("target_id"), told.alias("metadata"), at.alias("created_at")
    )


_SAID = "struct<reviewDecision:string,reviewNote:string,reviewedByUserId:string,matchedDocumentId:string,bulkReviewBatchId:string>"


def history_of_audit(logs: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The latest reviews of each document from the audit log, newest first, with their place.

    The decision of the metadata stands before the one the action names, the reviewer of the metadata before the row's
    user; missing or broken metadata give nulls. Repeated rows count once.
    """
    limit = min(max(limit, 1), MAX_HISTORY)
    decisions = ["CONFIRMED_DUPLICATE", "CONFIRMED_DISTINCT"]
    mine = logs.where((F.col("target_type") == "document") & F.col("target_id").isNotNull() & F.col("action").isin([f"DOCUMENT_REVIEW_{d}" for d in decisions]))
    once = mine.select("audit_id", "user_id", "action", "target_id", "metadata", "created_at").distinct().withColumn("_m", F.from_json("metadata", _SAID))
    w = Window.partitionBy("user_id", "target_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("audit_id").desc())
    decision = F.when(F.col("_m.reviewDecision").isin(decisions), F.col("_m.reviewDecision")).otherwise(F.replace("action", F.lit("DOCUMENT_REVIEW_"), F.lit("")))
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).select(
        "audit_id", F.col("target_id").alias("document_id"), decision.alias("decision"), F.col("created_at").alias("reviewed_at"), text.note(F.col("_m.reviewNote")).alias("note"),
        F.coalesce("_m.reviewedByUserId", "user_id").alias("actor_user_id"), F.col("_m.matchedDocumentId").alias("matched_document_id"), F.col("_m.bulkReviewBatchId").alias("bulk_review_batch_id"), "place",
    )
