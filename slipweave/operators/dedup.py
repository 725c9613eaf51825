"""Duplicates among the records of an owner: exact, near, reviewed, decided.

Every operator works on a registry of one row per record with document_id, user_id, created_at, exact_hash and
perceptual_hash. Order is (created_at, document_id). Null and damaged hashes match nothing; rows without an owner or id
never pair; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import hashing
from slipweave.operators.skew import lookup

#: Oldest hashed records of an owner that the reference's near-duplicate search looks at; the search here looks at all unless told so.
CANDIDATE_LIMIT = 200


def latest_versions(records: DataFrame, key: str = "document_id", by: str = "updated_at", columns: list[str] | None = None) -> DataFrame:
    """One row per key: the version updated last (ties: the largest row). Rows without a key are left out.

    columns names those wanted besides the key: no other one is read, moved or compared.
    """
    if columns is not None:
        records = records.select(key, by, *(c for c in columns if c not in (key, by)))
    order = [by, *(c for c in records.columns if c not in (by, key))]
    best = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*order)).alias("_v"))
    return best.select(key, *[F.col("_v")[c].alias(c) for c in order]).select(*records.columns)


def exact_first_seen(registry: DataFrame) -> DataFrame:
    """(document_id, user_id, matched_id) of every record whose owner had the same content before.

    The earliest record per owner and hash is a minimum, combined before the shuffle; no group is collected.
    """
    rows = registry.where(F.col("exact_hash").isNotNull() & F.col("user_id").isNotNull()).select("document_id", "user_id", F.lower("exact_hash").alias("h"), "created_at")
    first = rows.groupBy("user_id", "h").agg(F.min(F.struct("created_at", "document_id")).alias("f"), F.count("*").alias("n")).where("n > 1")
    out = lookup(rows, first.select("user_id", "h", F.col("f.document_id").alias("matched_id")), ["user_id", "h"], "inner")
    return out.where(F.col("document_id") != F.col("matched_id")).select("document_id", "user_id", "matched_id")


def hashed_pool(registry: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates of the near search: (c_id, user_id, c_created, c_bits), all or the `limit` oldest of each owner."""
    pool = registry.where(F.col("perceptual_hash").isNotNull() & F.col("user_id").isNotNull()).select(
        "user_id", F.col("document_id").alias("c_id"), F.col("created_at").alias("c_created"), hashing.hash_bits(F.col("perceptual_hash")).alias("c_bits")
    )
    if limit is not None:
        pool = pool.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy("c_created", "c_id"))).where(F.col("_r") <= limit).drop("_r")
    return pool.where(F.col("c_bits").isNotNull())


def near_pairs(registry: DataFrame, limit: int | None = None, probes: DataFrame | None = None) -> DataFrame:
    """(document_id, user_id, candidate_id, distance) of every earlier candidate within the distance.

    Equal bands (nine for eight bits) make an equi-join of a theta join; a pair is kept in the first band it shares, so
    no distinct is needed afterwards. probes restricts the records that search.
    """
    wanted = (registry if probes is None else probes).where(F.col("user_id").isNotNull()).select("document_id", "user_id", "created_at", hashing.hash_bits(F.col("perceptual_hash")).alias("bits")).where(F.col("bits").isNotNull())
    left = wanted.withColumn("b", F.explode(hashing.bands(F.col("bits")))).select("*", "b.band", "b.value").drop("b")
    right = hashed_pool(registry, limit).withColumn("b", F.explode(hashing.bands(F.col("c_bits")))).select("*", "b.band", "b.value").drop("b")
    met = left.join(right, ["user_id", "band", "value"])
    distance = hashing.hamming(F.col("bits"), F.col("c_bits"))
    earlier = (F.col("c_created") < F.col("created_at")) | ((F.col("c_created") == F.col("created_at")) & (F.col("c_id") < F.col("document_id")))
    first_band = F.lit(None).cast("int")
    shift = 0
    for i, width in enumerate(hashing.BAND_WIDTHS):
        same = F.shiftrightunsigned(F.col("bits").bitwiseXOR(F.col("c_bits")), shift).bitwiseAND(F.lit(2**width - 1)) == 0
        first_band = F.coalesce(first_band, F.when(same, F.lit(i)))
        shift += width
    kept = met.where(earlier & (distance <= hashing.MAX_DISTANCE) & (F.col("band") == first_band))
    return kept.select("document_id", "user_id", F.col("c_id").alias("candidate_id"), F.col("c_created").alias("candidate_created"), distance.cast("int").alias("distance"))


def best_match(pairs: DataFrame) -> DataFrame:
    """(document_id, user_id, matched_id, distance, similarity): nearest, then earliest candidate of each record."""
    best = pairs.groupBy("document_id", "user_id").agg(F.min(F.struct("distance", "candidate_created", "candidate_id")).alias("b"))
    return best.select("document_id", "user_id", F.col("b.candidate_id").alias("matched_id"), F.col("b.distance").alias("distance"), hashing.similarity(F.col("b.distance")).alias("similarity"))


def without_reviewed(pairs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Pairs that no one has reviewed; reviewed has user_id, document_a_id and document_b_id in either order."""
    known = reviewed.select("user_id", F.least("document_a_id", "document_b_id").alias("_a"), F.greatest("document_a_id", "document_b_id").alias("_b")).distinct()
    return pairs.withColumns({"_a": F.least("document_id", "candidate_id"), "_b": F.greatest("document_id", "candidate_id")}).join(known, ["user_id", "_a", "_b"], "left_anti").drop("_a", "_b")


def decide(registry: DataFrame, exact: DataFrame, resolved: DataFrame) -> DataFrame:
    """One decision per record: exact before near before suppressed before new.

    resolved has document_id, user_id, matched_id, similarity, suppressed (boolean) and reasons (array).
    """
    e = exact.select("document_id", "user_id", F.col("matched_id").alias("e_id"))
    n = resolved.select("document_id", "user_id", F.col("matched_id").alias("n_id"), F.col("similarity").alias("n_sim"), "suppressed", "reasons")
    out = registry.select("document_id", "user_id").join(e, ["document_id", "user_id"], "left").join(n, ["document_id", "user_id"], "left")
    is_e, is_n = F.col("e_id").isNotNull(), F.col("n_id").isNotNull() & ~F.coalesce("suppressed", F.lit(False))
    held = F.coalesce("suppressed", F.lit(False))
    pick = lambda a, b, c, d: F.when(is_e, a).when(is_n, b).when(held, c).otherwise(d)
    none = F.array().cast("array<string>")
    return out.select(
        "document_id", "user_id",
        pick(F.lit("EXACT_DUPLICATE"), F.lit("LIKELY_DUPLICATE"), F.lit("NEW"), F.lit("NEW")).alias("duplicate_status"),
        pick(F.lit("EXACT_DUPLICATE"), F.lit("LIKELY_DUPLICATE_REVIEW"), F.lit("SUPPRESSED_NEAR_DUPLICATE"), F.lit("NEW_UPLOAD")).alias("decision"),
        pick(none, F.array(F.lit("IMAGE_SIMILARITY_ONLY")), F.col("reasons"), none).alias("reasons"),
        pick(F.col("e_id"), F.col("n_id"), F.lit(None), F.lit(None)).alias("matched_id"),
        pick(F.lit(1.0), F.col("n_sim"), F.lit(None), F.lit(None)).alias("similarity"),
        F.when(is_n & ~is_e, "PENDING").otherwise("NOT_REQUIRED").alias("review_status"),
    )


def uploads_by_outcome(items: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of batch outcomes per group of keys; items has `outcome` (see batch_outcome)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    return items.groupBy(*keys).agg(
        F.count("*").alias("total"), n("exactDuplicate").alias("exact"), n("reviewNeeded").alias("review_needed"), n("newUpload").alias("new"), n("suppressed").alias("suppressed"), n("qualityRejected").alias("rejected"),
        n("failed").alias("failed"),
    )


def batch_outcome(status: Column, quality: Column, duplicate_status: Column, decision: Column) -> Column:
    """Outcome of one uploaded item; the first that fits."""
    is_ = lambda c, *v: F.coalesce(c.isin(*v), F.lit(False))
    return (
        F.when(is_(status, "waiting", "uploading", "processing"), status).when(is_(status, "rejected") | is_(quality, "FAIL"), "qualityRejected").when(is_(status, "failed"), "failed")
        .when(is_(decision, "EXACT_DUPLICATE") | is_(duplicate_status, "EXACT_DUPLICATE"), "exactDuplicate")
        .when(is_(decision, "LIKELY_DUPLICATE_REVIEW") | is_(duplicate_status, "LIKELY_DUPLICATE"), "reviewNeeded").when(is_(decision, "SUPPRESSED_NEAR_DUPLICATE"), "suppressed").otherwise("newUpload")
    )
