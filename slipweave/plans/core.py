"""Queries of the core operators over the test tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slipweave.functions import hashing, labels, qr, quality, slips, text
from slipweave.operators import assess, dedup, intake, registry, review, timestamps
from slipweave.sources import files
from slipweave.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL where SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _registry(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The registry, or of it only the id and the named columns."""
    return dedup.latest_versions(read_table(spark, sf_dir, "document_records"), columns=list(columns) or None)


_HASHES = ("user_id", "created_at", "exact_hash", "perceptual_hash")


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest read of each document; a read delivered again counts once."""
    return dedup.latest_versions(read_table(spark, sf_dir, "slip_reads").dropDuplicates(["read_id"]).withColumn("_at", F.col("read_at")), by="_at").drop("_at")


# White space of the web platform in SQL.
_WS = "[\\s\\x0b\\x{{00a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]"
_JS_TRIM = f"regexp_replace({{0}}, '^{_WS}+|{_WS}+$', '', 'g')"

# The same registry in SQL: the version updated last; rows of one time differ in nothing but the match.
_REG = """
reg AS (SELECT * FROM document_records WHERE document_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC, matched_document_id DESC NULLS LAST) = 1)"""
_HASHED = (
    _REG
    + """,
hashed AS (SELECT user_id, document_id, created_at, perceptual_hash,
    CASE WHEN regexp_full_match(perceptual_hash, '[0-9a-fA-F]{16}') THEN ('0x' || perceptual_hash)::UBIGINT END AS bits
  FROM reg WHERE perceptual_hash IS NOT NULL AND user_id IS NOT NULL)"""
)
_EARLIER = "(c.created_at < p.created_at OR (c.created_at = p.created_at AND c.document_id < p.document_id))"
_POOL = """,
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, document_id) AS r FROM hashed) WHERE r <= 200 AND bits IS NOT NULL)"""
_PAIRS = (
    _HASHED
    + _POOL
    + f""",
pairs AS (SELECT p.document_id, p.user_id, c.document_id AS candidate_id, c.created_at AS candidate_created, bit_count(xor(p.bits, c.bits)) AS distance
  FROM hashed p JOIN pool c ON p.user_id = c.user_id AND {_EARLIER} WHERE bit_count(xor(p.bits, c.bits)) <= 8)"""
)
# The same pairs with every hashed record of the owner as a candidate.
_ALL_PAIRS = _PAIRS.replace(_POOL, """,
pool AS (SELECT * FROM hashed WHERE bits IS NOT NULL)""")
_EXACT = """,
exact AS (SELECT document_id, user_id, first_value(document_id) OVER (PARTITION BY user_id, lower(exact_hash) ORDER BY created_at, document_id) AS matched_id
  FROM reg WHERE exact_hash IS NOT NULL AND user_id IS NOT NULL QUALIFY matched_id <> document_id),
best AS (SELECT document_id, user_id, candidate_id AS matched_id, distance FROM pairs
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY distance, candidate_created, candidate_id) = 1)"""


# Queries named *_uncapped compare with all records of the owner; those without it keep the reference's cap, as their SQL does.

# --- duplicates -------------------------------------------------------------------------------------------------------


@query(f"WITH {_PAIRS}{_EXACT} SELECT document_id, user_id, matched_id FROM exact")
def exact_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_first_seen(_registry(spark, sf_dir, "user_id", "created_at", "exact_hash"))


_BEST = "SELECT document_id, user_id, matched_id, distance::INTEGER AS distance, round(1 - distance / 64.0, 4)::DOUBLE AS similarity FROM best"


@query(f"WITH {_PAIRS}{_EXACT} {_BEST}")
def near_dup_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.best_match(dedup.near_pairs(_registry(spark, sf_dir, *_HASHES), dedup.CANDIDATE_LIMIT))


@query(f"WITH {_ALL_PAIRS}{_EXACT} {_BEST}")
def near_dup_best_match_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.best_match(dedup.near_pairs(_registry(spark, sf_dir, *_HASHES)))


@query(f"""WITH {_HASHED} SELECT p.document_id, count(*) AS n_candidates, min(bit_count(xor(p.bits, c.bits)))::INTEGER AS nearest
FROM hashed p JOIN hashed c ON p.user_id = c.user_id AND {_EARLIER} WHERE bit_count(xor(p.bits, c.bits)) <= 8 GROUP BY p.document_id""")
def near_dup_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = dedup.near_pairs(_registry(spark, sf_dir, *_HASHES))
    return pairs.groupBy("document_id").agg(F.count("*").alias("n_candidates"), F.min("distance").alias("nearest"))


def _decisions(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    reg = _registry(spark, sf_dir, *_HASHES)
    best = dedup.best_match(dedup.near_pairs(reg, limit)).select("*", F.lit(False).alias("suppressed"), F.array().cast("array<string>").alias("reasons"))
    return dedup.decide(reg, dedup.exact_first_seen(reg), best)


_DECIDED = f"""WITH {_PAIRS}{_EXACT}, decided AS (SELECT r.document_id, r.user_id,
  CASE WHEN e.matched_id IS NOT NULL THEN 'EXACT_DUPLICATE' WHEN b.matched_id IS NOT NULL THEN 'LIKELY_DUPLICATE' ELSE 'NEW' END AS duplicate_status,
  CASE WHEN e.matched_id IS NOT NULL THEN 'EXACT_DUPLICATE' WHEN b.matched_id IS NOT NULL THEN 'LIKELY_DUPLICATE_REVIEW' ELSE 'NEW_UPLOAD' END AS decision,
  CASE WHEN e.matched_id IS NULL AND b.matched_id IS NOT NULL THEN 'IMAGE_SIMILARITY_ONLY' ELSE '' END AS reasons, coalesce(e.matched_id, b.matched_id) AS matched_id,
  CASE WHEN e.matched_id IS NOT NULL THEN 1.0::DOUBLE ELSE round(1 - b.distance / 64.0, 4)::DOUBLE END AS similarity,
  CASE WHEN e.matched_id IS NULL AND b.matched_id IS NOT NULL THEN 'PENDING' ELSE 'NOT_REQUIRED' END AS review_status
  FROM reg r LEFT JOIN exact e USING (document_id) LEFT JOIN best b ON b.document_id = r.document_id) """
_ALL_DECIDED = _DECIDED.replace(_PAIRS, _ALL_PAIRS)


@query(_DECIDED + "SELECT * FROM decided")
def duplicate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir, dedup.CANDIDATE_LIMIT).withColumn("reasons", F.array_join("reasons", ";"))


@query(_ALL_DECIDED + "SELECT * FROM decided")
def duplicate_decision_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ";"))


_COUNTED = """SELECT user_id, count(*) AS total, count(*) FILTER (duplicate_status = 'EXACT_DUPLICATE') AS exact,
count(*) FILTER (duplicate_status = 'LIKELY_DUPLICATE') AS likely, count(*) FILTER (duplicate_status = 'NEW') AS new FROM decided GROUP BY user_id"""


def _counted(decisions: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("duplicate_status") == s)
    return decisions.groupBy("user_id").agg(F.count("*").alias("total"), n("EXACT_DUPLICATE").alias("exact"), n("LIKELY_DUPLICATE").alias("likely"), n("NEW").alias("new"))


@query(_DECIDED + _COUNTED)
def decision_counts_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_decisions(spark, sf_dir, dedup.CANDIDATE_LIMIT))


@query(_ALL_DECIDED + _COUNTED)
def decision_counts_by_owner_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(_decisions(spark, sf_dir))


_UNSEEN = """, seen AS (SELECT DISTINCT user_id, least(document_a_id, document_b_id) AS a, greatest(document_a_id, document_b_id) AS b FROM review_pairs)
SELECT document_id, candidate_id, distance::INTEGER AS distance FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = p.user_id AND s.a = least(p.document_id, p.candidate_id) AND s.b = greatest(p.document_id, p.candidate_id))"""


def _unseen(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    pairs = dedup.near_pairs(_registry(spark, sf_dir, *_HASHES), limit)
    return dedup.without_reviewed(pairs, read_table(spark, sf_dir, "review_pairs")).select("document_id", "candidate_id", "distance")


@query(f"WITH {_PAIRS}{_UNSEEN}")
def reviewed_pair_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unseen(spark, sf_dir, dedup.CANDIDATE_LIMIT)


@query(f"WITH {_ALL_PAIRS}{_UNSEEN}")
def reviewed_pair_antijoin_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unseen(spark, sf_dir)


EVIDENCE = ["amount", "transaction_reference", "receiver_name", "sender_name", "date_time", "receiver_bank"]


def _key_sql(field: str, value: str) -> str:
    """The compared form of a field in SQL."""
    ws, thai = _WS.replace("{{", "{").replace("}}", "}"), "[\\x{0e00}-\\x{0e7f}]"
    trimmed = f"regexp_replace(coalesce({value}, ''), '^{ws}+|{ws}+$', '', 'g')"
    one_blank = lambda x: f"regexp_replace({x}, '{ws}+', ' ', 'g')"
    if field == "amount":
        kept = f"regexp_replace({value}, '[^0-9.]', '', 'g')"
        return f"coalesce(TRY_CAST(nullif(regexp_extract({kept}, '^(\\d+\\.?\\d*|\\.\\d+)', 1), '') AS DOUBLE)::VARCHAR, {one_blank(f'lower({trimmed})')})"
    if field == "transaction_reference":
        form = "^([0-9OIl]{9,20})([A-Za-z]{3,5}?)([0-9OIl]{4,})$"
        digits = lambda g: f"translate(upper(regexp_extract({trimmed}, '{form}', {g})), 'OIL', '011')"
        # Leading zeros go while eight digits follow.
        bank = f"right({digits(1)}, greatest(8, length(ltrim({digits(1)}, '0')))) || upper(regexp_extract({trimmed}, '{form}', 2)) || {digits(3)}"
        return f"CASE WHEN regexp_matches({trimmed}, '{form}') THEN {bank} ELSE {one_blank(f'lower({trimmed})')} END"
    if field in ("receiver_name", "sender_name"):
        v = f"regexp_replace({trimmed}, '\\x{{0e4d}} ?\\x{{0e32}}', 'ำ', 'g')"
        for _ in range(2):  # a letter between two blanks belongs to both
            v = f"regexp_replace({v}, '({thai}){ws}+({thai})', '\\1\\2', 'g')"
        for title in (f"^น{ws}*\\.{ws}*ส{ws}*\\.{ws}*", f"^นางสาว{ws}*", f"^นาง{ws}*", f"^นาย{ws}*"):
            v = f"regexp_replace({v}, '{title}', '')"
        edge = f"(?:{ws}|[-.,;:''\"()\\[\\]])+"
        v = one_blank(f"regexp_replace({v}, '^{edge}|{edge}$', '', 'g')")
        return f"lower(regexp_replace({v}, '^{ws}+|{ws}+$', '', 'g'))"
    if field == "date_time":
        v = f"regexp_replace({trimmed}, '{ws}*({thai}){ws}*', '\\1', 'g')"
        v = one_blank(f"regexp_replace({v}, '{ws}*\\.{ws}*', '.', 'g')")
        return f"lower(regexp_replace({v}, '^{ws}+|{ws}+$', '', 'g'))"
    return one_blank(f"lower({trimmed})")


_NAMES_DIFFER = "(a.{f} <> '' AND b.{f} <> '' AND a.{f} <> b.{f} AND NOT (least(length(a.{f}), length(b.{f})) >= 4 AND starts_with(CASE WHEN length(a.{f}) <= length(b.{f}) THEN b.{f} ELSE a.{f} END, CASE WHEN length(a.{f}) <= length(b.{f}) THEN a.{f} ELSE b.{f} END)))"


def _differs(field: str, level: str) -> str:
    unlike = (_NAMES_DIFFER if field in ("receiver_name", "sender_name") else "a.{f} <> b.{f}").replace("{f}", field)
    code = {
        "amount": "IMAGE_READ_AMOUNT_MISMATCH", "transaction_reference": "IMAGE_READ_REFERENCE_MISMATCH", "receiver_name": "IMAGE_READ_RECIPIENT_MISMATCH", "sender_name": "IMAGE_READ_SENDER_MISMATCH",
        "date_time": "IMAGE_READ_DATETIME_MISMATCH", "receiver_bank": "IMAGE_READ_BANK_MISMATCH",
    }[field]
    return f"CASE WHEN {level.replace('{f}', field)} AND {unlike} THEN '{code}' END"


_HIGH, _SOME, _MEDIUM = "a.{f}_l = 2 AND b.{f}_l = 2", "a.{f}_l >= 1 AND b.{f}_l >= 1", "a.{f}_l = 1 AND b.{f}_l = 1"
_FIRM = ", ".join([_differs(f, _SOME) for f in EVIDENCE[:2]] + [_differs(f, _HIGH) for f in EVIDENCE[2:]])
_SOFT = ", ".join(_differs(f, _MEDIUM) for f in EVIDENCE[2:])
_KEYED = ", ".join(
    f"{_key_sql(f, f'rd.{f}.value')} AS {f}, CASE WHEN rd.{f}.value IS NULL THEN 0 WHEN rd.{f}.confidence = 'HIGH' THEN 2 WHEN rd.{f}.confidence = 'MEDIUM' THEN 1 ELSE 0 END AS {f}_l" for f in EVIDENCE
)
# The latest read of each document; a read delivered again counts once.
_RD = """rd AS (SELECT * FROM (SELECT * FROM slip_reads QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY arrived_at) = 1) WHERE document_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY read_at DESC, read_id DESC) = 1)"""
_JUDGED = f""", {_RD},
ev AS (SELECT reg.document_id, reg.document_type = 'BANK_TRANSFER_SLIP' AND rd.result IN ('EXTRACTED', 'PARTIAL') AS judged, {_KEYED} FROM reg JOIN rd ON rd.document_id = reg.document_id),
met AS (SELECT p.*, a.judged, list_filter([{_FIRM}], lambda x: x IS NOT NULL) AS firm, list_filter([{_SOFT}], lambda x: x IS NOT NULL) AS soft
  FROM pairs p LEFT JOIN ev a ON a.document_id = p.document_id LEFT JOIN ev b ON b.document_id = p.candidate_id),
told AS (SELECT *, firm || CASE WHEN len(soft) >= 2 OR (len(soft) >= 1 AND len(firm) > 0) THEN soft ELSE [] END AS against FROM met),
seen AS (SELECT *, coalesce(judged, false) AND len(against) > 0 AS held FROM told),
near AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY held, distance, candidate_created, candidate_id) = 1)
SELECT r.document_id, r.user_id, CASE WHEN e.matched_id IS NOT NULL THEN 'EXACT_DUPLICATE' WHEN NOT n.held THEN 'LIKELY_DUPLICATE' ELSE 'NEW' END AS duplicate_status,
  CASE WHEN e.matched_id IS NOT NULL THEN 'EXACT_DUPLICATE' WHEN NOT n.held THEN 'LIKELY_DUPLICATE_REVIEW' ELSE 'SUPPRESSED_NEAR_DUPLICATE' END AS decision,
  CASE WHEN e.matched_id IS NOT NULL THEN '' WHEN NOT n.held THEN 'IMAGE_SIMILARITY_ONLY' ELSE array_to_string(n.against, ';') END AS reasons,
  CASE WHEN e.matched_id IS NOT NULL THEN e.matched_id WHEN NOT n.held THEN n.candidate_id END AS matched_id,
  CASE WHEN e.matched_id IS NOT NULL THEN 1.0::DOUBLE WHEN NOT n.held THEN round(1 - n.distance / 64.0, 4)::DOUBLE END AS similarity,
  CASE WHEN e.matched_id IS NULL AND NOT n.held THEN 'PENDING' ELSE 'NOT_REQUIRED' END AS review_status
FROM reg r LEFT JOIN exact e USING (document_id) LEFT JOIN near n ON n.document_id = r.document_id WHERE e.matched_id IS NOT NULL OR n.document_id IS NOT NULL"""



def _suppressed(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    """Near duplicates after evidence: the nearest candidate that no slip field contradicts, else the reasons."""
    reg = _registry(spark, sf_dir, *_HASHES, "document_type")
    read = _reads(spark, sf_dir).select("document_id", F.col("result").isin("EXTRACTED", "PARTIAL").alias("has_evidence"), *EVIDENCE)
    evidence = reg.select("document_id", "document_type").join(read, "document_id")
    resolved = assess.resolve(dedup.near_pairs(reg, limit), evidence, EVIDENCE)
    return dedup.decide(reg, dedup.exact_first_seen(reg), resolved).where("decision <> 'NEW_UPLOAD'").withColumn("reasons", F.array_join("reasons", ";"))


@query(f"WITH {_PAIRS}{_EXACT}{_JUDGED}")
def suppressed_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppressed(spark, sf_dir, dedup.CANDIDATE_LIMIT)


@query(f"WITH {_ALL_PAIRS}{_EXACT}{_JUDGED}")
def suppressed_near_duplicates_uncapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppressed(spark, sf_dir)


@query(
    _ALL_DECIDED
    + """SELECT d.document_id, d.decision, d.matched_id, d.similarity, CASE WHEN r.perceptual_hash IS NULL THEN 'UPLOADED' ELSE 'READY' END AS status,
CASE d.duplicate_status WHEN 'EXACT_DUPLICATE' THEN 'DOCUMENT_EXACT_DUPLICATE_UPLOADED' WHEN 'LIKELY_DUPLICATE' THEN 'DOCUMENT_LIKELY_DUPLICATE_UPLOADED' ELSE 'DOCUMENT_NEW_UPLOADED' END AS audit_action
FROM decided d JOIN reg r USING (document_id) WHERE r.intake_batch >= 1"""
)
def intake_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of new batches decided against everything of their owner that is earlier, with what is stored of them."""
    reg = _registry(spark, sf_dir, *_HASHES, "intake_batch", "document_type")
    stored, audit = intake.accept(reg, reg.where("intake_batch >= 1"))
    return stored.join(audit.select("target_id", F.col("action").alias("audit_action")), F.col("document_id") == F.col("target_id")).select("document_id", "decision", "matched_id", "similarity", "status", "audit_action")


_ASKED = """asked AS (SELECT DISTINCT user_id, document_id, action AS decision, note FROM review_history WHERE user_id IS NOT NULL AND document_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY user_id, document_id ORDER BY reviewed_at DESC, entry_id DESC) = 1),
told AS (SELECT a.user_id, a.document_id, CASE WHEN r.document_id IS NULL THEN 'not_found'
  WHEN r.duplicate_status IS DISTINCT FROM 'LIKELY_DUPLICATE' OR r.review_status IS DISTINCT FROM 'PENDING' OR m.document_id IS NULL THEN 'skipped' ELSE 'updated' END AS status
  FROM asked a LEFT JOIN reg r ON r.document_id = a.document_id AND r.user_id = a.user_id LEFT JOIN reg m ON m.document_id = r.matched_document_id AND m.user_id = a.user_id)"""


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest entry of each document in the history, read as a request to review it."""
    entries = read_table(spark, sf_dir, "review_history").where(F.col("user_id").isNotNull() & F.col("document_id").isNotNull())
    latest = entries.groupBy("user_id", "document_id").agg(F.max(F.struct("reviewed_at", "entry_id", "action", "note")).alias("e"))
    return latest.select("user_id", "document_id", F.col("e.action").alias("decision"), F.col("e.note").alias("note"), F.col("e.reviewed_at").alias("reviewed_at"))


@query(f"""WITH {_REG}, {_ASKED} SELECT user_id, count(*) AS requested, count(*) FILTER (status = 'updated') AS updated, count(*) FILTER (status = 'skipped') AS skipped,
count(*) FILTER (status = 'not_found') AS not_found FROM told GROUP BY user_id""")
def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a bulk review per owner."""
    reg = _registry(spark, sf_dir, "user_id", "matched_document_id", "duplicate_status", "review_status", "similarity_score")
    return review.outcome_counts(review.judged_requests(reg, _asked(spark, sf_dir)))


@query(f"""WITH {_REG}, {_ASKED} SELECT t.document_id, a.decision AS review_status, r.matched_document_id AS reviewed_match_id, 'DOCUMENT_REVIEW_' || a.decision AS audit_action
FROM told t JOIN asked a USING (user_id, document_id) JOIN reg r USING (document_id) WHERE t.status = 'updated'""")
def reviewed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bulk review changes: the record, and the audit row it leaves."""
    reg = _registry(spark, sf_dir, "user_id", "matched_document_id", "duplicate_status", "review_status", "similarity_score")
    judged = review.judged_requests(reg, _asked(spark, sf_dir))
    audit = review.audit_rows(judged).select(F.col("target_id").alias("document_id"), F.col("action").alias("audit_action"))
    changed = review.changes(judged).select("document_id", "review_status", "reviewed_match_id")
    return changed.join(audit, "document_id")


@query("""WITH once AS (SELECT DISTINCT audit_id, user_id, action, target_type, target_id, metadata, created_at FROM audit_logs),
said AS (SELECT *, json_extract_string(nullif(metadata, ''), '$.reviewDecision') AS named FROM once WHERE target_type = 'document' AND target_id IS NOT NULL AND action LIKE 'DOCUMENT_REVIEW_CONFIRMED_%')
SELECT audit_id, target_id AS document_id, CASE WHEN named IN ('CONFIRMED_DUPLICATE', 'CONFIRMED_DISTINCT') THEN named ELSE replace(action, 'DOCUMENT_REVIEW_', '') END AS decision,
coalesce(json_extract_string(nullif(metadata, ''), '$.reviewedByUserId'), user_id) AS actor_user_id, json_extract_string(nullif(metadata, ''), '$.matchedDocumentId') AS matched_document_id,
row_number() OVER (PARTITION BY user_id, target_id ORDER BY created_at DESC, audit_id DESC) AS place FROM said
QUALIFY row_number() OVER (PARTITION BY user_id, target_id ORDER BY created_at DESC, audit_id DESC) <= 5""")
def history_from_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest reviews of each document as the audit log tells them."""
    return review.history_of_audit(read_table(spark, sf_dir, "audit_logs")).select("audit_id", "document_id", "decision", "actor_user_id", "matched_document_id", "place")


_OUTCOME = """CASE WHEN quality_status = 'FAIL' THEN 'qualityRejected' WHEN duplicate_decision_type = 'EXACT_DUPLICATE' OR duplicate_status = 'EXACT_DUPLICATE' THEN 'exactDuplicate'
WHEN duplicate_decision_type = 'LIKELY_DUPLICATE_REVIEW' OR duplicate_status = 'LIKELY_DUPLICATE' THEN 'reviewNeeded' WHEN duplicate_decision_type = 'SUPPRESSED_NEAR_DUPLICATE' THEN 'suppressed' ELSE 'newUpload' END"""


@query(f"""WITH {_REG}, items AS (SELECT intake_batch, {_OUTCOME} AS outcome FROM reg) SELECT intake_batch, count(*) AS total, count(*) FILTER (outcome = 'exactDuplicate') AS exact,
count(*) FILTER (outcome = 'reviewNeeded') AS review_needed, count(*) FILTER (outcome = 'newUpload') AS new, count(*) FILTER (outcome = 'suppressed') AS suppressed,
count(*) FILTER (outcome = 'qualityRejected') AS rejected, count(*) FILTER (outcome = 'failed') AS failed FROM items GROUP BY intake_batch""")
def batch_outcome_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = dedup.batch_outcome(F.lit("completed"), F.col("quality_status"), F.col("duplicate_status"), F.col("duplicate_decision_type"))
    return dedup.uploads_by_outcome(_registry(spark, sf_dir).withColumn("outcome", outcome), ["intake_batch"])


# --- registry -----------------------------------------------------------------------------------------------------------


@query(f"WITH {_REG} SELECT document_type, review_status, count(*) AS n FROM reg WHERE duplicate_status = 'LIKELY_DUPLICATE' AND document_type = 'BANK_TRANSFER_SLIP' GROUP BY document_type, review_status")
def dashboard_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.filtered(_registry(spark, sf_dir), duplicate_status="LIKELY_DUPLICATE", document_type="BANK_TRANSFER_SLIP", review_status="all")
    return rows.groupBy("document_type", "review_status").agg(F.count("*").alias("n"))


@query(f"""WITH {_REG} SELECT 'all' AS preset, count(*) AS n FROM reg UNION ALL SELECT 'needs_review', count(*) FROM reg WHERE review_status = 'PENDING'
UNION ALL SELECT 'exact_duplicates', count(*) FROM reg WHERE duplicate_status = 'EXACT_DUPLICATE' UNION ALL SELECT 'likely_duplicates', count(*) FROM reg WHERE duplicate_status = 'LIKELY_DUPLICATE'
UNION ALL SELECT 'suppressed', count(*) FROM reg WHERE duplicate_decision_type = 'SUPPRESSED_NEAR_DUPLICATE'""")
def preset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = lambda equal: [F.coalesce(F.col(c) == v, F.lit(False)) for c, v in equal.items()] or [F.lit(True)]
    flags = F.array(*[F.struct(F.lit(name).alias("preset"), fits(equal)[0].alias("fits")) for name, equal in registry.PRESETS.items()])
    return _registry(spark, sf_dir).select(F.explode(flags).alias("p")).groupBy("p.preset").agg(F.count_if("p.fits").alias("n"))


@query(f"""WITH {_REG} SELECT document_id, original_filename, cast(round(similarity_score, 4) AS DOUBLE) AS similarity FROM reg WHERE duplicate_status = 'LIKELY_DUPLICATE' AND review_status = 'PENDING'
ORDER BY created_at DESC, document_id DESC LIMIT 10 OFFSET 10""")
def queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry.review_queue(_registry(spark, sf_dir, "original_filename", "created_at", "duplicate_status", "review_status", "similarity_score"))
    return registry.page(rows, "newest", 2).select("document_id", "original_filename", F.round("similarity_score", 4).alias("similarity"))


@query(f"WITH {_REG} SELECT user_id, count(*) AS total, greatest(1, ceil(count(*) / 10.0))::BIGINT AS pages FROM reg WHERE duplicate_status = 'LIKELY_DUPLICATE' AND review_status = 'PENDING' GROUP BY user_id")
def queue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.page_counts(registry.review_queue(_registry(spark, sf_dir, "user_id", "duplicate_status", "review_status")), ["user_id"])


@query(f"""WITH {_REG} SELECT document_id, user_id, (row_number() OVER w)::INTEGER AS position, lag(document_id) OVER w AS previous_id, lead(document_id) OVER w AS next_id
FROM reg WHERE duplicate_status = 'LIKELY_DUPLICATE' AND review_status = 'PENDING' WINDOW w AS (PARTITION BY user_id ORDER BY created_at, document_id)""")
def queue_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.neighbours(registry.review_queue(_registry(spark, sf_dir, "user_id", "created_at", "duplicate_status", "review_status")), "oldest")


@query(f"""WITH {_REG} SELECT a.document_id, a.matched_document_id, b.original_filename AS matched_original_filename, b.duplicate_status AS matched_duplicate_status
FROM reg a LEFT JOIN reg b ON a.user_id = b.user_id AND a.matched_document_id = b.document_id AND regexp_full_match(a.matched_document_id, '[0-9a-fA-F]{{24}}') WHERE a.matched_document_id IS NOT NULL""")
def matched_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = _registry(spark, sf_dir)
    out = registry.with_matched(reg.where(F.col("matched_document_id").isNotNull()), reg, ["original_filename", "duplicate_status"])
    return out.select("document_id", "matched_document_id", "matched_original_filename", "matched_duplicate_status")


_READS = """reads AS (SELECT * FROM slip_reads WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY read_at DESC, read_id DESC) = 1)"""


def _search_sql(words: str) -> str:
    """Documents of which a field holds the words, in its own compared form or as plain text."""
    number = lambda x: f"CASE WHEN regexp_full_match(regexp_replace({x}, '[^0-9.]', '', 'g'), '[0-9]+\\.?[0-9]*|\\.[0-9]+') THEN printf('%.2f', regexp_replace({x}, '[^0-9.]', '', 'g')::DOUBLE) ELSE lower(trim({x})) END"
    literal = f"'{words}'"
    plain = _key_sql("receiver_bank", literal)
    holds = lambda value, key: f"coalesce({value} <> '' AND {key} <> '' AND contains({value}, {key}), false)"
    tests = [holds(number("coalesce(rd.amount.value, '')"), number(plain))]
    for f in ("transaction_reference", "receiver_name", "sender_name", "date_time"):
        tests.append(holds(_key_sql(f, f"rd.{f}.value"), _key_sql(f, literal if f == "transaction_reference" else plain)))
    tests += [holds(_key_sql("receiver_bank", f"rd.{f}.value"), plain) for f in registry.SEARCH_FIELDS]
    return f"WITH {_RD} SELECT document_id, read_id FROM rd WHERE {' OR '.join(tests)}"


def _search(spark: SparkSession, sf_dir: str, words: str) -> DataFrame:
    fields = {f: F.col(f)["value"] for f in registry.SEARCH_FIELDS}
    return _reads(spark, sf_dir).where(registry.matches_search(words, fields)).select("document_id", "read_id")


@query(_search_sql("Lotus Bank"))
def field_search_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "Lotus Bank")


@query(_search_sql("15.00"))
def field_search_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "15.00")


@query("SELECT read_id, amount.value AS raw, CASE WHEN regexp_full_match(regexp_replace(amount.value, '[^0-9.]', '', 'g'), '[0-9]+\\.?[0-9]*|\\.[0-9]+') "
       "THEN printf('%.2f', try_cast(regexp_replace(amount.value, '[^0-9.]', '', 'g') AS DOUBLE)) ELSE lower(trim(amount.value)) END AS search_key, "
       "try_cast(regexp_extract(regexp_replace(amount.value, '[^0-9.]', '', 'g'), '^([0-9]+\\.?[0-9]*|\\.[0-9]+)', 1) AS DOUBLE) AS number FROM (SELECT DISTINCT read_id, amount FROM slip_reads) WHERE amount.value IS NOT NULL")  # fmt: skip
def amount_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("amount")["value"]
    rows = read_table(spark, sf_dir, "slip_reads").select("read_id", "amount").distinct().where(v.isNotNull())
    return rows.select("read_id", v.alias("raw"), text.amount_search_key(v).alias("search_key"), text.amount_number(v).alias("number"))


_REFS = "regexp_extract({0}, '^([0-9OIl]{{9,20}})([A-Za-z]{{3,5}}?)([0-9OIl]{{4,}})$', {1})"


@query(f"WITH r AS (SELECT DISTINCT read_id, {_JS_TRIM.format('transaction_reference.value')} AS v FROM slip_reads WHERE transaction_reference.value IS NOT NULL), "
       f"p AS (SELECT read_id, v, regexp_matches(v, '^[0-9OIl]{{9,20}}[A-Za-z]{{3,5}}?[0-9OIl]{{4,}}$') AS bank, translate(upper({_REFS.format('v', 1)}), 'OIL', '011') AS a, "
       f"upper({_REFS.format('v', 2)}) AS b, translate(upper({_REFS.format('v', 3)}), 'OIL', '011') AS c FROM r) SELECT read_id, CASE WHEN bank THEN "
       f"(CASE WHEN length(ltrim(a, '0')) >= 8 THEN ltrim(a, '0') ELSE right(a, greatest(8, length(ltrim(a, '0')))) END) || b || c ELSE regexp_replace(lower(v), '{_WS.format()}+', ' ', 'g') END AS reference_key FROM p")  # fmt: skip
def reference_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("transaction_reference")["value"]
    rows = read_table(spark, sf_dir, "slip_reads").select("read_id", v.alias("v")).distinct().where(F.col("v").isNotNull())
    return rows.select("read_id", text.reference_key(F.col("v")).alias("reference_key"))


@query("SELECT entry_id, nullif(left(regexp_replace(regexp_replace(note, '^[\\s]+|[\\s]+$', '', 'g'), '[\\s]+', ' ', 'g'), 500), '') AS note FROM (SELECT DISTINCT entry_id, note FROM review_history)")
def note_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "review_history").select("entry_id", "note").distinct()
    return rows.select("entry_id", text.note(F.col("note")).alias("note"))


@query(f"WITH {_READS} SELECT x.document_id, CASE WHEN x.sender_name.value IS NULL AND x.receiver_name.value IS NULL THEN true WHEN x.sender_name.value IS NULL OR x.receiver_name.value IS NULL THEN false "
       "ELSE trim(lower(x.sender_name.value)) = trim(lower(x.receiver_name.value)) END AS same_party FROM reads x")  # fmt: skip
def compare_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select("document_id", text.values_match(F.col("sender_name")["value"], F.col("receiver_name")["value"]).alias("same_party"))


@query(f"""WITH {_REG} SELECT document_id, CASE document_type WHEN 'BANK_TRANSFER_SLIP' THEN 'Bank transfer slip' WHEN 'DEPOSIT_PAYMENT_SLIP' THEN 'Deposit / payment slip' WHEN 'CHEQUE' THEN 'Cheque' ELSE 'Unknown' END AS type_label,
CASE WHEN file_size < 1024 THEN printf('%d B', file_size) WHEN file_size < 1048576 THEN printf('%.1f KB', round(file_size / 1024.0, 1)) ELSE printf('%.1f MB', round(file_size / 1048576.0, 1)) END AS size_label,
'documents/' || regexp_replace(user_id, '[^a-zA-Z0-9_-]', '_', 'g') || '/' || document_id || '/original.' || CASE mime_type WHEN 'image/jpeg' THEN 'jpg' WHEN 'image/png' THEN 'png' WHEN 'image/webp' THEN 'webp' ELSE 'bin' END AS object_key
FROM reg""")
def record_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _registry(spark, sf_dir).select(
        "document_id", labels.label(F.col("document_type"), labels.DOCUMENT_TYPES).alias("type_label"), text.file_size_label(F.col("file_size")).alias("size_label"),
        files.object_key(F.col("user_id"), F.col("document_id"), F.col("mime_type")).alias("object_key"),
    )


def _export_sql() -> str:
    """The lines of the export: cells quoted only where they must be."""
    words = lambda x: f"array_to_string(list_transform(string_split(lower(replace({x}, '_', ' ')), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
    table = lambda t: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in t.items()) + "}"
    cell = lambda x: f"CASE WHEN regexp_matches(coalesce({x}, ''), '[\",\\r\\n]') THEN '\"' || replace({x}, '\"', '\"\"') || '\"' ELSE coalesce({x}, '') END"
    reasons = f"array_to_string(list_transform(coalesce(r.duplicate_decision_reasons, []), lambda c: coalesce({table(labels.REASONS)}[c], {words('c')})), '; ')"
    cells = [
        "r.document_id", "r.original_filename", "strftime(r.created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'", f"coalesce({table(labels.DOCUMENT_TYPES)}[r.document_type], {words('r.document_type')})", words("r.duplicate_status"), "r.duplicate_decision_type", reasons,
        words("r.review_status"), *(f"rd.{f}.value" for f in ("amount", "transaction_reference", "receiver_name", "sender_name", "date_time", "receiver_bank", "sender_bank")),
        "regexp_replace(printf('%.4f', round(r.similarity_score, 4)), '\\.?0+$', '')", "r.matched_document_id", "m.original_filename",
    ]
    match = "m.document_id = r.matched_document_id AND m.user_id = r.user_id AND regexp_full_match(r.matched_document_id, '[0-9a-fA-F]{24}')"
    return f"WITH {_REG}, {_RD} SELECT r.document_id, concat_ws(',', {', '.join(map(cell, cells))}) AS line FROM reg r LEFT JOIN reg m ON {match} LEFT JOIN rd ON rd.document_id = r.document_id"


@query(_export_sql())
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = _registry(spark, sf_dir)
    full = registry.with_matched(reg, reg, ["original_filename"]).join(_reads(spark, sf_dir).drop("user_id", "status"), "document_id", "left")
    return registry.export_lines(full)


@query(f"""WITH {_REG} SELECT document_id, concat_ws(',', CASE WHEN duplicate_decision_type = 'EXACT_DUPLICATE' OR duplicate_status = 'EXACT_DUPLICATE' THEN 'info'
WHEN duplicate_decision_type = 'LIKELY_DUPLICATE_REVIEW' OR duplicate_status = 'LIKELY_DUPLICATE' THEN 'warning' WHEN duplicate_decision_type = 'SUPPRESSED_NEAR_DUPLICATE' THEN 'info,info' ELSE 'positive' END,
CASE review_status WHEN 'PENDING' THEN 'warning' WHEN 'CONFIRMED_DUPLICATE' THEN 'info' WHEN 'CONFIRMED_DISTINCT' THEN 'positive' END, CASE WHEN quality_status IN ('WARN', 'FAIL') THEN 'warning' END) AS tones FROM reg""")
def result_summary_tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("duplicate_status", "duplicate_decision_type", "review_status", "quality_status", "duplicate_decision_reasons")
    items = labels.result_summary(*map(F.col, names))
    return _registry(spark, sf_dir).select("document_id", F.array_join(F.transform(items, lambda x: x["tone"]), ",").alias("tones"))


@query(f"""WITH {_REG} SELECT document_type, count(*) FILTER (quality_status IS NULL) AS missing, count(*) AS total FROM reg GROUP BY document_type""")
def quality_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records lack a check, by type: the dry run of a backfill."""
    return _registry(spark, sf_dir).groupBy("document_type").agg(F.count_if(F.col("quality_status").isNull()).alias("missing"), F.count("*").alias("total"))


# --- review -------------------------------------------------------------------------------------------------------------


@query("""SELECT user_id, least(document_a_id, document_b_id) AS document_a_id, greatest(document_a_id, document_b_id) AS document_b_id,
arg_max(decision, (updated_at, reviewed_at, decision)) AS decision, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS created_at FROM review_pairs GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"))
def pair_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = read_table(spark, sf_dir, "review_pairs")
    known = F.col("decision") == "CONFIRMED_DUPLICATE"  # the memory so far; the other decisions are merged into it
    merged = review.merge_pairs(pairs.where(known), pairs.where(~F.coalesce(known, F.lit(False))))
    return merged.select("user_id", "document_a_id", "document_b_id", "decision", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("""WITH e AS (SELECT DISTINCT entry_id, document_id, reviewed_at, action FROM review_history)
SELECT entry_id, document_id, action, (row_number() OVER (PARTITION BY document_id ORDER BY reviewed_at DESC NULLS LAST, entry_id DESC))::INTEGER AS place FROM e QUALIFY place <= 5""")
def review_history_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.history(read_table(spark, sf_dir, "review_history")).select("entry_id", "document_id", "action", "place")


@query(f"""WITH {_REG}, d AS (SELECT document_id, arg_max(action, (reviewed_at, entry_id)) AS action FROM review_history GROUP BY document_id)
SELECT r.document_id, coalesce(d.action, r.review_status) AS review_status FROM reg r LEFT JOIN d USING (document_id)""")
def review_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = read_table(spark, sf_dir, "review_history").groupBy("document_id").agg(F.max_by("action", F.struct("reviewed_at", "entry_id")).alias("review_status"))
    return review.apply_changes(_registry(spark, sf_dir), last, ["review_status"]).select("document_id", "review_status")


@query(f"""WITH {_REG}, c AS (SELECT document_id, CASE WHEN document_type = 'CHEQUE' THEN 'UNKNOWN' ELSE document_type END AS t FROM reg)
SELECT reg.document_id, c.t AS document_type, CASE WHEN c.t = reg.document_type THEN reg.quality_status END AS quality_status FROM reg JOIN c USING (document_id)""")
def type_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = _registry(spark, sf_dir)
    change = reg.select("document_id", F.when(F.col("document_type") == "CHEQUE", "UNKNOWN").otherwise(F.col("document_type")).alias("document_type"))
    return review.correct_type(reg, change, ["quality_status"]).select("document_id", "document_type", "quality_status")


@query("SELECT strftime(created_at, '%Y-%m-%d') AS day, action, count(*) AS n FROM (SELECT DISTINCT audit_id, created_at, action FROM audit_logs) GROUP BY 1, 2")
def audit_activity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "audit_logs").select("audit_id", "created_at", "action").distinct()
    return rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day"), "action").agg(F.count("*").alias("n"))


@query("SELECT audit_id, json_extract_string(metadata, '$.documentType') AS document_type, json_extract_string(metadata, '$.oldType') AS old_type, json_extract_string(metadata, '$.newType') AS new_type, "
       "json_extract_string(metadata, '$.matchedDocumentId') AS matched_id FROM (SELECT DISTINCT audit_id, metadata FROM audit_logs WHERE length(trim(metadata)) > 0)")  # fmt: skip
def audit_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "audit_logs").where(F.length(F.trim("metadata")) > 0).select("audit_id", "metadata").distinct()
    get = lambda k: F.get_json_object("metadata", f"$.{k}")
    return rows.select("audit_id", get("documentType").alias("document_type"), get("oldType").alias("old_type"), get("newType").alias("new_type"), get("matchedDocumentId").alias("matched_id"))


# --- slips, payloads, pictures --------------------------------------------------------------------------------------------


@query()
def slip_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine fields of every OCR text."""
    rows = read_table(spark, sf_dir, "slip_reads").select("read_id", "raw_ocr_text").distinct()
    out = slips.extract_fields(rows, "raw_ocr_text")
    return out.select("read_id", *[F.concat_ws("|", F.col(f)["value"], F.col(f)["confidence"], F.col(f)["source"]).alias(f) for f in slips.FIELDS], "n_fields", "level")


@query()
def ocr_best_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of three readings of each slip: as read, without letters, with its blanks doubled."""
    t = F.col("raw_ocr_text")
    rows = read_table(spark, sf_dir, "slip_reads").select("read_id", "raw_ocr_text").distinct().where(t.isNotNull())
    return slips.best_reading(rows.withColumn("v", F.array(F.regexp_replace(t, "[A-Za-z]", "#"), t, F.regexp_replace(t, " ", "  "))), "read_id", "v").select("read_id", "variant", F.round("score", 2).alias("score"))


def _generated(spark: SparkSession, sf_dir: str, kinds: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    rows = read_table(spark, sf_dir, "orders").join(read_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("o_orderkey", kinds(F.col("c_name"), F.col("o_totalprice"), F.col("o_orderdate"), F.col("o_orderkey")).alias("t"), "c_name", "o_totalprice", "o_orderdate")


_EXPECTED = """SELECT o_orderkey, format('{:,.2f}', o_totalprice) AS amount_text, replace(c_name, '#', '') AS receiver, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS date_time,
lpad(o_orderkey::VARCHAR, 12, '0') || 'BTF' || lpad((o_orderkey % 100000)::VARCHAR, 5, '0') AS reference, 'KBANK' AS sender_bank, 'SCB' AS receiver_bank FROM orders JOIN customer ON o_custkey = c_custkey"""


@query(_EXPECTED)
def slip_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slips printed from orders come back as the values they were printed from."""
    slip = lambda name, price, date, key: F.concat_ws(
        "\n", F.concat(F.lit("To: "), name), F.lit("SCB"), F.lit("-"), F.lit("From: Anna Kell"), F.lit("KBANK"), F.concat(F.lit("Amount: "), F.format_number(price, 2)),
        F.date_format(date, "dd/MM/yyyy HH:mm:ss"), F.concat(F.lit("Reference: "), F.lpad(key.cast("string"), 12, "0"), F.lit("BTF"), F.lpad((key % 100000).cast("string"), 5, "0")),
    )
    out = slips.extract_fields(_generated(spark, sf_dir, slip), "t")
    v = lambda f: F.col(f)["value"]
    return out.select(
        "o_orderkey", F.format_number(v("amount").cast("double"), 2).alias("amount_text"), v("receiver_name").alias("receiver"), v("date_time").alias("date_time"), v("transaction_reference").alias("reference"),
        v("sender_bank").alias("sender_bank"), v("receiver_bank").alias("receiver_bank"),
    )


def _tlv(tag: str, value: Column) -> Column:
    return F.concat(F.lit(tag), F.lpad(F.length(value).cast("string"), 2, "0"), value)


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    account = F.concat(_tlv("00", F.lit(qr.BILL_PAYMENT_AID)), _tlv("01", F.lpad(F.col("p_size").cast("string"), 13, "0")), _tlv("02", F.col("p_partkey").cast("string")))
    body = F.concat(
        _tlv("00", F.lit("01")), _tlv("01", F.lit("12")), _tlv("30", account), _tlv("53", F.lit("764")), _tlv("54", F.format_string("%.2f", F.col("p_retailprice"))), _tlv("58", F.lit("TH")),
        _tlv("59", F.substring("p_name", 1, 20)), F.lit("6304"),
    )
    return part.select("p_partkey", F.concat(body, F.when(F.col("p_partkey") % 10 == 0, "0000").otherwise(qr.crc16(F.concat(body, F.lit("0000"))))).alias("payload"))


@query("""SELECT p_partkey, 'THAI_QR_PAYMENT' AS format, 'BILL_PAYMENT' AS subtype, printf('%.2f', p_retailprice) AS amount, lpad(p_size::VARCHAR, 13, '0') AS target,
p_partkey::VARCHAR AS reference1, left(p_name, 20) AS merchant_name, p_partkey % 10 <> 0 AS consistent FROM part""")
def payment_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads made from parts come back as the values they were made from; every tenth has a wrong checksum."""
    out = qr.payment_fields(_payloads(spark, sf_dir), "payload")
    return out.select("p_partkey", *[F.col(f"qr_{c}").alias(c) for c in ("format", "subtype", "amount", "target", "reference1", "merchant_name", "consistent")])


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(t, '^(?i)https?://') THEN 'GENERIC_URL' WHEN regexp_full_match(t, '[\\x20-\\x7E\\r\\n\\t]+') THEN 'PLAIN_TEXT' ELSE 'UNKNOWN_FORMAT' END AS format
FROM (SELECT doc_id, {_JS_TRIM.format('text')} AS t FROM documents WHERE text IS NOT NULL)""")
def payload_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each text would be as a decoded payload."""
    rows = read_table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    return qr.payment_fields(rows.select("doc_id", "text"), "text").select("doc_id", F.col("qr_format").alias("format"))


_PIXELS = "list_transform(embedding, lambda x: greatest(0, least(255, floor(x * 64 + 128)))::INTEGER)"


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x * 64 + 128))).cast("int"))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("px"))


@query(f"""WITH p AS (SELECT vec_id, px || px[1:8] AS g FROM (SELECT vec_id, {_PIXELS} AS px FROM embeddings))
SELECT vec_id, list_aggregate(list_transform(range(16), lambda n: substr('0123456789abcdef', 1 + list_sum(list_transform(range(4), lambda k: CASE WHEN g[1 + ((n * 4 + k) // 8) * 9 + (n * 4 + k) % 8] > g[2 + ((n * 4 + k) // 8) * 9 + (n * 4 + k) % 8] THEN [8, 4, 2, 1][k + 1] ELSE 0 END))::INTEGER, 1)), 'string_agg', '') AS dhash FROM p""")
def dhash_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("vec_id", hashing.dhash(F.concat("px", F.slice("px", 1, 8))).alias("dhash"))


@query(f"""WITH p AS (SELECT vec_id, {_PIXELS} AS px FROM embeddings), m AS (SELECT vec_id, round(list_avg(px), 2)::DOUBLE AS lum, px FROM p)
SELECT vec_id, lum AS luminance, CASE WHEN lum < 45 THEN 'TOO_DARK' WHEN lum > 225 THEN 'TOO_BRIGHT' ELSE '' END AS warning FROM m""")
def quality_luminance(spark: SparkSession, sf_dir: str) -> DataFrame:
    lum = quality.mean_luminance(F.col("px"))
    rows = _pixels(spark, sf_dir).withColumn("luminance", lum)
    checked = quality.assess(F.lit(1000), F.lit(1000), F.lit(100.0), F.col("luminance"))
    return rows.select("vec_id", "luminance", F.array_join(checked["warnings"], ";").alias("warning"))


@query()
def quality_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("vec_id", quality.sharpness("px", F.lit(8)).alias("sharpness"), quality.text_like_parts("px", F.lit(8)).alias("parts"))


# --- time ---------------------------------------------------------------------------------------------------------------


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = read_table(spark, sf_dir, "slip_reads").withColumn("printed", F.col("date_time.value"))
    return timestamps.normalise_times(reads, "read_id", "user_id", "printed", "device_zone", "device_locale", "arrived_at")


@query()
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _times(spark, sf_dir).where(F.col("zone_from") != "ESTIMATED").select("read_id", "instant_us")


@query()
def p3_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable time, those with an estimated zone included."""
    return _times(spark, sf_dir)


@query()
def p3_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well zones are estimated: of a tenth of the reads with a known device zone it is hidden, and estimated.

    One row: hidden reads, those whose estimated instant is the true one, and their share.
    """
    reads = read_table(spark, sf_dir, "slip_reads").withColumn("printed", F.col("date_time.value"))
    hidden = F.pmod(F.xxhash64("read_id"), F.lit(10)) == 0
    masked = reads.withColumn("device_zone", F.when(~hidden, F.col("device_zone")))
    args = ("read_id", "user_id", "printed", "device_zone", "device_locale", "arrived_at")
    true = timestamps.normalise_times(reads, *args).where("zone_from = 'DEVICE'").select("read_id", F.col("instant_us").alias("true_us"))
    found = timestamps.normalise_times(masked, *args).where("zone_from = 'ESTIMATED'").join(true, "read_id")
    return found.agg(F.count("*").alias("hidden"), F.count_if(F.col("instant_us") == F.col("true_us")).alias("recovered"), F.avg(F.coalesce(F.col("instant_us") == F.col("true_us"), F.lit(False)).cast("double")).alias("share"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_decision_uncapped(spark, sf_dir)
