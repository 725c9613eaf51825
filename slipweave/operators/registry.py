"""Reading the registry of an owner or of all: filters, search, order, pages, neighbours, matched records, export rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slipweave.functions import labels, text
from slipweave.operators.skew import lookup

# Sort modes of the review queue, caps and page sizes.
SORTS = {
    "newest": [("created_at", False), ("document_id", False)], "oldest": [("created_at", True), ("document_id", True)],
    "highest_similarity": [("similarity_score", False), ("created_at", False), ("document_id", False)], "lowest_similarity": [("similarity_score", True), ("created_at", False), ("document_id", False)],
}
PAGE_SIZE, MAX_PAGE_SIZE = 10, 50
DASHBOARD_SEARCH_CAP, QUEUE_SEARCH_CAP, EXPORT_CAP = 200, 500, 5000
SEARCH_FIELDS = ["amount", "transaction_reference", "receiver_name", "sender_name", "date_time", "receiver_bank", "sender_bank", "receiver_account_tail", "sender_account_tail"]
EXPORT_HEADER = [
    "document id", "filename", "created at", "document type", "duplicate status", "duplicate decision", "duplicate decision reasons", "review status", "amount (extracted)", "reference number (extracted)",
    "receiver name (extracted)", "sender name (extracted)", "date/time (extracted)", "receiver bank (extracted)", "sender bank (extracted)", "similarity score", "matched document id", "matched filename",
]
PRESETS = {
    "all": {}, "needs_review": {"review_status": "PENDING"}, "exact_duplicates": {"duplicate_status": "EXACT_DUPLICATE"}, "likely_duplicates": {"duplicate_status": "LIKELY_DUPLICATE"},
    "suppressed": {"duplicate_decision_type": "SUPPRESSED_NEAR_DUPLICATE"},
}


def owned(df: DataFrame, owner: str) -> DataFrame:
    return df.where(F.col("user_id") == owner)


def filtered(df: DataFrame, **equal: str | None) -> DataFrame:
    """Rows that equal every given value; None and `all` are no condition."""
    for column, value in equal.items():
        if value is not None and value != "all":
            df = df.where(F.col(column) == value)
    return df


def review_queue(df: DataFrame) -> DataFrame:
    return filtered(df, duplicate_status="LIKELY_DUPLICATE", review_status="PENDING")


def order_of(sort: str) -> list[Column]:
    """Order columns of a sort mode; an unknown mode is `newest`. A null score is lowest."""
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in SORTS.get(sort, SORTS["newest"])]


def page(df: DataFrame, sort: str = "newest", number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page; sizes are held to 1..50, a page past the end is empty."""
    size = min(max(size, 1), MAX_PAGE_SIZE) if isinstance(size, int) else PAGE_SIZE
    number = number if isinstance(number, int) and number >= 1 else 1
    return df.orderBy(*order_of(sort)).offset((number - 1) * size).limit(size)


def page_counts(df: DataFrame, keys: list[str], size: int = PAGE_SIZE) -> DataFrame:
    """Total and number of pages per group."""
    return df.groupBy(*keys).agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))


def neighbours(df: DataFrame, sort: str = "newest") -> DataFrame:
    """Position, previous and next record of each record in its owner's queue."""
    w = Window.partitionBy("user_id").orderBy(*order_of(sort))
    return df.select("document_id", "user_id", F.row_number().over(w).alias("position"), F.lag("document_id").over(w).alias("previous_id"), F.lead("document_id").over(w).alias("next_id"))


def with_matched(df: DataFrame, registry: DataFrame, columns: list[str], prefix: str = "matched_") -> DataFrame:
    """Left join of each record with the record of the same owner that it matches; invalid and absent matches give nulls."""
    right = registry.select(F.col("user_id"), F.col("document_id").alias("_m"), *[F.col(c).alias(prefix + c) for c in columns])
    left = df.withColumn("_m", F.when(F.col("matched_document_id").rlike("^[0-9a-fA-F]{24}\\z"), F.col("matched_document_id")))
    return lookup(left, right, ["user_id", "_m"]).drop("_m")


def matches_search(query: str, value: dict[str, Column], references: list[Column] = ()) -> Column:  # type: ignore[assignment]
    """Whether a record's fields hold the query: as amount, reference, name, time or plain text. A blank query holds.

    The query is normalised once, as a literal; value maps the names in SEARCH_FIELDS to text columns.
    """
    q = F.lit(query)
    plain = text.basic(q)
    holds = lambda c, n: F.coalesce((c != "") & (n != "") & F.contains(c, n), F.lit(False))
    filled = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    amount = filled(value["amount"]) & holds(text.amount_search_key(value["amount"]), text.amount_search_key(plain))
    refs = [filled(c) & holds(text.reference_key(c), text.reference_key(q)) for c in (value["transaction_reference"], *references)]
    names = [holds(text.thai_name_key(value[f]), text.thai_name_key(plain)) for f in ("receiver_name", "sender_name")]
    time = holds(text.date_time_key(value["date_time"]), text.date_time_key(plain))
    out = (plain == "") | amount | time
    for hit in (*refs, *names, *(holds(text.basic(value[f]), plain) for f in SEARCH_FIELDS)):
        out = out | hit
    return out


def search(df: DataFrame, query: str, cap: int | None = DASHBOARD_SEARCH_CAP, sort: str = "newest") -> DataFrame:
    """The newest `cap` rows are searched, as a request does; None searches all. Fields are structs with a value."""
    rows = df if cap is None else df.orderBy(*order_of(sort)).limit(cap)
    return rows.where(matches_search(query, {f: F.col(f)["value"] for f in SEARCH_FIELDS}))


def export_lines(df: DataFrame) -> DataFrame:
    """(document_id, line): one CSV line of 18 cells a record; df has the record, its field structs and matched_filename."""
    field = lambda f: F.coalesce(F.col(f)["value"], F.lit(""))
    score = F.round("similarity_score", 4)
    cells = [
        F.col("document_id"), F.col("original_filename"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), labels.label(F.col("document_type"), labels.DOCUMENT_TYPES),
        labels.label(F.col("duplicate_status")), F.col("duplicate_decision_type"), labels.reasons_text(F.col("duplicate_decision_reasons")), labels.label(F.col("review_status")),
        *(field(f) for f in ("amount", "transaction_reference", "receiver_name", "sender_name", "date_time", "receiver_bank", "sender_bank")),
        F.when(score.isNotNull() & ~F.isnan(score), F.regexp_replace(F.format_string("%.4f", score), "\\.?0+\\z", "")), F.col("matched_document_id"), F.col("matched_original_filename"),
    ]
    return df.select("document_id", text.csv_line(*cells).alias("line"))


def write_csv(lines: DataFrame, path: str) -> None:
    """One table of several parts with CRLF ends: the first part is the header alone, the lines follow; no line leaves the JVM."""
    header = lines.sparkSession.createDataFrame([(",".join(EXPORT_HEADER),)], "value string").coalesce(1)
    # Parts of a union keep their order, and files are named by part.
    header.unionByName(lines.select(F.col("line").alias("value"))).write.option("lineSep", "\r\n").text(path)


OBJECT_ID = "^[0-9a-fA-F]{24}\\z"


def record_of(registry: DataFrame, document_id: str, owner: str) -> DataFrame:
    """The record of an owner; no row for another owner's record or for a text that is no id."""
    return owned(registry, owner).where((F.col("document_id") == document_id) & F.lit(document_id).rlike(OBJECT_ID))


def pair_of(pairs: DataFrame, owner: str, one: str, other: str) -> DataFrame:
    """What an owner decided about two records, named in either order."""
    low, high = F.least("document_a_id", "document_b_id"), F.greatest("document_a_id", "document_b_id")
    return owned(pairs, owner).where((low == min(one, other)) & (high == max(one, other)))


def distinct_in_order(ids: Column) -> Column:
    """Trimmed ids that are not blank, each once, in the order in which they came first."""
    return F.array_distinct(F.filter(F.transform(ids, text.trim), lambda x: F.coalesce(F.length(x) > 0, F.lit(False))))
