"""Queries of the training-data problems over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipweave.llm import groups, incremental, labelled, lookalike, mixing, names, pii, splitting, tokenizer
from slipweave.sources.tables import Scratch, read_table


def _free_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, pii.Finder]:
    reads = read_table(spark, sf_dir, "slip_reads")
    return pii.slip_texts(reads, read_table(spark, sf_dir, "review_history")), labelled.trained(reads)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(*_free_texts(spark, sf_dir))
    return found.select("text_field", "record_id", "kind", "start_pos").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads, history = read_table(spark, sf_dir, "slip_reads"), read_table(spark, sf_dir, "review_history")
    # Repeated rows count once: equal texts of a record are one, other texts of it stay.
    texts = pii.slip_texts(reads, history, blank=True).distinct()
    return pii.redact(texts, labelled.trained(reads)).select("text_field", "record_id", "redacted")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.record_groups(read_table(spark, sf_dir, "document_records"), Scratch(spark, "p2"), linked_only=True)


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.record_groups(read_table(spark, sf_dir, "document_records"), Scratch(spark, "p2"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = Scratch(spark, "p4").write(lookalike.slip_forms(read_table(spark, sf_dir, "slip_reads")), "forms")
    return lookalike.equal_looking_pairs(forms, ["user_id", "field_name"], "value", "form")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.slip_forms(read_table(spark, sf_dir, "slip_reads"))


def _parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.slip_parties(read_table(spark, sf_dir, "slip_reads"), read_table(spark, sf_dir, "nickname_reference"), Scratch(spark, "p5"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalike.equal_looking_pairs(_parties(spark, sf_dir), ["user_id"], "value", "party")
    return pairs.withColumnsRenamed({"value_a": "name_a", "value_b": "name_b"})


def p5_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parties(spark, sf_dir)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.duplicate_pairs(*incremental.near_records(read_table(spark, sf_dir, "document_records"), Scratch(spark, "p6")))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "p6")
    return incremental.record_classes(*incremental.near_records(read_table(spark, sf_dir, "document_records"), scratch), scratch)


def _texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", *more, "text")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode(_texts(spark, sf_dir))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir).withColumn("original", F.coalesce("text", F.lit("")))
    back = tokenizer.decode(tokenizer.encode(texts))
    return back.select("doc_id", (F.col("text") == F.col("original")).alias("same"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sizes = tokenizer.count_tokens(_texts(spark, sf_dir, "source"))
    return mixing.mix(sizes, read_table(spark, sf_dir, "source_targets"), Scratch(spark, "p8"))


def p8_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, sf_dir))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split(_texts(spark, sf_dir), read_table(spark, sf_dir, "cut_limits"))


def p8_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix promises, by listed source: no text above its cap, tokens within one text of the plan."""
    scratch = Scratch(spark, "p8")
    sizes = scratch.write(tokenizer.count_tokens(_texts(spark, sf_dir, "source")), "counted")
    chosen, plan = mixing.mix(sizes, read_table(spark, sf_dir, "source_targets"), scratch)
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    out = mixing.shares(chosen, plan).join(plan.select("source", "copies"), "source").join(largest, "source", "left")
    near = F.abs(F.col("chosen_tokens") - F.col("copies") * F.col("available_tokens")) <= F.coalesce("largest", F.lit(0)) + F.lit(0.5)
    return out.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_cap"), near.alias("share_reached"))


def p9_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the new parts of the pieces make up each text, for all limits, and no piece is above its limit."""
    texts, limits = _texts(spark, sf_dir), read_table(spark, sf_dir, "cut_limits")
    parts = splitting.split(texts, limits).join(F.broadcast(limits.select("limit_id", "max_tokens").distinct()), "limit_id")
    new = F.expr("substring(text, new_from - start_char + 1, end_char - new_from)")
    listed = F.array_sort(F.collect_list(F.struct("piece_no", new.alias("s"))))
    rebuilt = parts.groupBy("doc_id", "limit_id").agg(F.array_join(F.transform(listed, lambda x: x["s"]), "").alias("again"), F.max(F.col("n_tokens") - F.col("max_tokens")).alias("over"))
    whole = rebuilt.join(texts, "doc_id").groupBy("doc_id").agg(F.bool_and((F.col("again") == F.col("text")) & (F.col("over") <= 0)).alias("whole"))
    return texts.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.coalesce("whole", F.lit(True)).alias("whole"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_redacted, p2_found, p2_groups, p4_found, p4_forms, p5_found, p5_parties, p6_found, p6_classes, p7_ids, p7_roundtrip, p8_chosen, p8_shares, p8_kept, p9_pieces, p9_rebuilt)}

_GROUPS = """
WITH RECURSIVE ids AS (SELECT DISTINCT document_id AS id FROM document_records WHERE document_id IS NOT NULL),
links AS (SELECT DISTINCT r.document_id AS a, r.matched_document_id AS b FROM document_records r JOIN ids ON ids.id = r.matched_document_id
          WHERE r.document_id IS NOT NULL AND r.document_id <> r.matched_document_id),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS id, a AS other FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other),
found AS (SELECT id, min(other) AS group_id FROM reach GROUP BY id)
"""

_PAIRS = """
WITH rec AS (
  SELECT document_id AS d, user_id AS u, min(coalesce(intake_batch, 0)) AS b,
         max(CASE WHEN regexp_full_match(perceptual_hash, '[0-9a-fA-F]{16}') THEN ('0x' || perceptual_hash)::UBIGINT END) AS v,
         max(CASE WHEN regexp_full_match(exact_hash, '[0-9a-fA-F]{64}') THEN lower(exact_hash) END) AS e
  FROM document_records WHERE document_id IS NOT NULL AND user_id IS NOT NULL GROUP BY document_id, user_id)
"""

# Classes of records by equal vector or exact hash: nodes are both kinds of hashes of an owner, a record joins its two.
_CLASSES = (
    _PAIRS.replace("WITH rec", "WITH RECURSIVE rec")
    + """,
two AS (SELECT DISTINCT u || ':' || printf('%016x', v) AS x, u || ':' || e AS y FROM rec WHERE v IS NOT NULL AND e IS NOT NULL),
edges AS (SELECT x AS a, y AS b FROM two UNION SELECT y, x FROM two),
reach AS (SELECT a AS id, a AS other FROM edges UNION SELECT reach.id, edges.b FROM reach JOIN edges ON edges.a = reach.other),
names AS (SELECT id, coalesce(min(CASE WHEN length(split_part(other, ':', 2)) = 16 THEN other END), min(other)) AS c FROM reach GROUP BY id),
own AS (SELECT d, u, coalesce(u || ':' || printf('%016x', v), u || ':' || e, u || ':' || d) AS id FROM rec),
classed AS (SELECT d, u, coalesce(names.c, own.id) AS c FROM own LEFT JOIN names ON names.id = own.id),
vecs AS (SELECT u, v, max(b) AS b FROM rec WHERE v IS NOT NULL GROUP BY u, v),
ends AS (SELECT coalesce(n.c, x.u || ':' || printf('%016x', x.v)) AS a, coalesce(m.c, y.u || ':' || printf('%016x', y.v)) AS b
  FROM vecs x JOIN vecs y ON x.u = y.u AND x.v <> y.v AND (x.b >= 1 OR y.b >= 1) AND bit_count(xor(x.v, y.v)) <= 8
  LEFT JOIN names n ON n.id = x.u || ':' || printf('%016x', x.v) LEFT JOIN names m ON m.id = y.u || ':' || printf('%016x', y.v)),
degree AS (SELECT a, count(DISTINCT b) AS n FROM ends WHERE a <> b GROUP BY a)
SELECT d AS document_id, u AS user_id, c AS class_id, coalesce(n, 0) AS n_links FROM classed LEFT JOIN degree ON degree.a = classed.c"""
)

SQL: dict[str, str] = {
    "p6_classes": _CLASSES,
    "p8_kept": "SELECT DISTINCT source, true AS within_cap, true AS share_reached FROM source_targets WHERE target_share > 0 AND max_repeats > 0 AND source IS NOT NULL",
    "p9_rebuilt": "SELECT doc_id, true AS whole FROM documents",
    "p7_roundtrip": "SELECT doc_id, true AS same FROM documents",
    "p2_found": _GROUPS + "SELECT id AS document_id, group_id FROM found",
    "p2_groups": _GROUPS + "SELECT ids.id AS document_id, coalesce(found.group_id, ids.id) AS group_id FROM ids LEFT JOIN found ON found.id = ids.id",
    "p6_found": _PAIRS + "SELECT DISTINCT x.d AS document_a_id, y.d AS document_b_id FROM rec x JOIN rec y ON x.u = y.u AND x.d < y.d AND (x.b >= 1 OR y.b >= 1) WHERE x.e = y.e OR bit_count(xor(x.v, y.v)) <= 8",
}
