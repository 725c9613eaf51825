import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from slipweave.functions import slips
from slipweave.operators import assess, dedup, intake, registry, review
from slipweave.operators.skew import lookup

REG = "document_id string, user_id string, created_at timestamp, exact_hash string, perceptual_hash string, extra string"
T0 = datetime(2024, 1, 1)


def records(n, owners, seed=0):
    r, out = random.Random(seed), []
    centres = [r.getrandbits(64) for _ in range(12)]
    for i in range(n):
        bits = r.choice(centres)
        for _ in range(r.randrange(7)):
            bits ^= 1 << r.randrange(64)
        phash = r.choice([f"{bits:016x}"] * 8 + [f"{bits:016X}", None, "n/a", ""])
        out.append((f"{i:024x}", f"u{r.randrange(owners)}", T0 + timedelta(seconds=r.randrange(50)), r.choice([f"{r.randrange(40):064x}", None]), phash, "x"))
    return out


def brute(rows, limit):
    owners, out = {}, set()
    for d, u, t, _, p, _ in rows:
        if p is not None:
            owners.setdefault(u, []).append((t, d, p))
    ok = lambda p: len(p) == 16 and all(c in "0123456789abcdefABCDEF" for c in p)
    for items in owners.values():
        items.sort()
        for t, d, p in items:
            for ct, cd, cp in items[:limit]:
                if (ct, cd) < (t, d) and ok(p) and ok(cp) and (n := (int(p, 16) ^ int(cp, 16)).bit_count()) <= 8:
                    out.add((d, cd, n))
    return out


def test_near_pairs_equal_brute_force(spark):
    rows = records(300, 3)
    df = spark.createDataFrame(rows, REG)
    for limit in (None, 20):
        got = dedup.near_pairs(df, limit).collect()
        assert {(r.document_id, r.candidate_id, r.distance) for r in got} == brute(rows, limit) and len(got) == len(brute(rows, limit))


def test_exact_and_decisions(spark):
    rows = records(200, 2, 1)
    df = spark.createDataFrame(rows, REG)
    first = {}
    for d, u, t, e, _, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if e:
            first.setdefault((u, e), d)
    want = {(d, first[u, e]) for d, u, _, e, _, _ in rows if e and first[u, e] != d}
    assert {(r.document_id, r.matched_id) for r in dedup.exact_first_seen(df).collect()} == want
    best = dedup.best_match(dedup.near_pairs(df)).select("*", F.lit(False).alias("suppressed"), F.array().cast("array<string>").alias("reasons"))
    decided = {r.document_id: r for r in dedup.decide(df, dedup.exact_first_seen(df), best).collect()}
    assert len(decided) == 200 and {d for d, r in decided.items() if r.decision == "EXACT_DUPLICATE"} == {d for d, _ in want}
    assert all(r.reasons == ["IMAGE_SIMILARITY_ONLY"] and r.review_status == "PENDING" for r in decided.values() if r.decision == "LIKELY_DUPLICATE_REVIEW")


def test_empty_registry(spark):
    df = spark.createDataFrame([], REG)
    assert dedup.near_pairs(df).count() == 0 and dedup.exact_first_seen(df).count() == 0


def test_hot_key_lookup(spark):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, v int")
    right = spark.createDataFrame([("hot", "H"), ("k0", "Z"), ("none", "N")], "k string, w string")
    plain, salted = left.join(right, ["k"], "left"), lookup(left, right, ["k"], rows=10)
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, salted.select("k", "v", "w").collect()), key=str)


def test_reviewed_pairs_drop_out(spark):
    pairs = spark.createDataFrame([("b", "u", "a", 1), ("c", "u", "a", 1)], "document_id string, user_id string, candidate_id string, distance int")
    seen = spark.createDataFrame([("u", "b", "a"), ("v", "a", "c")], "user_id string, document_a_id string, document_b_id string")
    assert [r.document_id for r in dedup.without_reviewed(pairs, seen).collect()] == ["c"]


FIELD = "struct<value:string,confidence:string,source:string>"


def judge(spark, a, b):
    fields = ["amount", "transaction_reference", "receiver_name", "sender_name", "date_time", "receiver_bank"]
    kinds = [("qr_text", "string"), *[(f, FIELD) for f in fields]]
    row = tuple(x.get(k) if kind == "string" else (*x[k], "s") if k in x else (None, "NONE", "s") for x in (a, b) for k, kind in kinds)
    df = spark.createDataFrame([row], ", ".join(f"{s}_{k} {kind}" for s in "ab" for k, kind in kinds))
    out = df.select(assess.assess({k: F.col(f"a_{k}") for k, _ in kinds}, {k: F.col(f"b_{k}") for k, _ in kinds}).alias("r")).first().r
    return out.result, list(out.reasons)


def test_evidence(spark):
    h, m = "HIGH", "MEDIUM"
    assert judge(spark, {"amount": ("1,000.00", h)}, {"amount": ("1000", m)}) == ("INSUFFICIENT_EVIDENCE", ["IMAGE_SIMILARITY_ONLY"])
    assert judge(spark, {"amount": ("1,000.00", h)}, {"amount": ("999", m)}) == ("CONFLICT", ["IMAGE_READ_AMOUNT_MISMATCH"])
    assert judge(spark, {"receiver_name": ("Anna", h)}, {"receiver_name": ("Peter", m)})[0] == "INSUFFICIENT_EVIDENCE"  # mixed levels are not compared
    assert judge(spark, {"receiver_name": ("Anna", m)}, {"receiver_name": ("Peter", m)})[0] == "INSUFFICIENT_EVIDENCE"
    two = judge(spark, {"receiver_name": ("Anna", m), "sender_name": ("X Y", m)}, {"receiver_name": ("Peter", m), "sender_name": ("Z W", m)})
    assert two == ("CONFLICT", ["IMAGE_READ_RECIPIENT_MISMATCH", "IMAGE_READ_SENDER_MISMATCH"])
    assert judge(spark, {"qr_text": "q", "amount": ("1", h)}, {"qr_text": "q", "amount": ("2", h)}) == ("MATCH", ["IDENTICAL_QR_PAYLOAD"])


def test_candidates_resolve_to_the_nearest_without_conflict(spark):
    pairs = spark.createDataFrame([("n", "u", "c1", T0, 1), ("n", "u", "c2", T0, 3), ("m", "u", "c1", T0, 2)], "document_id string, user_id string, candidate_id string, candidate_created timestamp, distance int")
    ev = spark.createDataFrame([(d, "BANK_TRANSFER_SLIP", (v, "HIGH", "s")) for d, v in (("n", "1"), ("m", "1"), ("c1", "2"), ("c2", "1"))], f"document_id string, document_type string, amount {FIELD}")
    out = {r.document_id: r for r in assess.resolve(pairs, ev, ["amount"]).collect()}
    assert (out["n"].matched_id, out["n"].suppressed) == ("c2", False)
    assert (out["m"].matched_id, out["m"].suppressed, list(out["m"].reasons)) == (None, True, ["IMAGE_READ_AMOUNT_MISMATCH"])


def test_pages_neighbours_and_search(spark):
    rows = [(f"{i:02d}", "u", T0 + timedelta(seconds=i), float(i % 3) if i % 4 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "document_id string, user_id string, created_at timestamp, similarity_score double")
    assert [r.document_id for r in registry.page(df, "newest", 2, 5).collect()] == ["06", "05", "04", "03", "02"]
    assert registry.page(df, "newest", 9, 5).count() == 0 and registry.page_counts(df, ["user_id"], 5).first().pages == 3
    assert [r.similarity_score for r in registry.page(df, "lowest_similarity", 1, 3).collect()] == [None] * 3
    near = {r.document_id: (r.position, r.previous_id, r.next_id) for r in registry.neighbours(df, "oldest").collect()}
    assert near["00"] == (1, None, "01") and near["11"] == (12, "10", None)
    fields = {f: F.lit(None).cast("string") for f in registry.SEARCH_FIELDS} | {"amount": F.lit("1,500.00"), "receiver_name": F.lit("นาย สมชาย"), "receiver_bank": F.lit("Lotus Bank")}
    ask = lambda q: spark.range(1).select(registry.matches_search(q, fields)).first()[0]
    assert [ask(q) for q in ("", "500", "สมชาย", "lotus", "nothing")] == [True, True, True, True, False]


def test_pair_memory_and_snapshots(spark):
    kind = "user_id string, document_a_id string, document_b_id string, decision string, reviewed_by_user_id string, reviewed_at timestamp, created_at timestamp, updated_at timestamp"
    old = spark.createDataFrame([("u", "a", "b", "D", "r", T0, T0, T0)], kind)
    new = spark.createDataFrame([("u", "b", "a", "E", "r", T0, T0 + timedelta(1), T0 + timedelta(1)), ("u", None, "a", "E", "r", T0, T0, T0)], kind)
    merged = review.merge_pairs(old, new.union(new)).collect()
    assert [(r.document_a_id, r.document_b_id, r.decision, r.created_at) for r in merged] == [("a", "b", "E", T0)]
    reg = spark.createDataFrame([("a", "CHEQUE", "PASS"), ("b", "UNKNOWN", "WARN")], "document_id string, document_type string, quality_status string")
    change = spark.createDataFrame([("a", "UNKNOWN"), ("b", "UNKNOWN")], "document_id string, document_type string")
    assert sorted(map(tuple, review.correct_type(reg, change, ["quality_status"]).collect())) == [("a", "UNKNOWN", None), ("b", "UNKNOWN", "WARN")]


def test_csv_file(spark, tmp_path):
    registry.write_csv(spark.createDataFrame([("1", '1,"a, b"')], "document_id string, line string").coalesce(1), str(tmp_path / "out"))
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    assert b"".join(p.read_bytes() for p in parts).decode() == ",".join(registry.EXPORT_HEADER) + '\r\n1,"a, b"\r\n'


def test_records_without_evidence_keep_their_candidate(spark):
    pairs = spark.createDataFrame([("n", "u", "c", T0, 1)], "document_id string, user_id string, candidate_id string, candidate_created timestamp, distance int")
    for has, want in ((True, True), (False, False), (None, False)):
        ev = spark.createDataFrame([(d, "BANK_TRANSFER_SLIP", has, (v, "HIGH", "s")) for d, v in (("n", "1"), ("c", "2"))], f"document_id string, document_type string, has_evidence boolean, amount {FIELD}")
        assert assess.resolve(pairs, ev, ["amount"]).first().suppressed is want


def test_lookups_by_owner(spark):
    a, b = "a" * 24, "b" * 24
    reg = spark.createDataFrame([(a, "u"), (b, "v")], "document_id string, user_id string")
    assert [registry.record_of(reg, d, o).count() for d, o in ((a, "u"), (b, "u"), ("x", "u"))] == [1, 0, 0]
    pairs = spark.createDataFrame([("u", a, b, "D")], "user_id string, document_a_id string, document_b_id string, decision string")
    assert [registry.pair_of(pairs, o, *ids).count() for o, ids in (("u", (b, a)), ("u", (a, b)), ("v", (a, b)))] == [1, 1, 0]
    ids = spark.createDataFrame([([" x", "y", "x ", "", None],)], "ids array<string>")
    assert ids.select(registry.distinct_in_order(F.col("ids"))).first()[0] == ["x", "y"]


def test_bulk_review(spark):
    kind = "document_id string, user_id string, matched_document_id string, duplicate_status string, review_status string, similarity_score double, x string"
    reg = spark.createDataFrame(
        [("a", "u", "m", "LIKELY_DUPLICATE", "PENDING", 0.9, ""), ("b", "u", "m", "NEW", "PENDING", None, ""), ("c", "u", "gone", "LIKELY_DUPLICATE", "PENDING", 0.9, ""), ("d", "v", "m", "LIKELY_DUPLICATE", "PENDING", 0.9, ""), ("m", "u", None, "NEW", None, None, "")], kind
    )
    asked = spark.createDataFrame([("u", d, "CONFIRMED_DUPLICATE", "  same  slip ", T0) for d in "abcdz"], "user_id string, document_id string, decision string, note string, reviewed_at timestamp")
    judged = review.judged_requests(reg, asked)
    assert {r.document_id: r.status for r in judged.collect()} == {"a": "updated", "b": "skipped", "c": "skipped", "d": "not_found", "z": "not_found"}
    assert tuple(review.outcome_counts(judged).first()) == ("u", 5, 1, 2, 2)
    changed = review.apply_changes(reg.withColumn("reviewed_match_id", F.lit(None).cast("string")), review.changes(judged), ["review_status", "reviewed_match_id"])
    assert {r.document_id: (r.review_status, r.reviewed_match_id) for r in changed.collect()}["a"] == ("CONFIRMED_DUPLICATE", "m")
    logs = review.audit_rows(judged, "batch").withColumn("audit_id", F.lit("1"))
    assert logs.first().action == "DOCUMENT_REVIEW_CONFIRMED_DUPLICATE"
    told = review.history_of_audit(logs.union(logs)).collect()
    assert [(t.document_id, t.decision, t.note, t.actor_user_id, t.matched_document_id, t.bulk_review_batch_id) for t in told] == [("a", "CONFIRMED_DUPLICATE", "same slip", "u", "m", "batch")]


def test_intake_and_owner_buckets(spark, tmp_path):
    rows = [("a", "u", "e" * 64, "0" * 16, T0), ("b", "u", "f" * 64, "0" * 15 + "1", T0 + timedelta(1)), ("c", "u", "e" * 64, None, T0 + timedelta(2)), ("d", "v", "e" * 64, "0" * 16, T0 + timedelta(3))]
    reg = spark.createDataFrame([(*r, "CHEQUE", 1) for r in rows], "document_id string, user_id string, exact_hash string, perceptual_hash string, created_at timestamp, document_type string, clash int")
    records, audit = intake.accept(reg, reg.where("document_id > 'a'"))
    got = {r.document_id: (r.decision, r.matched_id, r.status) for r in records.collect()}
    assert got == {"b": ("LIKELY_DUPLICATE_REVIEW", "a", "READY"), "c": ("EXACT_DUPLICATE", "a", "UPLOADED"), "d": ("NEW_UPLOAD", None, "READY")}
    assert {r.target_id: r.action for r in audit.collect()} == {"b": "DOCUMENT_LIKELY_DUPLICATE_UPLOADED", "c": "DOCUMENT_EXACT_DUPLICATE_UPLOADED", "d": "DOCUMENT_NEW_UPLOADED"}
    assert intake.accept(reg.limit(0), reg.limit(0))[0].count() == 0
    path = str(tmp_path / "registry")
    intake.append_by_owner(reg.where("user_id = 'u'"), path)
    intake.append_by_owner(reg.where("user_id = 'v'"), path)
    mine = intake.read_owner(spark, path, "u")
    assert mine.count() == 3 and "owner_bucket" in mine._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]


def test_fragmented_thai_text(spark):
    texts = ["ก ข ค", "ก  ข  ค", "จํ านวนเงิน 500.00", "จํานวน", "ก ข"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(slips.clean_text(F.col("t"))).collect()]
    assert got == ["กขค", "ก  ข  ค", "จำนวนเงิน 500.00", "จำนวน", "ก ข"]
