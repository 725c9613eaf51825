import random

from slipweave.llm import incremental
from slipweave.sources.tables import Scratch

KIND = "document_id string, user_id string, intake_batch int, exact_hash string, perceptual_hash string, vec string"


def make(n, seed):
    r = random.Random(seed)
    centres, out = [r.getrandbits(64) for _ in range(15)], []
    for i in range(n):
        bits = r.choice(centres)
        for _ in range(r.randrange(8)):
            bits ^= 1 << r.randrange(64)
        h = r.choice([f"{bits:016x}"] * 9 + [f"{bits:016X}", None, "n/a", "", "0" * 15])
        out.append((f"{i:024x}", r.choice(["u", "u", "v", None]), r.choice([0, 0, 0, 1, 2, 5, None]), r.choice([f"{r.randrange(30):064x}", "ab", None]), h, "clash"))
    return out


def brute(rows):
    want = set()
    for i, (d1, u1, b1, e1, p1, _) in enumerate(rows):
        for d2, u2, b2, e2, p2, _ in rows[i + 1 :]:
            if d1 == d2 or u1 is None or u1 != u2 or ((b1 or 0) < 1 and (b2 or 0) < 1):
                continue
            ok = all(p and len(p) == 16 and p != "n/a" for p in (p1, p2))
            if (e1 and len(e1) == 64 and e1 == e2) or (ok and (int(p1, 16) ^ int(p2, 16)).bit_count() <= 8):
                want.add((min(d1, d2), max(d1, d2)))
    return want


def test_pairs_equal_brute_force(spark):
    rows = make(400, 3)
    df = spark.createDataFrame(rows + rows[:50], KIND)
    got = incremental.duplicate_pairs(*incremental.near_records(df, Scratch(spark, "t"))).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def vectors(spark, rows):
    return spark.createDataFrame(rows, KIND).select("user_id", incremental.vector(incremental.F.col("perceptual_hash")).alias("vec"))


def test_a_large_owner_is_spread_over_parts(spark, tmp_path):
    rows = [r for r in make(300, 4) if r[1]]
    index = incremental.VectorIndex(spark, str(tmp_path / "index"), part_rows=20)
    index.append(vectors(spark, rows), "1")
    index.append(vectors(spark, rows), "2")
    vecs = {(u, int(p, 16)) for _, u, _, _, p, _ in rows if p and len(p) == 16}
    want = {(u, a, b) for u, a in vecs for v, b in vecs if u == v and (a ^ b).bit_count() <= 8}
    got = [(r.user_id, r.vec_q % 2**64, r.vec_x % 2**64) for r in index.probe(vectors(spark, rows)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_another_session_opens_the_index_and_reads_what_it_probes(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(f"{i}", f"owner{i % 40}", 0, None, f"{random.Random(i).getrandbits(64):016x}", "") for i in range(40_000)]
    incremental.VectorIndex(spark, path).append(vectors(spark, rows), "history")
    again = incremental.VectorIndex(spark.newSession(), path)
    near = int(rows[7][4], 16) ^ 0b111
    links = again.accept(vectors(spark, [("new", rows[7][1], 1, None, f"{near:016x}", "")]), "b1")
    assert {(r.vec_a % 2**64, r.vec_b % 2**64, r.distance) for r in links.collect()} >= {tuple(sorted((near, int(rows[7][4], 16)), key=lambda v: v - 2**64 if v >> 63 else v)) + (3,)}
    read, probes = again.probed(vectors(spark, [("new", rows[7][1], 1, None, f"{near:016x}", "")]))
    run = read._jdf.queryExecution()
    run.toRdd().count()
    scan = run.executedPlan().collectLeaves().head()
    assert "PartitionFilters: [((((t#" in scan.toString() or "PartitionFilters: [((t#" in scan.toString()
    # Of the stored rows, the files of other cells and the pages of other owners are not read.
    assert scan.metrics().get("numOutputRows").get().value() < again.table().count() / 4
    assert read.count() < again.table().count() / 50 and probes.count() == 13


def test_classes_and_empty(spark):
    rows = [("a", "u", 0, None, "0" * 16, ""), ("b", "u", 1, None, "0" * 16, ""), ("c", "u", 1, None, "0" * 15 + "1", ""), ("d", "u", 1, None, None, "")]
    members, links = incremental.near_records(spark.createDataFrame(rows, KIND), Scratch(spark, "t"))
    got = {r.document_id: (r.class_id, r.n_links) for r in incremental.record_classes(members, links).collect()}
    assert got == {"a": ("u:" + "0" * 16, 1), "b": ("u:" + "0" * 16, 1), "c": ("u:" + "0" * 15 + "1", 1), "d": ("u:d", 0)}
    assert incremental.duplicate_pairs(*incremental.near_records(spark.createDataFrame([], KIND), Scratch(spark, "t"))).count() == 0
