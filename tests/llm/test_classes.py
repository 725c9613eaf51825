from test_incremental import KIND, make

from slipweave.llm import incremental
from slipweave.sources.tables import Scratch


def brute(rows):
    """(class_id, n_links) of each record: groups by equal vector or equal exact hash, links between groups."""
    bits = lambda p: int(p, 16) if p and len(p) == 16 and p != "n/a" else None
    recs = {(d, u): (bits(p), e if e and len(e) == 64 else None, b or 0) for d, u, b, e, p, _ in rows if u}
    group = {k: k for k in recs}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, (v, e, _) in recs.items():
        for m, (w, f, _) in recs.items():
            if k[1] == m[1] and ((v is not None and v == w) or (e and e == f)):
                group[root(k)] = root(m)
    name, links = {}, {}
    for k in recs:
        mine = [recs[m] for m in recs if root(m) == root(k)]
        vs = [v for v, _, _ in mine if v is not None]
        name[k] = k[1] + ":" + (f"{min(vs):016x}" if vs else mine[0][1] or k[0])
    for k, (v, _, b) in recs.items():
        for m, (w, _, c) in recs.items():
            if k[1] == m[1] and None not in (v, w) and (b or c) and (v ^ w).bit_count() <= 8 and name[k] != name[m]:
                links.setdefault((k[1], name[k]), set()).add(name[m])
    return {k[0]: (name[k], len(links.get((k[1], name[k]), ()))) for k in recs}


def classes(spark, rows):
    members, links = incremental.near_records(spark.createDataFrame(rows, KIND), Scratch(spark, "t"))
    out = incremental.record_classes(members, links).collect()
    assert len(out) == len({r.document_id for r in out})
    return {r.document_id: (r.class_id, r.n_links) for r in out}


def test_an_exact_hash_joins_records_without_a_vector(spark):
    e, f = "e" * 64, "f" * 64
    rows = [
        ("a", "u", 0, e, "0" * 16, ""), ("b", "u", 1, e.upper(), None, ""), ("c", "u", 1, e, "f" * 16, ""), ("d", "u", 1, None, "f" * 15 + "e", ""), ("g", "u", 1, None, "f" * 16, ""),
        ("h", "u", 1, f, "n/a", ""), ("i", "u", 0, f, None, ""), ("j", "v", 1, e, None, ""), ("k", "v", 1, None, None, ""),
    ]
    zero = ("u:" + "0" * 16, 1)
    assert classes(spark, rows) == {"a": zero, "b": zero, "c": zero, "g": zero, "d": ("u:" + "f" * 15 + "e", 1), "h": ("u:" + f, 0), "i": ("u:" + f, 0), "j": ("v:" + e, 0), "k": ("v:k", 0)}


def test_classes_equal_brute_force(spark):
    for seed, owners in ((3, None), (8, "uv")):
        rows = [r[:3] + (r[3] if i % 5 else f"{i % 90:064x}",) + r[4:] for i, r in enumerate(make(260, seed))]
        if owners:  # few shared hashes, so that many groups remain
            rows = [r[:3] + (f"{i % 200:064x}",) + r[4:] for i, r in enumerate(rows)]
        want = brute(rows)
        assert classes(spark, rows) == want and len({c for c, _ in want.values()}) > 2
