import os
import random

import pytest
from pyspark.sql import functions as F

from slipweave.llm import mixing, splitting
from slipweave.llm.tokenizer import VOCABULARY, transducer
from slipweave.sources.tables import Scratch

TARGETS = "source string, target_share double, max_repeats int"


def test_shares_are_reached_within_caps(spark):
    r = random.Random(2)
    rows = [(i, r.choice("aaaaaab"), r.choice([0, 5, 20, 90, 400])) for i in range(3000)] + [(9001, "unlisted", 50), (9002, None, 50), (9003, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").repartition(40)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("none", 0.1, 9), (None, 0.1, 1), ("zero", 0.0, 1)], TARGETS)
    chosen, plan = mixing.mix(df, targets, Scratch(spark, "t"))
    got = {r.source: r for r in mixing.shares(chosen, plan).collect()}
    assert got["none"].chosen_tokens == 0 and got["a"].most_copies == 1 and got["b"].most_copies <= 3
    assert abs(got["a"].actual_share - 5 / 9) < 0.002 and abs(got["b"].actual_share - 4 / 9) < 0.002
    picked = chosen.collect()
    assert len({p.doc_id for p in picked}) == len(picked) and {p.source for p in picked} == {"a", "b"}
    whole = mixing.mix(df, targets, Scratch(spark, "t"), total_tokens=5000)[0].agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0]
    assert abs(whole - 5000) <= 2 * 400


def test_pivot_keeps_the_mass():
    r = random.Random(1)
    for i in range(300):
        a, b = [i, r.randint(1, 99), r.uniform(0.01, 0.99)], [i + 1000, r.randint(1, 99), r.uniform(0.01, 0.99)]
        done, rest = mixing.pivot(a, b, 7)
        assert abs(done[1] * done[2] + rest[1] * rest[2] - a[1] * a[2] - b[1] * b[2]) < 1e-6
        assert min(done[2], 1 - done[2]) < 1e-6 and -1e-6 < rest[2] < 1 + 1e-6


def test_nothing_to_mix(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    chosen, plan = mixing.mix(empty, spark.createDataFrame([("a", 1.0, 1)], TARGETS), Scratch(spark, "t"))
    assert chosen.count() == 0 and mixing.shares(chosen, plan).first().actual_share == 0.0


LIMITS = [(1, 64, 8), (2, 200, 0), (3, 30, 29)]


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary is absent")
def test_pieces(spark):
    r = random.Random(4)
    words = ["Anna", "pays", "the bill.", "ไม้สัก,", "漢字。", "x,", "\n", "\n\n", "812345678901", "😀"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(400))) for _ in range(60)] + ["a" * 3000, "漢字" * 900, "", None, " ", "😀" * 300, "\n" * 2000, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = splitting.split(df, spark.createDataFrame([*LIMITS, (4, None, 1), (5, 0, 0)], "limit_id int, max_tokens int, overlap_tokens int")).collect()
    t, by = transducer(), {}
    for p in out:
        by.setdefault((p.doc_id, p.limit_id), []).append(p)
    for i, text in enumerate(texts):
        for limit, most, overlap in LIMITS:
            ps = sorted(by.get((i, limit), []), key=lambda p: p.piece_no)
            assert bool(ps) == (t.count(text) > most)
            assert not ps or "".join(text[p.new_from : p.end_char] for p in ps) == text
            for p in ps:
                assert p.text == text[p.start_char : p.end_char] and t.count(p.text) == p.n_tokens <= most
                shared = t.count(text[p.start_char : p.new_from])
                assert p.piece_no == 0 or abs(shared - min(overlap, most - t.count(text[p.new_from : p.end_char]))) <= 3 or p.start_char == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary is absent")
def test_cuts_are_at_the_strongest_boundary(spark):
    text = "one two three four five six. " * 8 + "\n\n" + "one two three four five six. " * 8
    out = splitting.split(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, 70, 0)], "limit_id int, max_tokens int, overlap_tokens int"))
    assert [p.text for p in out.orderBy("piece_no").collect()][0].endswith("\n\n") and out.count() == 2


def test_many_sources_are_joined_by_shuffle(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 3}", 10 + i % 5) for i in range(300)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("s0", 0.5, 1), ("s1", 0.5, 2)], TARGETS)
    want = {r.source: r.chosen_tokens for r in mixing.shares(*mixing.mix(df, targets, Scratch(spark, "t"))).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    got = {r.source: r.chosen_tokens for r in mixing.shares(*mixing.mix(df, targets, Scratch(spark, "t"))).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 14 for k in want)
