import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from slipweave.operators import dedup
from test_operators import REG, brute, records

DATA = "/root/testdata/sf0.01"  # its largest owner has 292 records


def test_the_near_search_looks_at_all_records_of_an_owner(spark):
    rows = records(500, 1, 5)
    got = dedup.near_pairs(spark.createDataFrame(rows, REG)).collect()
    want = brute(rows, None)
    assert {(r.document_id, r.candidate_id, r.distance) for r in got} == want and len(got) == len(want) > len(brute(rows, dedup.CANDIDATE_LIMIT))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_uncapped_queries_equal_their_sql_and_find_more(spark):
    con = duckdb.connect()
    for t in ("document_records", "review_pairs"):
        con.execute(f"CREATE VIEW {t} AS FROM '{Path(DATA, t)}.parquet'")
    ask = lambda name, columns: sorted(repr(tuple(r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    for name in ("near_dup_best_match", "duplicate_decision", "decision_counts_by_owner", "reviewed_pair_antijoin"):
        got = entry.queries()[f"{name}_uncapped"](spark, DATA)
        columns = sorted(got.columns)
        mine = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
        assert mine == ask(f"{name}_uncapped", columns) != ask(name, columns), name
    decided = {r.document_id for r in entry.queries()["duplicate_decision_uncapped"](spark, DATA).where("decision <> 'NEW_UPLOAD'").collect()}
    assert {r.document_id for r in entry.queries()["suppressed_near_duplicates_uncapped"](spark, DATA).collect()} == decided
