import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
@pytest.mark.parametrize("name", ["exact_first_seen", "near_dup_best_match", "duplicate_decision", "reviewed_pair_antijoin", "matched_lookup", "reference_normalise", "amount_normalise", "slip_extraction", "payment_payloads", "pair_upsert", "dhash_grid", "suppressed_near_duplicates", "intake_decisions", "review_outcomes", "reviewed_records", "history_from_audit", "field_search_name", "export_rows", "queue_pages", "queue_neighbours"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    mine = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})")
    assert mine == sorted(repr(tuple(r)) for r in cursor.fetchall()) and mine


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are absent")
def test_core_plans_have_no_python_and_no_cartesian_product(spark):
    for name in ("exact_first_seen", "near_dup_best_match", "duplicate_decision", "p3_found", "slip_fields", "payment_payloads"):
        plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name
