import random

import pytest

from slipweave.llm import groups
from slipweave.sources.tables import Scratch


def union_find(links):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {v: top(v) for v in list(up)}


def run(spark, links, hot=groups.HOT_ROWS):
    df = spark.createDataFrame(links, "a string, b string")
    out = groups.connected_groups(df, "a", "b", Scratch(spark, "t"), hot).collect()
    got = {r.id: r.group_id for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize("seed", range(2))
def test_random_links(spark, seed):
    r = random.Random(seed)
    links = [(f"n{r.randrange(300)}", f"n{r.randrange(300)}") for _ in range(220)] + [("n1", None), (None, "n2"), ("self", "self")] * 2
    assert run(spark, links) == union_find(links)


def test_chain_and_hub_with_salted_keys(spark):
    chain = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(250)]
    hub = [(f"h{i:04d}", "hub") for i in range(200)]
    assert run(spark, chain + hub + chain, hot=20) == union_find(chain + hub)


def test_no_links(spark):
    assert run(spark, []) == {}


def test_records(spark):
    rows = [("a", "b", 1), ("b", None, 2), ("c", "nobody", 3), ("d", "d", 4), ("a", "c", 5), (None, "a", 6), ("e", "pending", 7)]
    df = spark.createDataFrame(rows, "document_id string, matched_document_id string, id int")
    got = {r.document_id: r.group_id for r in groups.record_groups(df, Scratch(spark, "t")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert groups.record_groups(df, Scratch(spark, "t"), linked_only=True).count() == 3
    assert groups.record_groups(df.limit(0), Scratch(spark, "t")).count() == 0
