"""Problem 2: consolidate pairwise links into groups by low-diameter decomposition.

Each level draws one exponentially distributed head start per vertex, lets clusters grow along the edges for a few
steps (a vertex belongs to the cluster that reaches it first), contracts every cluster to one super-vertex and goes on
with the edges between clusters. Contraction is right however far clusters have grown, so the steps per level are a
constant; the number of levels is logarithmic in the length of the longest chain. The assignments of all levels are
composed from the last to the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.operators.skew import HOT_ROWS, lookup
from slipweave.sources.tables import Scratch

#: Rate of the exponential head starts: smaller clusters with a larger rate.
BETA = 0.4
#: Steps that clusters grow in one level.
STEPS = 3


def _head_start(vertex: str, level: int) -> F.Column:
    """-start time of a vertex; the same whenever it is recomputed."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.col(vertex), F.lit(level)), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return F.log(unit) / BETA


def _grow(edges: DataFrame, total: int, level: int, hot_rows: int) -> DataFrame:
    """(vertex, cluster) after STEPS steps; edges has src, dst in both directions."""
    state = edges.select(F.col("src").alias("v")).distinct().select("v", _head_start("v", level).alias("at"), F.col("v").alias("cluster"))
    for _ in range(STEPS):
        reached = lookup(edges.withColumnRenamed("src", "v"), state, ["v"], "inner", total, hot_rows).select(F.col("dst").alias("v"), (F.col("at") + 1.0).alias("at"), "cluster")
        first = F.min(F.struct("at", "cluster")).alias("f")
        state = state.unionByName(reached).groupBy("v").agg(first).select("v", "f.at", "f.cluster")
    return state.select("v", "cluster")


def connected_groups(links: DataFrame, a: str, b: str, scratch: Scratch, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(id, group_id) of every id that occurs in a link; group_id is the smallest id of its group in code point order.

    links may hold repeated rows, self links and nulls (both ignored), and any further columns. No link gives no rows.
    """
    raw = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    raw = scratch.write(raw.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    # Numbers in the order of the ids: the smallest number of a group is its smallest id.
    ids = raw.select(F.col("a").alias("id")).union(raw.select(F.col("b").alias("id"))).distinct()
    numbered = scratch.write(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("v")), "ids")
    total = 2 * raw.count()
    edges = lookup(raw, numbered.withColumnsRenamed({"id": "a", "v": "src"}), ["a"], "inner", total, hot_rows)
    edges = lookup(edges, numbered.withColumnsRenamed({"id": "b", "v": "dst"}), ["b"], "inner", total, hot_rows).select("src", "dst")
    edges = scratch.write(edges.union(edges.select("dst", "src")), "edges")
    levels: list[DataFrame] = []
    while total:
        assigned = scratch.write(_grow(edges, total, len(levels), hot_rows), "clusters")
        levels.append(assigned)
        between = lookup(edges, assigned.withColumnsRenamed({"v": "src", "cluster": "cs"}), ["src"], "inner", total, hot_rows)
        between = lookup(between, assigned.withColumnsRenamed({"v": "dst", "cluster": "cd"}), ["dst"], "inner", total, hot_rows)
        between = between.where(F.col("cs") != F.col("cd")).select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()
        left = scratch.write(between, "between")
        scratch.drop(edges)
        edges, total = left, left.count()
    scratch.drop(edges)
    if not levels:
        return numbered.select("id", F.col("id").alias("group_id"))
    total = numbered.count()
    root = levels[-1]
    for assigned in reversed(levels[:-1]):
        up = lookup(assigned.withColumnRenamed("cluster", "c"), root.withColumnsRenamed({"v": "c", "cluster": "top"}), ["c"], "left", total, hot_rows)
        root = up.select("v", F.coalesce("top", "c").alias("cluster"))
    root = scratch.write(root, "roots")
    smallest = root.groupBy("cluster").agg(F.min("v").alias("g"))
    out = lookup(root, smallest, ["cluster"], "inner", total, hot_rows).select("v", "g")
    out = lookup(out, numbered, ["v"], "inner", total, hot_rows)
    return lookup(out, numbered.withColumnsRenamed({"id": "group_id", "v": "g"}), ["g"], "inner", total, hot_rows).select("id", "group_id")


def record_groups(records: DataFrame, scratch: Scratch, id_col: str = "document_id", match_col: str = "matched_document_id", linked_only: bool = False) -> DataFrame:
    """One row per record: id and group_id (its own id if nothing links to it); linked_only leaves those out.

    A match that is null, the record itself or no record's id is no link. A record with several rows has all their
    links. Rows without an id are ignored; an empty table gives no rows.
    """
    ids = records.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull()).distinct()
    links = records.select(F.col(id_col).alias("id"), F.col(match_col).alias("match")).where(F.col("id").isNotNull() & F.col("match").isNotNull() & (F.col("id") != F.col("match"))).distinct()
    links = lookup(links, ids.select(F.col("id").alias("match"), F.lit(True).alias("_there")), ["match"], "inner")
    grouped = connected_groups(links, "id", "match", scratch)
    if not linked_only:
        grouped = ids.join(grouped, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))
    return grouped.select(F.col("id").alias(id_col), "group_id")
