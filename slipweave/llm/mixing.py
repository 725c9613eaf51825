"""Problem 8: combine sources to target shares of the total size, with a cap on repeats.

Every text of a source gets the same fractional number of copies. Its whole part is given; the fractional parts are
rounded by the pivotal method: two open texts exchange mass at random, in tokens, until one of them is integral, so the
source's total stays what it was. Each task works through its own rows and leaves at most one open text per source;
these are combined in a reduction tree of fixed fan-in. No row moves for it, so a source with most rows is no hot task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipweave.operators.skew import lookup
from slipweave.sources.tables import Scratch

#: Tasks whose open texts are combined by one task of the next level.
FAN_IN = 16
#: Sources of a target table that are broadcast; larger tables are joined by shuffle.
BROADCAST_SOURCES = 100_000
_EPS = 1e-9
_OPEN = "doc_id long, source string, n_tokens long, base int, x double, task int"


def _uniform(seed: int, a: int, b: int) -> float:
    return int.from_bytes(hashlib.blake2b(f"{seed}|{a}|{b}".encode(), digest_size=7).digest(), "big") / 2**56


def pivot(a: list, b: list, seed: int) -> tuple[list, list]:
    """(decided, open) after one exchange between items [doc_id, n_tokens, x] with 0 < x < 1; sum of n_tokens * x stays."""
    (da, wa, xa), (db, wb, xb) = a, b
    up, down = min((1 - xa) * wa, xb * wb), min(xa * wa, (1 - xb) * wb)
    move = up if _uniform(seed, da, db) * (up + down) < down else -down
    xa, xb = xa + move / wa, xb - move / wb
    first, second = [da, wa, xa], [db, wb, xb]
    return (first, second) if xa < _EPS or xa > 1 - _EPS else (second, first)


def _round(seed: int, last: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        base: dict[int, int] = {}
        task = 0
        for b in batches:
            out = []
            for doc, source, n, whole, x, t in b.itertuples(index=False, name=None):
                task = t
                if x < _EPS or x > 1 - _EPS:
                    out.append((doc, source, n, whole + round(x), 0.0, t))
                    continue
                now, other = [doc, n, x], held.get(source)
                base[doc] = whole
                if other is None:
                    held[source] = now
                    continue
                done, rest = pivot(other, now, seed)
                out.append((done[0], source, done[1], base.pop(done[0]) + round(done[2]), 0.0, t))
                if rest[2] < _EPS or rest[2] > 1 - _EPS:
                    out.append((rest[0], source, rest[1], base.pop(rest[0]) + round(rest[2]), 0.0, t))
                    del held[source]
                else:
                    held[source] = rest
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "source", "n_tokens", "base", "x", "task"])
        left = [(d, s, n, base[d] + (last and _uniform(seed, d, -1) < x), 0.0 if last else x, task) for s, (d, n, x) in held.items()]
        if left:
            yield pd.DataFrame(left, columns=["doc_id", "source", "n_tokens", "base", "x", "task"])

    return run


def plan_shares(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, copies): fractional copies of each text of a source.

    Without total_tokens the total is the largest at which every listed source that has tokens reaches its share within
    its cap; with it, a source that would need more than its cap gives its cap. Sources without tokens give nothing and
    the others keep their proportions. Sources that are not listed, or have a null or non-positive share or cap, get 0.
    """
    ok = targets.where((F.col("target_share") > 0) & (F.col("max_repeats") > 0) & F.col("source").isNotNull())
    listed = ok.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = listed.join(sizes, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)).cast("long"))
    has = F.col("available_tokens") > 0
    whole = joined.agg(
        F.sum(F.when(has, F.col("target_share"))).alias("_shares"), F.min(F.when(has, F.col("max_repeats") * F.col("available_tokens") / F.col("target_share"))).alias("_scale")
    )
    scale = F.lit(float(total_tokens)) / F.col("_shares") if total_tokens else F.col("_scale")
    copies = F.when(has, F.least(F.col("max_repeats").cast("double"), scale * F.col("target_share") / F.col("available_tokens"))).otherwise(0.0)
    return joined.crossJoin(F.broadcast(whole)).select("source", "target_share", "max_repeats", "available_tokens", copies.alias("copies"))


def mix(texts: DataFrame, targets: DataFrame, scratch: Scratch, total_tokens: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(chosen, plan): copies of each text (doc_id, source, n_tokens, copies >= 1), and the shares planned.

    texts has doc_id (unique), source and n_tokens; texts without tokens are never chosen. A source's chosen tokens
    differ from its plan by less than its last open text. Empty tables give no rows.
    """
    rows = scratch.write(texts.select("doc_id", "source", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0 and doc_id is not null"), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    plan = scratch.write(plan_shares(sizes, targets, total_tokens), "plan")
    wanted = plan.where("copies > 0").select("source", "copies")
    with_copies = rows.join(F.broadcast(wanted), "source") if plan.count() <= BROADCAST_SOURCES else lookup(rows, wanted, ["source"], "inner")
    whole = F.floor(F.col("copies") + _EPS)
    todo = with_copies.select("doc_id", "source", "n_tokens", whole.cast("int").alias("base"), F.greatest(F.lit(0.0), F.col("copies") - whole).alias("x"), F.spark_partition_id().alias("task"))
    decided, tasks = [], None
    while True:
        done = scratch.write(todo.mapInPandas(_round(seed, tasks == 1), _OPEN), "rounded")
        decided.append(done.where("x = 0"))
        still = done.where("x > 0")
        if tasks == 1 or not still.take(1):
            break
        tasks = -(-(done.agg(F.max("task")).first()[0] + 1) // FAN_IN)
        # The same texts meet in the same order whenever a task is run again.
        todo = still.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).repartition(max(tasks, 1), "task").sortWithinPartitions("task", "source", "doc_id")
        if tasks == 1:
            todo = still.withColumn("task", F.lit(0)).coalesce(1).sortWithinPartitions("source", "doc_id")
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out.where("base > 0").select("doc_id", "source", "n_tokens", F.col("base").alias("copies")), plan


def shares(chosen: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per listed source: its target and what the mix reached; a source without texts reaches 0."""
    got = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("chosen_tokens"), F.count("*").alias("chosen_texts"), F.max("copies").alias("most_copies")
    )
    total = F.broadcast(got.agg(F.sum("chosen_tokens").alias("_all")))
    out = plan.join(got, "source", "left").crossJoin(total)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "source", "target_share", "max_repeats", "available_tokens", zero("chosen_tokens"), zero("chosen_texts"), zero("most_copies"), F.coalesce(F.col("chosen_tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share")
    )
