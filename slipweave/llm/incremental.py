"""Problem 6: check each new batch against everything accepted before, over a persisted inverted file.

The index is a folder that outlives the session. Its cells are the values of five sub-codes of a 64-bit picture vector
(13, 13, 13, 13 and 12 bits); each vector lies with all its bits in one cell of every sub-code, in files by sub-code
and group of cells, sorted by owner, so that a reader skips the pages of other owners. The bound of a cell for a query is the Hamming distance of the two sub-codes. Two
vectors at distance 8 or less agree in one of the first four sub-codes up to one bit, or fully in the fifth (otherwise
they would differ in 4 * 2 + 1 = 9 bits). So probing cells in the order of their bounds may stop at bound 1 (0 for the
fifth): no nearer match is possible in any other cell, and none is missed. Candidates are reranked by the exact distance.
A batch reads the files of the cells it probes and appends files of its own; history is never compared with itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slipweave.llm import groups
from slipweave.operators.skew import lookup
from slipweave.sources.tables import Scratch

MAX_DISTANCE = 8
#: (shift, bits, largest bound probed) of the sub-codes.
CELLS = [(51, 13, 1), (38, 13, 1), (25, 13, 1), (12, 13, 1), (0, 12, 0)]
#: First bits of a sub-code that name its group of cells, a folder of the index; rows of a page that is read or skipped.
GROUP_BITS, PAGE_ROWS = 2, 1_000
#: Vectors of one owner in one part of a search; larger owners are spread over several.
PART_ROWS = 50_000
#: Owners of a batch by whose names the files are filtered; batches of more owners read all owners of the cells.
NAMED_OWNERS = 1_000
#: Candidates reranked at once.
STEP = 4_000_000


# Fixed value: a whole hash.
WHOLE = "^[0-9a-fA-F]{16}\\z"


def vector(hash_col: F.Column) -> F.Column:
    """64 bits as a long; null unless the text is a hexadecimal number of 16 digits."""
    half = lambda start: F.conv(F.substring(hash_col, start, 8), 16, 10).cast("long")
    return F.when(hash_col.rlike(WHOLE), F.shiftleft(half(1), 32).bitwiseOR(half(9)))


def exact_key(hash_col: F.Column) -> F.Column:
    """Lower-case SHA-256 text; null if incomplete."""
    return F.when(hash_col.rlike("^[0-9a-fA-F]{64}\\z"), F.lower(hash_col))


class _Part:
    """The cells of one sub-code that a partition holds, for all owners in it."""

    def __init__(self, table: int, owner: np.ndarray, vectors: np.ndarray):
        self.table = table
        self.shift, self.bits, self.bound = CELLS[table]
        key = self._key(owner, self._code(vectors))
        order = np.lexsort((vectors, key))
        key, vec = key[order], vectors[order]
        new = np.ones(len(key), bool)  # a vector that several batches brought counts once
        new[1:] = (key[1:] != key[:-1]) | (vec[1:] != vec[:-1])
        self.keys, self.vec = key[new], vec[new]

    def _code(self, vectors: np.ndarray) -> np.ndarray:
        return ((vectors >> np.uint64(self.shift)) & np.uint64(2**self.bits - 1)).astype(np.int64)

    def _key(self, owner: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (owner << self.bits) | code

    def probe(self, owner: np.ndarray, vectors: np.ndarray, flip: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query row, vector found, distance) of each pair within MAX_DISTANCE that no earlier sub-code finds.

        A query with flip -1 probes the cells of its own group, one with a bit the cell that differs in this bit.
        """
        code = self._code(vectors)
        low = self.bits - GROUP_BITS
        for mask in [0, *(1 << k for k in range(self.bits * self.bound))]:
            rows = np.flatnonzero(flip == (-1 if mask < 1 << low else mask.bit_length() - 1))
            if not len(rows):
                continue
            key = self._key(owner[rows], code[rows] ^ mask)
            lo = np.searchsorted(self.keys, key, "left")
            n = np.searchsorted(self.keys, key, "right") - lo
            ends = np.cumsum(n)
            begin = 0
            while begin < len(n):
                base = ends[begin - 1] if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, base + STEP, "right")))
                m = n[begin:stop]
                total = int(m.sum())
                if total:
                    q = rows[np.repeat(np.arange(begin, stop), m)]
                    x = self.vec[np.arange(total) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[begin:stop], m)]
                    diff = vectors[q] ^ x
                    dist = np.bitwise_count(diff)
                    keep = dist <= MAX_DISTANCE
                    for s, b, r in CELLS[: self.table]:  # an earlier sub-code finds it
                        keep &= np.bitwise_count((diff >> np.uint64(s)) & np.uint64(2**b - 1)) > r
                    if keep.any():
                        yield q[keep], x[keep], dist[keep]
                begin = stop


class _Rows:
    """Columns of a batch, with owners and parts as numbers of a dictionary that grows."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}

    def read(self, b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        coded = b.column("user_id").cast(pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        of = np.array([self.numbers.setdefault(n, len(self.numbers)) for n in names] or [0], np.int64)
        owner = of[coded.indices.to_numpy(zero_copy_only=False)]
        column = lambda c: b.column(c).to_numpy(zero_copy_only=False)
        return owner << 20 | column("part").astype(np.int64), column("vec").view(np.uint64), column("t"), column("flip")


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index (flip -2) come first in each partition, then the queries."""
    rows, held, parts = _Rows(), [], None
    for b in batches:
        owner, vec, table, flip = rows.read(b)
        split = int(np.searchsorted(flip, -1))
        if split:
            held.append((owner[:split], vec[:split], table[:split]))
        if split == len(flip):
            continue
        if parts is None:
            own, v, t = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int32))
            parts, held = {int(k): _Part(int(k), own[t == k], v[t == k]) for k in np.unique(t)}, []
        users = b.column("user_id").cast(pa.string())
        for k, part in parts.items():
            here = np.flatnonzero((table == k) & (flip > -2))
            if not len(here):
                continue
            for q, x, d in part.probe(owner[here], vec[here], flip[here]):
                yield pa.RecordBatch.from_arrays(
                    [pc.take(users, pa.array(here[q])), pa.array(vec[here[q]].view(np.int64)), pa.array(x.view(np.int64)), pa.array(d.astype(np.int32))], names=["user_id", "vec_q", "vec_x", "distance"]
                )


class VectorIndex:
    """Inverted file of owner-scoped picture vectors in a folder that all machines share.

    Any session may open the folder again. A batch is a folder of its own, so a batch appended again after a failure
    replaces what it left behind.
    """

    FIELDS = "user_id string, vec long, batch string, t int, g int"

    def __init__(self, spark: SparkSession, path: str, part_rows: int = PART_ROWS):
        self.spark, self.path, self.part_rows = spark, path.rstrip("/"), part_rows

    @staticmethod
    def _vectors(vectors: DataFrame) -> DataFrame:
        known = vectors.where(F.col("user_id").isNotNull() & F.col("vec").isNotNull())
        return known.select("user_id", "vec").distinct()

    @staticmethod
    def _group(table: int) -> F.Column:
        shift, bits, _ = CELLS[table]
        return F.shiftrightunsigned("vec", shift + bits - GROUP_BITS).bitwiseAND(F.lit(2**GROUP_BITS - 1)).cast("int")

    def append(self, vectors: DataFrame, batch: str) -> None:
        """Add the (user_id, vec) rows of a batch; rows without owner or vector are ignored."""
        cells = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), self._group(t).alias("g")) for t in range(len(CELLS))]))
        filed = self._vectors(vectors).withColumn("c", cells).select("user_id", "vec", "c.t", "c.g")
        filed = filed.hint("rebalance", "t", "g").sortWithinPartitions("t", "g", "user_id")
        filed.write.mode("overwrite").option("compression", "zstd").option("parquet.page.row.count.limit", PAGE_ROWS).partitionBy("t", "g").parquet(f"{self.path}/batch={batch}")

    def table(self) -> DataFrame:
        """All cells: user_id, vec, batch and the folder (t, g)."""
        return self.spark.read.schema(self.FIELDS).option("basePath", self.path).parquet(self.path)

    def probed(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(index rows, probes): the stored rows of the cells that the queries probe, and the probes with their flips."""
        asked = self._vectors(queries)
        one = lambda t, g, flip: F.struct(F.lit(t).alias("t"), g.alias("g"), F.lit(flip).alias("flip"))
        each = []
        for t, (_, bits, bound) in enumerate(CELLS):
            own = self._group(t)
            each += [one(t, own, -1), *(one(t, own.bitwiseXOR(F.lit(1 << k)), bits - GROUP_BITS + k) for k in range(GROUP_BITS * bound))]
        probes = asked.withColumn("c", F.explode(F.array(*each))).select("user_id", "vec", "c.t", "c.g", "c.flip")
        folder = F.expr(f"t * {2**GROUP_BITS} + g")
        folders = [r[0] for r in probes.select(folder.alias("f")).distinct().collect()]  # at most the folders of the index
        index = self.table().where(folder.isin(folders)) if folders else self.table().where("false")
        owners = [r[0] for r in asked.select("user_id").distinct().limit(NAMED_OWNERS + 1).collect()]
        if 0 < len(owners) <= NAMED_OWNERS:
            index = index.where(F.col("user_id").isin(owners))
        return index, probes

    def probe(self, queries: DataFrame) -> DataFrame:
        """(user_id, vec_q, vec_x, distance) of all indexed vectors within MAX_DISTANCE of a query, itself included."""
        index, probes = self.probed(queries)
        large = index.where("t = 0").groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") > self.part_rows)
        large = large.select("user_id", F.ceil(F.col("n") / self.part_rows).cast("int").alias("parts"))
        parts = F.coalesce("parts", F.lit(1))
        left = index.join(large, "user_id", "left").select("user_id", "vec", "t", "g", F.pmod(F.xxhash64("vec"), parts).cast("int").alias("part"), F.lit(-2).alias("flip"))
        right = probes.join(large, "user_id", "left").select("user_id", "vec", "t", "g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "flip")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        both = left.unionByName(right).repartition(n, "user_id", "t", "g", "part").sortWithinPartitions("flip")
        return both.select("user_id", "vec", "t", "part", "flip").mapInArrow(_search, "user_id string, vec_q long, vec_x long, distance int")

    def accept(self, vectors: DataFrame, batch: str) -> DataFrame:
        """Append a batch and give its links: (user_id, vec_a <= vec_b, distance) with all that is indexed, itself included."""
        self.append(vectors, batch)
        return self.probe(vectors).select("user_id", F.least("vec_q", "vec_x").alias("vec_a"), F.greatest("vec_q", "vec_x").alias("vec_b"), "distance")


def near_records(records: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(members, links): one row per record, and the links between vectors that a new batch brought.

    members has document_id, user_id, batch (the first in which the record came), vec, exact. links has user_id,
    vec_a <= vec_b and distance, 0 for a vector that came again. Repeated rows and later versions count once (of several hashes of one record the largest stands); null and damaged hashes match nothing;
    rows without a record or owner id are ignored.
    """
    src = records.where(F.col("document_id").isNotNull() & F.col("user_id").isNotNull())
    members = src.groupBy("document_id", "user_id").agg(
        F.min(F.coalesce("intake_batch", F.lit(0))).alias("batch"), vector(F.max(F.when(F.col("perceptual_hash").rlike(WHOLE), F.lower("perceptual_hash")))).alias("vec"), F.max(exact_key(F.col("exact_hash"))).alias("exact")
    )
    members = scratch.write(members, "members")
    index = VectorIndex(members.sparkSession, scratch.path("index"))
    index.append(members.where("batch < 1"), "history")
    # Batches that wait are accepted together: their cells are read once.
    links = index.accept(members.where("batch >= 1"), "new")
    return members, scratch.write(links.distinct(), "links")


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(document_a_id, document_b_id) of all same or nearly same records of an owner, at least one of a new batch."""
    # Both sides are renamed through select, so no column reference is ambiguous.
    side = lambda x, *more: members.select(F.col("document_id").alias(f"d{x}"), F.col("batch").alias(f"b{x}"), "user_id", *more)
    new = (F.col("b1") >= 1) | (F.col("b2") >= 1)
    near = links.join(side(1, F.col("vec").alias("vec_a")), ["user_id", "vec_a"]).join(side(2, F.col("vec").alias("vec_b")), ["user_id", "vec_b"])
    out = near.where(new & ((F.col("vec_a") < F.col("vec_b")) | (F.col("d1") < F.col("d2"))) & (F.col("d1") != F.col("d2"))).select("d1", "d2")
    shared = members.where(F.col("exact").isNotNull()).groupBy("user_id", "exact").agg(F.count("*").alias("n"), F.max("batch").alias("last"))
    shared = shared.where((F.col("n") > 1) & (F.col("last") >= 1)).select("user_id", "exact")
    same = shared.join(side(1, "exact"), ["user_id", "exact"]).join(side(2, "exact"), ["user_id", "exact"]).where(new & (F.col("d1") < F.col("d2")))
    out = out.unionByName(same.select("d1", "d2"))
    return out.select(F.least("d1", "d2").alias("document_a_id"), F.greatest("d1", "d2").alias("document_b_id")).distinct()


def record_classes(members: DataFrame, links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row per record: its class and the number of other classes linked to it.

    A class is a group of records of one owner that equal vectors or equal exact hashes join; its id is the owner and the
    smallest vector in hexadecimal, or the exact hash if no record of it has a vector, or the record if it has neither.
    """
    scratch = scratch or Scratch(members.sparkSession, "classes")
    hexed = F.lower(F.lpad(F.hex("vec"), 16, "0"))
    # An exact hash joins its vectors to the smallest of them; few hashes have more than one vector.
    both = members.where(F.col("vec").isNotNull() & F.col("exact").isNotNull()).select("user_id", "exact", hexed.alias("h")).distinct()
    least = scratch.write(both.groupBy("user_id", "exact").agg(F.min("h").alias("lo"), F.count("*").alias("n")), "least")
    star = lookup(both, least.where("n > 1").drop("n"), ["user_id", "exact"], "inner").where(F.col("h") != F.col("lo"))
    # The owner before 16 digits: the smallest id of a group has its smallest vector.
    joined = groups.connected_groups(star.select(F.concat("user_id", "h").alias("a"), F.concat("user_id", "lo").alias("b")), "a", "b", scratch)
    owner = F.expr("substring(id, 1, length(id) - 16)")
    top = scratch.write(joined.select(owner.alias("user_id"), F.expr("right(id, 16)").alias("h"), F.expr("right(group_id, 16)").alias("top")).where("h <> top"), "tops")
    classed = lambda rows: rows.join(top, ["user_id", "h"], "left").withColumn("class_id", F.coalesce("top", "h")).drop("top", "h")
    of_exact = classed(least.select("user_id", "exact", F.col("lo").alias("h")))
    seen, unseen = members.where(F.col("vec").isNotNull()), members.where(F.col("vec").isNull())
    own = ["document_id", "user_id", "class_id"]
    out = classed(seen.select("document_id", "user_id", hexed.alias("h"))).select(*own)
    out = out.unionByName(lookup(unseen.drop("vec"), of_exact, ["user_id", "exact"]).withColumn("class_id", F.coalesce("class_id", "exact")).select(*own))
    # A link of vectors is a link of their classes, counted once and not within a class.
    ends = links.where("vec_a <> vec_b").select("user_id", F.lower(F.lpad(F.hex("vec_a"), 16, "0")).alias("h"), F.lower(F.lpad(F.hex("vec_b"), 16, "0")).alias("other"))
    ends = classed(classed(ends).withColumnsRenamed({"class_id": "a", "other": "h"})).withColumnRenamed("class_id", "b").where(F.col("a") != F.col("b"))
    ends = ends.select("user_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = ends.select("user_id", F.explode(F.array("a", "b")).alias("class_id")).groupBy("user_id", "class_id").agg(F.count("*").alias("n_links"))
    named = F.concat_ws(":", "user_id", F.coalesce("class_id", "document_id")).alias("class_id")
    return lookup(out, degree, ["user_id", "class_id"]).select("document_id", "user_id", named, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
