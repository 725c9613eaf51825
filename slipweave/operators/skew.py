"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key above which the key is split.
HOT_ROWS = 200_000


def hot_keys(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `rows` rows and the number of parts each is cut into; at most count(df) / rows of them."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    return counted.select(*keys, F.ceil(F.col("_n") / rows).cast("int").alias("_parts"))


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", total: int | None = None, rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right, whose keys are unique, without a hot task when many left rows share a key.

    Hot keys are counted first (combined before the shuffle); their left rows are spread over `_parts` salts and the
    single right row is repeated for each. Below `rows` rows in total no key can be hot and a plain join is used.
    """
    if total is not None and total <= rows:
        return left.join(right, keys, how)
    hot = hot_keys(left, keys, rows)
    spread = F.pmod(F.monotonically_increasing_id(), F.coalesce("_parts", F.lit(1))).cast("int")
    salted = left.join(hot, keys, "left").withColumn("_salt", spread).drop("_parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return salted.join(right.join(hot, keys, "left").withColumn("_salt", parts).drop("_parts"), [*keys, "_salt"], how).drop("_salt")
