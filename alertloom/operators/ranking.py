"""Row positions at scale: no window ever spans a whole key or the whole table.

Positions follow the order of a seeded hash of the row id, so a fixed prefix of the hash cuts every
key into even buckets. A position is the key's offset, plus the bucket's, plus the row number inside
the bucket. A key holding a third of the rows is spread over all its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_HEX = 3


def order_hash(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hashed_position(df: DataFrame, keys: Sequence[str], row_id: str, seed: int, bucket_hex: int = BUCKET_HEX) -> DataFrame:
    """Add `position` (0-based inside the key, in seeded hash order) and `group_size`."""
    keys = list(keys)
    h = df.withColumn("_h", order_hash(seed, row_id)).withColumn("_b", F.substring("_h", 1, bucket_hex))
    counts = h.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_b",
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
        F.sum("_c").over(W.partitionBy(*keys)).alias("group_size"),
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_h", row_id)
    joined = h.join(offsets, [*keys, "_b"])
    return joined.withColumn("position", F.col("_off") + F.row_number().over(inside) - 1).drop("_h", "_b", "_off")


def with_group_offsets(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Turn per-key positions into one global position, keys in order. Adds `index` and `total`.

    The running sum covers one row per key (the strata), never the rows themselves.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.max("group_size").alias("_n"))
    run = W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_base"), F.sum("_n").over(W.partitionBy(F.lit(0))).alias("total")
    )
    return df.join(offsets, keys).withColumn("index", F.col("_base") + F.col("position")).drop("_base")
