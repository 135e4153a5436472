"""Sums of packed arrays that tasks make, a bounded number of them at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrays that are summed in one task before the next sum.
FAN_IN = 64

SCHEMA = T.StructType().add("block", "integer").add("task", "long").add("packed", "binary")


def pack(array: np.ndarray) -> bytes:
    """The bytes of an array, compressed: counts of one task are small and mostly zero."""
    body = np.ascontiguousarray(array).tobytes()
    return len(body).to_bytes(8, "little") + pa.Codec("zstd").compress(body, asbytes=True)


def unpack(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True), kind)


def tree_sum(partial: DataFrame, kind: str) -> DataFrame:
    """(block, task, packed): the sum of the packed arrays of each block, of numpy type `kind`, over all tasks.

    `task` is any number a task gives its arrays. FAN_IN neighbours are summed first, then FAN_IN of their sums, and so on, so that
    no task holds more than that many arrays, however many tasks there were.
    """

    def add(group: pa.Table) -> pa.Table:
        total = 0
        for packed in group.column("packed"):
            total = total + unpack(packed.as_py(), kind)
        return pa.table({"block": group.column("block").slice(0, 1), "task": group.column("task").slice(0, 1), "packed": pa.array([pack(total)], pa.binary())})

    most = partial.agg(F.max("task")).first()[0] or 0
    out = partial.select("block", "task", "packed")
    while most:
        most //= FAN_IN
        out = out.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("long")).groupBy("block", "task").applyInArrow(add, SCHEMA)
    return out
