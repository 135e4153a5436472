"""Values cut into cells that keep their order, each of a bounded number of rows, on any distribution.

A group is cut evenly between its least and its largest value. A cell that still has more than LIMIT rows is cut again, between
its own least and largest value, and so on: a group whose values all lie in a narrow range, or mostly in one, takes a
round or two more, and its rows are ranked in as many tasks as those of any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.session import cut_lineage, release

#: Rows that may be ordered in one task, and parts of one cut.
LIMIT = 100_000
PARTS = 4096


def in_cells(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`rows` with `_cell`, an array of numbers: cells of a group stand in the order of their values.

    Each value occurs once in its group and is not null. All rows of a group are in one cell, [], if there are few.
    """
    keys = list(keys)
    cell = [*keys, "_cell"]
    out = cut_lineage(rows.withColumn("_cell", F.array().cast("array<int>")))
    while True:
        sizes = out.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"))
        full = cut_lineage(sizes.where((F.col("_n") > LIMIT) & (F.col("_low") < F.col("_high"))))
        if full.isEmpty():
            return out
        named = full.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_cell").alias("_of"), "_n", "_low", "_high")
        same = F.col("_cell") == F.col("_of")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        parts = F.least(F.lit(PARTS), F.ceil(4 * F.col("_n") / LIMIT))
        # halves, as the whole difference may be beyond what a double holds
        share = (F.col(value) / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        # the ends go to the first and last part, so each cut takes rows apart, also between infinite ends
        number = F.when(F.col(value) == F.col("_low"), F.lit(0)).when(F.col(value) == F.col("_high"), parts - 1).when(F.isnan(share), F.floor(parts / 2)).otherwise(F.least(F.floor(share * parts), parts - 1))
        part = F.when(F.col("_of").isNotNull(), F.array(number.cast("int"))).otherwise(F.array().cast("array<int>"))
        last = out
        out = cut_lineage(out.join(named, same, "left").withColumn("_cell", F.concat("_cell", part)).select(*rows.columns, "_cell"))
        release(last, full)
