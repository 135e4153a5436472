"""Exact interpolated percentiles that never hold a group in one task.

Spark's `percentile` keeps every distinct value of a group in one aggregation buffer. Here values are
first reduced to (value, count) and cut into cells of bounded size that keep their order; sums of cells
say which cell holds the wanted ranks, and only those cells are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.operators.ordered_cells import in_cells


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, fractions: Sequence[float], weight: str | None = None) -> DataFrame:
    """(keys..., n, p_0, p_1, ...) by linear interpolation between the two closest ranks.

    `weight` names a column of repeat counts when the rows are already counted.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("c"))
    )
    counted = in_cells(counted, keys, "v").withColumnRenamed("_cell", "b")
    hist = counted.groupBy(*keys, "b").agg(F.sum("c").alias("bc"))
    by_bucket = W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    hist = hist.select(
        *keys, "b", "bc",
        F.coalesce(F.sum("bc").over(by_bucket), F.lit(0)).alias("before"),
        F.sum("bc").over(whole).alias("n"),
    )
    wanted = F.explode(F.array(*[F.struct(F.lit(float(f)).alias("f"), F.lit(i).alias("i")) for i, f in enumerate(fractions)]))
    asked = hist.withColumn("q", wanted).select(*keys, "b", "bc", "before", "n", F.col("q.f").alias("f"), F.col("q.i").alias("qi"))
    position = (F.col("n") - 1) * F.col("f")
    asked = asked.withColumn("lo", F.floor(position)).withColumn("hi", F.least(F.floor(position) + 1, F.col("n") - 1))
    asked = asked.withColumn("frac", position - F.col("lo"))
    end = F.col("before") + F.col("bc")
    touched = ((F.col("lo") >= F.col("before")) & (F.col("lo") < end)) | ((F.col("hi") >= F.col("before")) & (F.col("hi") < end))
    asked = asked.where(touched)
    # at most two cells per (group, fraction) survive; rank only the values inside them
    in_bucket = W.partitionBy(*keys, "b").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    needed = asked.select(*keys, "b").distinct()
    ranked = counted.join(needed, [*keys, "b"], "left_semi").withColumn(
        "inside", F.coalesce(F.sum("c").over(in_bucket), F.lit(0))
    )
    hits = ranked.join(asked.select(*keys, "b", "before", "n", "qi", "lo", "hi", "frac"), [*keys, "b"])
    first = F.col("before") + F.col("inside")

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= first) & (F.col(rank) < first + F.col("c")), F.col("v")))

    per_q = hits.groupBy(*keys, "qi").agg(
        F.max("n").alias("n"), F.max("frac").alias("frac"), at("lo").alias("v_lo"), at("hi").alias("v_hi")
    )
    value_at = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")
    return per_q.groupBy(*keys).agg(
        F.max("n").alias("n"),
        *[F.max(F.when(F.col("qi") == i, value_at)).alias(f"p_{i}") for i in range(len(fractions))],
    )
