"""Mixing sources to target weights by Poisson replication.

Each source gets a rate: how often its documents should appear on average so that the source holds its target share
of the mix. The number of copies of a document is the inverse of the Poisson distribution with that mean at a number
hashed from seed and id, so it never depends on partitions or retries. Copies are then put in one global random order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import uniform
from alertloom.session import cut_lineage

#: A mean above this is drawn as a sum of independent parts with means up to it.
PART_MEAN = 8.0
#: Counts listed for a part; a Poisson count with mean 8 exceeds this with a chance below 1e-20.
PART_MOST = 48


def source_rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", weights: dict | None = None, power: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, size, weight, rate), one row per source; a null source is a source of its own.

    Sizes are code points. `weights` gives target weights by source (0 where a source is not named); without it the
    weight is size ** power. The mix has `epochs` times the size of the input. Empty sources get rate 0.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(power))).otherwise(0.0))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        given = F.create_map(*pairs)[F.coalesce("source", F.lit(""))] if pairs else F.lit(None).cast("double")
        weighed = sizes.withColumn("weight", F.coalesce(given, F.lit(0.0)))
    total = weighed.agg(F.sum("size").alias("size"), F.sum(F.when(F.col("size") > 0, F.col("weight"))).alias("weight")).first()
    mass, weight = float(total["size"] or 0), float(total["weight"] or 0)
    rate = F.col("weight") / F.lit(weight) * F.lit(epochs * mass) / F.col("size") if weight > 0 else F.lit(0.0)
    return weighed.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))


def poisson_copies(rate: Column, cdf: Column, parts: Column, seed: str, key: Column) -> Column:
    """The number of copies: for each part, how many values of its distribution function are at or below its number."""
    draw = lambda j: F.size(F.filter(cdf, lambda c: c <= uniform(F.lit(seed), key, j)))
    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, j: n + draw(j))).otherwise(0)


def with_distribution(rates: DataFrame) -> DataFrame:
    """`rates` with the number of parts of each mean and the distribution function of one part."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / PART_MEAN).cast("int"))
    mean = F.col("rate") / F.col("parts")
    term = [F.exp(-mean) * F.pow(mean, F.lit(float(k))) / F.lit(float(math.factorial(k))) for k in range(PART_MOST + 1)]
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("all"))
    step = lambda acc, t: F.struct((acc["sum"] + t).alias("sum"), F.concat(acc["all"], F.array(acc["sum"] + t)).alias("all"))
    return rates.withColumn("parts", parts).withColumn("cdf", F.aggregate(F.array(*term), start, step, lambda acc: acc["all"]))


def mix(docs: DataFrame, rates: DataFrame, seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """Every copy of every document, in one global random order, with `copy` (from 1), `n_copies` and `mix_key`.

    Rows with the same id get the same number of copies. Documents whose source has no rate are left out. The rates have
    one row per source; Spark broadcasts them when they are small and splits a large source otherwise. Columns of `docs`
    that bear one of the three names are replaced.
    """
    own = ("copy", "n_copies", "mix_key")
    rest = [c for c in docs.columns if c.lower() not in own]
    known = cut_lineage(with_distribution(rates)).select(F.col("source").alias("_source"), "rate", "parts", "cdf").alias("r")
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(source_col).alias("_of"), F.col(id_col).alias("_id"))
    met = left.join(known, left["_of"].eqNullSafe(known["_source"]))
    counted = met.select("row", "_id", poisson_copies(F.col("rate"), F.col("cdf"), F.col("parts"), seed, F.col("_id")).alias("n_copies"))
    copies = counted.where("n_copies > 0").select("row", "_id", "n_copies", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("copy")))
    return copies.select("row.*", "copy", "n_copies", key.alias("mix_key")).repartition("mix_key").sortWithinPartitions("mix_key")
