"""Paired cluster bootstrap over candidate pairs.

Values are reduced to one (sum, n) row per (pair of candidates, metric, cluster) before any resample opens. The caller
picks the estimator: "indexed" draws whole clusters by index, "weighted" gives each cluster a Poisson(1) weight per
replicate, which needs no index, so a replicate is a plain sum that combines map-side whatever the number of clusters.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from alertloom.functions.stats import r6
from alertloom.session import cut_lineage

METHODS = ("indexed", "weighted")
#: Cells of a packed row at most, and replicates that a task draws from it.
CHUNK = 1 << 18
REPS = 50
KEYS = ("a", "b", "metric")


def candidate_pairs(vectors: DataFrame) -> DataFrame:
    """Per-case differences a - b for unordered pairs of differently named candidates on common cases.

    `vectors`: candidate, name, metric, case_id, cluster, value. Arms of one candidate share a name and
    are not paired with each other. One case has as many rows as there are candidates, so gathering a
    case's values is bounded by the number of candidates, never by the data.
    """
    cell = F.struct(F.col("candidate").alias("c"), F.col("name").alias("n"), F.col("value").alias("v"))
    per_case = vectors.groupBy("metric", "case_id", "cluster").agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    opened = per_case.select("metric", "case_id", "cluster", "cells", F.posexplode("cells").alias("i", "x"))
    others = F.filter(F.slice(F.col("cells"), F.col("i") + 2, F.size("cells")), lambda y: y["n"] != F.col("x.n"))
    return opened.select("metric", "case_id", "cluster", "x", F.explode(others).alias("y")).select(
        F.col("x.c").alias("a"), F.col("y.c").alias("b"), "metric", "case_id", "cluster", (F.col("x.v") - F.col("y.v")).alias("diff")
    )


def cluster_sums(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*KEYS, "cluster").agg(F.sum("diff").alias("s"), F.count(F.lit(1)).alias("n"))


def _uniform(*parts: Column) -> Column:
    """Integer in [0, 2^32) from the md5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("bigint")


def _poisson_bounds() -> list[int]:
    total, term, out = 0.0, math.exp(-1.0), []
    for k in range(13):
        total += term
        out.append(int(total * 2**32))
        term /= k + 1
    return out


#: A 32-bit uniform integer below the k-th bound gives a weight of at most k.
POISSON_BOUNDS = _poisson_bounds()


def poisson_weight(u: Column) -> Column:
    """Poisson(1) by inverse distribution from a 32-bit uniform integer."""
    out = F.when(u < POISSON_BOUNDS[0], 0)
    for k, bound in enumerate(POISSON_BOUNDS[1:], 1):
        out = out.when(u < bound, k)
    return out.otherwise(len(POISSON_BOUNDS))


def _by_index(head: dict, clusters: Sequence[str | None], rep: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a packed row that whole-cluster draws hit. One md5 holds four 32-bit numbers: slot q * 4 + k takes the k-th."""
    size, lo = head["n_clusters"], head["lo"]
    digests = b"".join(hashlib.md5(b"%d:%d:%d" % (seed, rep, q)).digest() for q in range(-(-size // 4)))
    at = np.frombuffer(digests, ">u4")[:size].astype(np.int64) % size - lo
    at = at[(at >= 0) & (at < len(clusters))]
    return at, np.ones(len(at))


def _by_weight(head: dict, clusters: Sequence[str | None], rep: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in a packed row with a weight above none: Poisson(1) from the md5 of seed, replicate and cluster."""
    start = f"{seed}:{rep}"
    digests = b"".join(hashlib.md5((start if c is None else f"{start}:{c}").encode()).digest()[:4] for c in clusters)
    k = np.searchsorted(POISSON_BOUNDS, np.frombuffer(digests, ">u4").astype(np.int64), side="right")
    at = np.flatnonzero(k)
    return at, k[at].astype(float)


def _packed(sums: DataFrame, groups: DataFrame) -> DataFrame:
    """(KEYS, n_clusters, lo, cells): the sums of each group in the order of its clusters, cut into rows of CHUNK cells at most."""
    numbered = sums.join(groups, list(KEYS)).withColumn("idx", F.row_number().over(W.partitionBy(*KEYS).orderBy("cluster")) - 1)
    known = F.col("s").isNotNull().cast("double").alias("known")
    cell = F.struct("idx", F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("s"), F.col("n").cast("double").alias("n"), known, F.col("cluster").cast("string").alias("cluster"))
    lo = (F.floor(F.col("idx") / CHUNK) * CHUNK).cast("bigint").alias("lo")
    return cut_lineage(numbered.groupBy(*KEYS, "n_clusters", lo).agg(F.sort_array(F.collect_list(cell)).alias("cells")))


def _replicate_means(sums: DataFrame, groups: DataFrame, seed: int, n_boot: int, method: str) -> DataFrame:
    """(KEYS, rep, mean). Every packed row meets every block of replicates, read again from the shared folder and not shuffled.

    A draw is never a row: a task draws in arrays of CHUNK cells at most, and one sum for each replicate leaves it.
    """
    draw = _by_index if method == "indexed" else _by_weight
    blocks = sums.sparkSession.range(0, n_boot, REPS, numPartitions=-(-n_boot // REPS)).withColumnRenamed("id", "first")
    met = _packed(sums, groups).hint("shuffle_replicate_nl").crossJoin(blocks)
    kind = {f.name: f.dataType.simpleString() for f in sums.schema.fields}

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                head = {c: batch.column(c)[i].as_py() for c in ("n_clusters", "lo", "first")}
                cells = batch.column("cells").slice(i, 1).flatten()
                values = [cells.field(c).to_numpy(zero_copy_only=False) for c in ("s", "n", "known")]
                clusters = cells.field("cluster").to_pylist()
                out = []
                for rep in range(head["first"], min(head["first"] + REPS, n_boot)):
                    at, w = draw(head, clusters, rep, seed)
                    out.append((rep, *(float((w * v[at]).sum()) for v in values)))
                keys = [pa.array([batch.column(c)[i].as_py()] * len(out), batch.column(c).type) for c in KEYS]
                numbers = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), *[pa.float64()] * 3), strict=True)]
                yield pa.RecordBatch.from_arrays(keys + numbers, names=[*KEYS, "rep", "ws", "wn", "known"])

    schema = ", ".join(f"{c} {kind[c]}" for c in KEYS) + ", rep bigint, ws double, wn double, known double"
    parts = met.select(*KEYS, "n_clusters", "lo", "first", "cells").mapInArrow(resample, schema)
    total = parts.groupBy(*KEYS, "rep").agg(F.sum("ws").alias("ws"), F.sum("wn").alias("wn"), F.sum("known").alias("known"))
    return total.where("wn > 0").select(*KEYS, "rep", F.when(F.col("known") > 0, F.col("ws") / F.col("wn")).alias("mean"))


def paired_bootstrap(vectors: DataFrame, seed: int = 42, n_boot: int = 2000, confidence: float = 0.95, method: str = "indexed") -> DataFrame:
    """diff, interval, n, n_clusters per candidate pair and metric; N/A below two clusters."""
    if not 0 < confidence < 1 or n_boot < 1 or method not in METHODS:
        raise ValueError(f"needs a confidence between 0 and 1, at least one resample, and a method of {METHODS}")
    sums = cut_lineage(cluster_sums(candidate_pairs(vectors)))
    sizes = cut_lineage(sums.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n"), F.sum("s").alias("s")))
    drawn = sizes.where(F.col("n_clusters") >= 2).select(*KEYS, "n_clusters")
    reps = _replicate_means(sums, drawn, seed, n_boot, method)
    tail = (1 - confidence) / 2
    # a group has n_boot replicates, so this percentile buffer is bounded by n_boot
    ci = reps.groupBy(*KEYS).agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci"))
    return sizes.join(ci, list(KEYS), "left").select(
        *KEYS, "n", "n_clusters",
        r6(F.col("s") / F.col("n")).alias("diff"),
        r6(F.get("ci", F.lit(0))).alias("ci_low"),
        r6(F.get("ci", F.lit(1))).alias("ci_high"),
        F.when(F.col("n_clusters") < 2, "an interval needs two clusters or more").alias("na_reason"),
    )


SCENARIO_KEYS = ("a", "b", "metric", "scenario")


def scenario_bootstrap(pairs: DataFrame, seed: int = 42, n_boot: int = 2000, confidence: float = 0.95) -> DataFrame:
    """diff, interval, n and n_clusters per candidate pair, metric and scenario, from one set of resamples.

    `pairs` is that of `candidate_pairs` with a `scenario`. Each cluster gets its Poisson(1) weights once, a vector of one per
    resample, and all its scenarios and metrics share it: a batch of clusters is a product of weights and sums. So many
    scenarios cost one pass, and their intervals move together. N/A below two clusters.
    """
    if not 0 < confidence < 1 or n_boot < 1:
        raise ValueError("needs a confidence between 0 and 1 and at least one resample")
    keys = list(SCENARIO_KEYS)
    sums = cut_lineage(pairs.groupBy(*keys, "cluster").agg(F.sum("diff").cast("double").alias("s"), F.count(F.lit(1)).alias("n")))
    sizes = cut_lineage(sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n").alias("n"), F.sum("s").alias("s")))
    listed = [tuple(r) for r in sizes.select(*keys).orderBy(*keys).collect()]  # one row per pair, metric and scenario
    numbers = sums.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(listed)], sizes.select(*keys).schema.add("_k", "integer"))
    cell = F.struct("_k", "s", F.col("n").cast("double").alias("n"))
    per = sums.join(numbers, keys).groupBy("cluster").agg(F.collect_list(cell).alias("cells"))  # as many as keys
    weights = F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda rep: poisson_weight(_uniform(F.lit(str(seed)), rep.cast("string"), F.col("cluster").cast("string"))).cast("byte"))

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(listed), n_boot))
        for batch in batches:
            cells, w = batch.column("cells"), batch.column("w")
            each = w.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), n_boot)
            at = np.repeat(np.arange(len(batch)), cells.value_lengths().to_numpy())
            flat = cells.flatten()
            number = flat.field("_k").to_numpy()
            for j, name in enumerate(("s", "n")):
                dense = np.zeros((len(batch), len(listed)))
                dense[at, number] = flat.field(name).to_numpy()
                total[j] += dense.T @ each
        met = np.flatnonzero(total[1].any(axis=1))
        for k in met.tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k] * n_boot, pa.int32()), pa.array(range(n_boot), pa.int32()), pa.array(total[0, k]), pa.array(total[1, k])], names=["_k", "rep", "ws", "wn"])

    parts = per.select("cells", weights.alias("w")).mapInArrow(resample, "_k int, rep int, ws double, wn double")
    reps = parts.groupBy("_k", "rep").agg((F.sum("ws") / F.nullif(F.sum("wn"), F.lit(0.0))).alias("mean")).where("mean IS NOT NULL")
    tail = (1 - confidence) / 2
    # a group has n_boot replicates, so this percentile buffer is bounded by n_boot
    ci = reps.groupBy("_k").agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("ci")).join(numbers, "_k").drop("_k")
    enough = F.col("n_clusters") >= 2
    return sizes.join(ci, keys, "left").select(
        *keys, "n", "n_clusters", r6(F.col("s") / F.col("n")).alias("diff"),
        r6(F.when(enough, F.get("ci", F.lit(0)))).alias("ci_low"), r6(F.when(enough, F.get("ci", F.lit(1)))).alias("ci_high"),
        F.when(~enough, "an interval needs two clusters or more").alias("na_reason"),
    )
