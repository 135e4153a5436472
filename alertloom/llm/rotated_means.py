"""Clusters about centroids, exact in integers, with centroids ruled out in rotated coordinates.

Vectors are turned into integers once. Their principal axes are found from sums over all of them, and each vector is stored
with its leading coordinates on these axes and the length of what is left of it. For a vector and a centroid, the squared
distance of the leading coordinates plus the squared difference of the two lengths is never more than their squared distance.
So a round looks at the centroid of least bound first, in integers, and then only at those whose bound is no more than that.
Each round reads the stored vectors once and sends on one sum per cluster and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.llm.partials import SCHEMA, pack, tree_sum, unpack
from alertloom.session import cut_lineage, release

#: Components of a vector, units in one, centroids, rounds, and leading coordinates that are stored.
DIMS = 64
UNITS = 1024
CENTROIDS = 8
ROUNDS = 10
LEADING = 16
#: Largest component in units: squared distances of up to 64 components then fit in 63 bits.
LARGEST = 1 << 27
#: What rounding may change in a bound's root, as a share of both lengths: stored coordinates have 24 bits.
SLACK = 4e-6
#: Vectors handled at once inside a task.
ROWS = 1 << 15


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int = DIMS, units: int = UNITS) -> DataFrame:
    """(id, v): vectors of `dims` components, none null or non-finite, each the floor of `units` times its value."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))  # NaN is above all
    small = F.forall(x, lambda c: F.abs(c.cast("double") * units) <= LARGEST)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * units).cast("int"))
    v = F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component is larger than {LARGEST} units")))
    return vectors.where((F.size(x) == dims) & finite).select(F.col(id_col).alias("id"), v.alias("v"))


def whole_vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), ROWS):
        yield batch.slice(at, ROWS)


def axes(kept: DataFrame, dims: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of all vectors and their leading principal axes, as columns. Results don't depend on how exact they are."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            for part in slices(batch):
                x = np.column_stack([whole_vectors(part.column("v"), dims).astype(np.float64), np.ones(len(part))])
                total += x.T @ x
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([pack(total)], pa.binary())], names=SCHEMA.names)

    found = tree_sum(cut_lineage(kept.select("v").mapInArrow(sums, SCHEMA)), "float64").first()
    if found is None:
        return np.zeros(dims), np.eye(dims)[:, :leading]
    total = unpack(found["packed"], "float64").reshape(dims + 1, dims + 1)
    mean = total[-1, :-1] / total[-1, -1]
    _, vectors = np.linalg.eigh(total[:-1, :-1] / total[-1, -1] - np.outer(mean, mean))
    return mean, vectors[:, ::-1][:, :leading].copy()


def rotate(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Leading coordinates on the axes, and the length of what they leave of the vector, as 32-bit floats."""
    centred = x - mean
    lead = centred @ turn
    rest = np.sqrt(np.maximum((centred * centred).sum(1) - (lead * lead).sum(1), 0))
    return np.column_stack([lead, rest]).astype(np.float32)


def least_roots(own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """For each vector and centroid a number that is at most their distance, whatever rounding did."""
    own, centres = own.astype(np.float64), centres.astype(np.float64)
    a, b = (own * own).sum(1), (centres * centres).sum(1)
    square = np.maximum(a[:, None] + b[None, :] - 2 * own @ centres.T, 0)
    return np.sqrt(square) - SLACK * (np.sqrt(a)[:, None] + np.sqrt(b)[None, :]) - 1e-6


def nearest(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid of each vector, the smaller of equally near ones, its squared distance, and how many were looked at."""
    roots = least_roots(own, centres)
    rows = np.arange(len(x))
    cluster = roots.argmin(1)
    far = x - centroids[cluster]
    distance = (far * far).sum(1)
    looked = len(x)
    first = cluster.copy()
    for k in range(len(centroids)):
        left = rows[(first != k) & (roots[:, k] <= np.sqrt(distance.astype(np.float64)) * (1 + 1e-12) + 1e-6)]
        looked += len(left)
        far = x[left] - centroids[k]
        to = (far * far).sum(1)
        closer = (to < distance[left]) | ((to == distance[left]) & (k < cluster[left]))
        cluster[left[closer]], distance[left[closer]] = k, to[closer]
    return cluster, distance, looked


def start(kept: DataFrame, count: int, seed: str) -> list[list[int]]:
    """The vectors with the least sha256 of `seed:id`; of equal ids the least vector comes first, null ids come last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [list(r["v"]) for r in kept.select(digest.alias("digest"), "v").orderBy(F.col("digest").asc_nulls_last(), "v").limit(count).collect()]


def moved(stored: DataFrame, centroids: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floored mean of the vectors nearest to it; one without vectors stays."""
    dims, centres = centroids.shape[1], rotate(centroids.astype(np.float64), mean, turn)
    schema = T.StructType().add("cluster", "integer").add("sums", T.ArrayType(T.LongType()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), dims + 1), np.int64)
        for batch in batches:
            for part in slices(batch):
                x, own = stored_rows(part, dims, turn.shape[1])
                cluster, _, _ = nearest(x, own, centroids, centres)
                order = np.argsort(cluster, kind="stable")
                met, at = np.unique(cluster[order], return_index=True)
                sums[met, 1:] += np.add.reduceat(x[order], at, axis=0) if len(met) else 0
                sums[:, 0] += np.bincount(cluster, minlength=len(centroids))
        met = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(sums[met].tolist(), pa.list_(pa.int64()))], names=schema.names)

    each = stored.select("v", "rotated").mapInArrow(assign, schema).select("cluster", F.posexplode("sums").alias("place", "part"))
    totals = each.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found = {(r["cluster"], r["place"]): int(r["total"]) for r in totals.collect()}  # centroids x components
    new = [[found[k, i + 1] // found[k, 0] for i in range(dims)] if (k, 0) in found else list(map(int, c)) for k, c in enumerate(centroids)]
    return np.array(new, np.int64)


def stored_rows(part: pa.RecordBatch, dims: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(part.column("v").to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)
    return x, np.frombuffer(b"".join(part.column("rotated").to_pylist()), np.float32).reshape(-1, leading + 1)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, units: int = UNITS, count: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "3", leading: int = LEADING) -> DataFrame:
    """One row per vector that is kept: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors of another size, or with a null or non-finite component, are left out, and so are null vectors. With fewer vectors
    than centroids each is a centroid; without any the result is empty. Repeated rows count as often as they occur. A component
    above LARGEST units, or an inertia beyond 63 bits, stops the job. Other columns are not read.
    """
    spark = vectors.sparkSession
    kept = kept_vectors(vectors, id_col, vector_col, dims, units)
    mean, turn = axes(kept, dims, leading)
    centroids = np.array(start(kept, count, seed), np.int64).reshape(-1, dims)
    id_type = kept.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type)]).add("v", "binary").add("rotated", "binary")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = whole_vectors(part.column("v"), dims)
                packed = [[row.tobytes() for row in rows] for rows in (x.astype(np.int32), rotate(x.astype(np.float64), mean, turn))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(p, pa.binary()) for p in packed)], names=schema.names)

    stored = cut_lineage(kept.mapInArrow(store, schema))
    for _ in range(rounds if len(centroids) else 0):
        new = moved(stored, centroids, mean, turn)
        if (new == centroids).all():  # so would all further rounds leave them
            break
        centroids = new
    centres = rotate(centroids.astype(np.float64), mean, turn)
    final = T.StructType([T.StructField(id_col, id_type)]).add("cluster", "integer").add("distance", "long")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x, own = stored_rows(part, dims, leading)
                number, distance, _ = nearest(x, own, centroids, centres)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], names=final.names)

    assigned = cut_lineage(stored.mapInArrow(label, final))
    release(stored)
    per = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}  # one row per centroid
    rows = [(k, per[k], sum(per.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids) if k in per]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
