"""Quality scores by Naive Bayes support vectors.

A text is a set of n-grams: of its words, A-Z in lower case, and of the shapes of its words, in which every run of small
letters, capitals or digits is one sign and a word equal to the one before it is a sign of its own. The n-grams are hashed to
BUCKETS. Over all labelled rows that may be learned from, each bucket gets the logarithm of the ratio of its shares in
the two classes; a text's vector holds these ratios at its n-grams, at unit length. A linear hinge-loss model is fitted to
them by dual coordinate descent, and its margins are turned into probabilities by a logistic curve.

Counts of classes are summed over all rows by Spark. The fit alone takes a bounded sample, the rows of least hash, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.llm import tokens
from alertloom.llm.common import cut_packed
from alertloom.llm.partials import pack, tree_sum, unpack
from alertloom.llm.shingles import mixed, run_hashes, word_hashes
from alertloom.session import release

#: Buckets of hashed n-grams, a power of two; counts travel in blocks of BLOCK buckets.
BUCKETS = 1 << 18
BLOCK = 1 << 12
#: Longest n-gram of words and of shapes.
WORD_ORDER, SHAPE_ORDER = 2, 3
#: The sample that the linear model is fitted to: at most so many rows, half of them of each class, and so many n-grams.
FIT_ROWS = 6_000
FIT_FEATURES = 1 << 23
#: Smoothing of class counts, cost of a violated margin, rounds over the sample.
SMOOTHING = 1.0
COST = 1.0
ROUNDS = 20

_SAME = np.uint64(0x5851F42D4C957F2D)
_SIGNS = np.arange(256, dtype=np.uint8)
_SIGNS[ord("A") : ord("Z") + 1] = ord("A")
_SIGNS[ord("a") : ord("z") + 1] = ord("a")
_SIGNS[ord("0") : ord("9") + 1] = ord("0")
_SIGNS[0x80:] = ord("a")


def shape_hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of the shape of every word of all texts: its bytes as signs, equal neighbours once."""
    data, offsets = tokens.text_bytes(texts)
    word = (data != 0x20) & ((data < 9) | (data > 13))
    first = word.copy()
    first[1:] &= ~word[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = word[begins]
    signs = _SIGNS[data]
    kept = first.copy()
    kept[1:] |= word[1:] & (signs[1:] != signs[:-1])
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64)
    before = np.append(0, np.cumsum(kept))
    buffers = [None, pa.py_buffer(np.append(before[at], before[-1]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(signs[kept]))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(at), buffers).dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)]


def feature_sets(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The sorted buckets of all texts, each once a text, and the bounds of each text's."""
    words, bounds = word_hashes(texts)
    shapes = shape_hashes(texts)
    of = np.repeat(np.arange(len(bounds) - 1, dtype=np.int64), np.diff(bounds))
    if len(words) > 1:
        shapes[1:][(words[1:] == words[:-1]) & (of[1:] == of[:-1])] = _SAME
    found = []
    for kind, (sequence, order) in enumerate(((words, WORD_ORDER), (shapes, SHAPE_ORDER))):
        for size in range(1, order + 1):
            runs = run_hashes(sequence, size)
            whole = of[: len(runs)] == of[size - 1 :][: len(runs)]
            hashed = mixed(runs[whole] + np.uint64(16 * kind + size)) & np.uint64(buckets - 1)
            found.append(of[: len(runs)][whole] * buckets + hashed.astype(np.int64))
    each = np.unique(np.concatenate(found))
    return (each % buckets).astype(np.int32), np.searchsorted(each, np.arange(len(bounds), dtype=np.int64) * buckets)


def log_ratios(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Logarithm of the ratio of each bucket's shares in class 1 and class 0; `counts` has a row for each class."""
    shares = counts + smoothing
    shares = shares / shares.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def unit_rows(flat: np.ndarray, bounds: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """The ratios at all n-grams, each text's at length one; a text without any, or with none but zeros, stays zero."""
    values = ratios[flat]
    squares = np.append(0.0, np.cumsum(values * values))
    norms = np.sqrt(np.maximum(squares[bounds[1:]] - squares[bounds[:-1]], 0))
    return values / np.repeat(np.where(norms > 1e-12, norms, 1), np.diff(bounds))


def fit_hinge(flat: np.ndarray, values: np.ndarray, bounds: np.ndarray, labels: np.ndarray, size: int, cost: float = COST, rounds: int = ROUNDS) -> np.ndarray:
    """Weights, the last of them the constant, that minimise half their squared length plus `cost` times the hinge losses.

    Dual coordinate descent: each row's multiplier in [0, cost] is set to its best value, given all others, in random order,
    until no multiplier could move by more than a thousandth or the rounds are over.
    """
    rng = np.random.default_rng(11)
    signs = np.where(labels == 1, 1.0, -1.0)
    weights, dual = np.zeros(size + 1), np.zeros(len(labels))
    rows = [(flat[a:b], values[a:b], float(values[a:b] @ values[a:b]) + 1.0) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            at, x, square = rows[i]
            slope = signs[i] * (weights[at] @ x + weights[-1]) - 1
            new = min(max(dual[i] - slope / square, 0.0), cost)
            step = new - dual[i]
            if step:
                dual[i] = new
                weights[at] += step * signs[i] * x
                weights[-1] += step * signs[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


def fit_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and constant of the logistic curve of least loss from margins to label 1, by Newton's steps."""
    good, bad = float((labels == 1).sum()), float((labels != 1).sum())
    aim = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.column_stack([margins, np.ones(len(margins))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (aim - p))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(beta[0]), 1e-3), float(beta[1])


def margins_of(flat: np.ndarray, bounds: np.ndarray, ratios: np.ndarray, weights: np.ndarray) -> np.ndarray:
    parts = np.append(0.0, np.cumsum(unit_rows(flat, bounds, ratios) * weights[flat]))
    return parts[bounds[1:]] - parts[bounds[:-1]] + weights[-1]


@dataclass(frozen=True)
class Model:
    """What scoring needs, of a size that does not depend on the data: log-count ratios, weights and the logistic curve.

    Without rows of both classes there are no ratios, and `base`, the share of class 1, is the score of every text.
    """

    base: float
    ratios: np.ndarray | None = None
    weights: np.ndarray | None = None
    slope: float = 1.0
    constant: float = 0.0

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.ratios is None:
            return np.full(len(texts), self.base)
        flat, bounds = feature_sets(texts, len(self.ratios))
        margins = margins_of(flat, bounds, self.ratios, self.weights)
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.constant, -35, 35)))


def held_out(id_col: str):
    """Rows that nothing is learned from: crc32 of the id as text has remainder 1 by 3. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, label_id: str) -> DataFrame:
    """(id, text, label, rank) of the rows to learn from; `rank` orders the rows of a class by a hash of the id."""
    one = labels.where(F.col(label_col).isin(0, 1)).select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("label")).where(~held_out("id"))
    agreed = one.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where(~held_out("id"))
    # Of labels and texts neither is of a bounded size, so both are sorted by id, for any input.
    return texts.join(agreed.hint("merge"), "id").select("text", "label", F.xxhash64(F.col("id").cast("string"), F.lit(11)).alias("rank"))


def class_counts(rows: DataFrame, ends: dict[int, int], buckets: int) -> DataFrame:
    """One pass over the rows to learn from.

    Rows with a `block` hold, for one task, in how many rows of either class each bucket of the block occurs; rows without
    hold the n-grams of a row whose rank is at most its class's end, which may be in the sample.
    """
    schema = T.StructType().add("block", "integer").add("task", "long").add("packed", "binary").add("rank", "long").add("label", "integer").add("features", "binary")
    block = min(BLOCK, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, seen = np.zeros((2, buckets), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in tokens.chunks(batch, "text"):
                flat, bounds = feature_sets(part.column("text"), buckets)
                labels, ranks = part.column("label").to_numpy(), part.column("rank").to_numpy()
                each = np.repeat(labels, np.diff(bounds))
                for c in (0, 1):
                    total[c] += np.bincount(flat[each == c], minlength=buckets)
                    seen[c] += int((labels == c).sum())
                chosen = [k for k in range(len(labels)) if ranks[k] <= ends.get(int(labels[k]), -(1 << 63))]
                if chosen:
                    none = pa.nulls(len(chosen), pa.int32())
                    packed = [flat[bounds[k] : bounds[k + 1]].tobytes() for k in chosen]
                    yield pa.RecordBatch.from_arrays([none, pa.nulls(len(chosen), pa.int64()), pa.nulls(len(chosen), pa.binary()), pa.array(ranks[chosen]), pa.array(labels[chosen], pa.int32()), pa.array(packed, pa.binary())], names=schema.names)
        if seen.any():
            task = TaskContext.get().partitionId()
            blocks = list(range(buckets // block))
            packed = [pack(total[:, b * block : (b + 1) * block]) for b in blocks]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays([pa.array([*blocks, -1], pa.int32()), pa.array([task] * (n + 1), pa.int64()), pa.array([*packed, pack(seen)], pa.binary()), pa.nulls(n + 1, pa.int64()), pa.nulls(n + 1, pa.int32()), pa.nulls(n + 1, pa.binary())], names=schema.names)

    return rows.mapInArrow(count, schema)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id", buckets: int = BUCKETS, fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES, cost: float = COST, rounds: int = ROUNDS) -> Model:
    """A model of `label_col` (0 or 1) from the rows that are not held out.

    Counts of classes are over all of them. The linear model is fitted to the `fit_rows` / 2 rows of least hash of each class,
    as far as `fit_features` n-grams go, and the curve is moved by how much rarer a class is in all rows than in the sample. Ids
    with two different labels, and null labels or ids, teach nothing; repeated rows teach as often as they occur.
    """
    rows = labelled_rows(docs, labels, id_col, text_col, label_col, label_id)
    half = max(1, fit_rows // 2)
    ids = labels.where(F.col(label_col).isin(0, 1)).select(F.col(label_id).alias("id"), F.col(label_col).alias("label")).where(~held_out("id"))
    ranked = ids.select("label", F.xxhash64(F.col("id").cast("string"), F.lit(11)).alias("rank"))
    ends = {}
    for c in (0, 1):  # two numbers
        ends[c] = ranked.where(F.col("label") == c).select("rank").orderBy("rank").limit(half).agg(F.max("rank")).first()[0]
    ends = {c: end for c, end in ends.items() if end is not None}
    passed = cut_packed(class_counts(rows, ends, buckets))
    blocks = {r["block"]: unpack(r["packed"], "int64") for r in tree_sum(passed.where("block IS NOT NULL"), "int64").collect()}  # as many as blocks
    seen = blocks.pop(-1, np.zeros(2, np.int64))
    base = float(seen[1] / seen.sum()) if seen.sum() else 0.5
    if not seen.all():
        release(passed)
        return Model(base)
    counts = np.concatenate([blocks[b].reshape(2, -1) for b in sorted(blocks)], axis=1)
    ratios = log_ratios(counts)
    sample = None
    for c in (0, 1):
        of = passed.where(F.col("block").isNull() & (F.col("label") == c)).select("rank", "label", "features").orderBy("rank", F.xxhash64("features")).limit(half)
        sample = of if sample is None else sample.unionByName(of)
    drawn_rows = sample.orderBy("rank", "label", F.xxhash64("features")).limit(2 * half)
    schema = T.StructType().add("weights", "binary").add("slope", "double").add("constant", "double")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, classes, used = [], [], 0
        for batch in batches:
            for label, packed in zip(batch.column("label").to_pylist(), batch.column("features").to_pylist(), strict=True):
                if used + len(packed) // 4 > fit_features and len(set(classes)) == 2:
                    continue
                sets.append(np.frombuffer(packed, np.int32))
                classes.append(label)
                used += len(sets[-1])
        if not sets:
            return
        flat, bounds, of = np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), np.array(classes)
        weights = fit_hinge(flat, unit_rows(flat, bounds, ratios), bounds, of, buckets, cost, rounds)
        slope, constant = fit_curve(margins_of(flat, bounds, ratios, weights), of)
        drawn = np.maximum([(of == 0).sum(), (of == 1).sum()], 1)
        constant += float(np.log(seen[1] / seen[0]) - np.log(drawn[1] / drawn[0]))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([slope]), pa.array([constant])], names=schema.names)

    found = drawn_rows.mapInArrow(fit, schema).first()  # the weights: as many as buckets
    release(passed)
    return Model(base, ratios, np.frombuffer(found["weights"], np.float64), found["slope"], found["constant"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, score, predicted.

    A null or empty text has no n-grams and gets the score of the constant alone. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_col, slim.schema["id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.chunks(batch, "text"):
                p = model.scores(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=schema.names)

    return slim.mapInArrow(judge, schema)
