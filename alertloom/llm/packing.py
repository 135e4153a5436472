"""Packing pieces of documents into sequences by patterns fitted with non-negative least squares.

The histogram of piece lengths is fitted by patterns of a few lengths that fill a sequence: lengths are grouped in bins, all
patterns of up to four bins that fill a sequence are listed, and repeat counts that reproduce the histogram are found by
non-negative least squares and rounded down. What the rounded patterns leave over is put, longest first, where it fits
best. All of this works on counts by length, so its cost and size depend on the sequence length only, never on the
number of documents. Spark makes the pieces and the histogram, numbers the pieces of each length, and gives every piece
the place that the plan holds for its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from alertloom.llm import tokens
from alertloom.session import cut_lineage, release

SEQUENCE = 4096
BINS = 64
PATTERN_PARTS = 4
#: Share of the pieces of each length kept out of the fit, to fill what the patterns leave open.
HELD_BACK = 0.1
#: Pieces of one length that are ranked in one task, on average, if all have that length; and parts that a length has at least.
RANKED = 50_000
RANK_PARTS = 256


def document_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: id, piece (from 0), start, length, ids_crc32, and with `with_ids` the ids.

    A null or empty text is the end token alone. Only documents over `size` tokens are cut. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind)]).add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    schema = schema.add("ids", T.ArrayType(T.IntegerType())) if with_ids else schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.give_back()  # what an earlier stage left in this worker
        for batch in batches:
            for part in tokens.chunks(batch, "text"):
                ids, bounds = tokens.encode_texts(part.column("text"), vocabulary, end_id)
                lengths = np.diff(bounds)
                count = -(-lengths // size)
                row = np.repeat(np.arange(len(lengths)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, lengths[row] - start)
                at = bounds[row] + start
                sums = [tokens.crc32(ids[a : a + n]) for a, n in zip(at, length, strict=True)]
                columns = [part.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(sums, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(tokens.gather(ids, at, length))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def bin_patterns(bins: int = BINS, parts: int = PATTERN_PARTS) -> list[tuple[int, ...]]:
    """All multisets of up to `parts` bins (largest first) whose upper ends fill a sequence."""
    found: list[tuple[int, ...]] = []

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(head)
        elif len(head) < parts:
            for b in range(min(left, head[-1] if head else left), 0, -1):
                extend((*head, b), left - b)

    extend((), bins)
    return found


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by the active-set method of Lawson and Hanson."""
    x, chosen = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)

    def fit() -> np.ndarray:
        out = np.zeros_like(x)
        if chosen.any():
            out[chosen] = np.linalg.lstsq(a[:, chosen], b, rcond=None)[0]
        return out

    for _ in range(3 * a.shape[0]):
        slope = np.where(chosen, -np.inf, a.T @ (b - a @ x))
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        chosen[best] = True
        trial = fit()
        while (low := chosen & (trial <= 0)).any():
            step = np.min(x[low] / np.maximum(x[low] - trial[low], 1e-300))
            x += step * (trial - x)
            chosen &= x > 1e-12
            trial = fit()
        x = np.where(chosen, trial, 0)
    return x


class Plan:
    """Groups of sequences with the same layout: a group is (how many, room left, runs of (length, times))."""

    def __init__(self, histogram: dict[int, int], size: int = SEQUENCE, bins: int = BINS) -> None:
        self.size = size
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.open: list[list[tuple[int, tuple]]] = [[] for _ in range(size + 1)]
        held = {n: c - int(c * (1 - HELD_BACK)) for n, c in self.left.items()}
        self.left = {n: c - held[n] for n, c in self.left.items() if c > held[n]}
        self.fit_patterns(bins)
        self.left = {n: self.left.get(n, 0) + c for n, c in held.items()}
        self.fill_rest()

    def fit_patterns(self, bins: int) -> None:
        width = -(-self.size // bins)
        runs: dict[int, list[int]] = {}
        for n in sorted(self.left, reverse=True):
            runs.setdefault(-(-n // width), []).append(n)
        patterns = [p for p in bin_patterns(bins) if all(b in runs for b in p)]
        if not patterns:
            return
        a = np.zeros((bins, len(patterns)))
        for k, p in enumerate(patterns):
            for b in p:
                a[b - 1, k] += 1
        wanted = np.array([sum(self.left[n] for n in runs.get(b, ())) for b in range(1, bins + 1)], dtype=float)
        for pattern, times in zip(patterns, np.floor(least_squares(a, wanted) + 1e-9).astype(int), strict=True):
            if times:
                self.lay(pattern, int(times), width)

    def lay(self, pattern: tuple[int, ...], times: int, width: int) -> None:
        """Turn up to `times` repeats of a bin pattern into layouts of actual lengths, as far as there are pieces.

        All parts but the last come from their bins, longest first; the last is the longest piece that still fits, at most
        two bins short of the room. Repeats that lack a part are not laid.
        """

        def longest(upto: int, from_: int) -> int:
            return next((n for n in range(upto, max(0, from_), -1) if self.left.get(n)), 0)

        for _ in range(64 * self.size):  # each turn uses up a length or the repeats
            layout: tuple = ()
            room = self.size
            need: dict[int, int] = {}
            for k, b in enumerate(pattern):
                last = k == len(pattern) - 1
                top = room if last and k else b * width
                n = longest(min(top, room), top - 2 * width if last and k else (b - 1) * width)
                while n and self.left[n] <= need.get(n, 0):  # all of this length are in the layout already
                    n = longest(n - 1, top - 2 * width if last and k else (b - 1) * width)
                if not n:
                    return
                need[n] = need.get(n, 0) + 1
                layout = self.add(layout, n, 1)
                room -= n
            count = min([times, *(self.left[n] // c for n, c in need.items())])
            for n, c in need.items():
                self.left[n] -= c * count
            self.put(count, layout)
            times -= count
            if not times:
                return

    @staticmethod
    def add(layout: tuple, n: int, times: int) -> tuple:
        if layout and layout[-1][0] == n:
            return (*layout[:-1], (n, layout[-1][1] + times))
        return (*layout, (n, times))

    def put(self, count: int, layout: tuple) -> None:
        self.open[self.size - sum(n * t for n, t in layout)].append((count, layout))

    def fill_rest(self) -> None:
        for n in sorted((n for n, c in self.left.items() if c), reverse=True):
            count = self.left[n]
            room = n
            while count:
                while room <= self.size and not self.open[room]:
                    room += 1
                if room > self.size:  # nothing has room: new sequences of this length alone
                    each = self.size // n
                    for sequences, times in ((count // each, each), (1, count % each)):
                        if sequences and times:
                            self.put(sequences, ((n, times),))
                    break
                many, layout = self.open[room].pop()
                times = min(room // n, max(1, count // many))
                taken = min(many, count // times)
                if taken < many:
                    self.open[room].append((many - taken, layout))
                self.open[room - times * n].append((taken, self.add(layout, n, times)))
                count -= taken * times
                room = n

    def slots(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first number, end number, sequence, offset, times): where the pieces of a length with these numbers go.

        The piece with number r goes to sequence + (r - first) // times, at offset + (r - first) % times * length.
        """
        out, at, sequence = [], {}, 0
        for groups in self.open:
            for count, layout in groups:
                offset = 0
                for n, times in layout:
                    first = at.get(n, 0)
                    at[n] = first + count * times
                    out.append((n, first, at[n], sequence, offset, times))
                    offset += n * times
                sequence += count
        return out


def pack(pieces: DataFrame, size: int = SEQUENCE, length_col: str = "length") -> DataFrame:
    """`pieces` with `sequence_id` and `offset`; every length is from 1 to `size`.

    Writes `pieces` once, with a number for each row: counting and ranking are two jobs and must read the same numbers,
    which a scan made anew does not promise. Sequences are gapless from offset 0 and never over `size`. An empty table
    gives an empty result. The plan has rows by length, not by piece, and is broadcast. Raises if a piece has no place.
    """
    spark = pieces.sparkSession
    stored = cut_lineage(pieces.withColumn("_row", F.monotonically_increasing_id()))
    wanted = stored.count()
    numbered = stored.withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(max(RANK_PARTS, -(-wanted // RANKED)))).cast("int"))
    counts = cut_lineage(numbered.groupBy(F.col(length_col).alias("_n"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("c")))
    histogram = {int(n): int(c) for n, c in counts.groupBy("_n").agg(F.sum("c")).collect()}  # at most `size` rows
    before = F.sum("c").over(Window.partitionBy("_n").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select("_n", "_p", F.coalesce(before, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(length_col, "_part").orderBy("_row"))
    ranked = numbered.withColumn("_place", place).join(firsts, (F.col(length_col) == F.col("_n")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_place") - 1)
    slots = spark.createDataFrame(Plan(histogram, size).slots(), "_len long, _lo long, _hi long, _seq long, _off long, _times long")
    met = ranked.join(F.broadcast(slots), (F.col(length_col) == F.col("_len")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    inner = F.col("_rank") - F.col("_lo")
    placed = cut_lineage(met.select(*pieces.columns, (F.col("_seq") + F.floor(inner / F.col("_times"))).alias("sequence_id"), (F.col("_off") + inner % F.col("_times") * F.col(length_col)).alias("offset")))
    found = placed.count()
    if found != wanted:
        raise RuntimeError(f"{wanted} pieces, but {found} of them placed")
    release(stored, counts)
    return placed


def pack_documents(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """The pieces of all documents with their places."""
    return pack(document_pieces(docs, vocabulary, **options), options.get("size", SEQUENCE))
