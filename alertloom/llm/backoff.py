"""Language-model scores by stupid backoff, from n-gram count tables partitioned by hash.

A word after others scores c(n-gram) / c(its beginning), where the n-gram is the word with up to `order` - 1 words before it in the
text; an n-gram that does not occur is cut by its first word, at 0.4 times the score. A word alone scores c(word) / N. The score
of a document is the sum of the logarithms.

Texts are dealt into chunks by a hash of id and text. Each chunk sends its different n-grams of all lengths, sorted by hash, once,
to the count tables, each of which holds a range of the hashes. A table adds up what it gets and answers every chunk with the
counts, in the order they were asked for. The answers meet their chunk, which scores its texts whole. So an n-gram travels once
per chunk however often it occurs there, an answer takes a byte or less for each, texts are shuffled once, and no word or
n-gram gathers rows in one place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.llm import tokens
from alertloom.llm.partials import pack, unpack
from alertloom.llm.shingles import mixed, run_hashes, word_hashes
from alertloom.session import cut_lineage

BACKOFF = 0.4
ORDER = 3
#: N-grams are known by a hash of so many bits more than it takes to number all of them, so that one in a million, however many
#: there are, shares its hash with another; and of so many at least.
SPARE_BITS = 20
LEAST_BITS = 48
#: Text bytes of a chunk, and of the texts whose n-grams of one length one table gets, on average.
CHUNK_BYTES = 4 << 20
TABLE_BYTES = 5 << 20


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of all of them, compressed."""
    steps = np.diff(values.astype("<u8"), prepend=np.zeros(1, "<u8"))
    return pack(steps.view(np.uint8).reshape(-1, 8).T)


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes = unpack(packed, "uint8").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Counts, most of them small, in as few bytes as the largest needs, compressed."""
    kind = np.min_scalar_type(int(values.max())) if len(values) else np.dtype("uint8")
    return kind.itemsize.to_bytes(1, "little") + pack(values.astype(kind))


def unpack_counts(packed: bytes) -> np.ndarray:
    return unpack(packed[1:], f"uint{8 * packed[0]}").astype(np.int64)


def hash_bits(text_bytes: int, order: int) -> int:
    """Bits of an n-gram's hash for a corpus of so many bytes, with a word in every six or so."""
    return min(63, max(LEAST_BITS, SPARE_BITS + (order * text_bytes // 6).bit_length()))


def gram_hashes(words: np.ndarray, bounds: np.ndarray, order: int, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to `order`: hashes of the n-grams inside texts, and where each ends."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = []
    for size in range(1, order + 1):
        hashes = mixed(run_hashes(words, size) + np.uint64(size)) >> np.uint64(64 - bits)
        inside = np.flatnonzero(of[: len(hashes)] == of[size - 1 :][: len(hashes)])
        out.append((hashes[inside], inside + size - 1))
    return out


def different_grams(texts: pa.Array, order: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, sorted, and how often each occurs."""
    words, bounds = word_hashes(texts)
    return np.unique(np.concatenate([h for h, _ in gram_hashes(words, bounds, order, bits)]), return_counts=True)


def score_texts(texts: pa.Array, order: int, bits: int, grams: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Per text: words, score by all counts, score by the counts of other texts, words that backed off in the latter, and how many
    words either score took alone; their logarithms lack that of the number of all words.

    `grams` are the different n-grams of the texts, sorted, and `counts` those over the whole corpus.
    """
    words, bounds = word_hashes(texts)
    n = len(words)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    everywhere, elsewhere = np.zeros((order, n), np.int64), np.zeros((order, n), np.int64)
    for size, (hashes, ends) in enumerate(gram_hashes(words, bounds, order, bits), 1):
        if not len(hashes):
            continue
        number = np.searchsorted(grams, hashes)
        everywhere[size - 1, ends] = counts[number]
        _, at, times = np.unique(of[ends] * len(grams) + number, return_inverse=True, return_counts=True)
        elsewhere[size - 1, ends] = counts[number] - times[at]
    elsewhere[0] = everywhere[0]  # a word alone counts wherever it occurs
    scores, alone = np.zeros((2, n)), np.zeros((2, n), bool)
    steps = np.zeros(n, np.int64)
    left = np.ones((2, n), bool)
    for size in range(order, 0, -1):
        exists = everywhere[size - 1] > 0  # the text has so many words up to here
        beginning = np.append(0, everywhere[size - 2][:-1]) if size > 1 else np.ones(n, np.int64)
        for k, found in enumerate((everywhere, elsewhere)):
            hit = left[k] & exists & (found[size - 1] > 0)
            scores[k, hit] = np.log(found[size - 1][hit] / beginning[hit])
            left[k] &= ~hit
            if size == 1:
                alone[k] = hit
        steps += left[1] & exists
    scores[1] += steps * np.log(BACKOFF)
    sums = [np.append(0, np.cumsum(x)) for x in (*scores, steps > 0, *alone)]
    return [np.diff(bounds), *(x[bounds[1:]] - x[bounds[:-1]] for x in sums)]


def counted(dealt: DataFrame, order: int, bits: int, tables: int) -> DataFrame:
    """(chunk, part, counts): for each chunk, the counts over all chunks of its n-grams, in their order, a piece from every table."""
    asked = T.StructType().add("part", "integer").add("chunk", "long").add("grams", "binary").add("times", "binary")
    answered = T.StructType().add("chunk", "long").add("part", "integer").add("counts", "binary")
    bounds = np.array([(k << bits) // tables for k in range(tables + 1)], np.uint64)

    def ask(chunk: pa.Table) -> pa.Table:
        each, times = different_grams(chunk.column("text").combine_chunks(), order, bits)
        at = np.searchsorted(each, bounds).tolist()
        rows = [(p, a, b) for p, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([chunk.column("chunk")[0].as_py()] * len(rows), pa.int64())]
        columns += [pa.array([f(x[a:b]) for _, a, b in rows], pa.binary()) for f, x in ((pack_sorted, each), (pack_counts, times))]
        tokens.give_back()
        return pa.Table.from_arrays(columns, names=asked.names)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks_of, grams, times = [], [], []
        for batch in batches:
            chunks_of += batch.column("chunk").to_pylist()
            grams += [unpack_sorted(x.as_py()) for x in batch.column("grams")]
            times += [unpack_counts(x.as_py()).astype(np.int32) for x in batch.column("times")]
        ends = np.cumsum([len(g) for g in grams])[:-1]
        flat = np.concatenate(grams)
        del grams
        order_of = np.argsort(flat, kind="stable")
        flat = flat[order_of]
        new = np.append(True, flat[1:] != flat[:-1])
        del flat
        sums = np.add.reduceat(np.concatenate(times)[order_of], np.flatnonzero(new), dtype=np.int64)
        counts = np.empty(len(order_of), np.int64)
        counts[order_of] = sums[np.cumsum(new) - 1]
        del order_of, new
        pieces = np.split(counts, ends)
        for first in range(0, len(pieces), 256):
            some = pieces[first : first + 256]
            yield pa.RecordBatch.from_arrays([pa.array(chunks_of[first : first + len(some)], pa.int64()), pa.array([key[0].as_py()] * len(some), pa.int32()), pa.array([pack_counts(x) for x in some], pa.binary())], names=answered.names)
        tokens.give_back()

    return dealt.groupBy("chunk").applyInArrow(ask, asked).groupBy("part").applyInArrow(add, answered)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of `docs`: id, `n_words`, `log_score`, `mean_log_score`, `log_score_others` and `n_backoff`.

    Counts are over all texts. `log_score` uses them as they are, so no n-gram of a text is unknown. For `log_score_others`, n-grams
    of two and more words count only where they occur in other rows; `n_backoff` words of the text then lack their longest
    n-gram. A null, empty or blank text has no words, score 0 and no mean. Ids may be of any type, null, or repeated: each row is
    scored by itself, and rows equal in both id and text are in one chunk. N-grams are known by their hash (SPARE_BITS).
    Other columns are not read.
    """
    if order < 1:
        raise ValueError("the order is at least one")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = hash_bits(size, order)
    chunks = max(1, -(-size // CHUNK_BYTES))
    tables = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-order * size // table_bytes))
    dealt = slim.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks))).repartition(chunks, "chunk")
    schema = T.StructType([T.StructField(id_col, slim.schema["id"].dataType)])
    schema = schema.add("n_words", "long").add("whole", "double").add("others", "double").add("n_backoff", "long").add("alone", "long").add("alone_others", "long")

    def finish(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        texts = chunk.column("text").combine_chunks()
        by_part = sorted(zip(answers.column("part").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        counts = np.concatenate([np.zeros(0, np.int64), *(unpack_counts(c) for _, c in by_part)])
        n, whole, others, *rest = score_texts(texts, order, bits, different_grams(texts, order, bits)[0], counts)
        tokens.give_back()
        return pa.Table.from_arrays([chunk.column("id"), pa.array(n.astype(np.int64)), pa.array(whole), pa.array(others), *(pa.array(x.astype(np.int64)) for x in rest)], names=schema.names)

    answers = counted(dealt, order, bits, tables)
    out = cut_lineage(dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, schema))
    total = F.lit(math.log(out.agg(F.sum("n_words")).first()[0] or 1))
    less = lambda c, alone: F.col(c) - F.col(alone) * total
    log_score = less("whole", "alone")
    return out.select(id_col, "n_words", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("mean_log_score"), less("others", "alone_others").alias("log_score_others"), "n_backoff")
