"""Terms found in texts by one pass over their bytes.

All terms go into one automaton: a tree of their bytes in which every state also knows where to go when the next byte
continues no term. It is stored as arrays, a row of next states per state, with a column for each byte that occurs in any
term and one for all others. Texts are cut into lanes of equal length that overlap by the longest term, and a step takes all
lanes of a batch one byte further at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one automaton's table, and of all that are sent to the tasks.
TABLE_BYTES = 24 << 20
SENT_BYTES = 96 << 20
#: Bytes of text that a lane adds to its overlap, at least, and text bytes run at once.
LANE = 1024
RUN_BYTES = 2 << 20


class Automaton:
    """States of a list of different, non-empty terms. State 0 is the start; `shorter` leads to the longest term that ends a state."""

    def __init__(self, terms: Sequence[bytes]) -> None:
        self.longest = max(map(len, terms), default=0)
        used = sorted(set().union(*terms)) if terms else []
        self.column = np.zeros(256, np.uint8 if len(used) < 256 else np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        column = self.column.tolist()
        children: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for number, term in enumerate(terms):
            at = 0
            for byte in term:
                c = column[byte]
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = children[at][c]
            ends[at] = number
        self.ends = np.array(ends, np.int64)
        self.next = np.zeros((len(children), len(used) + 1), np.int32)
        self.shorter = np.zeros(len(children), np.int32)
        fall = np.zeros(len(children), np.int32)
        level = [0]
        while level:
            below = []
            for state in level:
                if state:
                    self.next[state] = self.next[fall[state]]
                    back = int(fall[state])
                    self.shorter[state] = back if ends[back] >= 0 else self.shorter[back]
                for c, child in children[state].items():
                    fall[child] = self.next[state, c] if state else 0
                    self.next[state, c] = child
                    below.append(child)
            level = below
        self.found = (self.ends >= 0) | (self.shorter > 0)

    def __len__(self) -> int:
        return self.next.size * self.next.itemsize

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) numbers, each pair once: which terms the texts, bytes from one offset to the next, hold."""
        if not self.longest or not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lane = max(LANE, self.longest)
        sizes = np.diff(offsets)
        lanes = -(-sizes // lane)
        of = np.repeat(np.arange(len(sizes)), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = offsets[:-1][of] + nth * lane
        stop = np.minimum(start + lane + self.longest - 1, offsets[1:][of])
        order = np.argsort(start - stop, kind="stable")  # the longest lanes first
        of, start, stop = of[order], start[order], stop[order]
        columns = self.column[data]
        states = np.zeros(len(start), np.int64)
        flat, width = self.next.ravel(), self.next.shape[1]
        alive, hits = len(start), []
        lengths = stop - start
        for step in range(int(lengths[0])):
            while alive and lengths[alive - 1] <= step:
                alive -= 1
            now = flat[states[:alive] * width + columns[start[:alive] + step]]
            states[:alive] = now
            if (met := np.flatnonzero(self.found[now])).size:
                hits.append(of[met] * len(self.ends) + now[met])
                if len(hits) > 256:
                    hits = [np.unique(np.concatenate(hits))]
        return self.terms_at(np.unique(np.concatenate(hits))) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def terms_at(self, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts, states = hits // len(self.ends), hits % len(self.ends)
        pairs = []
        while len(states):  # as often as the most terms that end one another
            term = self.ends[states]
            pairs.append(np.column_stack([texts, term])[term >= 0])
            states = self.shorter[states]
            texts, states = texts[states > 0], states[states > 0]
        each = np.unique(np.concatenate(pairs), axis=0)
        return each[:, 0], each[:, 1]


def cut_terms(terms: Sequence[bytes], table_bytes: int) -> list[list[int]]:
    """Ranges of sorted terms whose tables have at most so many bytes each, by one state per byte of a term; a longer term is alone."""
    width = 4 * (len(set().union(*terms)) + 1) if terms else 4
    ranges: list[list[int]] = []
    size = 0
    for k in sorted(range(len(terms)), key=lambda k: terms[k]):
        if not ranges or size + len(terms[k]) * width > table_bytes:
            ranges.append([])
            size = 0
        ranges[-1].append(k)
        size += len(terms[k]) * width
    return ranges


def fits(terms: DataFrame, term: str) -> bool:
    """Whether automata of all terms may be sent to the tasks: a state per byte, and at most 256 columns of 4 bytes."""
    n = terms.agg(F.sum(F.octet_length(F.lower(term)))).first()[0] or 0
    return n * 256 * 4 <= SENT_BYTES * 4  # most texts use less than a quarter of all bytes; checked again once built


def scan(texts: DataFrame, text_id: str, text: str, terms: DataFrame, term_id: str, term: str) -> DataFrame | None:
    """(text_id, term_id) where the lowercased term is a substring of the lowercased text; None if the automata are too large to send.

    One row for each row of either side that meet. A null or empty term is in no text.
    """
    rows = terms.select(F.col(term_id).alias("id"), F.lower(term).cast("binary").alias("t")).where(F.octet_length("t") > 0).toArrow()
    coded = rows.column("t").combine_chunks().dictionary_encode()
    each = coded.dictionary.to_pylist()
    built = []
    for numbers in cut_terms(each, TABLE_BYTES):
        built.append((np.array(numbers, np.int64), Automaton([each[k] for k in numbers])))
        if sum(len(a) for _, a in built) > SENT_BYTES:
            return None
    order = np.argsort(coded.indices.to_numpy(zero_copy_only=False), kind="stable")
    first = np.searchsorted(np.sort(coded.indices.to_numpy(zero_copy_only=False)), np.arange(len(each) + 1))
    sent = texts.sparkSession.sparkContext.broadcast((built, rows.column("id").combine_chunks().take(pa.array(order)), first))
    schema = T.StructType([T.StructField(text_id, texts.schema[text_id].dataType), T.StructField(term_id, terms.schema[term_id].dataType)])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata, ids, bounds = sent.value
        for batch in batches:
            flat = batch.column("t").cast(pa.large_binary()).fill_null(b"")
            offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
            data = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] else np.zeros(0, np.uint8)
            at = 0
            while at < len(flat):
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, side="right")) - 1)
                for numbers, automaton in automata:
                    which, met = automaton.run(data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at])
                    met = numbers[met]
                    times = bounds[met + 1] - bounds[met]
                    place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(bounds[met], times)
                    if len(place):
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(which, times) + at)), ids.take(pa.array(place))], names=schema.names)
                at = upto

    return texts.select(F.col(text_id).alias("id"), F.lower(text).cast("binary").alias("t")).mapInArrow(look, schema)
