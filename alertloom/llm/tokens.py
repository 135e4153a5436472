"""Token ids of whole texts, batch by batch.

Both public vocabularies used here split text before merging, and never across the start of a run of white space: what
stands before a blank and what follows from it on are encoded apart. So a batch is cut at such places, every different
piece is encoded once with the tokenizers library, and ids are gathered for all pieces at once. Nor do they join a letter with
a sign after it. Cuts are only made where this holds for certain: before a space or line feed that follows an ASCII or
Latin-1 letter, digit or sign, and before one of the signs , . ; : ! ? that follows an ASCII letter.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Text bytes handled at once inside a task.
CHUNK_BYTES = 4 << 20
#: Pieces whose ids a worker remembers (about 150 bytes each); beyond that it starts anew.
REMEMBERED = 600_000
#: New pieces encoded in one string, a special token between them.
JOINED = 50


class PieceEncoder:
    """Ids of pieces, remembered between batches up to a fixed number of pieces."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        self.between_id = min(special)
        self.between = special[self.between_id].content
        self.forget()

    def forget(self) -> None:
        self.code: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def codes(self, pieces: list[bytes]) -> np.ndarray:
        """A number for each piece, valid until the next call; `first` and `size` say where its ids are in `flat`."""
        new = [p for p in pieces if p not in self.code]
        if len(self.code) + len(new) > REMEMBERED:
            self.forget()
            new = pieces
        for at in range(0, len(new), 4096):
            self.learn(new[at : at + 4096])
        return np.fromiter((self.code[p] for p in pieces), dtype=np.int64, count=len(pieces))

    def learn(self, pieces: list[bytes]) -> None:
        plain, rare = [], []
        for p in pieces:
            (rare if "<|" in (text := p.decode("utf-8")) else plain).append((p, text))
        joined = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)] + [[x] for x in rare]
        texts = [self.between.join(t for _, t in group) for group in joined]
        for group, got in zip(joined, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.asarray(got.ids, dtype=np.int32)
            stops = np.append(np.flatnonzero(ids == self.between_id), len(ids)) if len(group) > 1 else np.array([len(ids)])
            starts = np.append(0, stops[:-1] + 1)
            self.keep(ids, [p for p, _ in group], starts, stops)

    def keep(self, ids: np.ndarray, pieces: list[bytes], starts: np.ndarray, stops: np.ndarray) -> None:
        n, at = len(self.code), self.used
        while at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + len(pieces) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size))
        self.flat[at : at + len(ids)] = ids
        self.first[n : n + len(pieces)], self.size[n : n + len(pieces)] = at + starts, stops - starts
        self.used = at + len(ids)
        self.code.update(zip(pieces, range(n, n + len(pieces)), strict=True))


_LETTERS, _SIGNS = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1] = True
_SIGNS[[ord(c) for c in ",.;:!?"]] = True


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    return PieceEncoder(path)


def drop_encoders() -> None:
    """Give back the memory of this worker's encoders, in a stage that encodes nothing."""
    encoder.cache_clear()
    give_back()


def give_back() -> None:
    """Return memory that is free inside this worker; it may wait for its next task for long."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each starts, with the end of the last."""
    flat = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text and at the safe cuts inside it."""
    cut = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        blank = (data[1:] == 0x20) | (data[1:] == 0x0A)
        cut[1:] = blank & (data[:-1] > 0x20) & (data[:-1] < 0x7F) | _SIGNS[data[1:]] & _LETTERS[data[:-1]]
    if len(data) > 2:
        blank = (data[2:] == 0x20) | (data[2:] == 0x0A)
        cut[2:] |= blank & (data[1:-1] >= 0x80) & (data[:-2] == 0xC3)
    starts = offsets[:-1]
    cut[starts[starts < offsets[1:]]] = True
    return np.flatnonzero(cut)


def gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin at `first` and have these sizes, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total, dtype=np.int64) + np.repeat(first - (ends - sizes), sizes)]


def encode_texts(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by `end_id`, and the bounds of each text's ids; a null text is empty."""
    data, offsets = text_bytes(texts)
    starts = piece_starts(data, offsets)
    buffers = [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    known = encoder(path)
    codes = known.codes(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
    counts = known.size[codes]
    ids = gather(known.flat, known.first[codes], counts)
    before = np.append(0, np.cumsum(counts))
    text_first = before[np.searchsorted(starts, offsets)]  # ids before each text, and in all
    n = len(offsets) - 1
    bounds = text_first + np.arange(n + 1)
    out = np.full(len(ids) + n, end_id, dtype=np.int32)
    keep = np.ones(len(out), dtype=bool)
    keep[bounds[1:] - 1] = False
    out[keep] = ids
    return out, bounds


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most CHUNK_BYTES of text, or one row."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < len(batch):
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
