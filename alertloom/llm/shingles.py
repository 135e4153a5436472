"""Hashes of words and of runs of words, for a batch of whole texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from alertloom.llm.tokens import text_bytes

#: Odd multipliers by place in a run, and for runs shorter than the window.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z in lower case, and the bounds of each text's words; a null text has none."""
    data, offsets = text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    word = (data != 0x20) & ((data < 9) | (data > 13))
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = word[first]
    at = np.flatnonzero(starts)
    bounds = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), bounds
    kept = np.append(0, np.cumsum(word))
    buffers = [None, pa.py_buffer(np.append(kept[at], kept[-1]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[word]))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(at), buffers).dictionary_encode()
    each = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return each[coded.indices.to_numpy(zero_copy_only=False)], bounds


def run_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words in a sequence of word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        total += mixed(words[k : k + n] * _PLACES[k])
        total *= _PLACES[(k + 3) % len(_PLACES)]
    return mixed(total)


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text; a text of fewer words has its whole sequence as one shingle."""
    words, bounds = word_hashes(texts)
    runs = run_hashes(words, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        n = b - a
        out.append(np.unique(runs[a : b - size + 1]) if n >= size else run_hashes(words[a:b], n) if n else np.zeros(0, np.uint64))
    return out
