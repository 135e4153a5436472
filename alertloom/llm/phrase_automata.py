"""Weighted acyclic automata of n-grams, as arrays.

A table of n-grams has one row per path: sorted words, the end sign (0) standing before all of them, and a weight. As every word
of a text starts one path, padded with end signs where its piece of text ends, the weight of any phrase is the sum over the
range of paths that begin with it. `pack` builds the automaton of a sorted table from its last words up: states with equal
transitions become one. `unpack` walks all paths of it again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from alertloom.llm.shingles import mixed
from alertloom.llm.tokens import gather, text_bytes

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?"]] = True
_ENDS[0x0A:0x0E] = True


@dataclass(frozen=True)
class Paths:
    """Sorted paths: `words` in byte order, `grams` one column per place (0: end, else a word's number plus one), weights."""

    words: pa.Array
    grams: list[np.ndarray]
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.weights)

    def key(self, row: int) -> list[bytes]:
        return [self.words[int(g[row]) - 1].as_py() if g[row] else b"" for g in self.grams]


def order_keys(grams: list[np.ndarray], size: int) -> np.ndarray:
    """One integer per path, in the order of paths; `size` is above all numbers of words."""
    bits = max(1, int(size).bit_length())
    key, used = grams[0].astype(np.int64), bits
    for column in grams[1:]:
        if used + bits > 62:  # ranks take less room
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            used = max(1, len(key).bit_length())
        key = key << bits | column
        used += bits
    return key


def collapse(words: pa.Array, grams: list[np.ndarray], weights: np.ndarray) -> Paths:
    """Sorted paths, equal ones added up."""
    if not len(weights):
        return Paths(words, [g.astype(np.int32) for g in grams], weights.astype(np.int64))
    key = order_keys(grams, len(words) + 1)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return Paths(words, [g[order[first]].astype(np.int32) for g in grams], np.add.reduceat(weights[order], first))


def in_byte_order(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different words, sorted, and each row's number among them."""
    coded = column.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy(zero_copy_only=False)]


def text_paths(texts: pa.Array, langs: list[str], order: int) -> dict[str, Paths]:
    """The paths of all texts of each language: from every word to the end of its piece, `order` words at most.

    A-Z count as a-z. Pieces end at the signs . , ; : ! ? and at line breaks; words are separated by spaces and tabs.
    """
    data, offsets = text_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint8)
    breaks = _ENDS[data]
    word = ~breaks & (data != 0x20) & (data != 0x09)
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[begins] = word[begins]
    at = np.flatnonzero(first)
    if not len(at):
        return {}
    breaks[begins] = True  # texts are pieces of their own
    piece = np.cumsum(breaks, dtype=np.int32)[at]
    upto = np.cumsum(word, dtype=np.int32)  # a text has less than 2^31 bytes
    buffers = [None, pa.py_buffer(np.append(upto[at] - 1, upto[-1]).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[word]))]
    words, number = in_byte_order(pa.Array.from_buffers(pa.large_binary(), len(at), buffers))
    number += 1
    grams = [number]
    for by in range(1, order):
        column = np.zeros(len(at), np.int64)
        same = piece[by:] == piece[:-by]
        column[:-by][same] = number[by:][same]
        grams.append(column)
    names, code = np.unique(np.array(langs, dtype=object), return_inverse=True)
    of = code[np.searchsorted(offsets, at, side="right") - 1]
    out = {}
    for k, name in enumerate(names):
        rows = of == k
        if rows.any():
            found = collapse(words, [g[rows] for g in grams], np.ones(int(rows.sum()), np.int64))
            out[str(name)] = part(found, 0, len(found)) if len(names) > 1 else found
    return out


def part(paths: Paths, a: int, b: int) -> Paths:
    """Paths a to b, with their own words only."""
    grams = [g[a:b] for g in paths.grams]
    used = np.zeros(len(paths.words) + 1, dtype=bool)
    for g in grams:
        used[g] = True
    used[0] = False
    kept = np.flatnonzero(used)
    number = np.zeros(len(used), np.int32)
    number[kept] = np.arange(1, len(kept) + 1)
    return Paths(paths.words.take(pa.array(kept - 1)), [number[g] for g in grams], paths.weights[a:b])


def union(many: list[Paths]) -> Paths:
    """All paths of several tables, weights of equal ones added up."""
    if len(many) == 1:
        return many[0]
    words, number = in_byte_order(pa.concat_arrays([p.words.cast(pa.large_binary()) for p in many]))
    firsts = np.cumsum([0, *(len(p.words) for p in many)])
    grams = []
    for place in range(len(many[0].grams)):
        mapped = []
        for p, at in zip(many, firsts, strict=False):
            own = np.append(0, number[at : at + len(p.words)] + 1)
            mapped.append(own[p.grams[place]])
        grams.append(np.concatenate(mapped))
    return collapse(words, grams, np.concatenate([p.weights for p in many]))


def cut_points(paths: Paths, bounds: list[list[bytes]]) -> list[int]:
    """For each bound, a path, the first row that is not before it."""
    if not len(paths) or not bounds:
        return [0] * len(bounds)
    words = paths.words.to_pylist()
    from bisect import bisect_left

    out = []
    for bound in bounds:
        a, b = 0, len(paths)
        for column, word in zip(paths.grams, bound, strict=True):
            known = bisect_left(words, word) if word else -1
            wanted = known + 1
            rows = column[a:b]
            low = a + int(np.searchsorted(rows, wanted, side="left"))
            if word and not (known < len(words) and words[known] == word):
                a = b = low  # nothing begins so
                break
            a, b = low, a + int(np.searchsorted(rows, wanted, side="right"))
            if a == b:
                break
        out.append(a)
    return out


def shared_states(labels: np.ndarray, values: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each state the number of the one that stands for it, and which states those are.

    States run from one of `firsts` to the next. Those with equal hashes of their transitions are compared, transition by
    transition, with the first of them, and one that differs stays on its own.
    """
    bounds = np.append(firsts, len(labels))
    sizes = np.diff(bounds)
    each = mixed(mixed(labels.astype(np.uint64) + np.uint64(1)) + values.astype(np.uint64))
    hashes = mixed(np.add.reduceat(each, firsts) + sizes.astype(np.uint64))
    order = np.argsort(hashes, kind="stable")
    new = np.append(True, hashes[order][1:] != hashes[order][:-1])
    like = np.empty(len(order), np.int64)
    like[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    fits = sizes == sizes[like]
    like[~fits] = np.flatnonzero(~fits)
    theirs = np.arange(len(labels)) - np.repeat(firsts - firsts[like], sizes)
    differs = (labels != labels[theirs]) | (values != values[theirs])
    wrong = np.logical_or.reduceat(differs, firsts)
    like[wrong] = np.flatnonzero(wrong)
    kept, number = np.unique(like, return_inverse=True)
    return number, kept


def pack(paths: Paths) -> bytes:
    """The automaton of sorted paths, packed: words, then the states of each place from the first."""
    levels = []
    values = paths.weights
    starts = np.arange(len(paths))
    for place in range(len(paths.grams) - 1, -1, -1):
        labels = paths.grams[place][starts].astype(np.int64)
        if place:
            changed = np.zeros(len(starts), dtype=bool)
            changed[:1] = True
            for g in paths.grams[:place]:
                column = g[starts]
                changed[1:] |= column[1:] != column[:-1]
            firsts = np.flatnonzero(changed)
        else:
            firsts = np.zeros(1, np.int64)
        number, kept = shared_states(labels, values, firsts)
        sizes = np.diff(np.append(firsts, len(labels)))[kept]
        rows = gather(np.arange(len(labels)), firsts[kept], sizes)
        levels.append((sizes, labels[rows], values[rows]))
        values, starts = number, starts[firsts]
    lengths = pc.binary_length(paths.words).to_numpy().astype(np.int64)
    arrays = [lengths, *(a for level in reversed(levels) for a in level)]
    head = np.array([len(a) for a in arrays], np.int64)
    narrow = [a.astype(np.int32 if not len(a) or a.max() < 1 << 31 else np.int64) for a in arrays]
    wide = np.array([a.itemsize for a in narrow], np.int64)
    body = b"".join([np.array([len(arrays)], np.int64).tobytes(), head.tobytes(), wide.tobytes(), *(a.tobytes() for a in narrow), b"".join(paths.words.to_pylist())])
    return len(body).to_bytes(8, "little") + pa.Codec("zstd").compress(body, asbytes=True)


def unpack(packed: bytes) -> Paths:
    """All paths of a packed automaton, in order."""
    body = pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    count = int(np.frombuffer(body, np.int64, 1)[0])
    head = np.frombuffer(body, np.int64, count, 8)
    wide = np.frombuffer(body, np.int64, count, 8 + 8 * count)
    at, arrays = 8 + 16 * count, []
    for size, width in zip(head.tolist(), wide.tolist(), strict=True):
        arrays.append(np.frombuffer(body, np.int32 if width == 4 else np.int64, size, at))
        at += size * width
    lengths, levels = arrays[0], [arrays[k : k + 3] for k in range(1, count, 3)]
    words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.append(0, np.cumsum(lengths)).astype(np.int64)), pa.py_buffer(body[at:])])
    grams: list[np.ndarray] = []
    states = np.zeros(1, np.int64)
    for sizes, labels, values in levels:
        sizes = sizes.astype(np.int64)
        first = np.cumsum(sizes) - sizes
        times = sizes[states]
        rows = gather(np.arange(len(labels)), first[states], times)
        grams = [np.repeat(g, times) for g in grams] + [labels[rows].astype(np.int32)]
        states = values[rows].astype(np.int64)
    return Paths(words, grams, states)


def phrase_weights(paths: Paths, least: int) -> tuple[list[bytes], list[int], list[int]]:
    """Phrases of weight `least` or more, their numbers of words and weights; also those that the first and the last path begin with.

    Other phrases that begin a path are wholly inside, so what is below `least` here is so everywhere.
    """
    phrases: list[bytes] = []
    sizes: list[int] = []
    weights: list[int] = []
    if not len(paths):
        return phrases, sizes, weights
    changed = np.zeros(len(paths), dtype=bool)
    changed[0] = True
    for place, g in enumerate(paths.grams):
        changed[1:] |= g[1:] != g[:-1]
        firsts = np.flatnonzero(changed)
        total = np.add.reduceat(paths.weights, firsts)
        wanted = total >= least
        wanted[[0, -1]] = True
        wanted &= g[firsts] > 0
        rows = firsts[wanted]
        each = [paths.words.take(pa.array(c[rows] - 1)).to_pylist() for c in paths.grams[: place + 1]]
        phrases += [b" ".join(words) for words in zip(*each, strict=True)]
        sizes += [place + 1] * len(rows)
        weights += total[wanted].tolist()
    return phrases, sizes, weights
