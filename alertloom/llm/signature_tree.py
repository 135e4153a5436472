"""Pairs of similar sets by signature trees.

Sets are leaves, sorted so that similar ones lie together; each node above holds the OR of its bitmaps, the range of its
set sizes and the most hash places shared within one set. Two nodes are traversed together and given up as soon as the
greatest overlap any two of their sets can have is too small. What is left at the leaves is compared exactly. As only
connected groups are wanted, node pairs whose sets are already in one group are passed over.
"""

from __future__ import annotations

import numpy as np

LEAF_BLOCK = 32
FAN_OUT = 4
#: Similarity as a fraction: two sets are linked when OVER * |intersection| >= UNDER * |union|.
OVER, UNDER = 100, 80


class SignatureTree:
    def __init__(self, sets: list[np.ndarray], bits: int = 1024) -> None:
        """`sets` are sorted arrays of 64-bit hashes, none empty; `order` says which set each leaf holds."""
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.order = np.lexsort((np.array([int(s[0]) for s in sets], dtype=np.uint64), sizes)) if sets else np.zeros(0, np.int64)
        self.sets = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        self.bitmaps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for k, s in enumerate(self.sets):
            place = s % np.uint64(bits)
            np.bitwise_or.at(self.bitmaps[k], (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        self.surplus = self.sizes - np.bitwise_count(self.bitmaps).sum(axis=1).astype(np.int64)
        self.levels: list[dict] = []
        bounds = np.append(np.arange(0, len(sets), LEAF_BLOCK), len(sets)).astype(np.int64)
        while len(bounds) > 1:
            starts, ends = bounds[:-1], bounds[1:]
            self.levels.append({
                "starts": starts, "ends": ends, "bitmaps": np.bitwise_or.reduceat(self.bitmaps, starts, axis=0), "surplus": np.maximum.reduceat(self.surplus, starts),
                "least": np.minimum.reduceat(self.sizes, starts), "most": np.maximum.reduceat(self.sizes, starts),
            })
            if len(starts) == 1:
                break
            bounds = np.append(bounds[:-1][::FAN_OUT], bounds[-1])

    def possible(self, level: int, i: int, j: int) -> bool:
        """Whether any set below node i can be linked with any below node j."""
        x = self.levels[level]
        least_i, least_j, most_i, most_j = x["least"][i], x["least"][j], x["most"][i], x["most"][j]
        if OVER * most_i < UNDER * least_j or OVER * most_j < UNDER * least_i:
            return False
        overlap = int(np.bitwise_count(x["bitmaps"][i] & x["bitmaps"][j]).sum()) + int(min(x["surplus"][i], x["surplus"][j]))
        return (OVER + UNDER) * overlap >= UNDER * (least_i + least_j)

    def groups(self) -> np.ndarray:
        """A group number for each set, in the order given; sets connected by links share one."""
        self.group = np.arange(len(self.sets))
        self.members = {i: [i] for i in range(len(self.sets))}
        if self.levels:
            self.traverse()
        out = np.empty(len(self.sets), dtype=np.int64)
        out[self.order] = self.group
        return out

    def traverse(self) -> None:
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            x = self.levels[level]
            a, b = slice(x["starts"][i], x["ends"][i]), slice(x["starts"][j], x["ends"][j])
            one = self.group[a.start]
            if (self.group[a] == one).all() and (self.group[b] == one).all() or not self.possible(level, i, j):
                continue
            if level == 0:
                self.compare(a, b)
                continue
            below = len(self.levels[level - 1]["starts"])
            rows = range(i * FAN_OUT, min((i + 1) * FAN_OUT, below))
            columns = range(j * FAN_OUT, min((j + 1) * FAN_OUT, below))
            pairs = [(level - 1, p, q) for p in rows for q in columns if p <= q or i != j]
            stack += sorted(pairs, key=lambda t: abs(t[1] - t[2]), reverse=True)  # nearest first

    def compare(self, a: slice, b: slice) -> None:
        common = np.bitwise_count(self.bitmaps[a][:, None, :] & self.bitmaps[b][None, :, :]).sum(axis=2, dtype=np.int64)
        overlap = common + np.minimum(self.surplus[a][:, None], self.surplus[b][None, :])
        total = self.sizes[a][:, None] + self.sizes[b][None, :]
        hopeful = (OVER + UNDER) * np.minimum(overlap, np.minimum(self.sizes[a][:, None], self.sizes[b][None, :])) >= UNDER * total
        for p, q in np.argwhere(hopeful & (self.group[a][:, None] != self.group[b][None, :])):
            x, y = a.start + int(p), b.start + int(q)
            if self.group[x] != self.group[y] and self.linked(x, y):
                self.unite(x, y)

    def linked(self, x: int, y: int) -> bool:
        shared = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
        return OVER * shared >= UNDER * (int(self.sizes[x]) + int(self.sizes[y]) - shared)

    def unite(self, x: int, y: int) -> None:
        into, from_ = sorted((int(self.group[x]), int(self.group[y])), key=lambda g: -len(self.members[g]))
        moved = self.members.pop(from_)
        self.group[moved] = into
        self.members[into] += moved
