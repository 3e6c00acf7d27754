"""Similarity join of a bounded set of records by signature trees.

A record is a set of numbers.  Its signature is a bitmap of hashed members; a
node of the tree holds the OR of its records' bitmaps, their range of sizes and
the most members that any of them loses to bits in common.  Two nodes are
traversed together, and a pair is dropped as soon as no two records below it
can have the overlap that the threshold asks of them.
"""

from __future__ import annotations

import numpy as np

LEAF = 32
FAN = 8


class UnionFind:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps (rows of 64-bit words) and the members that each set loses to bits in common."""
    largest = max(map(len, sets))
    bits = 1024
    while bits < 16 * largest and bits < 65_536:
        bits *= 2
    words = np.zeros((len(sets), bits // 64), np.uint64)
    for i, members in enumerate(sets):
        place = np.unique((members >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)
        np.bitwise_or.at(words[i], place >> 6, np.uint64(1) << (place & 63).astype(np.uint64))
    sizes = np.array([len(s) for s in sets])
    return words, sizes - np.bitwise_count(words).sum(axis=1).astype(np.int64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Members in common of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    place = np.searchsorted(b, a)
    place[place == len(b)] = 0
    return int((b[place] == a).sum())


def least_overlap(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Members in common that sizes a and b need: 100 * i >= percent * (a + b - i)."""
    return -(-(percent * (a + b)) // (100 + percent))


class SignatureTree:
    """Records in order of size, leaves of LEAF of them, inner nodes of FAN nodes."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, words: np.ndarray, lost: np.ndarray):
        self.rows = rows[np.lexsort((rows, sizes[rows]))]
        self.levels = []
        starts = np.arange(0, len(rows), LEAF)
        own = self.rows
        level = (
            np.bitwise_or.reduceat(words[own], starts, axis=0),
            np.minimum.reduceat(sizes[own], starts),
            np.maximum.reduceat(sizes[own], starts),
            np.maximum.reduceat(lost[own], starts),
        )
        self.levels.append(level)
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), FAN)
            level = (
                np.bitwise_or.reduceat(level[0], starts, axis=0),
                np.minimum.reduceat(level[1], starts),
                np.maximum.reduceat(level[2], starts),
                np.maximum.reduceat(level[3], starts),
            )
            self.levels.append(level)

    def leaf(self, k: int) -> np.ndarray:
        return self.rows[k * LEAF : (k + 1) * LEAF]


def _may_link(x: tuple, i: int, y: tuple, j: int, percent: int) -> bool:
    """Whether some record below node i of level x may link with one below node j of level y."""
    small_x, large_x, small_y, large_y = x[1][i], x[2][i], y[1][j], y[2][j]
    if 100 * min(large_x, large_y) < percent * max(small_x, small_y):
        return False
    common = int(np.bitwise_count(x[0][i] & y[0][j]).sum()) + min(x[3][i], y[3][j])
    return min(common, large_x, large_y) >= least_overlap(small_x, small_y, percent)


def link(
    sets: list[np.ndarray], first: np.ndarray, second: np.ndarray | None, percent: int, found: UnionFind
) -> None:
    """Join in ``found`` all records of ``first`` and ``second`` (or of ``first`` alone) that link.

    Sets are sorted arrays without repeats.  Records that are connected already
    are not compared again: only components are asked for.
    """
    sizes = np.array([len(s) for s in sets])
    words, lost = signatures(sets)
    left = SignatureTree(first, sizes, words, lost)
    right = left if second is None else SignatureTree(second, sizes, words, lost)
    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        level_x, i, level_y, j = stack.pop()
        if right is left and (level_x, i) == (level_y, j):
            if level_x == 0:
                _link_records(sets, left.leaf(i), left.leaf(i), True, sizes, words, lost, percent, found)
                continue
            below = range(i * FAN, min((i + 1) * FAN, len(left.levels[level_x - 1][0])))
            stack += [(level_x - 1, a, level_x - 1, b) for a in below for b in below if a <= b]
            continue
        if not _may_link(left.levels[level_x], i, right.levels[level_y], j, percent):
            continue
        if level_x == 0 and level_y == 0:
            _link_records(sets, left.leaf(i), right.leaf(j), False, sizes, words, lost, percent, found)
        elif level_x >= level_y:
            below = range(i * FAN, min((i + 1) * FAN, len(left.levels[level_x - 1][0])))
            stack += [(level_x - 1, a, level_y, j) for a in below]
        else:
            below = range(j * FAN, min((j + 1) * FAN, len(right.levels[level_y - 1][0])))
            stack += [(level_x, i, level_y - 1, b) for b in below]


def _link_records(
    sets: list, a: np.ndarray, b: np.ndarray, same: bool, sizes: np.ndarray, words: np.ndarray, lost: np.ndarray,
    percent: int, found: UnionFind,
) -> None:
    need = least_overlap(sizes[a][:, None], sizes[b][None, :], percent)
    common = np.bitwise_count(words[a][:, None, :] & words[b][None, :, :]).sum(axis=2, dtype=np.int64)
    common += np.minimum(lost[a][:, None], lost[b][None, :])
    most = np.minimum(common, np.minimum(sizes[a][:, None], sizes[b][None, :]))
    may = most >= need
    if same:
        may = np.triu(may, 1)
    if may.any():  # what is connected already needs no comparison
        roots = [np.array([found.find(int(x)) for x in side]) for side in (a, b)]
        may &= roots[0][:, None] != roots[1][None, :]
    for i, j in zip(*np.nonzero(may)):
        x, y = int(a[i]), int(b[j])
        if found.find(x) != found.find(y) and overlap(sets[x], sets[y]) >= need[i, j]:
            found.join(x, y)
