"""Recompression of word sequences, and what it says about windows of a fixed width.

A sequence is rewritten in rounds: a round of runs gives each run of one symbol
a name, a round of pairs gives a name to each neighbouring pair of which the
first symbol is of the left kind and the second of the right kind.  Names and
kinds follow from the symbols alone, so they are the same for every document in
every task: equal passages get equal symbols in their interior, and only the
symbols at their ends depend on what is around them.

For a window this is followed from both ends: a symbol that something outside
could take part in is popped, the rest goes on to the next round, until nothing
is left.  The popped symbols spell the window, so their hash is its signature.
What is left after ANCHOR_ROUNDS is consistent wherever the window occurs; the
ANCHOR_SYMBOLS neighbours of least hash in it are its anchor.  Both depend on
the window's words alone, not on the text around it or on how it is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Odd constants of the mixing steps.
_A, _B, _C = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LEFT, _RIGHT = np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63)
# One round in three names runs, the others name pairs.
RUN_EVERY = 3
# All windows take their anchors from the same round, so that neighbours share them.
ANCHOR_ROUNDS = 5
ANCHOR_SYMBOLS = 3


def _of_round(level: int, constant: np.uint64) -> np.uint64:
    return np.uint64((level + 1) * int(constant) & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


@dataclass
class Symbols:
    """A rewritten sequence: names, the word each begins at (and the end), and walls that nothing crosses."""

    names: np.ndarray
    starts: np.ndarray
    walls: np.ndarray

    @staticmethod
    def of(words: np.ndarray, walls: np.ndarray) -> "Symbols":
        return Symbols(words, np.arange(len(words) + 1), walls)


@dataclass
class Runs:
    symbols: Symbols
    of: np.ndarray  # the run of each symbol
    first: np.ndarray
    length: np.ndarray


def name_runs(s: Symbols) -> Runs:
    """Each maximal run of one symbol gets a name of its symbol and length; a run of one keeps its name."""
    head = np.ones(len(s.names), bool)
    head[1:] = (s.names[1:] != s.names[:-1]) | s.walls[1:] | s.walls[:-1]
    first = np.flatnonzero(head)
    length = np.diff(np.append(first, len(s.names)))
    names = s.names[first]
    names = np.where(length > 1, mix(names * _A + length.astype(np.uint64) * _C), names)
    return Runs(Symbols(names, np.append(s.starts[first], s.starts[-1]), s.walls[first]), np.cumsum(head) - 1, first, length)


def left_kind(names: np.ndarray, level: int) -> np.ndarray:
    """Whether a symbol may only begin a pair in this round (else it may only end one)."""
    return mix(names + _of_round(level, _C)) >> np.uint64(63) == 0


def name_pairs(s: Symbols, left: np.ndarray) -> tuple[Symbols, np.ndarray]:
    """The sequence with its pairs named, and the new place of each symbol."""
    kept = np.ones(len(s.names), bool)
    kept[1:] = ~(left[:-1] & ~left[1:] & ~s.walls[1:] & ~s.walls[:-1])
    second = np.flatnonzero(~kept)
    place = np.cumsum(kept) - 1
    names = s.names[kept]
    names[place[second]] = mix(s.names[second - 1] * _A + s.names[second] * _B + _C)
    return Symbols(names, np.append(s.starts[:-1][kept], s.starts[-1]), s.walls[kept]), place


@dataclass
class Windows:
    """For each window: its signature, its anchor's name, and the word at which the anchor begins."""

    signature: np.ndarray
    anchor: np.ndarray
    place: np.ndarray


def windows(words: np.ndarray, walls: np.ndarray, first: np.ndarray, width: int) -> Windows:
    """Signature and anchor of the windows of ``width`` words that begin at ``first``; none crosses a wall."""
    out = Windows(*(np.zeros(len(first), kind) for kind in (np.uint64, np.uint64, np.int64)))
    s = Symbols.of(words, walls)
    which, l, r = np.arange(len(first)), first.copy(), first + width - 1
    left, right = np.full(len(first), _LEFT), np.full(len(first), _RIGHT)
    anchored = np.zeros(len(first), bool)
    level = 0
    while len(which):
        before, low, high = s, l, r
        tag = _of_round(level, _B)
        if level % RUN_EVERY == 0:
            runs = name_runs(s)
            a, b = runs.of[l], runs.of[r]
            taken = np.minimum(runs.first[a] + runs.length[a], r + 1) - l
            left = mix(left * _A + s.names[l] + taken.astype(np.uint64) * _C + tag)
            taken = r - runs.first[b] + 1
            right = np.where(a == b, right, mix(right * _A + s.names[r] + taken.astype(np.uint64) * _C + tag))
            s, l, r = runs.symbols, a + 1, b - 1
        else:
            begins = left_kind(s.names, level)
            pop = ~begins[l]
            left = np.where(pop, mix(left * _A + s.names[l] + tag), left)
            l = l + pop
            pop = begins[r] & (l <= r)
            right = np.where(pop, mix(right * _A + s.names[r] + tag), right)
            r = r - pop
            empty = l > r
            s, place = name_pairs(s, begins)
            l, r = place[np.minimum(l, len(place) - 1)], place[np.maximum(r, 0)]
            l = np.where(empty, r + 1, l)
        done = l > r
        now = ~anchored[which] & (done | (level >= ANCHOR_ROUNDS))
        if now.any():
            for some, width_in in ((high - low + 1 >= ANCHOR_SYMBOLS, ANCHOR_SYMBOLS), (high - low + 1 < ANCHOR_SYMBOLS, 1)):
                some = some & now
                if some.any():
                    out.anchor[which[some]], out.place[which[some]] = _anchors(before, low[some], high[some], level, width_in)
            anchored[which[now]] = True
        if done.any():
            out.signature[which[done]] = mix(left[done] * _A + right[done] * _C)
            going = ~done
            which, l, r, left, right = which[going], l[going], r[going], left[going], right[going]
        level += 1
    return out


def _anchors(s: Symbols, low: np.ndarray, high: np.ndarray, level: int, together: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the neighbours, ``together`` many, inside [low, high] those of least hash, the first of equal ones."""
    names = s.names
    for k in range(1, together):
        names = mix(names[:-1] * _A + s.names[k:] * _B + _C)
    hashes, last = mix(names + _of_round(level, _C)), high - together + 1
    chosen, best = low.copy(), hashes[low]
    for step in range(1, int((last - low).max()) + 1):
        at = np.minimum(low + step, last)
        better = hashes[at] < best
        chosen, best = np.where(better, at, chosen), np.where(better, hashes[at], best)
    return best, s.starts[chosen]
