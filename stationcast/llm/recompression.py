"""Recompression of word sequences: rounds that name runs and pairs of symbols.

A symbol is named by a hash of what it stands for, so that every task gives equal substrings equal
names without asking others. Beside each symbol stand the words its name depends on: inside that
context the naming sees nothing else, so a window that holds the context of a symbol shares the
symbol with every other occurrence of the window, wherever it is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .words import ODD, mix

U = np.uint64


@dataclass
class Level:
    """Names of symbols in order, and for each the words [lo, hi) that decide its name."""

    name: np.ndarray
    first: np.ndarray  # starts a document
    lo: np.ndarray
    hi: np.ndarray

    @property
    def last(self) -> np.ndarray:
        out = np.ones(len(self.first), bool)
        out[:-1] = self.first[1:]
        return out


def ground(hashes: np.ndarray, bounds: np.ndarray) -> Level:
    at = np.arange(len(hashes))
    first = np.zeros(len(hashes) + 1, bool)
    first[bounds] = True
    return Level(hashes, first[:-1], at, at + 1)


def _before(level: Level) -> np.ndarray:
    """``lo`` of the symbol to the left; outside the document for the first one."""
    out = np.empty_like(level.lo)
    out[1:] = level.lo[:-1]
    out[level.first] = level.lo[level.first] - 1
    return out


def _after(level: Level) -> np.ndarray:
    out = np.empty_like(level.hi)
    out[:-1] = level.hi[1:]
    last = level.last
    out[last] = level.hi[last] + 1
    return out


def name_runs(level: Level) -> Level:
    """A run of equal symbols becomes one; its name depends on both neighbours too."""
    start = level.first.copy()
    start[1:] |= level.name[1:] != level.name[:-1]
    at = np.flatnonzero(start)
    end = np.append(at[1:], len(start)) - 1
    length = end - at + 1
    name = level.name[at]
    long = length > 1
    name[long] = mix(name[long] * U(ODD) + length[long].astype(U))
    return Level(name, level.first[at], _before(level)[at], _after(level)[end])


def name_pairs(level: Level, turn: int) -> Level:
    """A left symbol and the right symbol behind it become one; the sides are bits of the names."""
    right = (mix(level.name ^ U((turn * ODD + 7) % 2**64)) >> U(63)).astype(bool)
    opens = np.zeros(len(right), bool)
    opens[:-1] = ~right[:-1] & right[1:] & ~level.first[1:]
    second = np.zeros(len(right), bool)
    second[1:] = opens[:-1]
    at = np.flatnonzero(~second)
    pair = opens[at]
    name = level.name[at]
    name[pair] = mix(name[pair] * U(ODD) + (level.name[at[pair] + 1] ^ U(turn + 1)))
    lo = np.where(right[at], _before(level)[at], level.lo[at])
    hi = np.where(right[at], level.hi[at], _after(level)[at])
    return Level(name, level.first[at], lo, hi)


ROUNDS = 5  # names then stand for four to five words; longer ones leave fewer windows that hold a context


def levels(hashes: np.ndarray, bounds: np.ndarray) -> list[Level]:
    """Levels from words upwards. Runs are named in the first round only: naming them again widens
    every context by two symbols a round, and periodic texts are covered by the lower levels."""
    out = [ground(hashes, bounds)]
    for turn in range(ROUNDS):
        level = name_runs(out[-1]) if turn == 0 else out[-1]
        out.append(name_pairs(level, turn))
    return out


def anchors(found: list[Level], starts: np.ndarray, n: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each n-word window the level and index of one symbol that the window alone decides.

    It is the symbol of the highest level whose context lies inside the window, of those the one
    with the smallest hash, of equal ones the first: equal windows get the same symbol at the same
    place. Words are their own context, so every window has one.
    """
    index, level = np.full(len(starts), -1), np.full(len(starts), -1)
    todo = np.arange(len(starts))
    for k in range(len(found) - 1, -1, -1):
        if not len(todo):
            break
        symbols = found[k]
        before = np.cumsum(np.bincount(np.maximum(symbols.lo, -1) + 2, minlength=n_words + 3))
        inside = np.cumsum(np.bincount(np.minimum(symbols.hi, n_words + 1), minlength=n_words + 2))
        at = starts[todo]
        a, b = before[at + 1], inside[at + n] - 1
        some = a <= b
        rank = mix(symbols.name ^ U(k + 99))
        index[todo[some]] = _least(rank, a[some], b[some])
        level[todo[some]] = k
        todo = todo[~some]
    return level, index


def _least(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Index of the first smallest rank in each range a to b, by tables of doubling length."""
    out = np.empty(len(a), np.int64)
    depth = np.frexp(b - a + 1)[1] - 1
    best = np.arange(len(rank))
    for k in range(depth.max() + 1 if len(depth) else 0):
        if k:
            half = 1 << (k - 1)
            left, right = best[:-half], best[half:]
            best = np.where(rank[left] <= rank[right], left, right)
        here = depth == k
        left, right = best[a[here]], best[b[here] - (1 << k) + 1]
        out[here] = np.where(rank[left] <= rank[right], left, right)
    return out
