"""FM-index over word numbers, for phrases of up to ``DEPTH`` words.

The text of a shard is a ring of word numbers 1, 2, ... with a 0 behind every piece. Its rows are the
positions in order of the ``DEPTH`` numbers that follow (sorting deeper would not move the interval of
any phrase of that length); the index is the transform ``bwt``, the number before each row's position.
The first column is the sorted transform, and ``step``, a stable sort of it, takes the row of a position
to the row of the next one.

A phrase is an interval of rows. ``extend`` takes all intervals of one length at once in both directions:
on the left, the rows of a phrase step into the rows of the phrase without its first word; on the right,
the interval of a phrase is cut where its continuation changes. So the phrases that are one word longer
are the runs of rows of equal prefix and equal suffix, and each run's length is the phrase's count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEPTH = 4


def ring(numbers: np.ndarray) -> np.ndarray:
    """The pieces of two and more words, a single 0 behind each and nothing else."""
    numbers = np.append(np.int32(0), numbers)
    live = numbers != 0
    if not live.any():
        return np.zeros(0, np.int32)
    alone = live & ~np.append(False, live[:-1]) & ~np.append(live[1:], False)
    numbers = np.where(alone, 0, numbers).astype(np.int32)
    live = numbers != 0
    return numbers[live | np.append(False, live[:-1])] if not live[-1] else np.append(numbers[live | np.append(False, live[:-1])], np.int32(0))


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    new = np.ones(len(keys), np.int64)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def transform(numbers: np.ndarray) -> np.ndarray:
    """The transform of a ring."""
    if not len(numbers):
        return np.zeros(0, np.int32)
    wide = numbers.astype(np.int64)
    pairs = _ranks((wide << 32) | np.roll(wide, -1))
    rows = np.argsort((pairs << 32) | np.roll(pairs, -2))
    return numbers[rows - 1]


@dataclass
class FmIndex:
    """An index read from its transform."""

    bwt: np.ndarray

    def __post_init__(self) -> None:
        self.step = np.argsort(self.bwt, kind="stable")
        self.first = self.bwt[self.step]

    def words(self) -> np.ndarray:
        """For each row the number of its first word less one; -1 at the end of a piece."""
        return self.first.astype(np.int64) - 1

    def fill(self, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """For each row the position in the list of the interval that holds it; -1 if none does."""
        out = np.full(len(self.bwt), -1, np.int64)
        place = np.repeat(np.arange(len(starts)), counts)
        first = np.repeat(np.cumsum(counts) - counts, counts)
        out[np.repeat(starts, counts) + np.arange(len(place)) - first] = place
        return out

    def extend(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, count, prefix and suffix of every phrase one word longer whose two parts are members.

        member: for each row the number of the phrase it starts with, or -1.
        """
        after = member[self.step]
        live = (member >= 0) & (after >= 0)
        new = live.copy()
        new[1:] &= ~live[:-1] | (member[1:] != member[:-1]) | (after[1:] != after[:-1])
        starts = np.flatnonzero(new)
        upto = np.append(0, np.cumsum(live))
        counts = np.diff(np.append(upto[starts], upto[-1])) if len(starts) else np.zeros(0, np.int64)
        return starts, counts, member[starts], after[starts]
