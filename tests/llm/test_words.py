import re

import numpy as np
import pyarrow as pa
import pytest

from stationcast.llm import recompression
from stationcast.llm.words import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("limit", [1, 500, 1 << 20])
def test_words_of_any_block_size(texts, limit):
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    by_word = {}
    row = 0
    for start, end, block in blocks(batch.slice(0), "text", limit):
        assert start == row
        hashes = block.hashes()
        for i in range(end - start):
            words = WORD.findall(texts[start + i] or "")
            own = hashes[block.bounds[i]:block.bounds[i + 1]]
            assert len(words) == len(own)
            for w, h in zip(words, own):
                assert by_word.setdefault(w, h) == h
        row = end
    assert row == len(texts) and len(set(by_word.values())) == len(by_word)


def test_windows_are_equal_where_the_words_are(texts):
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    seen = {}
    for start, end, block in blocks(batch, "text", 2000):
        at, keys = block.windows(block.hashes(), 8)
        owner = np.searchsorted(block.bounds, at, "right") - 1
        for a, k, o in zip(at, keys, owner):
            words = tuple(WORD.findall(texts[start + o])[a - block.bounds[o]:][:8])
            assert len(words) == 8 and seen.setdefault(words, k) == k
    assert len(set(seen.values())) == len(seen)


def test_equal_windows_have_the_same_anchor():
    """A passage is planted between other words: every window inside it gets the symbol it gets elsewhere."""
    rng = np.random.default_rng(3)
    n = 20
    passage = rng.integers(1, 2**63, 200, dtype=np.uint64)
    passage[50:90] = passage[50]  # a run
    passage[120:160:2], passage[121:160:2] = passage[120], passage[121]  # a period
    found = {}
    for before in range(0, 30, 3):
        words = np.concatenate([rng.integers(1, 2**63, before, dtype=np.uint64), passage, rng.integers(1, 2**63, 7, dtype=np.uint64)])
        levels = recompression.levels(words, np.array([0, len(words)]))
        starts = np.arange(len(words) - n + 1)
        level, index = recompression.anchors(levels, starts, n, len(words))
        for s in range(before, before + 200 - n + 1):
            symbols = levels[level[s]]
            lo, hi = symbols.lo[index[s]], symbols.hi[index[s]]
            assert s <= lo and hi <= s + n
            got = (level[s], symbols.name[index[s]], lo - s, hi - s)
            assert found.setdefault(s - before, got) == got
    assert len({g[1] for g in found.values()}) < 100  # windows share symbols
