import hashlib
import re
from collections import Counter

import pytest

from stationcast.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [5, 35])
def test_same_as_brute_force(documents, texts, window):
    got = dedup_substrings(documents(texts), window, digest=True, clean="clean").orderBy("doc_id").collect()
    want = brute(texts, window)
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == want
    for r, t in zip(got, texts):
        assert (r["clean"] is None) == (t is None)
        if r["n_removed"] == 0:
            assert r["clean"] == t
        assert hashlib.sha256(" ".join(WORD.findall(r["clean"] or "")).encode()).hexdigest() == r["kept_sha256"]


def test_repeated_rows_and_clashing_names(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "x", 7), (1, text, "x", 7), (None, text + " more", "y", 8), (None, None, None, None), (2, "short", "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, marks string, n_words int")
    got = dedup_substrings(df, clean="clean").collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in got) == [(0, 0), (1, 0), (50, 50), (50, 50), (51, 50)]


def test_separators_of_kept_words_stay(documents):
    passage = " ".join(f"p{i}" for i in range(40))
    got = dedup_substrings(documents([f"a\nb {passage}\n\nc\td", f"{passage} e"]), clean="clean").orderBy("doc_id").collect()
    assert [r["clean"] for r in got] == ["a\nb c\td", "e"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_substrings(df, digest=True).count() == 0
