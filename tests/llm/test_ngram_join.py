import itertools
import random
import re

import numpy as np

from stationcast.llm import ngram_join
from stationcast.llm.components import connected_components
from stationcast.llm.ngram_join import compare, similarity_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(ids, texts):
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(texts)
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return links, [ids[find(i)] for i in range(len(texts))]


def test_same_as_brute_force(documents, texts):
    got = similarity_join(documents(texts)).orderBy("doc_id").collect()
    links, components = brute(list(range(len(texts))), texts)
    assert [r["n_links"] for r in got] == links
    assert [r["component_id"] for r in got] == components
    assert sum(r["kept"] for r in got) == len(set(components))
    empty = [i for i, t in enumerate(texts) if not (t or "").split()]
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in empty)


def test_group_larger_than_a_block(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(40):
        words = list(base)
        words[rng.randrange(150)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += ["other " + " ".join(f"u{i}" for i in range(30))]
    got = similarity_join(documents(texts)).orderBy("doc_id").collect()
    links, components = brute(list(range(len(texts))), texts)
    assert [r["n_links"] for r in got] == links and [r["component_id"] for r in got] == components


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, 1), (5, text, 1), (3, text + " x", 2), (None, text, 3), (9, "", 4), (8, None, 5), (7, "two words", 6), (6, "two  words", 7)]
    got = {(r["doc_id"], r["n_links"], r["component_id"], r["kept"])
           for r in similarity_join(spark.createDataFrame(rows, "doc_id long, text string, key int")).collect()}
    assert got == {(5, 2, 3, False), (3, 2, 3, True), (None, 0, None, True), (9, 0, 9, True), (8, 0, 8, True), (7, 1, 6, False), (6, 1, 6, True)}


def test_empty_table(spark):
    assert similarity_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_at_the_threshold(spark, documents):
    """Pairs just above the threshold are found."""
    rng = random.Random(3)
    texts = []
    for k in range(150):
        words = [f"{k}-{i}" for i in range(204)]
        other = list(words)
        for place in range(15, 200, 48):  # four changes of five shingles in 200: J = 180 / 220
            other[place] = f"v{rng.randrange(10**9)}"
        texts += [" ".join(words), " ".join(other)]
    assert min(brute(list(range(300)), texts)[0]) == 1
    got = similarity_join(documents(texts)).agg({"n_links": "sum"}).first()[0]
    assert got >= 0.99 * 300


def test_compare_blocks():
    sets = [np.array(s, np.uint64) for s in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 5, 6], [9, 10], [1, 2, 3, 4, 5])]
    root, links, some = compare(np.zeros(4, int), sets, np.array([1, 10, 100, 1000]), False)
    assert links.tolist() == [1010, 1001, 0, 11] and root.tolist() == [0, 0, 2, 0] and some.tolist() == [True, True, False, True]
    root, links, some = compare(np.array([0, 1, 0, 1]), sets, np.array([1, 10, 100, 1000]), True)
    assert links.tolist() == [1010, 1, 0, 1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    label = {}
    for a, b in edges:
        label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {n: c for n, c in label.items() if any(n in e and e[0] != e[1] for e in edges)}
