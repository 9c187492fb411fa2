import tracemalloc

import numpy as np
import pytest

from stationcast.llm import embedding_dedup
from stationcast.llm.embedding_dedup import embedding_components
from stationcast.llm.hnsw import Graph, unit


def vectors(n=700, d=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    close = base[:80] + rng.normal(size=(80, d)) * 0.12
    dense = base[0] + rng.normal(size=(250, d)) * 0.05
    return np.concatenate([base, close, dense, base[:10], base[5:6], base[5:6]])


def brute(x):
    u = unit(x)
    near = (u @ u.T) >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[near[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == root).all():
            return near.sum(1), root
        root = new


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARDS", 3)
    monkeypatch.setattr(embedding_dedup, "QUERIES", 400)
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, h int")
    got = embedding_components(df).orderBy("vec_id").collect()
    links, root = brute(x)
    assert [r["vec_id"] for r in got] == list(range(len(x)))
    own = np.array([r["n_links"] for r in got])
    assert (own <= links).all() and own.sum() >= 0.99 * links.sum()
    assert np.mean([r["component_id"] == c for r, c in zip(got, root)]) >= 0.99
    assert all(r["kept"] == (r["component_id"] == r["vec_id"]) for r in got)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.1]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]),
            (8, [float("inf"), 1.0]), (9, []), (10, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (11, [-1.0, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_components(df).collect()))
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == [(0, 0, None, True), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (3, 3, 1, False), *alone]
    assert embedding_components(df.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 30, 1500])
def test_graph(n):
    x = unit(np.random.default_rng(n).normal(size=(n, 12)))
    graph = Graph.load(Graph.build(x).dump())
    ids, sims = graph.search(graph.vectors, 32)
    want = np.argsort(-(x @ x.T), 1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / min(10, n) for a, b in zip(ids, want)]) > 0.9
    assert (sims[:, :-1] >= sims[:, 1:]).all()
    q, node = graph.within(graph.vectors, 0.6, 24, 0.05)
    true = (graph.vectors @ graph.vectors.T) >= 0.6
    assert true[q, node].all() and len(set(zip(q, node))) == len(q) and len(q) >= 0.98 * true.sum()


def test_audit_sees_lost_pairs_beside_a_large_group():
    rng = np.random.default_rng(3)
    x = unit(np.concatenate([rng.normal(size=(1, 32)) + rng.normal(size=(400, 32)) * 0.02, rng.normal(size=(800, 32))])).astype(np.float32)
    graph, ids = Graph.build(x), np.arange(len(x))
    far = unit(x[400:] + rng.normal(size=(800, 32)) * 0.02).astype(np.float32)  # copies in other shards
    own = np.arange(800) + len(x)
    assert embedding_dedup._audit(graph, 0.95, ids, far, own)[0] == embedding_dedup.BEAM
    for layer in graph.layers:  # 40 of the single vectors cannot be reached
        lost = (layer.links >= 400) & (layer.links < 440)
        layer.links[lost] = -1
        layer.links[400:440] = -1
    graph.layers[0].entry = 0
    sample = np.random.default_rng(1).permutation(len(x))[:128]
    pairs = (x[sample] @ x.T) >= 0.95
    q, node = graph.within(x[sample], 0.95, embedding_dedup.BEAM, embedding_dedup.SLACK)
    assert pairs[q, node].sum() >= 0.995 * pairs.sum()  # a sum over pairs is blind to them
    assert embedding_dedup._audit(graph, 0.95, ids, far, own)[0] == 0
    q, node = graph.within(far, 0.95, 0, 0.0)
    assert (np.bincount(q, minlength=800) > 0).all()


def test_pairs_of_a_dense_group_are_not_held():
    rng = np.random.default_rng(4)
    n = 8000
    x = unit(np.concatenate([rng.normal(size=(1, 8)) + rng.normal(size=(n // 2, 8)) * 0.02, rng.normal(size=(n // 2, 8))]))
    graph, ids, weights = Graph.build(x), np.arange(n), np.ones(n, np.int64)
    queries = x[:n // 2]
    tracemalloc.start()
    links, root = embedding_dedup._reduced(graph, queries, ids[:n // 2], x, ids, weights, 0.95, 24, 0.02)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    near = (queries @ x.T) >= 0.95
    assert (links == near.sum(1) - 1).all()
    assert len(np.unique(root[:n])) == 1
    assert peak < 16 * near.sum()  # the pairs alone would take that


def test_rows_of_a_shard_stay_small(spark):
    x = unit(np.random.default_rng(6).normal(size=(6000, 64)))
    df = spark.createDataFrame([(i, 64, 0, v.tolist(), 1) for i, v in enumerate(x)], "id long, dims int, shard int, vector array<double>, n_rows long")
    graphs = embedding_dedup.shard_graphs(df, 1, 0.95)
    binary = [f.name for f in graphs.schema if f.dataType.typeName() == "binary"]
    largest = graphs.selectExpr(f"max(greatest({', '.join(f'length({c})' for c in [*binary, binary[0]])}))").first()[0]
    assert largest <= 1 << 20  # executors hold and copy whole rows


def test_pieces_blocks_and_parts_of_queries(spark, monkeypatch):
    for name, value in {"SHARDS": 2, "BLOCKS": 3, "QUERIES": 50, "PIECE": 5000}.items():
        monkeypatch.setattr(embedding_dedup, name, value)
    x = vectors().astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = embedding_components(df).orderBy("vec_id").collect()
    links, root = brute(x)
    own = np.array([r["n_links"] for r in got])
    assert (own <= links).all() and own.sum() >= 0.99 * links.sum()
    assert np.mean([r["component_id"] == c for r, c in zip(got, root)]) >= 0.99
