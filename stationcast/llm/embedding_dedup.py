"""Near copies among embeddings: a navigable small-world graph per shard, queried by all vectors.

Equal vectors form a class and only one of them goes on. The classes are dealt to shards by hash; each
shard's graph is built once and written in pieces of ``PIECE`` bytes. Every class queries every shard, in
blocks of queries: a task holds one shard, put together from its pieces, and its block passes by, at most
``QUERIES`` at once. Per shard the beam and the reach of the search are widened until an
audit passes: brute force in blocks tells the links of about ``AUDITED`` vectors chosen by hash from all
shards, and of ``PROBES`` turned copies of the shard's own vectors, as links may be rare; the mean share
found per query must reach ``RECALL`` for few and for many links alike. A shard that no beam up to
``WIDEST`` serves is queried by brute force. Found pairs are verified by their cosine in double precision. A task neither holds nor returns the
pairs: part by part they go into the number of links of each query and a spanning forest, which it
returns; the forests' components are united.

Shards have at most about ``SHARD`` vectors and ``SHARD_BYTES`` bytes of them; there are ``SHARDS`` of them
unless more are needed. As each block brings its shard through the shuffle again, there are at most ``BLOCKS``
blocks unless they had more than ``ASKED`` queries. Vectors of single precision stay so until they are compared.

Result, a row per vector: n_links (other rows linked directly, equal ones included), component_id
(smallest vec_id reachable) and kept (vec_id = component_id). A vector that is null, empty, zero or
holds a null or non-finite component links with nothing, also not with its copies; so does a row
without vec_id. They are their own component and are kept. Vectors of different lengths never link.
Repeated rows count as copies of each other.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import connected_components
from .hnsw import Graph, unit
from .registry import query
from .store import stored

THRESHOLD = 0.95
SHARDS, SHARD, QUERIES = 8, 100_000, 16_384
SHARD_BYTES, PIECE = 1 << 25, 1 << 20
BLOCKS, ASKED = 3, 1 << 18
BEAM, SLACK = 24, 0.02
WIDEST = 8 * BEAM  # a wider search costs more than brute force
AUDITED, PROBES, RECALL = 2048, 256, 0.995
SINGLE = 1e-5  # error of similarities in single precision
CHECKED = 16384  # cosines computed at once in double precision


def usable(vector: Column) -> Column:
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _turned(vectors: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """Copies of unit vectors, turned by up to the threshold's angle."""
    aside = rng.normal(size=vectors.shape)
    aside -= np.einsum("nd,nd->n", aside, vectors)[:, None] * vectors
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    angle = np.arccos(np.clip(threshold, -1, 1)) * rng.random((len(vectors), 1)) * (size > SINGLE)
    return (np.cos(angle) * vectors + np.sin(angle) * aside / np.maximum(size, SINGLE)).astype(np.float32)


def _audit(graph: Graph, threshold: float, ids: np.ndarray, queries: np.ndarray, own: np.ndarray) -> tuple[int, float]:
    """Beam and slack at which the links of the queries (ids ``own``) in the shard are found; beam 0 is brute force."""
    rng = np.random.default_rng(1)
    probes = _turned(graph.vectors[rng.permutation(len(ids))[:PROBES]], threshold, rng)
    kind = np.repeat([0, 1], [len(queries), len(probes)])
    queries, own = np.concatenate([queries, probes]), np.concatenate([own, np.full(len(probes), -1)])

    def links(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        n = np.zeros(len(queries), np.int64)
        for q, node, _ in found:
            n += np.bincount(q[own[q] != ids[node]], minlength=len(n))
        return n

    true = links(graph.brute(queries, threshold))
    some = np.flatnonzero(true)
    if not len(some):
        return BEAM, SLACK
    _, group = np.unique(64 * kind[some] + np.log2(true[some]).astype(int), return_inverse=True)
    queries, own, true = queries[some], own[some], true[some]
    beam, slack, ways = BEAM, SLACK, graph.both_ways()
    while beam <= WIDEST:
        share = np.minimum(links(graph.hits(queries, threshold, beam, slack, ways)) / true, 1)
        if (np.bincount(group, share) >= RECALL * np.bincount(group)).all():
            return beam, slack
        beam, slack = 2 * beam, 2 * slack
    return 0, 0.0


def _runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Key and rows wherever neighbours have equal values; a run ends with its batch."""
    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                yield keys[start], batch.slice(start, i - start)
                start = i


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal values, of input sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for key, rows in _runs(batches, by):
        if key != last:
            if held:
                yield pa.Table.from_batches(held)
            held, last = [], key
        held.append(rows)
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _singles(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision."""
    out = np.empty(vectors.shape, np.float32)
    for i in range(0, len(vectors), QUERIES):
        out[i:i + QUERIES] = unit(vectors[i:i + QUERIES])
    return out


def shard_graphs(classes: DataFrame, shards: int, threshold: float) -> DataFrame:
    """(dims, shard, part, piece): each shard's graph, ids, weights, vectors, beam and slack as bytes, in pieces."""
    by = ["dims", "shard"]
    counts = classes.groupBy("dims").agg(F.count("*").alias("n"))
    audited = (classes.join(F.broadcast(counts), "dims").where(F.pmod(F.xxhash64("id", F.lit("audit")), F.col("n")) < AUDITED)
               .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for both in _groups(batches, by):
            sampled = both.column("audit")
            table, sample = both.filter(pc.invert(sampled)), both.filter(sampled)
            if not len(table):
                continue  # no vectors of this length in the shard
            ids = table.column("id").to_numpy()
            order = np.argsort(ids)  # the same graph whatever order the shuffle gave
            ids, vectors = ids[order], _matrix(table.column("vector"))[order]
            weights = table.column("n_rows").to_numpy()[order]
            dims, shard = (table.column(c)[0].as_py() for c in by)
            queries = unit(_matrix(sample.column("vector"))) if len(sample) else np.zeros((0, vectors.shape[1]))
            own = sample.column("id").to_numpy()
            del both, table, sample
            graph = Graph.build(_singles(vectors))
            beam, slack = _audit(graph, threshold - SINGLE, ids, queries.astype(np.float32), own)
            out = io.BytesIO()
            np.savez(out, ids=ids, weights=weights, vectors=vectors, beam=beam, slack=slack, **graph.arrays())
            del graph
            data = out.getbuffer()
            for part, start in enumerate(range(0, len(data), PIECE)):
                yield pa.record_batch({
                    "dims": pa.array([dims], pa.int32()), "shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()),
                    "piece": pa.array([data[start:start + PIECE].tobytes()], pa.binary()),
                })

    given = (classes.select(*by, "id", "vector", "n_rows", F.lit(False).alias("audit"))
             .union(audited.select(*by, "id", "vector", "n_rows", F.lit(True))))
    return given.repartitionById(shards, "shard").sortWithinPartitions(*by).mapInArrow(
        run, "dims int, shard int, part int, piece binary")


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of the pairs' nodes; ``root`` holds the smallest node of each node's tree."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _reduced(graph: Graph, queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, weights: np.ndarray,
             threshold: float, beam: int, slack: float, ways: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each query, and the root of each query and then each node in the forest of the pairs."""
    links, root = np.zeros(len(own)), np.arange(len(own) + len(ids))
    for q, node, sim in graph.hits(queries.astype(np.float32), threshold - SINGLE, beam, slack, ways):
        good = own[q] != ids[node]
        near = np.flatnonzero(good & (sim < threshold + SINGLE))  # others are sure
        for i in range(0, len(near), CHECKED):
            at = near[i:i + CHECKED]
            good[at] = np.einsum("nd,nd->n", queries[q[at]], unit(vectors[node[at]])) >= threshold
        q, node = q[good], node[good]
        links += np.bincount(q, weights[node], len(own))
        _unite(root, q, len(own) + node)
    return links.astype(np.int64), root


class Shard:
    """A shard put together from its pieces; batches of queries pass by, their forests over its nodes stay."""

    def __init__(self, pieces: list[pa.Buffer], threshold: float) -> None:
        with np.load(io.BytesIO(b"".join(pieces))) as z:
            self.ids, self.weights, self.vectors = z["ids"], z["weights"], z["vectors"]
            self.beam, self.slack = int(z["beam"]), float(z["slack"])
            self.graph = Graph.of(_singles(self.vectors), z)
        self.ways = self.graph.both_ways() if self.beam else None
        self.threshold, self.root = threshold, np.arange(len(self.ids))

    def links(self, own: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        """(id, links, root) of the queries with links; a root is a node of the query's tree."""
        links, root = _reduced(self.graph, unit(vectors), own, self.vectors, self.ids, self.weights, self.threshold,
                               self.beam, self.slack, self.ways)
        asked, reached = root[:len(own)], root[len(own):]
        nodes = np.flatnonzero(reached < len(own))  # a tree with links has a query as its root
        least = np.full(len(own), -1)
        least[reached[nodes[::-1]]] = nodes[::-1]  # the last one written stays
        _unite(self.root, least[reached[nodes]], nodes)
        some = np.flatnonzero(least[asked] >= 0)
        return _found(own[some], links[some], self.ids[least[asked[some]]])

    def forest(self) -> pa.RecordBatch:
        """The same of the nodes that are not the root of their tree."""
        some = np.flatnonzero(self.root != np.arange(len(self.root)))
        return _found(self.ids[some], np.zeros(len(some), np.int64), self.ids[self.root[some]])


def _found(ids: np.ndarray, links: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"id": ids, "links": links, "root": root})


def shard_links(graphs: DataFrame, classes: DataFrame, shards: int, blocks: int, threshold: float) -> DataFrame:
    """(id, root, links) of all vectors with a link, for each shard and block of queries."""
    by = ["dims", "shard", "block"]
    asked = classes.select(
        "dims", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("id", F.lit("query")), F.lit(blocks)).cast("int").alias("block"), F.lit(None).cast("int").alias("part"),
        F.lit(None).cast("binary").alias("piece"), "id", "vector")
    kept = graphs.select("dims", "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", "piece",
                         F.lit(None).cast("bigint").alias("id"), F.lit(None).cast(classes.schema["vector"].dataType).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pieces, shard = None, [], None
        for key, rows in _runs(batches, by):
            if key != last:
                if shard:
                    yield shard.forest()
                last, pieces, shard = key, [], None
            n = len(rows) - rows.column("part").null_count  # pieces come before queries
            pieces += [x.as_buffer() for x in rows.column("piece")[:n]]
            if n == len(rows):
                continue
            if not shard:
                if not pieces:
                    continue  # no vectors of this length in the shard
                shard, pieces = Shard(pieces, threshold), []
            for start in range(n, len(rows), QUERIES):
                part = rows.slice(start, QUERIES)
                yield shard.links(part.column("id").to_numpy(zero_copy_only=False), _matrix(pa.chunked_array([part.column("vector")])))
        if shard:
            yield shard.forest()

    return (asked.unionByName(kept).repartitionById(shards * blocks, F.expr(f"shard * {blocks} + block"))
            .sortWithinPartitions(*by, F.col("part").asc_nulls_last()).mapInArrow(run, "id bigint, links bigint, root bigint"))


def embedding_components(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    kind, wide = rows.schema[embedding].dataType, F.col(embedding).cast("array<double>")
    vector = F.col(embedding) if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else wide
    keyed = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), vector.alias("vector"), usable(vector).alias("fine"))
    keyed = keyed.withColumns({"fine": F.col("fine") & F.col("vec_id").isNotNull(),
                               "h": F.xxhash64(F.col("vector").cast("array<double>")),
                               "g": F.xxhash64(F.lit("second"), F.col("vector").cast("array<double>"))})
    linkable = keyed.where("fine")
    classes = linkable.groupBy("h", "g").agg(F.min("vec_id").alias("class"), F.count("*").alias("n_rows"), F.first("vector").alias("vector"))
    classes = stored(classes.select("*", F.size("vector").alias("dims"), F.monotonically_increasing_id().alias("id")), "classes")
    n, numbers = classes.agg(F.count("*"), F.coalesce(F.sum("dims"), F.lit(0))).first()
    width = 8 if vector is wide else 4
    shards = max(SHARDS, -(-n // SHARD), -(-numbers * width // SHARD_BYTES))
    blocks = max(1, min(BLOCKS, -(-n // QUERIES)), -(-n // ASKED))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = stored(shard_graphs(dealt, shards, threshold), "graphs")
    found = stored(shard_links(graphs, classes, shards, blocks, threshold), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = stored(connected_components(found, "id", "root").withColumnRenamed("node", "id"), "groups")
    least = groups.join(classes.select("id", "class"), "id").groupBy("component").agg(F.min("class").alias("component_id"))
    by_class = (classes.select("id", "h", "g", "class", "n_rows").join(links, "id", "left")
                .join(groups.join(least, "component").select("id", "component_id"), "id", "left"))
    joined = linkable.select("vec_id", "h", "g").join(by_class, ["h", "g"]).select(
        "vec_id", (F.col("n_rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "class").alias("component_id"))
    alone = keyed.where("not fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


@query("op10_embedding_near_dedup")
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
