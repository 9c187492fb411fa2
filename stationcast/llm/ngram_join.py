"""Similarity join on word shingles by an LSH forest of MinHash signatures, verified exactly.

Shingles are the sets of five consecutive words (a text of one to four words is one shingle); two
texts link if the Jaccard similarity of their sets is at least 0.8. Rows with the same words form a
class, and only one text per class goes on.

A forest holds ``TREES`` prefix tries over signatures. All trees are searched at one prefix length. In
the bucket of a prefix the texts are compared with its head by their signatures: those far from it are
no candidates, those near to it are done, as what links with them is not far from the head, and the rest
of the bucket goes on with a head of its own. A bucket that still has members after ``HEADS`` heads takes
them all as candidates. So a passage that very many texts share does not make them one group.

From the agreement s of heads with their near texts and the chance 1 - (1 - s^k)^trees of meeting at
length k, the recall is estimated; while it is below the target, the prefixes are shortened, which only
adds candidates.

The candidates' components are dealt to blocks of bounded size and compared exactly, block against
block, so a group of any size is neither gathered in a task nor written out as pairs.

Result, a row per document: ``class_id`` (smallest doc_id with the same words), ``n_links`` (other
rows linked directly, copies included), ``component_id`` (smallest doc_id reachable by links) and
``kept`` (doc_id = component_id). Texts without a word, null texts and rows without doc_id link with
nothing, are their own class and are kept. Repeated rows count as copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .registry import query
from .store import stored
from .words import ODD, Block, blocks, mix, powers

SHINGLE = 5
NUM, DEN = 4, 5  # the threshold 0.8 as a fraction, so that comparisons are exact
TREES, DEPTHS = 32, (6, 5, 4)
TARGET_RECALL = 0.9995
COMPARED = 96  # hashes of a signature that are compared; TREES * max(DEPTHS) make the prefixes
FAR, NEAR = 0.5, 0.85  # agreement below and above: 0.8 for a link, less 0.2 for a near text's link and 0.1 for chance
HEADS = 4
BLOCK = 1024  # texts of one side of a comparison

SECOND = 0x9FB21C651E98DF25
_SEEDS = mix(np.arange(1, 2 * TREES * max(DEPTHS) + 1, dtype=np.uint64)).reshape(2, -1)


def word_keys(block: Block, hashes: np.ndarray) -> np.ndarray:
    """128-bit key of each document's word sequence, as two columns."""
    out = np.zeros((len(block.bounds) - 1, 2), np.uint64)
    for k, base in enumerate((ODD, SECOND)):
        power, back = powers(base, len(hashes) + 1), powers(pow(base, -1, 1 << 64), len(hashes) + 1)
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[:-1], out=sums[1:])
        a, b = block.bounds[:-1], block.bounds[1:]
        out[:, k] = mix((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))
    return out


def shingles(block: Block, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in order of documents, and each document's bounds among them."""
    at, keys = block.windows(hashes, SHINGLE)
    n = block.n_words
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = word_keys(block, hashes)[short, 0]
    at = np.concatenate([at, block.bounds[short]])
    keys = np.concatenate([keys, whole])
    order = np.argsort(at, kind="stable")
    return keys[order], np.searchsorted(at[order], block.bounds)


def prefix_keys(keys: np.ndarray, bounds: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For each prefix length the keys of every tree, a row per document, and the compared hashes.

    Documents without words get 0.
    """
    full = bounds[1:] > bounds[:-1]
    heads = bounds[:-1][full]
    depth = max(DEPTHS)
    out = {d: np.zeros((len(full), TREES), np.uint64) for d in DEPTHS}
    hashes = np.zeros((len(full), COMPARED), np.uint32)
    for tree in range(TREES):
        key = np.full(full.sum(), tree + 1, np.uint64)
        for level in range(depth):
            j = tree * depth + level
            least = np.minimum.reduceat((keys ^ _SEEDS[0, j]) * (_SEEDS[1, j] | np.uint64(1)), heads) if len(heads) else key
            key = mix(key * np.uint64(ODD) + least)
            if level + 1 in out:
                out[level + 1][full, tree] = key
            if j < COMPARED:
                hashes[full, j] = mix(least) >> np.uint64(32)
    return out, hashes


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(values.reshape(-1).view(np.int64 if values.dtype == np.uint64 else np.int32))
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), flat)


def _key_column(keys: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(keys).tobytes()
    return pa.array([raw[i:i + 16] for i in range(0, len(raw), 16)], pa.binary())


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, hashes, p<depth>...) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, block in blocks(batch, "text"):
                hashes = block.hashes()
                prefixes, compared = prefix_keys(*shingles(block, hashes))
                out = {
                    "doc_id": batch.column("doc_id").slice(start, end - start),
                    "key": _key_column(word_keys(block, hashes)),
                    "n_words": pa.array(block.n_words, pa.int64()),
                    "hashes": _lists(compared),
                }
                yield pa.record_batch(out | {f"p{d}": _lists(v) for d, v in prefixes.items()})

    columns = ", ".join(f"p{d} array<bigint>" for d in DEPTHS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, key binary, n_words bigint, hashes array<int>, {columns}")


def candidate_edges(classes: DataFrame, depth: int) -> tuple[DataFrame, float]:
    """(id, head): classes with the heads of their buckets that they may link with or near to; estimated recall."""
    leaves = classes.select("id", F.posexplode(f"p{depth}").alias("tree", "prefix"))
    hashes = classes.select("id", "hashes")
    bucket, edges, found, expected = ["tree", "prefix"], None, 0, 0.0
    meet = 1 - F.pow(1 - F.pow(F.col("same") / COMPARED, F.lit(depth)), F.lit(TREES))
    for turn in range(HEADS):
        heads = leaves.groupBy(*bucket).agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
        members = leaves.join(heads, bucket).where("id != head")
        # a row per text and head, with the at most TREES buckets in which they meet
        pairs = members.groupBy("id", "head").agg(F.collect_list(F.struct(*bucket)).alias("met"))
        pairs = pairs.join(hashes, "id").join(hashes.toDF("head", "other"), "head")
        same = F.aggregate(F.zip_with("hashes", "other", lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y)
        scored = stored(pairs.select("id", "head", "met", same.alias("same")), "scored")
        linked = F.when(F.col("same") * DEN >= NUM * COMPARED, 1 / meet)
        counted = scored.agg(F.count(linked), F.sum(linked), F.count(F.when(F.col("same") < NEAR * COMPARED, True))).first()
        found, expected = found + counted[0], expected + (counted[1] or 0.0)
        near = scored.where(F.col("same") >= FAR * COMPARED).select("id", "head")
        edges = edges.union(near) if edges else near
        if not counted[2]:
            break
        rest = scored.where(F.col("same") < NEAR * COMPARED)
        if turn == HEADS - 1:
            edges = edges.union(rest.select("id", "head"))
        leaves = rest.select("id", F.inline("met"))
    return edges, found / expected if expected else 1.0


def _shared(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Set number and element number of the elements that two or more sets hold."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat)
    flat, owner = flat[order], owner[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    number = np.cumsum(first) - 1
    more = np.bincount(number) > 1
    keep = more[number]
    renumber = np.cumsum(more) - 1
    return owner[keep], renumber[number[keep]], int(more.sum())


def common_elements(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Numbers of elements that sets have in common: left against right, or left against itself."""
    n = len(left)
    owner, element, width = _shared(left if right is None else left + right)
    m = n if right is None else len(right)
    out = np.zeros((n, m), np.int32)
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    step = max(256, (1 << 23) // max(n, m))
    for at in range(0, width, step):
        part = slice(*np.searchsorted(element, [at, at + step]))
        total = n if right is None else n + m
        table = np.zeros((total, min(step, width - at)), np.float32)
        table[owner[part], element[part] - at] = 1
        out += np.rint(table[:n] @ (table if right is None else table[n:]).T).astype(np.int32)
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index of a symmetric link matrix."""
    root = np.arange(len(links))
    seen = np.zeros(len(links), bool)
    for i in range(len(links)):
        if not seen[i] and links[i].any():
            reach = front = np.arange(len(links)) == i
            while front.any():
                front = links[front].any(0) & ~reach
                reach = reach | front
            seen |= reach
            root[reach] = i
    return root


def compare(side: np.ndarray, sets: list[np.ndarray], weight: np.ndarray, cross: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Root, linked rows and whether there is a link, of each set: all with all, or side 0 with side 1."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    links = np.zeros((n, n), bool)
    a, b = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(n), np.arange(n))
    if len(a) and len(b):
        both = common_elements([sets[i] for i in a], [sets[i] for i in b] if cross else None)
        union = size[a][:, None] + size[b][None, :] - both
        close = (DEN * both >= NUM * union) & (both > 0)
        if not cross:
            np.fill_diagonal(close, False)
        links[np.ix_(a, b)] = close
        if cross:
            links[np.ix_(b, a)] = close.T
    return _roots(links), links @ weight, links.any(1)


def verified(members: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, root, links, parts) of the members of candidate groups that have a link.

    members: id, key, doc_id, n_rows, component, parts, part. A group goes in ``parts`` blocks; every pair
    of blocks is compared once. Texts are fetched by doc_id and told apart by their key.
    """
    texts = members.join(docs.select("doc_id", "text"), "doc_id")
    dealt = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"),
        (F.col("part") > F.col("other")).cast("int").alias("side"), "id", "key", "n_rows", "parts", "text")
    group = ["component", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in groupby(_members(batches), key=lambda r: r[0]):
            found = {}
            for _, side, own, n_rows, parts, keys in rows:
                found.setdefault(own, (side, n_rows, parts, keys))
            names = sorted(found)
            if len(names) < 2:
                continue
            side = np.array([found[k][0] for k in names])
            weight = np.array([found[k][1] for k in names], np.int64)
            root, links, some = compare(side, [found[k][3] for k in names], weight, i != j)
            some = np.flatnonzero(some)
            if len(some):
                yield pa.record_batch({
                    "id": pa.array([names[k] for k in some], pa.int64()),
                    "root": pa.array([names[root[k]] for k in some], pa.int64()),
                    "links": links[some], "parts": pa.array([found[names[k]][2] for k in some], pa.int32()),
                })

    return (dealt.repartition(*group).sortWithinPartitions(*group)
            .mapInArrow(run, "id bigint, root bigint, links bigint, parts int"))


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(group, side, id, rows, parts, shingle set) of each row whose text has the key it stands for."""
    for batch in batches:
        group = list(zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j"))))
        side, ids, key, n_rows, parts = (batch.column(c).to_pylist() for c in ("side", "id", "key", "n_rows", "parts"))
        for start, _, block in blocks(batch, "text"):
            hashes = block.hashes()
            own = word_keys(block, hashes)
            keys, bounds = shingles(block, hashes)
            for k in range(len(own)):
                r = start + k
                if own[k].tobytes() == key[r]:
                    yield group[r], side[r], ids[r], n_rows[r], parts[r], np.unique(keys[bounds[k]:bounds[k + 1]])


def candidate_members(classes: DataFrame, edges: DataFrame) -> DataFrame:
    groups = stored(connected_components(edges, "id", "head", "candidates"), "candidates")
    parts = groups.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("parts"))
    return (groups.join(parts, "component").withColumnRenamed("node", "id")
            .join(classes.select("id", "key", "doc_id", "n_rows"), "id")
            .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))


def linked_groups(found: DataFrame) -> DataFrame:
    """(id, component) from verified links; a group compared as one block has its components already."""
    whole = found.where("parts = 1").select("id", F.col("root").alias("component"))
    dealt = found.where("parts > 1")
    if dealt.isEmpty():
        return whole
    return stored(whole.union(connected_components(dealt, "id", "root", "linked")), "linked")


def similarity_join(docs: DataFrame) -> DataFrame:
    """Classes, links and components of all documents (needs doc_id and text)."""
    docs = docs.select(F.col("doc_id").cast("bigint"), "text")
    rows = stored(signatures(docs), "signatures")
    linkable = rows.where("n_words > 0 and doc_id is not null")
    # equal rows have equal signatures; the id of a class is fixed by writing it
    signed = [F.first(c).alias(c) for c in ("hashes", *(f"p{d}" for d in DEPTHS))]
    classes = linkable.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"), *signed)
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    for depth in DEPTHS:
        edges, recall = candidate_edges(classes, depth)
        if recall >= TARGET_RECALL:
            break
    found = stored(verified(candidate_members(classes, edges), docs), "verified")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = linked_groups(found)
    ids = groups.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = (classes.select("id", "key", F.col("doc_id").alias("class_id"), "n_rows").join(links, "id", "left")
                .join(groups.join(ids, "component").select("id", "component_id"), "id", "left"))
    joined = linkable.select("doc_id", "key").join(by_class, "key").select(
        "doc_id", "class_id", (F.col("n_rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "class_id").alias("component_id"))
    alone = rows.where("n_words = 0 or doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, CASE WHEN len(w) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY array_to_string(w, ' ')) END AS class_id,
  coalesce(n_links, 0)::BIGINT AS n_links, component_id, doc_id = component_id AS kept
FROM d JOIN c ON c.a = doc_id LEFT JOIN k ON k.a = doc_id
"""


@query("op5_ngram_jaccard_join", _SQL)
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
