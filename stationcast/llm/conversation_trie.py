"""Prefix trie of rebuilt conversations by ROLLUP over blocks of turn columns.

Conversation c begins with the first h turns of conversation c - c % 100 (all of them if it has fewer,
none if it does not exist), h = crc32(c) % 6, and goes on with its own turns behind its first h.

Turns become two numbers of a digest and a length before anything is shuffled. A conversation is cut into
blocks of ``WIDTH`` positional columns, and a block is keyed by the node at which the block before it ends:
sums over all turns so far of hashes of turn and position. ``ROLLUP`` over the columns aggregates all
prefixes of all blocks together, ``grouping_id`` tells a prefix's depth in its block. The first rollup gives
members and smallest member of each node. A conversation is the smallest member of a node and of all below
it on its path, so what a subtree saves is a sum over members: the turns above the first node of which the
member is the smallest; and a childless node counts for its smallest member. The second rollup adds these
up per node, at every depth at once; no step goes through the trie level by level.

A conversation of any length is numbered by running sums over buckets of ``BUCKET`` turn numbers and within
them, so it is spread over tasks; only rows with one conversation and one turn number stay together.
Members that end at a node are digested in order, from chunks of neighbouring conv_ids, as a stream.

Rows without a conv_id belong to no conversation and are left out. Rows with equal turn numbers are all
turns, in order of their digest; a null turn number comes first; null roles and texts are empty. Extra
columns are ignored. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query
from .store import stored

WIDTH = 8  # turn columns of a block
BUCKET_BITS = 10  # of turn numbers, and of blocks
CHUNK_BITS = 13  # of conv_ids digested together
FAMILY, HEADS = 100, 6
NODE = ["depth", "s1", "s2"]
SLOTS = range(1, WIDTH + 1)


def _prefix_sums(df: DataFrame, key: str, bucket: Column, order: list[Column], values: list[str]) -> DataFrame:
    """Adds ``<value>_before``: the sum over the key's rows in front; ``bucket`` must rise along the order."""
    cut = df.withColumn("bucket", bucket)
    totals = cut.groupBy(key, "bucket").agg(*(F.sum(v).alias(v) for v in values))
    ahead = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    totals = totals.select(key, "bucket", *(F.coalesce(F.sum(v).over(ahead), zero).alias(f"{v}_ahead") for v in values))
    local = cut.withColumns({f"{v}_inside": F.coalesce(F.sum(v).over(inside), zero) for v in values}).join(totals, [key, "bucket"])
    found = {f"{v}_before": F.col(f"{v}_ahead") + F.col(f"{v}_inside") for v in values}
    return local.withColumns(found).drop("bucket", *(f"{v}_{at}" for v in values for at in ("ahead", "inside")))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, len): the turn's digest as two numbers of 60 bits, and its code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        part(1).alias("a"), part(16).alias("b"), F.length(text).cast("bigint").alias("len"))


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, n_total, pos, a, b, len) of all rebuilt turns, and (conv_id, n_total) of all conversations."""
    before_all = -(1 << 62)  # bucket of rows without a turn number
    bucket = F.coalesce(F.shiftright("turn", BUCKET_BITS), F.lit(before_all))
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    numbered = _prefix_sums(rows.withColumn("one", F.lit(1).cast("bigint")), "conv_id", bucket, order, ["one"])
    numbered = stored(numbered.select("conv_id", (F.col("one_before") + 1).alias("pos"), "a", "b", "len"), "numbered")
    crc = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    convs = numbered.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({
        "base": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": crc % HEADS})
    bases = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = F.least("h", F.coalesce("base_n", F.lit(0))).alias("heads")
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", "n", heads).withColumn(
        "n_total", F.col("heads") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stored(convs, "conversations")
    given = numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).withColumnRenamed("conv_id", "base")
    given = convs.select("conv_id", "base", "heads", "n_total").join(given, "base").where("pos <= heads")
    own = numbered.join(convs.select("conv_id", "h", "heads", "n_total"), "conv_id").where("pos > h")
    own = own.withColumn("pos", F.col("pos") - F.col("h") + F.col("heads"))
    columns = ["conv_id", "n_total", "pos", "a", "b", "len"]
    return given.select(columns).union(own.select(columns)), convs.select("conv_id", "n_total")


def _hashes(a: Column, b: Column, pos: Column) -> tuple[Column, Column]:
    wide = "decimal(38,0)"
    return F.xxhash64(a, b, pos).cast(wide), F.xxhash64(pos, b, a, F.lit("second")).cast(wide)


def blocks(rebuilt_turns: DataFrame) -> DataFrame:
    """(conv_id, n_total, block, t1 ... t8, h1, h2, h1_before, h2_before); a t holds a, b, len or is null."""
    pos = F.col("pos")
    h1, h2 = _hashes(F.col("a"), F.col("b"), pos)
    cut = rebuilt_turns.select(
        "conv_id", "n_total", F.floor((pos - 1) / WIDTH).alias("block"), ((pos - 1) % WIDTH + 1).alias("slot"), "a", "b", "len",
        h1.alias("h1"), h2.alias("h2"))
    part = [F.max(F.when(F.col("slot") == k, F.col(c))).alias(f"{c}{k}") for k in SLOTS for c in ("a", "b", "len")]
    rows = cut.groupBy("conv_id", "block").agg(F.max("n_total").alias("n_total"), F.sum("h1").cast("decimal(38,0)").alias("h1"),
                                               F.sum("h2").cast("decimal(38,0)").alias("h2"), *part)
    columns = [F.when(F.col(f"a{k}").isNotNull(), F.struct(F.col(f"a{k}").alias("a"), F.col(f"b{k}").alias("b"), F.col(f"len{k}").alias("len")))
               .alias(f"t{k}") for k in SLOTS]
    rows = rows.select("conv_id", "n_total", "block", "h1", "h2", *columns)
    return _prefix_sums(rows, "conv_id", F.shiftright("block", BUCKET_BITS), [F.col("block")], ["h1", "h2"])


def _rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """Aggregates of every prefix, with its node (depth, s1, s2), ``k`` turns into its block, and t1 ... t8."""
    names = ", ".join(f"t{k}" for k in SLOTS)
    found = rows.sparkSession.sql(
        f"SELECT block, h1_before, h2_before, {names}, {WIDTH} - bit_count(grouping_id()) AS k, {aggregates} "
        f"FROM {{rows}} GROUP BY block, h1_before, h2_before, ROLLUP ({names})", rows=rows)
    last = F.element_at(F.array(*(f"t{k}" for k in SLOTS)), F.col("k"))
    found = found.where("k > 0").withColumn("last", last).where("last is not null")
    hashes = [_hashes(F.col(f"t{k}.a"), F.col(f"t{k}.b"), F.col("block") * WIDTH + k) for k in SLOTS]
    depth = (F.col("block") * WIDTH + F.col("k")).cast("bigint")
    sums = {}
    for i, name in enumerate(("s1", "s2")):
        total = F.col(f"h{i + 1}_before")
        for k in SLOTS:
            total = total + F.when(F.col("k") >= k, hashes[k - 1][i]).otherwise(F.lit(0))
        sums[name] = total.cast("decimal(38,0)")
    return found.withColumns({"depth": depth} | sums)


def nodes(rows: DataFrame) -> DataFrame:
    """(depth, s1, s2, p1, p2, conv_id, n_convs, len, n_children) of every node below the root; p names its parent."""
    found = _rollup(rows, "min(conv_id) AS conv_id, count(*) AS n_convs")
    own = _hashes(F.col("last.a"), F.col("last.b"), F.col("depth"))
    parent = {f"p{i + 1}": (F.col(f"s{i + 1}") - own[i]).cast("decimal(38,0)") for i in range(2)}
    found = stored(found.withColumns(parent).select(*NODE, "p1", "p2", "conv_id", "n_convs", F.col("last.len").alias("len")), "nodes")
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("s1"), F.col("p2").alias("s2")).agg(F.count("*").alias("n_children"))
    return stored(found.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes-children")


def subtrees(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(depth, s1, s2, n_leaves, saved_tokens) of every node below the root."""
    roles = members.groupBy("conv_id").agg(F.min("depth").alias("first"), F.max((F.col("n_children") == 0).cast("bigint")).alias("leaf"))
    known = rows.join(roles, "conv_id", "left")
    above = lambda k: F.col("first").isNull() | (F.col("block") * WIDTH + k < F.col("first"))
    saves = {f"v{k}": F.when(F.col(f"t{k}").isNotNull() & above(k), F.col(f"t{k}.len")).otherwise(F.lit(0)) for k in SLOTS}
    known = known.withColumns(saves).withColumn("v", sum((F.col(f"v{k}") for k in SLOTS), F.lit(0)).cast("bigint"))
    known = _prefix_sums(known, "conv_id", -F.shiftright("block", BUCKET_BITS), [F.col("block").desc()], ["v"])
    rest = {f"w{k}": F.col("v_before") + sum((F.col(f"v{j}") for j in SLOTS if j >= k), F.lit(0)) for k in SLOTS}
    found = _rollup(known.withColumns(rest).withColumn("leaf", F.coalesce("leaf", F.lit(0))),
                    "sum(leaf) AS n_leaves, " + ", ".join(f"sum(w{k}) AS w{k}" for k in SLOTS))
    saved = F.element_at(F.array(*(f"w{k}" for k in SLOTS)), F.col("k"))
    return found.select(*NODE, "n_leaves", saved.alias("saved_tokens"))


def ends(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, s1, s2, ends_sha256) of nodes, the root included, at which conversations end."""
    last = rows.where(F.col("block") == F.floor((F.col("n_total") - 1) / WIDTH)).select(
        F.col("n_total").alias("depth"), *((F.col(f"h{i}_before") + F.col(f"h{i}")).cast("decimal(38,0)").alias(f"s{i}") for i in (1, 2)), "conv_id")
    none = F.lit(0).cast("decimal(38,0)")
    empty = convs.where("n_total = 0").select(F.lit(0).cast("bigint").alias("depth"), none.alias("s1"), none.alias("s2"), "conv_id")
    chunks = last.union(empty).groupBy(*NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))  # at most 2 ** CHUNK_BITS of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None

        def done() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0)]
            return pa.record_batch({c: pa.array([v], t) for c, v, t in zip(NODE, node, kinds)} | {"ends_sha256": [digest.hexdigest()]})

        for batch in batches:
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if own == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        yield done()
                    node, digest = own, hashlib.sha256()
                digest.update(ids.encode())
        if node is not None:
            yield done()

    dealt = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    return dealt.mapInArrow(run, "depth bigint, s1 decimal(38,0), s2 decimal(38,0), ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row per node; needs conv_id, turn, role and text."""
    every, convs = rebuilt(stored(turns(conversations), "turns"))
    rows = stored(blocks(every), "blocks")
    below = nodes(rows)
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    first = root.first()["conv_id"]
    tops = below.agg(F.count(F.when(F.col("depth") == 1, True)).alias("n_children"),
                     F.greatest(F.count(F.when(F.col("n_children") == 0, True)), F.lit(1)).alias("n_leaves"),
                     F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("len")), F.lit(0)).alias("saved_tokens")).first()
    none = F.lit(0).cast("decimal(38,0)")
    root = root.where("n_convs > 0").select(
        F.lit(0).cast("bigint").alias("depth"), none.alias("s1"), none.alias("s2"), "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"),
        "n_convs", *(F.lit(tops[c]).cast("bigint").alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    # the children of the root know their parent; the others look it up
    parents = below.select((F.col("depth") + 1).alias("depth"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("conv_id").alias("parent"))
    known = below.join(parents, ["depth", "p1", "p2"], "left").join(subtrees(rows, below), NODE)
    parent = F.when(F.col("depth") == 1, F.lit(first).cast("bigint")).otherwise(F.col("parent")).alias("parent_conv_id")
    every_node = root.union(known.select(*NODE, "conv_id", parent, "n_convs", "n_children", "n_leaves", "saved_tokens"))
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return every_node.join(ends(rows, convs), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS txt,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(len(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
crc AS (
  SELECT DISTINCT conv_id, 0 AS step, 4294967295::UBIGINT AS c FROM t
  UNION ALL
  SELECT conv_id, step + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) FROM (
    SELECT conv_id, step, CASE WHEN step % 8 = 0 THEN xor(c, ascii(substr(conv_id::VARCHAR, step // 8 + 1, 1))::UBIGINT) ELSE c END AS x
    FROM crc WHERE step < 8 * len(conv_id::VARCHAR))),
h AS (SELECT conv_id, (xor(c, 4294967295::UBIGINT) % 6)::BIGINT AS h FROM crc WHERE step = 8 * len(conv_id::VARCHAR)),
given AS (SELECT h.conv_id, 0 AS own, pos, role, txt FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND pos <= h),
every AS (
  SELECT * FROM given UNION ALL SELECT conv_id, 1 AS own, pos, role, txt FROM t JOIN h USING (conv_id) WHERE pos > h),
seqs AS (
  SELECT conv_id, coalesce(list({'role': role, 'txt': txt} ORDER BY own, pos) FILTER (role IS NOT NULL), []) AS s
  FROM h LEFT JOIN every USING (conv_id) GROUP BY conv_id),
prefixes AS (SELECT conv_id, len(s) AS total, unnest(range(0, len(s) + 1)) AS depth, s FROM seqs),
member AS (SELECT conv_id, total, depth, s[1:depth] AS p, s[depth].txt AS txt FROM prefixes),
node AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth > 0 THEN len(txt) ELSE 0 END) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends_sha256
  FROM member GROUP BY p, depth),
child AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (p)),
up AS (SELECT p, n_convs, size, n_children, unnest(range(0, depth + 1)) AS d FROM full_node),
below AS (SELECT p[1:d] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size)::BIGINT AS saved_tokens FROM up GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_node n JOIN below USING (p) LEFT JOIN full_node q ON n.depth > 0 AND q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1]
"""


@query("op12_conversation_trie", _SQL)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
