"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

A document's size is its number of words. Sources in order of code points, null last, have the weights
3, 1, 2, repeating, and share 150 % of all sizes; no source gets more than twice its size, and what a
source cannot take is shared by weight among the others until none is above its limit. Where the limits
bind in order of limit over weight, the rest goes by one common rate, found from running sums.

A target is reached by whole rounds over the source and a part of one more round. The part is the
documents whose hash lies below a threshold: sizes are summed by source and the first digits of the
hash, the threshold falls into one of these buckets, and only that bucket's documents are summed again
by the next digits. After ``LEVELS`` levels the last bucket (a document, or rows with the same doc_id)
is taken if more than half of it fits. Nothing is sorted but the sums, and reruns agree.

A null or empty text has size 0; its target is its source's and it takes nothing. Rows with the same
doc_id are taken alike, also those with none, which share the hash of a null. Sources without words get
target 0. Extra columns pass through ``take_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query
from .store import stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2  # of all sizes, and of a source's size
DIGITS, LEVELS = 3, 3  # hexadecimal digits of the hash that a level reads


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of sources with their ``source_size``."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1)
    ranked = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * MOST)
    everything = Window.partitionBy()
    bound = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    ranked = ranked.withColumns({
        "budget": F.sum("source_size").over(everything) * F.lit(SHARE),
        "limits_before": F.sum("limit").over(bound) - F.col("limit"),
        "weight_left": F.sum("weight").over(everything) - F.sum("weight").over(bound) + F.col("weight"),
    })
    # a source is at its limit if the rate left for it and those behind it reaches the limit
    ranked = ranked.withColumn("full", F.col("limit") * F.col("weight_left") <= (F.col("budget") - F.col("limits_before")) * F.col("weight"))
    ranked = ranked.withColumns({
        "full_limits": F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(everything), F.lit(0)),
        "open_weights": F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything),
    })
    open_target = F.col("weight") * (F.col("budget") - F.col("full_limits")) / F.col("open_weights")
    return ranked.select("source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(open_target).alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(of, rounds, threshold): whole rounds over source ``of``, and the hash below which a document goes once more.

    sized: source, size, hash. A threshold ends in ``~``, which sorts behind all digits, to take its last bucket in.
    """
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    part = targets.select(F.col("source").alias("of"), rounds.alias("rounds"),
                          (F.col("target") - rounds * F.col("source_size")).alias("rest"), F.lit("").alias("prefix"))
    same = F.expr("source <=> of")
    for level in range(LEVELS):
        digits = F.substring("hash", level * DIGITS + 1, DIGITS).alias("digits")
        inside = sized.join(part, same).where(F.col("hash").startswith(F.col("prefix")))
        buckets = inside.groupBy("of", "rounds", "rest", "prefix", digits).agg(F.sum("size").alias("bucket"))
        run = buckets.withColumn("upto", F.sum("bucket").over(Window.partitionBy("of").orderBy("digits")))
        # the first bucket in which the running sum passes the rest
        past = run.where("upto > rest").groupBy("of").agg(
            F.min_by(F.struct("rounds", (F.col("rest") - F.col("upto") + F.col("bucket")).alias("rest"),
                              F.concat("prefix", "digits").alias("prefix"), "bucket"), "digits").alias("at"))
        part = past.select("of", "at.rounds", "at.rest", "at.prefix", "at.bucket")
        if level < LEVELS - 1:
            part = part.drop("bucket")
    tail = F.when(2 * F.col("rest") > F.col("bucket"), F.lit("~")).otherwise(F.lit(""))
    return part.select("of", "rounds", F.concat("prefix", tail).alias("threshold"))


def _hash(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def mix_plan(docs: DataFrame, seed: str = "") -> DataFrame:
    """(of, source_size, target, rounds, threshold) of every source of the documents."""
    sized = stored(docs.select("source", word_count(F.col("text")).alias("size"), _hash(seed).alias("hash")), "sized")
    targets = stored(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    cuts = thresholds(sized, targets).withColumnRenamed("of", "cut")
    plan = targets.join(cuts, F.expr("source <=> cut"), "left")
    return stored(plan.select(F.col("source").alias("of"), "source_size", "target", F.coalesce("rounds", F.lit(0)).alias("rounds"),
                              F.coalesce("threshold", F.lit("")).alias("threshold")), "plan")


def _copies(docs: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    once_more = (_hash(seed) < F.col("threshold")).cast("int")
    return docs.join(plan, F.expr("source <=> of")).withColumn("copies", F.col("rounds") + once_more)


def mix_sources(docs: DataFrame, seed: str = "") -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every row; needs doc_id, text and source."""
    marked = _copies(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), mix_plan(docs, seed), seed)
    return marked.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def take_mix(docs: DataFrame, seed: str = "") -> DataFrame:
    """The documents of the mix: each row as often as the mix takes it."""
    marked = _copies(docs, mix_plan(docs, seed), seed).where("copies > 0")
    return marked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ 	-]+'))::BIGINT AS size,
    substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 9) AS h FROM documents),
s AS (
  SELECT source, source_size, source_size * 2 AS cap, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
r AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    sum(cap) OVER b - cap AS caps_before, sum(w) OVER () - sum(w) OVER b + w AS w_left
  FROM s WINDOW b AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
f AS (SELECT *, cap * w_left <= (budget - caps_before) * w AS full_up FROM r),
t AS (
  SELECT source, source_size, CASE WHEN full_up THEN cap::DOUBLE ELSE
    w * (budget - coalesce(sum(cap) FILTER (full_up) OVER (), 0)) / sum(w) FILTER (NOT full_up) OVER () END AS target
  FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::INT AS rounds FROM t),
buckets AS (
  SELECT source, h, sum(size)::BIGINT AS bucket, sum(sum(size)) OVER (PARTITION BY source ORDER BY h)::BIGINT AS upto
  FROM d GROUP BY source, h),
last AS (
  SELECT p.source, min_by(h, h) AS h, min_by(target - rounds * source_size - upto + bucket, h) AS rest, min_by(bucket, h) AS bucket
  FROM p JOIN buckets b ON p.source IS NOT DISTINCT FROM b.source WHERE upto > target - rounds * source_size GROUP BY p.source)
SELECT d.doc_id, d.size, p.source_size, p.target, d.source,
  (d.size * (rounds + CASE WHEN d.h < last.h OR (d.h = last.h AND 2 * rest > bucket) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN last ON last.source IS NOT DISTINCT FROM d.source
"""


@query("op7_source_mix", _SQL)
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
