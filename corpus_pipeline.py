"""Corpus pipeline: each stage reads the whole table that the stage before it wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet
and read back as the documents of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationcast.llm.ngram_join import similarity_join
from stationcast.llm.quality_rules import judge_documents
from stationcast.llm.sentencepiece_codec import encode_documents, public_model
from stationcast.llm.source_mix import take_mix
from stationcast.llm.store import stored
from stationcast.llm.substring_dedup import dedup_substrings
from stationcast.session import workers_import_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, with ``text`` as the text and its length."""
    body = F.col(text)
    return df.select("doc_id", body.alias("text"), "lang", "source", F.length(body).cast("bigint").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that the rules reject."""
    judged = judge_documents(docs.select(*COLUMNS), clean="cleaned")
    return _documents(judged.where("kept"), "cleaned")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id.

    Of equal rows with one doc_id a single one stays; rows without doc_id link with nothing and stay.
    """
    kept = similarity_join(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    rows = Window.partitionBy("doc_id").orderBy("text")
    named = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").withColumns(
        {"nth": F.row_number().over(rows), "before": F.lag("text").over(rows)})
    once = named.where("nth = 1 or not (before <=> text)").select(*COLUMNS)
    return once.union(docs.select(*COLUMNS).where("doc_id is null"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated passages are cut from the texts; all rows stay."""
    return _documents(dedup_substrings(docs.select(*COLUMNS), clean="cleaned"), "cleaned")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; documents that it leaves out go."""
    return take_mix(docs.select(*COLUMNS))


def sentencepiece_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with begin and end ids, and hashes of the ids and of the decoded text."""
    return encode_documents(docs.select(*COLUMNS), public_model(), digest=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", source_mix),
    ("SentencePiece encoding and decoding", sentencepiece_codec),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    workers_import_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-").lower())
    return docs
