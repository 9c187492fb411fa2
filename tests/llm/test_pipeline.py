import hashlib

import numpy as np
import sentencepiece

import corpus_pipeline
from stationcast.llm.sentencepiece_codec import public_model
from stationcast.llm.store import stored

from . import reference


def test_stages_one_by_one(spark, sf_dir):
    """Each stage against plain Python on what the stage before it returned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    checks = [reference.quality, reference.join, reference.dedup, reference.mix]
    for (name, stage), check in zip(corpus_pipeline.STAGES, checks):
        out = stored(stage(spark, docs, sf_dir), "stage")
        assert out.dtypes == docs.dtypes, name
        rows = [tuple(r) for r in docs.collect()]
        assert sorted(tuple(r) for r in out.collect()) == sorted(check(rows)), name
        docs = out
    model = sentencepiece.SentencePieceProcessor(model_file=public_model())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(last) == docs.count()
    for r in last:
        ids = model.encode(text[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_odd_tables(spark, documents, sf_dir):
    """Nulls, repeated rows, clashing columns and empty tables pass through all stages."""
    text = "\n".join(f"Line {i} of a text that has some words and ends well." for i in range(9))
    other = "\n".join(f"Another {i} kind of text with its own words, {i * 7} in all." for i in range(9))
    docs = documents([text, text, other, None, "", other + " And more words."], [None, "a", "a", "b", "b", None], [1, 1, None, None, 4, 5])
    for extra in (docs, docs.selectExpr("*", "1 AS n_words", "'x' AS copies"), docs.where("false")):
        out = extra
        for _, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, out, sf_dir), "stage")
        assert {r["doc_id"] for r in out.collect()} <= {1, None, 5}
