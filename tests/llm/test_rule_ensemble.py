import random
import zlib

import pytest
from pyspark.sql import functions as F

from stationcast.llm.rule_ensemble import _with, score_quality


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        words = ["w" + "abcdefgh"[rng.randrange(8)] * rng.randint(1, 5) for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.7
        text = " ".join(words) + "." if good else rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), "no " * 60])
        rows.append((i, text, int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_accuracy(labelled):
    got = score_quality(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality")).join(labelled, "doc_id").collect()
    assert len(got) == 600 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in out) >= 0.97 * len(out)
    # the text alone makes the score
    again = score_quality(labelled.select("doc_id", "text"), labelled.select("doc_id", "quality")).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in got}


def test_odd_rows_and_labels(spark, labelled):
    more = labelled.select("doc_id", "text").union(spark.createDataFrame([(7, ""), (None, None), (None, "x"), (None, "x")], "doc_id long, text string"))
    labels = labelled.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (3, None), (4, 5)], "doc_id long, quality int"))
    got = score_quality(more, labels).collect()
    assert len(got) == 604 and all(r["score"] is not None for r in got)
    assert all(r["held_out"] is False for r in got if r["doc_id"] is None)


@pytest.mark.parametrize("where, score", [("quality = 1", 1.0), ("quality = 0", 0.0), ("false", 0.5)])
def test_one_kind_of_labels(labelled, where, score):
    got = score_quality(labelled.select("doc_id", "text").limit(5), labelled.where(where).select("doc_id", "quality"))
    found = {r["score"] for r in got.collect()}
    assert found <= {score, 0.5}


def test_empty_table(labelled):
    assert score_quality(labelled.select("doc_id", "text").where(F.lit(False)), labelled.select("doc_id", "quality")).count() == 0


def test_rules_keep_the_stricter_bound():
    rule = _with(_with((), "words", True, 5.0), "words", True, 3.0)
    assert rule == (("words", True, 3.0),) and len(_with(rule, "words", False, 1.0)) == 2
