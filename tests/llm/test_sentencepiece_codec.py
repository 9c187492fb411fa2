import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from stationcast.llm import sentencepiece_codec as codec
from stationcast.llm.sentencepiece_codec import MARK, ChunkTable, encode_documents, public_model

PIECES = [" ", "  ", "\n", "\t", MARK, "a", "b", "the", "ing", "é", "日", "😀", "\x00", ".", "<s>", "</s>", "<unk>", "<0x0A>",
          "\r", "\xa0", "\x85", "x" * 30, "12", "  \n", "́"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=public_model())


def cases(n):
    rng = random.Random(7)
    fixed = ["", " ", "a ", " a", "\n", "\n ", MARK, MARK * 3 + "a", "x" * 9000 + " y", " " * 5000 + "a"]
    return fixed + ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def test_same_ids_and_text_as_the_library(model):
    table = ChunkTable(public_model())
    texts = cases(3000)
    for text, (ids, surface) in zip(texts, table.encode(texts)):
        want = model.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want and surface == model.decode(want)


def test_table_is_emptied_when_full(model, monkeypatch):
    monkeypatch.setattr(codec, "TABLE_CHARS", 200)
    table = ChunkTable(public_model())
    for text in cases(300):
        assert np.frombuffer(next(table.encode([text]))[0], "<u4").tolist() == model.encode(text)
        assert sum(map(len, table.ids)) <= max(200, len(text) + 1)


def test_documents(model, documents, texts):
    got = encode_documents(documents(texts).withColumnRenamed("lang", "n_tokens"), public_model(), digest=True).orderBy("doc_id").collect()
    assert len(got) == len(texts)
    for r, t in zip(got, texts):
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids"] == ids
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(df, public_model()).count() == 0
