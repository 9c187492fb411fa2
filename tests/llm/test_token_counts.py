import random
import struct

import pytest
import sentencepiece

from stationcast.llm.sentencepiece_codec import public_model
from stationcast.llm.token_counts import PieceCounter, count_tokens


def _varint(data, at):
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data):
    at = 0
    while at < len(data):
        start = at
        tag, at = _varint(data, at)
        if tag & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at:at + n], at + n
        elif tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            n = 4 if tag & 7 == 5 else 8
            value, at = data[at:at + n], at + n
        yield tag, value, data[start:at]


def _number(value):
    out = b""
    while True:
        out += bytes([value & 127 | (128 if value > 127 else 0)])
        value >>= 7
        if not value:
            return out


def as_unigram(data, floor):
    """The model file read as a unigram model: its type is 1, and no score lies below ``floor``."""
    out = []
    for tag, value, raw in _fields(data):
        if tag >> 3 == 2:
            body = b"".join(_number(t) + _number(1) if t >> 3 == 3 else r for t, _, r in _fields(value))
            raw = _number(tag) + _number(len(body)) + body
        elif tag >> 3 == 1:
            body = b"".join(_number(t) + struct.pack("<f", max(floor, struct.unpack("<f", v)[0])) if t >> 3 == 2 else r
                            for t, v, r in _fields(value))
            raw = _number(tag) + _number(len(body)) + body
        out.append(raw)
    return b"".join(out)


@pytest.fixture(scope="module")
def counter():
    return PieceCounter(public_model())


@pytest.fixture(scope="module")
def library(counter):
    with open(public_model(), "rb") as f:
        data = as_unigram(f.read(), counter.unknown + 10)
    return sentencepiece.SentencePieceProcessor(model_proto=data)


def test_same_counts_as_the_library(counter, library):
    rng = random.Random(4)
    pieces = ["a", "b", "the", "ing", "é", "日", "😀", ".", "<s>", "12", "tion", "er", "\x00", "Ω", "ss", "--", " ", "  ", "\n", "\t", "▁"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert counter.count(text) == len(library.encode(text)), repr(text)


def test_ties_and_unknown_characters(counter):
    """Best score of all segmentations; of equal scores the one whose last piece starts earliest."""
    scores = {p: s for p, (_, s) in ((p, counter.trie.get(p)) for p in counter.trie.keys())}

    def brute(chunk):
        best = [(0.0, 0)]
        for end in range(1, len(chunk) + 1):
            found = None
            for start in range(end):
                piece = chunk[start:end]
                score, n = scores.get(piece), 1
                if score is None and end - start == 1:
                    score, n = counter.unknown, len(piece.encode())
                if score is not None and (found is None or best[start][0] + score > found[0]):
                    found = best[start][0] + score, best[start][1] + n
            best.append(found)
        return best[-1][1]

    rng = random.Random(9)
    for _ in range(500):
        chunk = "▁" + "".join(rng.choice("theaningsto😀é\x01") for _ in range(rng.randint(0, 14)))
        assert counter.viterbi(chunk) == brute(chunk)


def test_documents(documents, texts, counter, library):
    got = count_tokens(documents(texts).withColumnRenamed("lang", "n_tokens"), public_model()).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [len(library.encode(t)) if t else 0 for t in texts]


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), public_model()).count() == 0


def test_a_text_with_more_chunks_than_the_table_holds(monkeypatch):
    from stationcast.llm import token_counts

    text = " ".join(f"w{i}x{i * 7919 % 997}" for i in range(4000)) + " again again again"
    usual = PieceCounter(public_model()).count(text)
    monkeypatch.setattr(token_counts, "TABLE_CHARS", 500)
    counter = PieceCounter(public_model())
    assert counter.count(text) == usual == counter.count(text) and counter.chars < 1000
