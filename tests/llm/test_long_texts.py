"""One very long text, one very long word and a text of one repeated word beside short ones."""

import random

import pytest
import sentencepiece

from stationcast.llm.ngram_join import similarity_join
from stationcast.llm.quality_rules import judge_documents
from stationcast.llm.sentencepiece_codec import encode_documents, public_model
from stationcast.llm.source_mix import mix_sources
from stationcast.llm.substring_dedup import dedup_substrings
from stationcast.llm.token_counts import count_tokens


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(8)
    prose = " ".join(f"w{rng.randrange(50_000)}" for _ in range(300_000))
    return [prose, prose[:1_000_000], "x" * 300_000, "no " * 100_000, "short one", prose[500_000:1_500_000]]


def test_documents(documents, long_texts):
    docs = documents(long_texts)
    words = [len(t.split()) for t in long_texts]
    judged = judge_documents(docs).orderBy("doc_id").collect()
    assert [r["n_words"] for r in judged] == words and judged[3]["n_repeat_words"] == 100_000
    cut = dedup_substrings(docs).orderBy("doc_id").collect()
    assert cut[3]["n_removed"] == 100_000 and cut[1]["n_removed"] >= words[1] - 1 and cut[2]["n_removed"] == cut[4]["n_removed"] == 0
    assert len({r["component_id"] for r in similarity_join(docs).collect()}) == 6
    assert sorted(r["size"] for r in mix_sources(docs).collect()) == sorted(words)


def test_tokens(documents, long_texts):
    docs = documents(long_texts)
    model = sentencepiece.SentencePieceProcessor(model_file=public_model())
    got = encode_documents(docs, public_model()).orderBy("doc_id").collect()
    assert all(r["ids"] == model.encode(t, add_bos=True, add_eos=True) for r, t in zip(got, long_texts))
    counts = count_tokens(docs, public_model()).orderBy("doc_id").collect()
    assert all(0 < r["n_tokens"] <= len(t.encode()) + 1 for r, t in zip(counts, long_texts))
