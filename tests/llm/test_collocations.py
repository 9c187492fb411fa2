import random
import re
from collections import Counter

import numpy as np
import oracle
import pytest

from stationcast.llm import collocations as c
from stationcast.llm.fm_index import FmIndex, ring, transform


def pieces(text):
    low = (text or "").translate({x: x + 32 for x in range(65, 91)})
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def und(lang):
    return "und" if lang is None else lang


def brute_force(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        for words in pieces(text):
            n[und(lang)] += len(words)
            for m in range(1, 5):
                f.update((und(lang), *words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    cands = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    covered = {(k[0], *k[1 + i:1 + i + q]) for k, v in cands.items() for q in range(2, len(k) - 1) for i in range(len(k) - q)
               if (k[0], *k[1 + i:1 + i + q]) in cands and 100 * v >= 80 * cands[(k[0], *k[1 + i:1 + i + q])]}
    for (lang, *w), a in cands.items():
        if (lang, *w) not in covered:
            score, _, left, right = min((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])])
                                        for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), left, right))
    rank, got = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return got


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["Der", "la", "é", "zoé", "THE", "of", "a", "b1", "x-y", "naïve", "ﬀ"]
    fixed = ["the end of days", "la zoé", "naïve b1 a of", "a a a a a"]
    gaps = [" "] * 12 + ["  ", "\t", ", ", ".", "\n", "\r\n", "; ", "!?", " \x0b", "\xa0", " "]

    def text(size):
        out = []
        for _ in range(size):
            out += [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(words), rng.choice(gaps)]
        return "".join(out)

    rows = [(text(rng.randint(0, 80)), rng.choice(["en", "de", None, "und", ""])) for _ in range(120)]
    rows += [rows[0]] * 40 + [(None, "en"), ("", None), (" .,\n", "de"), (text(6000), "en"), ("one", "fr"), ("x" * 70000, "fr")]
    return rows


def frame(spark, rows, parts=4):
    # extra columns with the names of the operator's own
    return spark.createDataFrame([(t, g, i, "x") for i, (t, g) in enumerate(rows)], "text string, lang string, shard long, word string").repartition(parts)


@pytest.mark.parametrize("shard_words, block, parts", [(1 << 22, 1 << 20, 1), (500, 300, 5), (40, 1 << 20, 3)])
def test_same_as_counting_everything(spark, corpus, monkeypatch, shard_words, block, parts):
    monkeypatch.setattr(c, "BLOCK_BYTES", block)
    got = c.collocations(frame(spark, corpus, parts), least=5, top=60, shard_words=shard_words, bucket_phrases=1 << 20 if parts == 1 else 500)
    want = brute_force(corpus, 5, 60)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 100


def test_sql_agrees(spark, corpus, tmp_path):
    frame(spark, corpus).write.parquet(str(tmp_path / "d"))
    con = oracle.connect(str(tmp_path))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert not oracle.compare(con, c._SQL, c.collocations(frame(spark, corpus)))


def test_hot_phrase_and_hot_language(spark):
    rows = [("alpha beta gamma", "en")] * 3000 + [("alpha beta", "en")] * 1000 + [("beta gamma delta", "de")] * 40
    got = c.collocations(frame(spark, rows, 16), shard_words=64)
    assert sorted(map(tuple, got.collect())) == sorted(brute_force(rows, 30, 2000))


@pytest.mark.parametrize("rows", [[], [(None, None)], [("", "en"), (" ", None)], [("a b", "en")]])
def test_nothing_to_find(spark, rows):
    assert c.collocations(frame(spark, rows, 1)).count() == 0


def test_parts_of_a_long_text_are_its_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(c, "BLOCK_BYTES", 16)
    text = "ab cd ef gh ij kl mn op qr st, uv wx yz. " * 9 + "tail without any end"
    batch = pa.record_batch({"text": ["x", None, text, ""], "lang": ["en", None, "de", "fr"]})
    got = [[w for w in words.to_pylist()] for words, _, _ in c._text_parts(batch, {})]
    assert sum(got, []) == ["x"] + re.findall("[^ .,]+", text)
    opens = np.concatenate([o for _, o, _ in c._text_parts(batch, {})])
    assert opens.sum() == 1 + sum(map(bool, pieces(text)))


def test_intervals_of_the_index():
    rng = np.random.default_rng(0)
    numbers = rng.integers(0, 4, 400).astype(np.int32)
    loop = ring(numbers)
    assert loop[-1] == 0 and not ((loop[1:] == 0) & (loop[:-1] == 0)).any()
    index = FmIndex(transform(loop))
    member, phrases = index.words(), {(-1,): 0}
    names = [(k + 1,) for k in range(3)]
    text = [tuple(map(int, s.split())) for s in " ".join(map(str, numbers)).replace(" 0", " |").lstrip("0").split("|")]
    for m in range(2, 5):
        starts, counts, prefix, suffix = index.extend(member)
        phrases = {(*names[p], names[s][-1]): int(k) for p, s, k in zip(prefix, suffix, counts)}
        assert phrases == Counter(t[i:i + m] for t in text for i in range(len(t) - m + 1))
        names = [(*names[p], names[s][-1]) for p, s in zip(prefix, suffix)]
        member = index.fill(starts, counts)
    assert len(ring(np.array([0, 1, 0, 2, 0]))) == 0 and len(transform(ring(np.zeros(0, np.int32)))) == 0


def test_packing():
    for values in (np.zeros(0, np.int64), np.array([-5, 7, 7, 2**62, -(2**62)]), np.arange(300) * 7):
        for rising in (False, True):
            assert (c._unpack(c._pack(values, rising), np.int64, rising) == values).all()
