import hashlib
import random
import zlib
from collections import defaultdict

import oracle
import pytest

from stationcast.llm import conversation_trie as c

SCHEMA = "conv_id long, turn long, role string, text string, depth long, s1 string, block string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:30]


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append(((turn is not None, turn or 0), digest(role, text), role, text))
    turns = {k: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for k, v in own.items()}
    trie, last = defaultdict(list), {}
    for conv, seq in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        seq = tuple(turns.get(base, [])[:h] + seq[h:])
        for d in range(len(seq) + 1):
            trie[seq[:d]].append(conv)
        last[conv] = seq
    kids = defaultdict(list)
    for p in trie:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(trie, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(trie[p]) - 1) * len(p[-1][1]) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(x for x in trie[p] if last[x] == p))).encode()).hexdigest()
    return sorted((min(m), len(p), min(trie[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha(p)) for p, m in trie.items())


def run(spark, rows, parts=4):
    df = spark.createDataFrame([(*r, 7, "x", None) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in c.prefix_trie(df).collect()), key=lambda r: r[:2])


def conversations(n, longest, seed, alphabet=3):
    rng = random.Random(seed)
    out = []
    for conv in rng.sample(range(-300, 900), n) + [0, 100, 200]:
        for turn in range(rng.choice([1, 2, 3, 5, longest])):
            word = rng.choice("abcé😀"[:alphabet]) * rng.randint(1, 2)
            out.append((conv, turn * rng.choice([1, 1, 2]), rng.choice(["user", "assistant"]), word))
    return out


@pytest.fixture(scope="module")
def odd():
    rows = conversations(60, 9, 1)
    rows += [(None, 1, "user", "lost"), (5, None, None, None), (5, None, "user", ""), (5, 3, None, "x"), (5, 3, None, "x"), (7, -4, "a", None)]
    rows += [(k, t, "user", f"same {t}") for k in range(1000, 1400) for t in range(7)]  # a large group of copies
    rows += [(k, 0, "user", "hello") for k in range(1500, 1600)] + [(k, t, "user", f"{k}") for k in range(1500, 1600) for t in (1, 2)]
    return rows


def test_same_as_walking_the_trie(spark, odd):
    want = brute_force(odd)
    assert run(spark, odd) == want and len(want) > 150


def test_long_conversations_go_over_blocks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(c, "BUCKET_BITS", 2)
    monkeypatch.setattr(c, "CHUNK_BITS", 3)
    rng = random.Random(2)
    shared = [("user", "x" * rng.randint(1, 5)) for _ in range(150)]
    rows = conversations(40, 30, 3, alphabet=2)
    for conv, size in [(2001, 150), (2002, 150), (2003, 64), (2004, 65), (2005, 8), (2006, 149), (2100, 3), (2101, 16)]:
        rows += [(conv, t, *x) for t, x in enumerate(shared[:size])]
    rows += [(2007, t, *x) for t, x in enumerate(shared[:80] + [("user", "other")] * 40)]
    want = brute_force(rows)
    assert run(spark, rows) == want and max(r[1] for r in want) > 140


@pytest.mark.parametrize("rows", [[], [(None, 0, "user", "x")]])
def test_no_conversations(spark, rows):
    assert run(spark, rows, 1) == []


def test_only_turnless_members(spark):
    conv = next(k for k in range(1, 100) if zlib.crc32(str(k).encode()) % 6 >= 2)
    nobody = [(conv, 0, "user", "gone")]
    assert run(spark, nobody, 1) == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())] == brute_force(nobody)


def test_sql_agrees(spark, odd, tmp_path):
    df = spark.createDataFrame([(*r, 7, "x", None) for r in odd], SCHEMA)
    df.select("conv_id", "turn", "role", "text").write.parquet(str(tmp_path / "d"))
    con = oracle.connect(str(tmp_path))
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    assert not oracle.compare(con, c._SQL, c.prefix_trie(df))
