import oracle
import pytest

from stationcast.llm.source_mix import _SQL, mix_sources, source_targets, take_mix


def water_fill(sizes):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 2 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, None: 5}, {"z": 0, "y": 7}, {None: 12}, {chr(97 + i): i * i for i in range(12)},
])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    want = water_fill(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_same_as_sql_and_near_the_targets(spark, documents, tmp_path):
    texts = [" ".join(["w"] * (i * 7 % 90)) for i in range(600)] + [None, "", " \t"]
    sources = [None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 7}" for i in range(len(texts))]
    docs = documents(texts, sources)
    docs.write.parquet(str(tmp_path / "d"))
    con = oracle.connect(str(tmp_path))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = mix_sources(docs)
    assert not oracle.compare(con, _SQL, got)
    rows = got.collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for s in set(sources):
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 45  # half of the largest document


def test_taking_the_mix(documents):
    texts = [" ".join(["w"] * (5 + i % 9)) for i in range(300)]
    docs = documents(texts, [f"s{i % 4}" for i in range(300)])
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix_sources(docs).collect()}
    count = {}
    for r in take_mix(docs).collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {k: v for k, v in taken.items() if v} and take_mix(docs).columns == docs.columns


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "a b", "t"), (None, "x", None)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == 4 and len({r["taken"] for r in got if r["doc_id"] == 1}) == 1
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
