import oracle
import pytest

from stationcast.llm.quality_rules import _SQL, COUNTS, judge_documents

PROSE = "This is a plain line of text, as people write it, and it ends with a stop."


def line(i):
    """A line of its own words."""
    return " ".join(f"w{'abcdefghij'[k % 10]}{i}x{k}" for k in range(9)) + ", and so on."


def kept(documents, texts, **kw):
    return [r["kept"] for r in judge_documents(documents(texts), **kw).orderBy("doc_id").collect()]


def test_counts_agree_with_sql(spark, documents, texts, tmp_path):
    lines = [PROSE, "THIS IS SHOUTED LOUDLY", "home | news | contact", "$$$ ### %%% a", "", "All rights reserved 2020",
             "no no no no no no", "word " * 45, "ÀÉ ÖØ Þ", "straße für é", PROSE, "-- / · » a b", "a\x0bb\x0cc"]
    more = ["\n".join(lines[i:] + lines[:i]) for i in range(len(lines))] + [(PROSE + "\n") * 3]
    docs = documents([t for t in texts if t is not None] + more + [None])
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = oracle.connect(str(tmp_path))
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    got = judge_documents(docs.select("doc_id", "text")).select("doc_id", *COUNTS, "base_failed", "kept")
    assert not oracle.compare(con, _SQL, got)


def test_verdicts(documents):
    good = "\n".join(map(line, range(5)))
    words = [f"w{i}" for i in range(30)]
    cases = [
        (good, True), (good + "\nhome | news | about", True), (good + "\nall rights reserved.", True),
        (" | ".join(words), False), (" ".join(w.upper() + "!!" for w in words), False),
        (" ".join(w + "***" for w in words), False), ("too short.", False), (("x " * 50), False), (None, False), ("", False),
    ]
    assert kept(documents, [c[0] for c in cases]) == [c[1] for c in cases]


def test_cleaned_text_and_extra_columns(spark):
    text = f"{PROSE} One.\nhome | news | about\n{PROSE} Two.\n"
    df = spark.createDataFrame([(1, text, 9, None), (1, text, 9, None), (None, None, 8, "x")], "doc_id long, text string, n_words int, note string")
    rows = judge_documents(df, clean="clean").collect()
    assert len(rows) == 3 and rows[0] == rows[1]
    assert rows[0]["clean"] == f"{PROSE} One.\n{PROSE} Two.\n" and rows[0]["n_words"] == text.count(" ") + 1 + 2
    assert rows[2]["note"] == "x" and rows[2]["n_words"] == 0 and rows[2]["base_failed"]


def test_empty_table(documents, spark):
    assert judge_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("share, want", [(0.2, True), (0.5, False)])
def test_documents_that_lose_too_much_go(documents, share, want):
    lines = [line(i) for i in range(20)]
    bad = int(20 * share)
    lines[:bad] = [x.upper() for x in lines[:bad]]
    assert kept(documents, ["\n".join(lines)]) == [want]
