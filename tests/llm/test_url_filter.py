import itertools
import math

import pytest
from pyspark.sql import functions as F

from stationcast.llm.url_filter import LONGEST, filter_urls, split_label, url_parts

CASES = [
    ("http://A.Example.NET/En/x?q#f", "a.example.net", "/En/x", "net/", "block"),
    ("https://www.example.net/en/1", "www.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://example.net/en", "example.net", "/en", "net/", "block"),
    ("https://badexample.com/de/1", "badexample.com", "/de/1", None, "allow"),
    ("https://m.example.com/de/", "m.example.com", "/de/", "example.com/de/", "block"),
    ("https://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"),
    ("https://x.net", "x.net", "", None, "allow"),
    ("https://x.net?u=/en/", "x.net", "", None, "allow"),
    ("ftp://x.net/://y.org/fr/", "x.net", "/://y.org/fr/", "net/", "block"),
    ("x.net/en/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ("://", "", "", None, "allow"), ("http://ÄB.net/", "Äb.net", "/", "net/", "block"),
    ("http://" + "z" * 5000 + ".com/" + "y" * 5000, "z" * 5000 + ".com", "/" + "y" * 5000, None, "allow"),
]


@pytest.fixture(scope="module")
def judged(spark):
    urls = [c[0] for c in CASES] + [f"http://blog{i}.site.com/en/{i}" for i in range(30)]
    urls += [f"http://{w}.site.com/p/{i}" for i in range(4) for w in ("cheappills", "best-casino", "freebets4u")] + ["http://cheappills.site.com/p/0"]
    rows = [(i, u, "<title>the news of the day</title>" if i % 2 else None, "x") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")
    return {r["page_id"]: r for r in filter_urls(df).collect()}, urls


def test_hosts_paths_and_rules(judged):
    rows, urls = judged
    assert len(rows) == len(urls)
    for i, (_, host, path, rule, verdict) in enumerate(CASES):
        r = rows[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), CASES[i][0]


def test_bayes_blocks_hosts_like_the_seeds(judged):
    rows, urls = judged
    for i, u in enumerate(urls):
        if u and "site.com" in u:
            assert rows[i]["verdict"] == ("block" if "/p/" in u else "allow"), u


def test_segmentation_is_the_most_probable():
    counts, total = {"free": 50, "bets": 40, "be": 30, "ts": 5, "f": 9, "reebets": 1, "casino": 3}, 200

    def score(words):
        return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in words)

    for label in ("freebets", "fxbets", "casinofree", "a", "qq9"):
        cuts = range(1, len(label))
        every = [[label[a:b] for a, b in itertools.pairwise([0, *c, len(label)])] for k in range(len(label)) for c in itertools.combinations(cuts, k)]
        assert math.isclose(score(split_label(label, counts, total)), max(map(score, every)))
    assert "".join(split_label("y" * (3 * LONGEST), counts, total)) == "y" * (3 * LONGEST)


def test_only_seeds_or_none(spark):
    df = spark.createDataFrame([(1, "http://casino.com/", None), (1, "http://casino.com/", None)], "page_id long, url string, html string")
    assert [r["verdict"] for r in filter_urls(df).collect()] == ["block", "block"]
    assert [r["verdict"] for r in filter_urls(df.withColumn("url", F.lit("http://a.com/"))).collect()] == ["allow", "allow"]
    assert filter_urls(df.where("false")).count() == 0


def test_parts_of_null(spark):
    host, path = url_parts(F.col("u"))
    assert tuple(spark.createDataFrame([(None,)], "u string").select(host, path).first()) == ("", "")
