"""URL filters: rules first, then naive Bayes over the words of hosts and paths.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the
path goes on up to ``?``, ``#`` or the end. A rule fits its host and all subdomains if the path starts
with the rule's; the longest fitting rule decides. For the rest:

* Unigram counts come from the titles of all pages and the path words of all urls. Names between dots
  and other punctuation of a host are cut into words by Viterbi: every substring of up to 24 characters
  is looked up by a join with the counts, a known word scores the logarithm of its share, an unknown
  one of n characters log(10 / (total * 10^n)); ties go to the longer last word.
* Multinomial naive Bayes learns from all distinct urls with a host. A url counts as blocked if a word
  of its host is one of ``SEEDS``; the score of a url sums the log odds of its host and path words and
  the prior log odds. Shares of words are smoothed by ``PRIOR`` words dealt as in all urls, so a word
  that was rarely seen says little. A positive score blocks.

A null url or one without ``://`` has empty host and path, fits no rule and is allowed. Repeated urls
are judged alike, page_id may be null or repeat. Without any blocked url everything is allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .store import stored

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SEEDS = [
    "ads", "adult", "bets", "betting", "casino", "gambling", "jackpot", "loans", "pills", "poker",
    "porn", "slots", "spam", "tracker", "tracking", "viagra", "xxx",
]
# host names of the web that titles do not hold, counted beside the corpus
COMMON = ["www", "blog", "com", "net", "org", "cheap", "farm", "free", "shop", "news", "online", "mail"]
PRIOR = 50
EXTRA_COUNT = 50  # occurrences that seeds and common names get besides those of the corpus
LONGEST = 24
NOT_WORD = r"[^\p{L}\p{N}]+"


def url_parts(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null; of equally long ones the first."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(own + start).alias("rule"))).otherwise(out)
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def word_counts(titles: DataFrame, paths: DataFrame) -> DataFrame:
    """(word, n) over the titles' and paths' words, with the extra words."""
    words = titles.select(F.explode(_words(F.col("title"))).alias("word"))
    words = words.union(paths.select(F.explode(_words(F.col("path"))).alias("word"))).where(F.length("word") <= LONGEST)
    extra = titles.sparkSession.createDataFrame([(w, EXTRA_COUNT) for w in sorted({*SEEDS, *COMMON})], "word string, n bigint")
    return words.groupBy("word").agg(F.count("*").alias("n")).union(extra).groupBy("word").agg(F.sum("n").alias("n"))


def _substrings(labels: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label in batch.column("label").to_pylist():
                for at in range(0, len(label), 4096):
                    spans = [(a, label[a:b]) for a in range(at, min(at + 4096, len(label)))
                             for b in range(a + 1, min(a + LONGEST, len(label)) + 1)]
                    yield pa.record_batch({
                        "label": pa.array([label] * len(spans), pa.string()),
                        "start": pa.array([s for s, _ in spans], pa.int32()), "word": pa.array([w for _, w in spans], pa.string()),
                    })

    return labels.select("label").mapInArrow(run, "label string, start int, word string")


def split_label(label: str, counts: dict[str, int], total: int) -> list[str]:
    """Most probable words of a name."""
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        score, start = None, 0
        for a in range(max(0, end - LONGEST), end):
            n = counts.get(label[a:end])
            path = best[a] + (math.log(n / total) if n else math.log(10 / total) - (end - a) * math.log(10))
            if score is None or path > score:
                score, start = path, a
        best.append(score)
        back.append(start)
    words, end = [], len(label)
    while end:
        words.append(label[back[end]:end])
        end = back[end]
    return words[::-1]


def segmented(labels: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(label, words) of distinct labels."""
    known = _substrings(labels).join(counts, "word").groupBy("label").agg(F.collect_set(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, found = batch.column("label").to_pylist(), batch.column("known").to_pylist()
            words = [split_label(x, {k["word"]: k["n"] for k in ks or []}, total) for x, ks in zip(labels, found)]
            yield pa.record_batch({"label": pa.array(labels, pa.string()), "words": pa.array(words, pa.list_(pa.string()))})

    return labels.select("label").join(known, "label", "left").mapInArrow(run, "label string, words array<string>")


def _token(kind: str, word: Column) -> Column:
    return F.concat(F.lit(kind), F.when(word.rlike(r"^\d+$"), F.lit("#")).otherwise(word))


def url_tokens(urls: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(host, path, token, seed) of every word of distinct hosts and paths."""
    names = urls.select("host", F.explode(F.array_distinct(F.filter(F.split("host", NOT_WORD), lambda w: w != ""))).alias("label"))
    words = segmented(names.select("label").distinct(), counts, total)
    hosts = names.distinct().join(words, "label").select("host", F.explode("words").alias("word"))
    of_host = urls.join(hosts, "host").select("host", "path", _token("h:", F.col("word")).alias("token"), F.col("word").isin(SEEDS).alias("seed"))
    of_path = urls.select("host", "path", F.explode(_words(F.col("path"))).alias("word"))
    return of_host.union(of_path.select("host", "path", _token("p:", F.col("word")).alias("token"), F.lit(False).alias("seed")))


def bayes_scores(tokens: DataFrame) -> DataFrame:
    """(host, path, score) by naive Bayes learned from the seeds among the tokens."""
    key = ["host", "path"]
    blocked = stored(tokens.groupBy(*key).agg(F.max("seed").alias("blocked")), "blocked")
    counted = tokens.join(blocked, key).groupBy("token").agg(
        F.sum(F.col("blocked").cast("int")).alias("bad"), F.sum((~F.col("blocked")).cast("int")).alias("good"))
    counted = stored(counted, "tokens")
    bad, good = (x or 0 for x in counted.agg(F.sum("bad"), F.sum("good")).first())
    n_bad, n = (x or 0 for x in blocked.agg(F.sum(F.col("blocked").cast("int")), F.count("*")).first())
    if not n_bad or n_bad == n:
        return blocked.select(*key, F.when(F.col("blocked"), 1.0).otherwise(-1.0).alias("score"))
    usual = F.lit(PRIOR / (bad + good)) * (F.col("bad") + F.col("good"))
    share_bad, share_good = (F.col("bad") + usual) / F.lit(bad + PRIOR), (F.col("good") + usual) / F.lit(good + PRIOR)
    odds = counted.select("token", (F.log(share_bad) - F.log(share_good)).alias("odds"))
    scored = tokens.join(odds, "token").groupBy(*key).agg(F.sum("odds").alias("odds"))
    return scored.select(*key, (F.col("odds") + F.lit(math.log(n_bad / (n - n_bad)))).alias("score"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page (needs page_id, url and html)."""
    host, path = url_parts(F.col("url"))
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title", 1)
    parsed = stored(pages.select("page_id", host.alias("host"), path.alias("path"), F.coalesce(title, F.lit("")).alias("title")), "urls")
    urls = stored(parsed.where("host != ''").select("host", "path").distinct(), "hosts")
    counts = stored(word_counts(parsed, urls), "counts")
    total = counts.agg(F.sum("n")).first()[0]
    scores = bayes_scores(stored(url_tokens(urls, counts, total), "tokens"))
    found = fitting_rule(rules, F.col("host"), F.col("path"))
    by_bayes = F.when(F.col("score") > 0, F.lit("block")).otherwise(F.lit("allow"))
    return parsed.join(scores, ["host", "path"], "left").withColumn("found", found).select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_bayes).alias("verdict"), "score")


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
