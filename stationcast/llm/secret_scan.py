"""Secret scans over an incremental ledger of blobs; DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a Parquet table that is
only appended to, says of each blob which rules in which version have been run on it and what they found
(rule, start, end in code points). ``scan_unseen`` runs what is missing: of the blobs that appear in the
given versions, each rule whose current version the ledger does not have, once per blob however many
paths and versions share it. ``findings`` joins the ledger back to all paths. A rule that is changed gets
a new version and is run again alone; what an old version found is no longer read.

Texts are moved one per blob and task, so a text with any number of copies meets nowhere. If few blobs
are new (at most ``FEW``, 40 MB), they are broadcast and the texts of the others are not moved at all. A
scan that fails has appended nothing; one that runs twice appends the same findings, which are read once.

A rule is a pattern; matches are taken from the left without overlap, and those whose group is shorter
than ``least`` are dropped afterwards, so that a dropped match still hides what it covers. Starts are
running sums over the lengths of the matches and of the parts between them.

A null text is the empty text and has no findings; repeated rows and rows without any key are judged like
others. The caller's columns pass through whatever their names; one that has the name of the result is
replaced. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from .registry import query
from .store import stored

FEW = 1_000_000  # new blobs that are broadcast
RUN = 256  # matches whose running sum is taken in one go

_any_case = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
_KEYS = "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` is the length of ``group`` from which a match counts."""

    name: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


BASE = (
    Rule("assign", 1, rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),  # a run of these characters is one match or none, whatever its length
)
ADDED = (
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("login", 1, r"""://[^\x00-\x20/:@"'<>]{1,64}:[^\x00-\x20/:@"'<>]{3,128}@"""),
)
RULES = BASE + ADDED
_FOUND = "array<struct<rule:string,start:bigint,end:bigint>>"


def _sums(steps: Column, start: Column) -> Column:
    """Steps (gap, size, ok) as (start, end, ok), counted on from ``start``."""
    nothing = F.expr("cast(array() as array<struct<start:bigint,end:bigint,ok:boolean>>)")

    def add(done: Column, step: Column) -> Column:
        begin = done["at"] + step["gap"]
        end = begin + step["size"]
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), step["ok"].alias("ok")))).alias("out"))

    return F.aggregate(steps, F.struct(start.cast("bigint").alias("at"), nothing.alias("out")), add)


def spans(text: Column, rule: Rule) -> Column:
    """What a rule finds in a text: array of (rule, start, end)."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    kept = lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group) if rule.group else m) >= rule.least
    steps = F.transform(F.arrays_zip(between.alias("gap"), found.alias("match")), lambda s: F.struct(
        F.length(s["gap"]).cast("bigint").alias("gap"), F.length(s["match"]).cast("bigint").alias("size"), kept(s["match"]).alias("ok")))
    steps = F.filter(steps, lambda s: s["size"].isNotNull())  # the part behind the last match
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN)),
                       lambda i: F.slice(steps, (i * RUN + 1).cast("int"), RUN))
    width = lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda n, s: n + s["gap"] + s["size"])
    # the length of each run, then the starts of runs, then the starts within them
    whole = F.transform(runs, lambda r: F.struct(F.lit(0).cast("bigint").alias("gap"), width(r).alias("size"), F.lit(True).alias("ok")))
    starts = _sums(whole, F.lit(0))["out"]
    placed = F.flatten(F.zip_with(runs, starts, lambda r, s: _sums(r, s["start"])["out"]))
    good = F.transform(F.filter(placed, lambda s: s["ok"]), lambda s: F.struct(F.lit(rule.name).alias("rule"), s["start"].alias("start"), s["end"].alias("end")))
    return F.when(text.rlike(rule.pattern), good).otherwise(F.expr(f"cast(array() as {_FOUND})"))


def address(text: Column) -> Column:
    """The name of a text: its SHA-256; a null text has that of the empty one."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(blob, scanned, found) as appended so far; the table is begun if there is none."""
    schema = f"blob binary, scanned array<string>, found {_FOUND}"
    nothing = spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in
                                      (("blob", "binary"), ("scanned", "array<string>"), ("found", _FOUND))))
    nothing.write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def unseen(blobs: DataFrame, known: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo): the distinct blobs that some rule has not read in its current version, with those rules' keys."""
    keys = F.array(*(F.lit(r.key) for r in rules))
    run = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("scanned"))
    todo = F.array_except(keys, F.coalesce("scanned", F.expr("cast(array() as array<string>)")))
    return blobs.select("blob").distinct().join(run, "blob", "left").select("blob", todo.alias("todo")).where(F.size("todo") > 0)


def scan_unseen(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> int:
    """Runs the missing rules over the texts of ``versions`` and appends the findings; the number of blobs read."""
    spark = versions.sparkSession
    rows = versions.select(address(F.col(f"`{text}`")).alias("blob"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    todo = stored(unseen(rows, ledger(spark, path), rules), "todo")
    count = todo.count()
    if not count:
        return 0
    if count <= FEW:
        rows = rows.join(F.broadcast(todo.select("blob")), "blob", "left_semi")
    texts = rows.groupBy("blob").agg(F.first("text").alias("text")).join(todo, "blob")
    none = F.expr(f"cast(array() as {_FOUND})")
    found = [F.when(F.array_contains("todo", r.key), spans(F.col("text"), r)).otherwise(none) for r in rules]
    texts.select("blob", F.col("todo").alias("scanned"), F.concat(*found).alias("found")).write.mode("append").parquet(path)
    return count


def findings(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "findings") -> DataFrame:
    """The rows of ``versions`` without their text, and ``name``: array of (start, order, end, rule) in this order.

    order is the rule's place among ``rules``.
    """
    found = ledger(versions.sparkSession, path)
    current = F.map_from_arrays(F.array(*(F.lit(r.name) for r in rules)), F.array(*(F.lit(r.key) for r in rules)))
    order = F.map_from_arrays(F.array(*(F.lit(r.name) for r in rules)), F.array(*(F.lit(i) for i in range(len(rules)))))
    valid = F.filter("found", lambda f: F.coalesce(F.array_contains("scanned", F.try_element_at(current, f["rule"])), F.lit(False)))
    placed = F.transform(valid, lambda f: F.struct(f["start"].alias("start"), order[f["rule"]].alias("order"), f["end"].alias("end"), f["rule"].alias("rule")))
    # a blob has a row per scan that had something new to do; only rows with findings meet here
    by_blob = found.select("blob", placed.alias("found")).where(F.size("found") > 0).groupBy("blob").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    kept = [F.col(f"`{c}`").alias(c) for c in versions.columns if c not in (text, name)]
    paths = versions.select(F.struct(*kept).alias("row"), address(F.col(f"`{text}`")).alias("blob"))
    none = F.expr("cast(array() as array<struct<start:bigint,order:int,end:bigint,rule:string>>)")
    return paths.join(by_blob, "blob", "left").select("row.*", F.coalesce("found", none).alias(name))


def secret_report(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document."""
    keyed = docs.select("doc_id", "text")
    scan_unseen(keyed, path)
    found = findings(keyed, path)
    count = lambda rule: F.size(F.filter("findings", lambda f: f["rule"] == rule)).cast("bigint")
    said = lambda column: F.array_join(F.transform(column, lambda f: F.concat_ws(":", f["rule"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["order"] < len(BASE))
    return found.select("doc_id", *(count(r.name).alias(f"n_{r.name}") for r in BASE),
                        F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("findings")).alias("spans"))


def _sql_rule(place: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return (f"SELECT row, {place} AS place, '{rule.name}' AS rule, {rule.least} AS least, {rule.group} AS grp, "
            f"regexp_extract_all(t, '{pattern}') AS found, regexp_split_to_array(t, '{pattern}') AS gaps FROM d")


_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({' UNION ALL '.join(_sql_rule(i, r) for i, r in enumerate(RULES))}),
m AS (SELECT row, place, rule, least, grp, unnest(found) AS m, unnest(gaps[1:len(found)]) AS gap, unnest(range(1, len(found) + 1)) AS i FROM f),
p AS (SELECT *, (sum(len(gap) + len(m)) OVER (PARTITION BY row, place ORDER BY i))::BIGINT AS upto FROM m),
s AS (
  SELECT row, place, rule, upto - len(m) AS start, rule || ':' || (upto - len(m)) || ':' || upto AS span FROM p
  WHERE CASE WHEN grp = 2 THEN len(regexp_extract(m, '{BASE[0].pattern.replace("'", "''")}', 2)) ELSE len(m) END >= least),
g AS (
  SELECT row, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans
  FROM s GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""


@query("op13_secret_scan", _SQL)
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), work_path(spark, "ledger"))
