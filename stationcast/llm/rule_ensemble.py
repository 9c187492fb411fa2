"""Quality classifier as a sparse ensemble of rules over text statistics.

Statistics of a text are Spark column expressions over the whole text. A random forest
of shallow trees is grown on them; every path from a root to a node is a rule, a conjunction of
conditions on statistics. A lasso logistic regression weighs the rules, most get weight 0, and the rules
that are left are compiled into one Spark column expression, so that scoring is a projection.

Learning uses the ``TRAINING_ROWS`` labelled rows with the smallest hashes of doc_id, a documented bound;
rows whose crc32(doc_id as text) mod 5 is 0 are held out, and so are rows without label or doc_id. Only the
text is an input of a score. Null texts count as empty, whose statistics are all 0; a score is between
0 and 1, higher if label 1 is likelier, and ``predicted`` is 1 from 0.3. Without labels of both kinds the
score is the share of label 1, or 0.5 without any label. Repeated rows score alike.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import query
from .store import stored

TRAINING_ROWS = 20_000
TREES, DEPTH, LASSO = 40, 3, 0.001
FOLDS, CUT = 5, 0.3
WORD = r"[^\x20\x09-\x0D]+"

Rule = tuple[tuple[str, bool, float], ...]  # (statistic, at most, threshold)


# characters that are counted, by name
CLASSES = {
    "symbols": r"[#*$%&<>]", "bars": r"[|]", "shouts": r"!", "capitals": r"\p{Lu}", "digits": r"\d", "stops": r"[.?]",
    "commas": r"[,;:]", "lines": r"\n",
}


def text_counts(text: Column) -> dict[str, Column]:
    """Numbers that the statistics are made of; the only expressions that read the text."""
    text = F.coalesce(text, F.lit(""))
    counts = {name: F.regexp_count(text, F.lit(pattern)) for name, pattern in CLASSES.items()}
    return counts | {"n_chars": F.length(text), "n_words": F.regexp_count(text, F.lit(WORD)),
                     "n_distinct": F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+")))}


def _share(n: str, of: str) -> Column:
    return F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(F.lit(0.0)).alias(n)


def statistics() -> list[Column]:
    """Statistics of a text from its counts."""
    return [
        F.log1p(F.col("n_words")).alias("words"), _share("n_chars", "n_words").alias("word_length"),
        _share("n_distinct", "n_words").alias("distinct"), _share("capitals", "n_chars"), _share("digits", "n_chars"),
        *[_share(c, "n_words") for c in ("symbols", "bars", "shouts", "stops", "commas", "lines")],
    ]


NAMES = ["words", "word_length", "distinct", "capitals", "digits", "symbols", "bars", "shouts", "stops", "commas", "lines"]


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistics) of every document; the counts are written once, each from one pass over its text."""
    counts = stored(docs.select("doc_id", *[c.alias(n) for n, c in text_counts(F.col("text")).items()]), "counts")
    return counts.select("doc_id", *statistics())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def training_rows(stats: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(label, statistics) of at most ``bound`` labelled documents that are not held out."""
    usable = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.min(label).cast("double").alias("label"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(bound)
    rows = stats.join(F.broadcast(chosen), "doc_id")  # at most ``bound`` pairs of numbers
    # equal partitions in every run, as the forest samples by partition
    return stored(rows.repartition(8, "doc_id").sortWithinPartitions("doc_id"), "training")


def grow_rules(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> list[Rule]:
    """Paths of the trees of a forest, each once."""
    given = rows.select("label", array_to_vector(F.array(*NAMES)).alias("features"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", maxBins=64).fit(given)
    found: dict[Rule, None] = {}

    def walk(node, path: Rule) -> None:
        if path:
            found[path] = None
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, at = NAMES[split.featureIndex()], split.threshold()
        walk(node.leftChild(), _with(path, name, True, at))
        walk(node.rightChild(), _with(path, name, False, at))

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def _with(path: Rule, name: str, most: bool, at: float) -> Rule:
    """The path with one more condition; of two on one side the stricter stays."""
    bounds = {(n, m): t for n, m, t in path}
    old = bounds.get((name, most))
    bounds[name, most] = at if old is None else (min if most else max)(old, at)
    return tuple(sorted((n, m, t) for (n, m), t in bounds.items()))


def rule_column(rule: Rule) -> Column:
    out = None
    for name, most, at in rule:
        part = F.col(name) <= at if most else F.col(name) > at
        out = part if out is None else out & part
    return out


def fit_rules(rows: DataFrame, rules: list[Rule], lasso: float = LASSO) -> tuple[float, list[tuple[float, Rule]]]:
    """Intercept, and the rules of non-zero weight."""
    given = rows.select("label", array_to_vector(F.array(*[rule_column(r).cast("double") for r in rules])).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, standardization=False, maxIter=100).fit(stored(given, "rules"))
    weights = model.coefficients.toArray()
    return float(model.intercept), [(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-9]


def score_column(intercept: float, weighted: list[tuple[float, Rule]]) -> Column:
    """Probability of label 1 from the statistics' columns."""
    total = F.lit(intercept)
    for weight, rule in weighted:
        total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def learn_score(stats: DataFrame, labels: DataFrame, label: str, bound: int) -> Column:
    rows = training_rows(stats, labels, label, bound)
    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < ones < n:
        return F.lit(float(ones / n) if n else 0.5)
    return score_column(*fit_rules(rows, grow_rules(rows)))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document (needs doc_id and text)."""
    stats = text_statistics(docs)
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), learn_score(stats, labels, label, bound).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


@query("op6_quality_classifier")
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(docs, labels)
