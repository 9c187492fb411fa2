"""Training of all families and horizons, scoring, saving."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import regression_metrics
from ..operators.windows import latest
from ..schemas import HORIZONS, KEY, TARGETS, TIME
from . import linear, trees
from .frame import training_frame

Models = dict[tuple[str, str], PipelineModel]


def train_families(
    features: DataFrame, holdout: int = 90, families=("lightgbm", "linear", "hgbr", "randomforest"),
    *, rounds: int = 100, n_trees: int = 600, huber: bool = True, seed: int = 42, parallelism: int = 4,
) -> tuple[Models, DataFrame, list[str]]:
    """(models by family and horizon, frame with ``split``, feature names).

    The imputed frame is computed once and cached for all fits, and ``parallelism`` fits
    submit their jobs side by side.
    """
    frame, names = training_frame(features, holdout)
    frame = frame.persist()
    train = frame.where(F.col("split") == "train")
    validated = trees.with_validation(train)
    models: Models = {}
    if "linear" in families:
        for t, (_, model) in linear.select_and_fit(train, names, TARGETS, huber=huber).items():
            models["linear", HORIZONS[TARGETS.index(t)]] = model
    build = {
        "lightgbm": lambda t: (trees.boosted(names, t, rounds=rounds, seed=seed), validated),
        "hgbr": lambda t: (trees.boosted_histogram(names, t, rounds=rounds, seed=seed), validated),
        "randomforest": lambda t: (trees.forest(names, t, trees=n_trees, seed=seed), train),
    }
    jobs = [(f, h, t) for f in build if f in families for h, t in zip(HORIZONS, TARGETS)]

    def fit(job):
        f, _, t = job
        pipeline, rows = build[f](t)
        return trees.fit_rows(pipeline, rows, t)

    with ThreadPoolExecutor(parallelism) as pool:
        models.update({(f, h): m for (f, h, _), m in zip(jobs, pool.map(fit, jobs))})
    return models, frame, names


def score(models: Models, rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per input row and horizon, one column per family; no shuffle."""
    families = list(dict.fromkeys(f for f, _ in models))
    internal = ["_features", "_scaled"]
    for (f, h), model in models.items():
        rows = model.transform(rows).withColumnRenamed("prediction", f"_{f}_{h}").drop(*internal)
    per_horizon = F.array(*[
        F.struct(
            F.lit(h).alias("horizon"),
            *[(F.col(f"_{f}_{h}") if (f, h) in models else F.lit(None).cast("double")).alias(f"p_{f}") for f in families],
        )
        for h in HORIZONS
    ])
    return rows.select(*keep, F.inline(per_horizon))


def score_holdout(models: Models, frame: DataFrame) -> DataFrame:
    """Predictions of the holdout with their truth, one column per family."""
    scored = score(models, frame.where(F.col("split") == "test"), [KEY, TIME, *TARGETS])
    truth = reduce(
        lambda out, pair: F.when(F.col("horizon") == pair[0], F.col(pair[1])).otherwise(out),
        zip(HORIZONS, TARGETS), F.lit(None).cast("double"),
    )
    return scored.withColumn("y_true", truth).drop(*TARGETS)


def holdout_metrics(preds: DataFrame, families: list[str]) -> DataFrame:
    long = preds.withColumnsRenamed({f"p_{f}": f for f in families}).unpivot(
        [KEY, TIME, "horizon", "y_true"], families, "family", "y_pred"
    )
    return regression_metrics(long, ["family", "horizon"], "y_true", "y_pred")


def score_latest(models: Models, frame: DataFrame) -> DataFrame:
    """Predictions of the newest row of each station."""
    return score(models, latest(frame, KEY, [TIME]), [KEY, TIME])


def registry_entries(metrics: DataFrame, created, root: str) -> DataFrame:
    """Registry rows of freshly scored models: family, horizon, time, path, metrics, library."""
    scores = [c for c in metrics.columns if c not in ("family", "horizon")]
    return metrics.select(
        "family",
        "horizon",
        created.alias("created"),
        F.concat_ws("/", F.lit(root), F.concat_ws("_", "family", "horizon")).alias("path"),
        F.struct(*scores).alias("metrics"),
        F.lit("spark.ml").alias("library"),
    )


def save_models(models: Models, path: str) -> None:
    for (f, h), model in models.items():
        model.write().overwrite().save(f"{path}/{f}_{h}")


def load_models(path: str, families: list[str]) -> Models:
    return {(f, h): PipelineModel.load(f"{path}/{f}_{h}") for f in families for h in HORIZONS}
