"""Search over model settings with expanding time folds."""

from __future__ import annotations

import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import expanding_folds
from ..schemas import KEY, TIME

# ---- fixed values: search space of the forest ----
FOREST_SPACE = {
    "trees": list(range(200, 1300, 100)),
    "depth": list(range(4, 31)),
    "min_leaf": list(range(1, 21)),
    "features": ["sqrt", "log2", "0.8", "0.6"],
}
# ---- fixed values: search space of the boosted trees ----
BOOSTED_SPACE = {
    "step": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2],
    "depth": list(range(4, 9)),
    "min_leaf": list(range(10, 201, 10)),
    "sampling": [0.6, 0.7, 0.8, 0.9, 1.0],
    "features": ["0.6", "0.7", "0.8", "0.9", "all"],
}


def draw_trials(space: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    rng = random.Random(seed)
    return [{k: rng.choice(v) for k, v in space.items()} for _ in range(n)]


def tune(
    train: DataFrame,
    target: str,
    build: Callable[..., Pipeline],
    trials: list[dict],
    *,
    parallelism: int = 4,
) -> list[dict]:
    """Trials with their mean fold RMSE, best first.

    The folds are cut per station and cached once; trials run side by side as Spark jobs.
    """
    rows = expanding_folds(train.where(F.col(target).isNotNull()), KEY, TIME).persist()
    numbers = sorted(r["fold"] for r in rows.select("fold").distinct().collect())

    def rmse(job):
        trial, fold = job
        part = rows.where(F.col("fold") == fold)
        model = build(**trial).fit(part.where(F.col("role") == "train"))
        scored = model.transform(part.where(F.col("role") == "val"))
        err = F.col(target) - F.col("prediction")
        return scored.agg(F.sqrt(F.avg(err * err))).first()[0]

    jobs = [(t, f) for t in trials for f in numbers]
    with ThreadPoolExecutor(parallelism) as pool:
        scores = list(pool.map(rmse, jobs))
    rows.unpersist()
    out = []
    for i, t in enumerate(trials):
        mine = scores[i * len(numbers) : (i + 1) * len(numbers)]
        out.append({**t, "trial": i, "folds": len(mine), "cv_rmse": sum(mine) / len(mine)})
    return sorted(out, key=lambda t: t["cv_rmse"])
