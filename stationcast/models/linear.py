"""Ridge, elastic-net and Huber candidates, chosen by forward folds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import RobustScaler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.folds import number_rows
from ..schemas import KEY, TIME
from .frame import assembler

# ---- fixed values: candidate grids ----
RIDGE_ALPHAS = np.logspace(-2, 3, 12)
NET_ALPHAS = np.logspace(-2, 2, 11)
NET_L1 = np.linspace(0.05, 0.95, 7)
HUBER_EPSILON, HUBER_ALPHA = 1.35, 1e-4
FOLDS = 3


def with_fold_roles(df: DataFrame, k: int = FOLDS) -> DataFrame:
    """Columns ``fold_1..k``: 1 in the training rows of the fold, 2 in its test rows, else 0."""
    size = F.call_function("div", F.col("_n"), F.lit(k + 1))
    roles = {}
    for i in range(k):
        start = F.col("_n") - size * F.lit(k - i)
        role = F.when(F.col("_pos") < start, 1).when(F.col("_pos") < start + size, 2).otherwise(0)
        roles[f"fold_{i + 1}"] = role
    return number_rows(df, KEY, TIME).withColumns(roles).drop("_pos", "_n")


def fold_moments(
    df: DataFrame, names: list[str], targets: list[str], folds: list[str], robust: dict | None = None
) -> dict:
    """Sums of products of (1, features, target) per fold, role and target.

    One pass over the data serves all folds, horizons and candidates: each partition adds up
    its matrices, Spark sums them by cell, and the driver receives (k + 2)^2 numbers per
    fold, role and target.

    ``robust`` maps (fold, target) to (coefficients, scale). Training rows are then weighted
    by their Huber weight under that model, and each entry is (sums, squares of the inliers,
    number of outliers, rows).
    """
    size = len(names) + 2

    def partial(batches):
        total: dict[tuple[str, int, str], np.ndarray] = {}
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf[names].to_numpy(float)])
            for t in targets:
                y = pdf[t].to_numpy(float)
                z = np.column_stack([x, y])
                for f in folds:
                    code = pdf[f].to_numpy()
                    for role in (1,) if robust else (1, 2):
                        rows = z[(code == role) & ~np.isnan(y)]
                        extra = np.zeros(3)
                        weighted = rows
                        if robust:
                            coef, sigma = robust[f, t]
                            r = np.abs(rows[:, -1] - rows[:, :-1] @ coef)
                            inlier = r <= HUBER_EPSILON * sigma
                            w = np.where(inlier, 1.0, HUBER_EPSILON * sigma / np.maximum(r, 1e-300))
                            weighted = rows * w[:, None]
                            extra = np.array([(r[inlier] ** 2).sum(), (~inlier).sum(), len(r)])
                        at = (f, role, t)
                        total[at] = total.get(at, 0) + np.concatenate([(rows.T @ weighted).ravel(), extra])
        if total:
            yield pd.DataFrame(
                [(f, r, t, m.tolist()) for (f, r, t), m in total.items()],
                columns=["fold", "role", "target", "cells"],
            )

    parts = df.select(*names, *targets, *folds).mapInPandas(
        partial, "fold string, role int, target string, cells array<double>"
    )
    sums = (
        parts.select("fold", "role", "target", F.posexplode("cells").alias("cell", "v"))
        .groupBy("fold", "role", "target", "cell")
        .agg(F.sum("v").alias("v"))
    )
    cells: dict = {}
    for r in sums.collect():
        at = (r["fold"], r["role"], r["target"])
        cells.setdefault(at, np.zeros(size * size + 3))[r["cell"]] = r["v"]
    if robust:
        return {(f, t): (c[:-3].reshape(size, size), *c[-3:]) for (f, _, t), c in cells.items()}
    return {at: c[:-3].reshape(size, size) for at, c in cells.items()}


def fold_scales(df: DataFrame, names: list[str], folds: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Median and interquartile range of each feature over the training rows of each fold."""
    aggs = [
        F.percentile_approx(F.when(F.col(f) == 1, F.col(c)), [0.25, 0.5, 0.75], 10000).alias(f"{f}|{c}")
        for f in folds
        for c in names
    ]
    row = df.agg(*aggs).first()
    out = {}
    for f in folds:
        q = np.array([row[f"{f}|{c}"] for c in names], float)
        iqr = q[:, 2] - q[:, 0]
        out[f] = (q[:, 1], np.where(iqr == 0, 1.0, iqr))
    return out


def _scaled(moments: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The same sums for scaled features; scaling is linear, so no further pass is needed."""
    k = len(centre)
    a = np.eye(k + 2)
    a[1 : k + 1, 0] = -centre / scale
    a[range(1, k + 1), range(1, k + 1)] = 1.0 / scale
    return a @ moments @ a.T


def _centred(m: np.ndarray):
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    y_mean = m[0, -1] / n
    g = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    c = m[1:-1, -1] / n - mean * y_mean
    return n, mean, y_mean, g, c


def ridge_paths(m: np.ndarray, alphas) -> np.ndarray:
    """Coefficients with the intercept first, one column per penalty."""
    n, mean, y_mean, g, c = _centred(m)
    b = np.column_stack([np.linalg.lstsq(g + np.eye(len(c)) * a / n, c, rcond=None)[0] for a in alphas])
    return np.vstack([y_mean - mean @ b, b])


def net_paths(moments: list[np.ndarray], alphas, l1, sweeps: int = 1000, tol: float = 1e-5) -> np.ndarray:
    """Elastic-net coefficients by coordinate descent on the sums.

    All problems and candidates advance together; the result is indexed by problem,
    coefficient (intercept first) and candidate.
    """
    parts = [_centred(m) for m in moments]
    mean, y_mean, g, c = (np.array([p[i] for p in parts]) for i in (1, 2, 3, 4))
    alphas, l1 = np.asarray(alphas, float), np.asarray(l1, float)
    soft, ridge = alphas * l1, alphas * (1 - l1)
    b = np.zeros((len(parts), c.shape[1], len(alphas)))
    for _ in range(sweeps):
        worst = 0.0
        for j in range(c.shape[1]):
            own = g[:, j, j, None]
            rest = c[:, j, None] - np.matmul(g[:, None, j], b)[:, 0] + own * b[:, j]
            new = np.sign(rest) * np.maximum(np.abs(rest) - soft, 0) / np.maximum(own + ridge, 1e-300)
            worst = max(worst, np.abs(new - b[:, j]).max())
            b[:, j] = new
        if worst < tol:
            break
    intercept = y_mean[:, None] - np.einsum("pk,pkc->pc", mean, b)
    return np.concatenate([intercept[:, None], b], axis=1)


def huber_fits(
    df: DataFrame, names: list[str], targets: list[str], folds: list[str], scales: dict, moments: dict,
    *, passes: int = 30, tol: float = 1e-4,
) -> dict:
    """Huber coefficients on the scaled features, per fold and target.

    Reweighted least squares with the scale estimated alongside. Every pass over the data
    advances all folds and targets together.
    """

    def raw(b, f):
        centre, scale = scales[f]
        slope = b[1:] / scale
        return np.concatenate([[b[0] - slope @ centre], slope])

    state = {}
    for t in targets:
        for f in folds:
            m = _scaled(moments[f, 1, t], *scales[f])
            b = ridge_paths(m, [HUBER_ALPHA])[:, 0]
            state[f, t] = (b, max(rmse_from_moments(m, b[:, None])[0], 1e-9))
    for _ in range(passes):
        sums = fold_moments(df, names, targets, folds, {k: (raw(b, k[0]), s) for k, (b, s) in state.items()})
        moved = 0.0
        for (f, t), (m, inlier_squares, outliers, n) in sums.items():
            old, sigma = state[f, t]
            m = _scaled(m, *scales[f])
            penalty = np.diag([0.0] + [HUBER_ALPHA * sigma] * len(names))
            b = np.linalg.lstsq(m[:-1, :-1] + penalty, m[:-1, -1], rcond=None)[0]
            spread = n - outliers * HUBER_EPSILON**2
            new_sigma = max(np.sqrt(inlier_squares / spread), 1e-9) if spread > 0 else sigma
            moved = max(moved, np.abs(b - old).max() / new_sigma, abs(new_sigma / sigma - 1))
            state[f, t] = (b, new_sigma)
        if moved < tol:
            break
    return {k: b for k, (b, _) in state.items()}


def rmse_from_moments(m: np.ndarray, coefs: np.ndarray) -> np.ndarray:
    """RMSE of each column of ``coefs`` on the rows behind the sums."""
    full = np.vstack([coefs, -np.ones(coefs.shape[1])])
    return np.sqrt(np.maximum(np.einsum("ic,ij,jc->c", full, m, full), 0) / m[0, 0])


def candidates() -> list[dict]:
    out = [{"kind": "ridge", "alpha": float(a), "l1": 0.0} for a in RIDGE_ALPHAS]
    out += [{"kind": "net", "alpha": float(a), "l1": float(r)} for a in NET_ALPHAS for r in NET_L1]
    return out + [{"kind": "huber", "alpha": HUBER_ALPHA, "l1": 0.0}]


def linear_search(train: DataFrame, names: list[str], targets: list[str], *, huber: bool = True) -> pd.DataFrame:
    """Mean fold RMSE of every candidate and target: columns target, kind, alpha, l1, cv_rmse."""
    folds = [f"fold_{i + 1}" for i in range(FOLDS)]
    df = with_fold_roles(train).select(*names, *targets, *folds).persist()
    scales = fold_scales(df, names, folds)
    moments = fold_moments(df, names, targets, folds)
    grid = [c for c in candidates() if huber or c["kind"] != "huber"]
    net = [c for c in grid if c["kind"] == "net"]
    robust = huber_fits(df, names, targets, folds, scales, moments) if huber else {}
    df.unpersist()
    jobs = [(t, f) for t in targets for f in folds]
    fitted = {(t, f, role): _scaled(moments[f, role, t], *scales[f]) for t, f in jobs for role in (1, 2)}
    nets = net_paths([fitted[t, f, 1] for t, f in jobs], [c["alpha"] for c in net], [c["l1"] for c in net])
    total = {t: np.zeros(len(grid)) for t in targets}
    for (t, f), net_coefs in zip(jobs, nets):
        coefs = [ridge_paths(fitted[t, f, 1], RIDGE_ALPHAS), net_coefs]
        if huber:
            coefs.append(robust[f, t][:, None])
        total[t] += rmse_from_moments(fitted[t, f, 2], np.hstack(coefs)) / len(folds)
    return pd.DataFrame([{"target": t, **c, "cv_rmse": float(s)} for t in targets for c, s in zip(grid, total[t])])


def estimator(candidate: dict, names: list[str], target: str, n: int, y_std: float) -> Pipeline:
    """Pipeline of a candidate.

    Spark divides its penalty by the deviation of the target, hence the factor. The normal
    solver reads the data once.
    """
    alpha, l1 = candidate["alpha"], candidate["l1"]
    cols = {"featuresCol": "_scaled", "labelCol": target, "standardization": False}
    if candidate["kind"] == "huber":
        lr = LinearRegression(**cols, loss="huber", epsilon=HUBER_EPSILON, regParam=2 * alpha / n, maxIter=100)
    elif candidate["kind"] == "ridge":
        lr = LinearRegression(**cols, solver="normal", regParam=alpha * y_std / n)
    else:
        reg = alpha * l1 + alpha * (1 - l1) * y_std
        lr = LinearRegression(
            **cols, solver="normal", regParam=reg, elasticNetParam=alpha * l1 / reg, maxIter=500, tol=1e-9
        )
    scaler = RobustScaler(inputCol="_features", outputCol="_scaled", withCentering=True, relativeError=1e-4)
    return Pipeline(stages=[assembler(names), scaler, lr])


def fit_linear(train: DataFrame, names: list[str], target: str, candidate: dict) -> PipelineModel:
    rows = train.where(F.col(target).isNotNull())
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("s")).first()
    return estimator(candidate, names, target, stats["n"], stats["s"] or 1.0).fit(rows)


def select_and_fit(train: DataFrame, names: list[str], targets: list[str], **search) -> dict[str, tuple[dict, PipelineModel]]:
    """Best candidate and its model, refitted on all training rows, per target."""
    scores = linear_search(train, names, targets, **search)
    best = scores.sort_values("cv_rmse", kind="stable").groupby("target").first()

    def fit(t):
        row = best.loc[t]
        choice = {"kind": row["kind"], **{c: float(row[c]) for c in ("alpha", "l1", "cv_rmse")}}
        return t, (choice, fit_linear(train, names, t, choice))

    with ThreadPoolExecutor(len(targets)) as pool:
        return dict(pool.map(fit, targets))
