import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationcast.models import calibration, linear, training, trees, tuning
from stationcast.models.frame import training_frame
from stationcast.schemas import HORIZONS, KEY, TARGETS, TIME

D0 = dt.datetime(2022, 1, 1)


@pytest.fixture(scope="module")
def features(spark):
    """Two stations, 500 days: AR(1) index with a yearly cycle, one informative and one useless feature."""
    rng = np.random.default_rng(11)
    rows = []
    for s in ("a", "b"):
        signal = rng.normal(0, 1, 504)
        aqi, level = [], 120.0
        for i in range(504):
            level = 120 + 0.7 * (level - 120) + 8 * signal[i - 1] * (i > 0) + rng.normal(0, 3)
            aqi.append(float(level))
        for i in range(500):
            rows.append((
                s, D0 + dt.timedelta(days=i), aqi[i], float(signal[i]), float(rng.normal()), None,
                aqi[i - 1] if i else None, *[aqi[i + h] if i + h < 500 else None for h in (1, 2, 3)],
            ))
    schema = f"{KEY} string, {TIME} timestamp_ntz, aqi double, signal double, noise double, empty double, lag double, " + ", ".join(f"{t} double" for t in TARGETS)
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def frame(features):
    df, names = training_frame(features, 60)
    return df.persist(), names


def test_frame_has_no_gaps_and_no_empty_feature(frame):
    df, names = frame
    assert names == ["aqi", "signal", "noise", "lag"]
    assert df.dropna(subset=names).count() == df.count() == 1000
    assert df.where("split = 'test'").count() == 120


def moments(spark, x, y):
    z = np.column_stack([np.ones(len(x)), x, y])
    return z.T @ z


def test_moments_and_scaling(spark, frame):
    df, names = frame
    rows = linear.with_fold_roles(df.where("split = 'train'")).persist()
    folds = ["fold_1", "fold_2", "fold_3"]
    got = linear.fold_moments(rows, names, TARGETS, folds)
    pdf = rows.toPandas()
    part = pdf[(pdf["fold_2"] == 1) & pdf["aqi_t2"].notna()]
    want = moments(spark, part[names].to_numpy(float), part["aqi_t2"].to_numpy(float))
    assert np.allclose(got["fold_2", 1, "aqi_t2"], want)
    centre, scale = np.array([1.0, 2, 3, 4]), np.array([2.0, 1, 4, 0.5])
    scaled = moments(spark, (part[names].to_numpy(float) - centre) / scale, part["aqi_t2"].to_numpy(float))
    assert np.allclose(linear._scaled(want, centre, scale), scaled)


def test_ridge_and_net_solve_their_problems(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.2, 3]
    y = x @ [2, -1, 3, 0.5] + 10 + rng.normal(size=300)
    m = moments(spark, x, y)
    xc, yc = x - x.mean(0), y - y.mean()
    ridge = linear.ridge_paths(m, [3.0])[:, 0]
    assert np.allclose(ridge[1:], np.linalg.solve(xc.T @ xc + 3 * np.eye(4), xc.T @ yc))
    b = linear.net_paths([m, m], [0.5], [0.4], sweeps=20000, tol=1e-12)[1, 1:, 0]
    slope = xc.T @ (yc - xc @ b) / 300 - 0.5 * 0.6 * b  # optimality conditions
    assert np.allclose(slope[b != 0], 0.5 * 0.4 * np.sign(b[b != 0]), atol=1e-6)
    assert (np.abs(slope[b == 0]) <= 0.5 * 0.4 + 1e-9).all()
    coefs = np.column_stack([ridge, np.r_[ridge[0] + 1, ridge[1:]]])
    want = [np.sqrt(((y - c[0] - x @ c[1:]) ** 2).mean()) for c in coefs.T]
    assert np.allclose(linear.rmse_from_moments(m, coefs), want)


@pytest.mark.parametrize("kind, alpha, l1", [("ridge", 5.0, 0.0), ("net", 0.5, 0.4)])
def test_final_fit_uses_the_same_penalty(spark, frame, kind, alpha, l1):
    df, names = frame
    train = df.where("split = 'train'")
    model = linear.fit_linear(train, names, "aqi_t1", {"kind": kind, "alpha": alpha, "l1": l1})
    pdf = train.where("aqi_t1 is not null").toPandas()
    scaler, lr = model.stages[1], model.stages[2]
    x = (pdf[names].to_numpy(float) - scaler.median.toArray()) / scaler.range.toArray()
    m = moments(spark, x, pdf["aqi_t1"].to_numpy(float))
    paths = linear.ridge_paths(m, [alpha]) if kind == "ridge" else linear.net_paths([m], [alpha], [l1], tol=1e-10, sweeps=20000)[0]
    assert np.allclose(np.r_[lr.intercept, lr.coefficients.toArray()], paths[:, 0], atol=1e-4)


def test_huber_ignores_outliers(spark):
    rng = np.random.default_rng(4)
    n = 400
    x = rng.normal(size=n)
    y = 3 * x + 5 + rng.normal(0, 0.5, n)
    y[::20] += 200
    rows = [("s", D0 + dt.timedelta(days=i), float(x[i]), float(y[i]), 1) for i in range(n)]
    df = spark.createDataFrame(rows, f"{KEY} string, {TIME} timestamp_ntz, x double, t double, fold_1 int")
    scales = {"fold_1": (np.zeros(1), np.ones(1))}
    first = linear.fold_moments(df, ["x"], ["t"], ["fold_1"])
    b = linear.huber_fits(df, ["x"], ["t"], ["fold_1"], scales, first, passes=60, tol=1e-7)["fold_1", "t"]
    assert abs(b[0] - 5) < 0.3 and abs(b[1] - 3) < 0.1


def test_search_prefers_a_good_candidate(frame):
    df, names = frame
    scores = linear.linear_search(df.where("split = 'train'"), names, TARGETS)
    assert len(scores) == 3 * (12 + 77 + 1)
    by = scores[scores["target"] == "aqi_t1"].set_index("kind")["cv_rmse"].groupby(level=0).min()
    assert by["ridge"] < 4 and by["huber"] < 4  # the noise of the series is 3
    worst = scores[scores["target"] == "aqi_t1"]["cv_rmse"].max()
    assert worst > 2 * by["ridge"]


def test_families_beat_the_last_value(features):
    models, frame, _ = training.train_families(features, 60, rounds=15, n_trees=30, huber=False)
    preds = training.score_holdout(models, frame)
    families = ["lightgbm", "linear", "hgbr", "randomforest"]
    scores = {(r["family"], r["horizon"]): r["rmse"] for r in training.holdout_metrics(preds, families).collect()}
    naive = frame.where("split = 'test' and aqi_t1 is not null").agg(F.sqrt(F.avg(F.pow(F.col("aqi") - F.col("aqi_t1"), F.lit(2))))).first()[0]
    assert all(scores[f, "hd1"] < naive for f in families)
    latest = training.score_latest(models, frame)
    assert latest.count() == 2 * len(HORIZONS)
    assert latest.where(" or ".join(f"p_{f} is null" for f in families)).count() == 0


def test_saved_models_score_the_same(spark, frame, tmp_path):
    df, names = frame
    model = linear.fit_linear(df.where("split = 'train'"), names, "aqi_t1", {"kind": "ridge", "alpha": 1.0, "l1": 0.0})
    models = {("linear", h): model for h in HORIZONS}
    training.save_models(models, str(tmp_path / "m"))
    loaded = training.load_models(str(tmp_path / "m"), ["linear"])
    a, b = (sorted(map(tuple, training.score_latest(m, df).collect())) for m in (models, loaded))
    assert a == b


def test_importance_finds_the_signal(spark, frame):
    df, names = frame
    model = trees.fit_rows(trees.forest(names, "aqi_t1", trees=20, depth=6), df.where("split = 'train'"), "aqi_t1")
    ranked = [r["feature"] for r in trees.importance(model, names, spark).collect()]
    assert set(ranked[:2]) == {"aqi", "signal"}
    permuted = {r["feature"]: r["rmse_increase"] for r in
                trees.permutation_importance(model, df.where("split = 'test'"), names, "aqi_t1").collect()}
    assert permuted["signal"] > 1 and abs(permuted["noise"]) < 0.5


def test_shuffle_is_a_permutation(frame):
    df, names = frame
    out = trees.shuffled(df, ["noise"], [KEY, TIME]).select("noise", "s_noise").toPandas()
    assert np.allclose(np.sort(out["noise"]), np.sort(out["s_noise"]))
    assert (out["noise"] != out["s_noise"]).mean() > 0.95


def test_tuning_orders_trials(frame):
    df, names = frame
    trials = [{"trees": 1, "depth": 1}, {"trees": 20, "depth": 6}]
    found = tuning.tune(df.where("split = 'train'"), "aqi_t1", lambda **kw: trees.forest(names, "aqi_t1", **kw), trials)
    assert found[0]["depth"] == 6 and found[0]["folds"] == 3
    drawn = tuning.draw_trials(tuning.FOREST_SPACE, 5, seed=1)
    assert drawn == tuning.draw_trials(tuning.FOREST_SPACE, 5, seed=1) and len(drawn) == 5


def test_calibration_is_monotone_and_flat_outside(spark):
    fit = spark.createDataFrame([("hd1", float(p), float(p * 2 + (p % 3))) for p in range(10, 60)], "horizon string, p double, y double")
    ask = spark.createDataFrame([("hd1", float(p)) for p in (0, 10, 20, 40, 59, 400)], "horizon string, p double")
    got = [r["c"] for r in calibration.isotonic_calibrate(fit, ask, "horizon", "y", "p", "c", groups=["hd1"]).orderBy("p").collect()]
    assert got == sorted(got) and got[0] == got[1] and got[-1] == got[-2]


def test_calibration_matches_brute_force(spark):
    """The isotonic fit is max over starts of min over ends of the mean between them."""
    rng = np.random.default_rng(9)
    p = np.round(rng.uniform(0, 300, 60), 1)
    p[10:20] = p[0]  # ties
    y = p + rng.normal(0, 60, 60)
    df = spark.createDataFrame([("hd1", float(a), float(b)) for a, b in zip(p, y)], "horizon string, p double, y double")
    got = {r["p"]: r["c"] for r in calibration.isotonic_calibrate(df, df, "horizon", "y", "p", "c", groups=["hd1"]).collect()}
    points = np.unique(p)
    total, n = (np.array([f(y[p == v]) for v in points]) for f in (np.sum, len))
    mean = lambda i, j: total[i : j + 1].sum() / n[i : j + 1].sum()
    k = len(points)
    want = [max(min(mean(i, j) for j in range(m, k)) for i in range(m + 1)) for m in range(k)]
    assert np.allclose([got[v] for v in points], np.clip(want, 0, 500))


def test_calibration_keeps_every_row_and_the_range(spark):
    fit = spark.createDataFrame([("hd9", float(p), float(p) * 12) for p in range(10, 60)], "horizon string, p double, y double")
    ask = spark.createDataFrame([("hd9", 59.0), ("hd9", None), ("other", 20.0), (None, 20.0), ("hd9", float("nan"))], "horizon string, p double")
    got = calibration.isotonic_calibrate(fit, ask, "horizon", "y", "p", "c").collect()
    assert len(got) == 5 and [r["c"] for r in got if r["c"] is not None] == [500.0]


def test_permutation_is_one_of_all_rows(spark):
    df = spark.range(5000).select((F.col("id") % 7).cast("string").alias("station_id"), F.col("id").alias("event_timestamp"), F.col("id").cast("double").alias("x"))
    out = trees.shuffled(df, ["x"], ["station_id", "event_timestamp"]).toPandas()
    assert len(out) == 5000 and sorted(out["s_x"]) == sorted(out["x"]) and (out["s_x"] != out["x"]).mean() > 0.99
    assert abs(np.corrcoef(out["x"], out["s_x"])[0, 1]) < 0.1
