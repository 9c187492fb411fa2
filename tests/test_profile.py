import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationcast.operators import metrics, profile
from stationcast.operators.quantiles import exact_quantiles, order_image


@pytest.mark.parametrize("n", [1, 2, 3, 50, 997])
@pytest.mark.parametrize("digits", [None, 2])
def test_quantiles_match_numpy(spark, n, digits):
    rng = random.Random(n)
    data = [(g, round(rng.choice([rng.uniform(-50, 50), 7.25]), 2)) for g in "ab" for _ in range(n)] + [("a", None)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = exact_quantiles(df, ["g"], "v", probs, names, digits=digits).collect()
    assert len(got) == 2
    for r in got:
        want = np.quantile([v for g, v in data if g == r["g"] and v is not None], probs)
        assert np.allclose([r[x] for x in names], want, atol=1e-9)


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(11)] + [("b", 5.0), ("b", 5.0), ("a", None)], "g string, v double")
    got = {(r["g"], r["bin"]): r["count"] for r in profile.histogram(df, ["g"], "v", 5).collect()}
    assert got == {("a", 0): 2, ("a", 1): 2, ("a", 2): 2, ("a", 3): 2, ("a", 4): 3, ("b", 0): 2}


def test_boxplot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -50.0]
    df = spark.createDataFrame([(1, v) for v in values], "g int, v double")
    r = profile.boxplot_stats(df, ["g"], "v", digits=2).first()
    assert (r["median"], r["whisker_lo"], r["whisker_hi"], r["outliers"], r["count"]) == (3.0, 1.0, 5.0, 2, 7)


def test_correlation_uses_complete_pairs(spark):
    data = [(1.0, 2.0, None), (2.0, 4.1, 1.0), (3.0, 6.0, 5.0), (None, 1.0, 2.0), (5.0, 9.0, 0.5)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    df = df.withColumn("a", F.col("a") + 1e9).withColumn("constant", F.lit(1.0))
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df, df.columns).collect()}
    assert len(got) == 16 and got["a", "constant"] is None
    x = np.array(data, float)
    for i, p in enumerate("abc"):
        for j, q in enumerate("abc"):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert np.isclose(got[p, q], np.corrcoef(x[ok, i], x[ok, j])[0, 1])


def test_correlation_without_common_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, 3.0)], "a double, `b.c` double")
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df, df.columns).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b.c"): None, ("b.c", "a"): None, ("b.c", "b.c"): None}
    assert all(r["corr"] is None for r in profile.correlation_matrix(df.where("false"), df.columns).collect())


def test_correlation_of_wide_tables(spark):
    df = spark.range(50).select(*[((F.col("id") * (i + 3) * 7919) % (11 + i)).cast("double").alias(f"c{i}") for i in range(60)])
    got = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df, df.columns).collect()}
    want = np.corrcoef(np.array(df.collect()).T)
    assert len(got) == 3600 and all(np.isclose(got[f"c{i}", f"c{j}"], want[i, j]) for i in range(60) for j in range(60))


def test_profiles_round_nothing_and_skip_nan(spark):
    df = spark.createDataFrame([(0.001,), (0.002,), (0.004,), (float("nan"),), (float("inf"),), (None,)], "v double")
    r = profile.describe(df, ["v"]).first()
    assert np.isclose(r["mean"], 0.007 / 3) and r["p50"] == 0.002 and r["count"] == 3 and r["max"] == 0.004
    wide = spark.createDataFrame([(1e16,), (1e-9,), (2e-9,)], "v double")
    q = exact_quantiles(wide, [], "v", [0.0, 0.5, 1.0], ["a", "b", "c"]).first()
    assert (q["a"], q["b"], q["c"]) == (1e-9, 2e-9, 1e16)
    with pytest.raises(Exception, match="more than 2 decimals"):
        profile.describe(df, ["v"], digits=2).collect()


def test_quantiles_of_a_group_without_name(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "g string, v double")
    got = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", [0.5], ["m"]).collect()}
    assert got == {None: 2.0, "a": 5.0}


def test_kde_integrates_to_one(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("a", float(v)) for v in rng.normal(0, 1, 500).round(2)], "g string, v double")
    out = profile.kde_grid(df, ["g"], "v", 200).orderBy("i").collect()
    x, d = (np.array([r[c] for r in out]) for c in ("x", "density"))
    assert len(out) == 200 and 0.97 < np.trapezoid(d, x) <= 1.0


def test_metrics_definitions(spark):
    df = spark.createDataFrame([(0.0, 0.5), (100.0, 115.0), (40.0, 60.0), (None, 1.0)], "y double, p double")
    m = metrics.regression_metrics(df, [], "y", "p").first()
    y, p = np.array([0.0, 100.0, 40.0]), np.array([0.5, 115.0, 60.0])
    assert m["n"] == 3 and np.isclose(m["rmse"], np.sqrt(((y - p) ** 2).mean()))
    assert np.isclose(m["r2"], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert np.isclose(m["mape_pct"], (np.abs(y - p) / np.maximum(np.abs(y), 1)).mean() * 100)
    assert np.isclose(m["acc_category"], 1 / 3) and np.isclose(m["acc_within_15"], 2 / 3)


@pytest.mark.parametrize("p, r2", [(5.0, 1.0), (6.0, 0.0)])
def test_r2_of_a_constant_truth(spark, p, r2):
    df = spark.createDataFrame([(5.0, p), (5.0, 5.0)], "y double, p double")
    assert metrics.regression_metrics(df, [], "y", "p").first()["r2"] == r2


def test_missing_counts(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "a int, `b.c` double")
    got = {r["column"]: (r["type"], r["rows"], r["missing"]) for r in profile.missing_per_column(df).collect()}
    assert got == {"a": ("int", 2, 0), "b.c": ("double", 2, 1)}


def test_order_image_keeps_the_order_and_tells_doubles_apart(spark):
    import struct

    rng = np.random.default_rng(0)
    bits = rng.integers(0, 0x7FF0000000000000, 3000)
    doubles = [struct.unpack("<d", struct.pack("<q", int(b)))[0] for b in bits]
    edges = [0.0, -0.0, 5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), 1.7976931348623157e308, 1e16, 1.0, np.nextafter(1.0, 0), np.nextafter(1.0, 2)]
    edges += [f for e in range(-1074, 1024, 7) for p in [2.0**e] for f in (p, float(np.nextafter(p, 0)), float(np.nextafter(p, 1e308)))]
    values = [float(v) for v in doubles + edges] + [-float(v) for v in doubles + edges]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_image(F.col("v") + F.lit(0.0)).alias("k"))
    want = lambda v: struct.unpack("<q", struct.pack("<d", abs(v)))[0] * (-1 if v < 0 else 1)
    assert all(r["k"] == want(r["v"]) for r in df.collect())


@pytest.mark.parametrize("digits", [None, 2])
def test_quantiles_of_any_distribution(spark, digits):
    rng = np.random.default_rng(1)
    groups = {
        "tail": np.append(np.round(rng.random(3000), 2), [1e13, -1e13] if digits else [1e16, 1e300, -1e308]),
        "close": 1.0 + np.round(rng.integers(0, 9, 700) * 1e-2, 2) if digits else 1.0 + rng.integers(0, 9, 700) * 2.0**-52,
        "signs": np.round(rng.normal(size=501), 2), "same": np.full(40, 7.25), "one": np.array([3.0]), "zeros": np.array([0.0, -0.0, 0.0, 1.0]),
    }
    if not digits:
        groups["tiny"] = rng.integers(-50, 50, 300) * 5e-324
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("tail", None), ("tail", float("nan")), (None, 2.0), (None, 4.0), ("void", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: list(r)[1:] for r in exact_quantiles(df, ["g"], "v", probs, [f"p{i}" for i in range(5)], digits=digits).collect()}
    assert got.pop(None) == [2.0, 2.5, 3.0, 3.8, 4.0] and got.keys() == groups.keys()
    for g, vs in groups.items():
        vs = np.sort(vs)
        for p, value in zip(probs, got[g]):
            at = (len(vs) - 1) * p
            lo, hi = vs[int(np.floor(at))], vs[int(np.ceil(at))]
            assert value == pytest.approx(lo + (hi - lo) * (at - np.floor(at)), rel=1e-12, abs=1e-300)
