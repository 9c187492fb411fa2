import datetime as dt
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationcast.operators.cleaning import iqr_bounds
from stationcast.plans.features import add_features
from stationcast.queries import QUERIES, load_all, streams
from stationcast.queries.features import bounds_before_cut
from stationcast.queries.inputs import daily
from stationcast.schemas import CAPPED, HORIZONS, KEY, MEASURES, TIME
from stationcast.streaming import features as sf
from stationcast.streaming import history, ingest

D0 = dt.datetime(2024, 1, 1)
SCHEMA = "k string, t timestamp_ntz, id int, v double"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def land(spark, path, data):
    df = spark.createDataFrame(data, SCHEMA)
    df.write.mode("append").parquet(path)
    return df.schema


def at(day, hour=0):
    return D0 + dt.timedelta(days=day, hours=hour)


def days(spark, path):
    return {(r["k"], (r["day"] - D0.date()).days): r["v"] for r in ingest.current(spark, path, ["k", "day"]).collect()}


def test_late_rows_within_the_watermark_count_and_older_ones_do_not(spark, tmp_path):
    landing, log = str(tmp_path / "in"), str(tmp_path / "log")

    def step(data):
        schema = land(spark, landing, data)
        stream = ingest.daily_updates(ingest.read_landing(spark, landing, schema), "k", "t", ["v"], [], "2 days")
        ingest.run_available(stream, str(tmp_path / "cp"), lambda b, i: ingest.append_changes(b, i, log))

    step([("a", at(0, 1), 1, 10.0), ("a", at(5), 2, 1.0)])
    step([("a", at(4), 3, 7.0)])  # late, inside the watermark
    step([("a", at(0, 2), 4, 1000.0), ("a", at(5, 2), 5, 3.0)])  # day 0 is closed
    assert days(spark, log) == {("a", 0): 10.0, ("a", 4): 7.0, ("a", 5): 2.0}


def test_duplicates_are_dropped_across_batches(spark, tmp_path):
    landing, log = str(tmp_path / "in"), str(tmp_path / "log")
    data = [("a", at(0), 1, 1.0), ("a", at(0, 1), 2, 2.0)]
    for extra in ([], [("a", at(0, 2), 3, 3.0)]):
        schema = land(spark, landing, data + extra)
        stream = ingest.deduplicate(ingest.read_landing(spark, landing, schema), ["k", "id"], "t", "10 days")
        ingest.run_available(stream, str(tmp_path / "cp"), lambda b, i: ingest.append_changes(b, i, log), mode="append")
    assert sorted(r["id"] for r in spark.read.parquet(log).collect()) == [1, 2, 3]


def test_redelivered_day_replaces_the_stored_one(spark, tmp_path):
    landing, log = str(tmp_path / "in"), str(tmp_path / "log")
    sink = ingest.delivery_sink(log, "k", "t", ["v"], [], "delivery")
    # the second delivery of day 1 comes in three batches
    parts = [[("a", at(1), 1, 1.0), ("a", at(2), 2, 2.0)], [("a", at(1), 3, 10.0)], [("a", at(1, 1), 4, 20.0)], [("a", at(1, 2), 5, 90.0)]]
    for i, data in enumerate(parts):
        schema = land(spark, landing, data)
        stream = ingest.read_landing(spark, landing, schema).withColumn("delivery", F.when(F.col("id") < 3, 1).otherwise(2))
        ingest.run_available(stream, str(tmp_path / "cp"), sink)
    got = ingest.newest_deliveries(spark, log, "k", ["v"], [], "delivery").collect()
    assert {(r["day"] - D0.date()).days: r["v"] for r in got} == {1: 40.0, 2: 2.0}


def test_replayed_batch_changes_nothing_and_logs_compact(spark, tmp_path):
    log = str(tmp_path / "log")
    first = spark.createDataFrame([("a", D0.date(), 1.0), ("b", D0.date(), 2.0)], "k string, day date, v double")
    second = spark.createDataFrame([("a", D0.date(), 9.0)], "k string, day date, v double")
    for batch, i in ((first, 0), (second, 1), (second, 1), (second, 1)):
        ingest.append_changes(batch, i, log)
    assert spark.read.parquet(log).count() == 3 and days(spark, log) == {("a", 0): 9.0, ("b", 0): 2.0}
    ingest.compact(spark, log, str(tmp_path / "log2"), ["k", "day"])
    assert days(spark, str(tmp_path / "log2")) == days(spark, log)
    assert spark.read.parquet(str(tmp_path / "log2")).count() == 2
    # the last batch is replayed after the compaction, and a new checkpoint starts again at 0
    ingest.append_changes(second, 1, str(tmp_path / "log2"))
    assert days(spark, str(tmp_path / "log2")) == {("a", 0): 9.0, ("b", 0): 2.0}
    ingest.append_changes(first, 0, str(tmp_path / "log2"), run=1)
    assert days(spark, str(tmp_path / "log2")) == {("a", 0): 1.0, ("b", 0): 2.0}


def daily_rows(data):
    """Days and cells of (day, value): the series is the value, every other cell a function of it or missing."""
    days = np.array([d for d, _ in data], np.int64)
    cells = np.array([[v] + [np.nan if (d + j) % 3 == 0 else v * j for j in range(1, len(history.CELLS))] for d, v in data])
    return days, cells.reshape(len(data), len(history.CELLS))


@pytest.mark.parametrize("late", [0, 1, 4, 9])
def test_state_gives_what_a_recompute_gives(late):
    rng = np.random.default_rng(late)
    for _ in range(40):
        days = np.sort(rng.choice(90, rng.integers(1, 45), replace=False))
        days, cells = daily_rows([(int(d), float("nan") if rng.random() < 0.2 else float(rng.integers(0, 99))) for d in days])
        order = np.argsort(days + rng.integers(0, late + 1, len(days)), kind="stable")  # no row is later than that
        past, got = history.History.empty(), {}
        for at in range(0, len(days), 3):
            part = order[at:at + 3]
            both = np.append(part, part)  # an older version of each row comes with it
            stamps = np.append(np.full(len(part), 2 * at + 1), np.full(len(part), 2 * at))
            past, out, columns = history.advance(past, days[both], stamps, np.vstack([cells[part], cells[part] + 1]), late)
            got |= dict(zip(out.tolist(), columns))
            past = history.History.of(past.row())
        assert len(past.days) <= late + history.BEFORE + history.AHEAD + 1
        _, out, columns = history.advance(history.History.empty(), days, np.zeros(len(days), np.int64), cells, 10**6)
        assert sorted(got) == out.tolist() and np.allclose(np.array([got[d] for d in out.tolist()]), columns, equal_nan=True)


def test_rows_of_final_days_and_older_versions_change_nothing():
    days, cells = daily_rows([(d, float(d)) for d in range(20)])
    past, _, _ = history.advance(history.History.empty(), days, np.full(20, 5), cells, 2)
    same, out, _ = history.advance(past, days[:3], np.full(3, 9), cells[:3] + 1, 2)
    assert same is past and not len(out)
    after, out, columns = history.advance(past, days[-1:], np.array([4]), cells[-1:] + 100, 2)
    assert out[-1] == 19 and columns[-1][0] == 19.0 and np.array_equal(after.cells, past.cells, equal_nan=True)


def land_daily(spark, path, batch_id, rows, run=0):
    data = [(k, at(d), float(v), None if d % 3 else float(v * 2)) for k, d, v in rows]
    df = spark.createDataFrame(data, f"{KEY} long, {TIME} timestamp_ntz, aqi double, pm10 double")
    rest = {m: F.lit(None).cast("double") for m in MEASURES if m not in ("aqi", "pm10")}
    ingest.append_changes(df.withColumns(rest).select(KEY, TIME, *MEASURES), batch_id, path, run)


def test_features_and_forecasts_follow_late_days_and_a_new_model(spark, tmp_path):
    daily, features, forecasts = (str(tmp_path / n) for n in ("daily", "features", "forecasts"))
    history_rows = [(k, d, (d * 7 + k) % 50) for k in (1, 2) for d in range(30) if (k, d) != (1, 27)]
    land_daily(spark, daily, 0, history_rows)
    bounds = iqr_bounds(spark.read.parquet(daily), KEY, CAPPED)
    weights = spark.createDataFrame([(h, "linear", 1.0) for h in HORIZONS], "horizon string, model string, weight double")
    versions = {"now": 10.0}

    def score(rows):  # a model that says one number, read anew for each batch
        return rows.select(KEY, TIME, F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon"), F.lit(versions["now"]).alias("p_linear"))

    def step():
        rows = sf.feature_stream(spark, daily, bounds, 5)
        sink = sf.forecast_sink(features, forecasts, score, weights, F.lit("2024-02-01").cast("date"))
        ingest.run_available(rows, str(tmp_path / "cp"), sink, mode="append", state_partitions=2)
        found = {r[KEY]: r["blend"]["hd1"] for r in ingest.current(spark, forecasts, [KEY]).collect()}
        return found

    def expected():
        return add_features(ingest.current(spark, daily, [KEY, TIME]), bounds=bounds)

    assert step() == {1: 10.0, 2: 10.0}
    land_daily(spark, daily, 1, [(1, 30, 3)])  # the next day of one station
    land_daily(spark, daily, 2, [(1, 27, 44), (3, 30, 1)])  # a late day, a new station
    land_daily(spark, daily, 3, [(1, 30, 4)])  # and the next day again
    versions["now"] = 20.0
    assert step() == {1: 20.0, 2: 10.0, 3: 20.0}
    land_daily(spark, daily, 3, [(1, 30, 4)])  # a batch that is repeated
    assert step() == {1: 20.0, 2: 10.0, 3: 20.0}
    got = ingest.current(spark, features, [KEY, TIME])
    want = expected().select(got.columns)
    assert got.count() == want.count() == 62
    close = lambda c: F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) < 1e-9, F.col(f"a.{c}").isNull() & F.col(f"b.{c}").isNull())
    both = got.alias("a").join(want.alias("b"), (F.col(f"a.{KEY}") == F.col(f"b.{KEY}")) & (F.col(f"a.{TIME}") == F.col(f"b.{TIME}")))
    names = [c for c in got.columns if c not in (KEY, TIME)]
    assert len(names) > 25 and both.where(reduce(lambda x, y: x & y, map(close, names))).count() == 62


@pytest.fixture
def plain_state(spark):
    """The session with the state provider that Spark has of itself: it has no column families."""
    usual = spark.conf.get(STATE_STORE)
    plain = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(STATE_STORE, plain)
    yield spark
    assert spark.conf.get(STATE_STORE) == plain  # left as it was
    spark.conf.set(STATE_STORE, usual)


@pytest.fixture
def events_dir(spark, tmp_path):
    kinds = ["view", "click", "purchase", "error", "signup"]
    data = [(i, at(i % 30, i % 24), i % 2 + 1, kinds[i // 7 % 5], float(i * 13 % 97), f'{{"k": {i % 11}}}') for i in range(400)]
    df = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_the_feature_stream_brings_its_state_provider(plain_state, events_dir, rows):
    load_all()
    got, want = (rows(QUERIES[q](plain_state, events_dir)) for q in ("stream_features", "train_capped_features"))
    assert got == want and len(got) == 30


def test_chained_forecasts_bring_their_state_provider(plain_state, events_dir, tmp_path):
    def score(features):  # says the newest value of the index
        return features.select(KEY, TIME, F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon"), F.col("aqi").alias("p_linear"))

    weights = plain_state.createDataFrame([(h, "linear", 1.0) for h in HORIZONS], "horizon string, model string, weight double")
    bounds = bounds_before_cut(daily(plain_state, events_dir))
    path = str(tmp_path / "out")
    sink = sf.forecast_sink(f"{path}/features", f"{path}/forecast", score, weights, F.lit("2024-02-01").cast("date"))
    streams.run_chained(plain_state, events_dir, path, bounds, sink)
    found = {r[KEY]: (r["latest_feature_timestamp"], r["blend"]["hd3"]) for r in ingest.current(plain_state, f"{path}/forecast", [KEY]).collect()}
    newest = {r[KEY]: (r[TIME], r["aqi"]) for r in add_features(daily(plain_state, events_dir), bounds=bounds).orderBy(TIME).collect()}
    assert found == newest and len(found) == 2


def test_a_store_scores_with_the_newest_version(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression

    from stationcast.models import store as st
    from stationcast.models.frame import assembler

    path = str(tmp_path / "models")
    rows = spark.createDataFrame([(1, at(0), 2.0, 5.0), (2, at(0), None, 7.0)], f"{KEY} long, {TIME} timestamp_ntz, x double, y double")
    means = spark.createDataFrame([(2, 3.0)], f"{KEY} long, x double")

    def version(n, factor):
        train = spark.createDataFrame([(float(i), factor * i) for i in range(9)], "x double, t double")
        fit = Pipeline(stages=[assembler(["x"]), LinearRegression(featuresCol="_features", labelCol="t")]).fit(train)
        st.publish({("linear", h): fit for h in HORIZONS}, ["x"], means, path, n)

    store = st.ModelStore(spark, path)
    version(1, 10.0)
    say = lambda: {r[KEY]: round(r["p_linear"], 6) for r in store.score(rows).where("horizon = 'hd2'").collect()}
    assert say() == {1: 20.0, 2: 30.0} and store.version == 1  # the missing value is the station's mean
    version(2, 100.0)
    assert say() == {1: 200.0, 2: 300.0} and store.version == 2
    version(0, 1.0)
    assert say() == {1: 200.0, 2: 300.0} and store.version == 2


def test_the_gate_runs_the_update_only_when_it_is_due(spark):
    df, ran = spark.createDataFrame([(at(3),)], "t timestamp_ntz"), []
    assert not sf.refresh(df, "t", at(3).date(), lambda: ran.append(1)) and ran == []
    assert sf.refresh(df, "t", at(4).date(), lambda: ran.append(2)) and sf.refresh(None, "t", at(0).date(), lambda: ran.append(3)) and ran == [2, 3]


def test_freshness_gate(spark):
    df = spark.createDataFrame([(at(3),), (at(1),)], "t timestamp_ntz")
    assert sf.is_fresh(df, "t", at(3).date()) and not sf.is_fresh(df, "t", at(4).date())
    assert not sf.is_fresh(df.where(F.lit(False)), "t", at(0).date())
