import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from stationcast.plans.features import add_features
from stationcast.plans.update import PART, FeatureTables, part_of
from stationcast.schemas import KEY, MEASURES, STATISTICS, TARGETS, TIME

D0 = dt.datetime(2024, 1, 1)
SCHEMA = f"{KEY} string, {TIME} timestamp_ntz, " + ", ".join(f"{m} double" for m in MEASURES)
SPAN = 7


def row(rng, station, day, gaps):
    return (station, D0 + dt.timedelta(days=day), *[None if rng.random() < gaps else round(rng.uniform(1, 300), 2) for _ in MEASURES])


def frame(spark, rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def values(df):
    cols = [KEY, TIME, "month", *MEASURES, *STATISTICS, *TARGETS]
    return {(r[0], r[1]): tuple(None if v is None else round(v, 6) for v in r[2:]) for r in df.select(*cols).collect()}


def written(root):
    out = {}
    for folder, _, files in os.walk(f"{root}/features"):
        for f in files:
            if f.endswith(".parquet"):
                out.setdefault(folder.rpartition("=")[2], set()).add(f)
    return out


@pytest.fixture
def history():
    rng = random.Random(3)
    rows = {}
    for station, share, gaps in (("a", 0.9, 0.05), ("b", 0.3, 0.4), ("c", 0.6, 0.95)):
        for day in range(70):
            if rng.random() < share:
                rows[station, day] = row(rng, station, day, gaps)
    return rows


def test_same_as_computing_everything(spark, tmp_path, history):
    rng = random.Random(4)
    rows = dict(history)
    tables = FeatureTables(spark, str(tmp_path / "t"), SPAN)
    tables.create(frame(spark, rows.values()))
    empty = lambda s, d: (s, D0 + dt.timedelta(days=d), *[None] * len(MEASURES))
    steps = [
        [row(rng, s, 70, 0.2) for s in "ab"],  # the next day
        [row(rng, "a", 30, 0.0), row(rng, "b", 31, 0.5), row(rng, "c", 3, 0.0)],  # late days, new or replaced
        [empty("a", 40), empty("c", 3), empty("b", 12)],  # values that go
        [row(rng, "new", 5, 0.1), row(rng, "new", 50, 0.1), row(rng, "a", 0, 0.3), row(rng, "a", 69, 0.3)],
        [row(rng, "b", -20, 0.0), row(rng, "c", 120, 0.0)],  # before and behind all parts
    ]
    for step in steps:
        rows |= {(r[0], (r[1] - D0).days): r for r in step}
        for _ in range(2 if step is steps[2] else 1):  # a repeated update changes nothing
            tables.replace_days(frame(spark, step).withColumn(PART, part_of(F.col(TIME), SPAN)))
        whole = add_features(frame(spark, rows.values()), bounds=tables.read("bounds"))
        got, want = values(tables.features()), values(whole)
        assert got.keys() == want.keys()
        assert [k for k in want if got[k] != want[k]] == []
        assert tables.features().columns == whole.columns and tables.features().count() == len(rows)
        assert tables.daily().count() == len(rows)


def test_only_reached_parts_are_written(spark, tmp_path, history):
    tables = FeatureTables(spark, str(tmp_path / "t"), SPAN)
    full = {k: r for k, r in history.items() if k[0] == "a"}
    tables.create(frame(spark, full.values()))
    before = written(tables.root)
    rng = random.Random(5)
    step = frame(spark, [row(rng, "a", 30, 0.0)]).withColumn(PART, part_of(F.col(TIME), SPAN))
    parts = tables.replace_days(step)
    after = written(tables.root)
    assert {p for p in after if after[p] != before.get(p)} == set(map(str, parts))
    assert 1 <= len(parts) <= 4 < len(after)
    assert tables.replace_days(step.where("false")) == []
