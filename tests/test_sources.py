import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from stationcast.operators import cleaning
from stationcast.schemas import KEY, TIME
from stationcast.session import shared_root, work_path
from stationcast.sources import artifacts, files, payloads


def test_payloads(spark, rows):
    good = json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "us_aqi": [1.5, None], "pm2_5": [2, 3]}})
    uneven = json.dumps({"hourly": {"time": ["2024-01-01T00:00"], "us_aqi": [1, 2], "pm2_5": [2]}})
    df = spark.createDataFrame([(1, good), (2, ""), (3, uneven), (4, "{}"), (5, None), (6, "<html>")], "id int, text string")
    ok, bad = payloads.parse_payloads(df, ["id"], "text", {"us_aqi": "aqi", "pm2_5": "pm25"})
    assert rows(ok) == [(1, dt.datetime(2024, 1, 1), 1.5, 2.0), (1, dt.datetime(2024, 1, 1, 1), None, 3.0)]
    assert [r[0] for r in rows(bad)] == [2, 3, 4, 5, 6]


def test_newest_folder_per_family_and_horizon():
    base = "file:/x/artifact="
    names = ["lgb_AQI_t%2B1_20240101T000000Z", "lgb_AQI_t%2B1_20240201T000000Z", "rf_AQI_t%2B3_20230101T000000Z", "other"]
    got = artifacts.newest_folders([f"{base}{n}/part-0.csv" for n in names])
    assert got == ["lgb_AQI_t+1_20240201T000000Z", "rf_AQI_t+3_20230101T000000Z"]


def test_csv_keeps_microseconds(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 1, 2, 3, 123456)
    df = spark.createDataFrame([(t, None), (None, 1.0)], "t timestamp_ntz, v double")
    files.write_csv(df, str(tmp_path / "c"))
    back = files.read_csv(spark, str(tmp_path / "c"), df.schema)
    assert sorted(back.collect(), key=str) == sorted(df.collect(), key=str)


def test_fallback_only_when_csv_is_absent(spark, tmp_path):
    schema = spark.createDataFrame([(1,)], "a int").schema
    spark.createDataFrame([(1,)], schema).write.parquet(str(tmp_path / "p"))
    assert files.read_any(spark, str(tmp_path / "c"), str(tmp_path / "p"), schema).first()[0] == 1
    files.write_csv(spark.createDataFrame([(2,)], schema), str(tmp_path / "c"))
    assert files.read_any(spark, str(tmp_path / "c"), str(tmp_path / "p"), schema).first()[0] == 2


def test_only_written_partitions_are_replaced(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    make = lambda data: spark.createDataFrame(data, f"{KEY} int, day string, v int")
    files.write_partitioned(make([(1, "a", 1), (2, "a", 2), (1, "b", 3)]), path, "day", [KEY])
    files.write_partitioned(make([(1, "b", 30)]), path, "day", [KEY])
    assert rows(spark.read.parquet(path), KEY, "day", "v") == [(1, "a", 1), (1, "b", 30), (2, "a", 2)]


def test_verified_write(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, d),) for d in (1, 3)], f"{TIME} timestamp_ntz")
    report = files.write_verified(df, str(tmp_path / "v"), TIME).first()
    assert report["ok"] and report["rows"] == 2 and report["last"] == dt.datetime(2024, 1, 3)


def test_json_rows_keep_nulls(spark):
    df = spark.createDataFrame([(1, None, dt.datetime(2024, 1, 1))], "a int, b double, t timestamp_ntz")
    doc = json.loads(files.rows_as_json(df).first()[0])
    assert doc["a"] == 1 and doc["b"] is None and doc["t"].startswith("2024-01-01T00:00:00")


def test_shared_folder_comes_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_root(spark) == root and work_path(spark, "x").startswith(root)


def test_artifact_matrix(spark):
    df = spark.createDataFrame([("linear", "hd1"), ("hgbr", "hd3"), ("linear", "hd1")], "family string, horizon string")
    got = {r["family"]: (r["hd1"], r["hd3"]) for r in artifacts.artifact_matrix(df, ["linear", "hgbr"], ["hd1", "hd3"]).collect()}
    assert got == {"linear": (True, False), "hgbr": (False, True)}
    none = artifacts.artifact_matrix(df, ["linear", "lightgbm"], ["hd1"]).collect()
    assert {r["family"]: r["hd1"] for r in none} == {"linear": True, "lightgbm": False, "hgbr": False}


def test_times_with_offsets_and_bad_times(spark):
    texts = ["2024-01-01T00:00:00+05:00", "2024-01-01 00:00:00Z", "2024-01-01T00:00:00", "2024-01-01", "2024-01-01T10:00:00.5-0330", "no", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r["t"]) for r in cleaning.normalize_time(df, "t").collect()]
    assert got == ["2023-12-31 19:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00",
                   "2024-01-01 13:30:00.500000", "None", "None"]
    bad = '{"hourly": {"time": ["2024-01-01T00:00", "soon"], "x": [1.0, 2.0]}}'
    good = '{"hourly": {"time": ["2024-01-01T00:00"], "x": [1.0]}}'
    rows, rejected = payloads.parse_payloads(spark.createDataFrame([(1, bad), (2, good)], "id int, p string"), ["id"], "p", {"x": "x"})
    assert [r["id"] for r in rows.collect()] == [2] and [r["id"] for r in rejected.collect()] == [1]


def test_latest_artifact(spark):
    df = spark.createDataFrame([("f", "h", 1, "old"), ("f", "h", 3, "new"), ("f", "h", 2, "mid")], "family string, horizon string, created int, path string")
    assert artifacts.latest_artifacts(df).first()["path"] == "new"
    assert df.select(F.lit(1)).count() == 3
