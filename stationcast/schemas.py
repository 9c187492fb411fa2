"""Column names, schemas and vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "station_id"
TIME = "event_timestamp"

# ---- fixed values: measures of a reading and how a day summarises them ----
AIR = ["aqi", "pm25", "pm10", "no2", "so2", "co", "o3"]
WEATHER = ["temperature", "humidity", "precipitation"]
MEASURES = AIR + WEATHER
SUMMED = ["precipitation"]
AVERAGED = [m for m in MEASURES if m not in SUMMED]
# measures whose outliers are capped; the index itself, pm25 and co are left alone
CAPPED = ["pm10", "so2", "no2", "o3", "temperature", "humidity", "precipitation"]

# ---- fixed values: field names of the hourly source payloads ----
AIR_PAYLOAD = {
    "us_aqi": "aqi",
    "pm2_5": "pm25",
    "pm10": "pm10",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "carbon_monoxide": "co",
    "ozone": "o3",
}
WEATHER_PAYLOAD = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "precipitation": "precipitation",
}

# ---- fixed values: names under which features are published ----
PUBLISHED = {
    "aqi": "AQI",
    "pm25": "PM2.5",
    "pm10": "PM10",
    "no2": "NO2",
    "so2": "SO2",
    "co": "CO",
    "o3": "O3",
    "temperature": "Temperature",
    "humidity": "Humidity",
    "precipitation": "Precipitation",
    "log_pm25": "log_PM2.5",
    "log_co": "log_CO",
    "aqi_lag_1": "AQI_lag_1",
    "aqi_lag_2": "AQI_lag_2",
    "aqi_roll_mean_3": "AQI_roll_mean_3",
    "aqi_roll_std_3": "AQI_roll_std_3",
    "aqi_diff": "AQI_diff",
    "aqi_t1": "AQI_t+1",
    "aqi_t2": "AQI_t+2",
    "aqi_t3": "AQI_t+3",
}

# ---- fixed values: vocabularies ----
SEASONS = ["Spring", "Summer", "Winter"]
WEEKDAYS = list(range(7))  # Monday = 0
FAMILIES = ["lightgbm", "linear", "hgbr", "randomforest"]  # also the fallback order
FAMILY_PREFIX = {"lightgbm": "lgb", "linear": "linear", "hgbr": "hgb", "randomforest": "rf"}
HORIZONS = ["hd1", "hd2", "hd3"]
TARGETS = ["aqi_t1", "aqi_t2", "aqi_t3"]
AQI_MIN, AQI_MAX = 0.0, 500.0

STATISTICS = [
    "log_pm25", "log_co", "aqi_lag_1", "aqi_lag_2", "aqi_roll_mean_3", "aqi_roll_std_3", "aqi_diff",
]
ONE_HOTS = [f"season_{s}" for s in SEASONS] + [f"weekday_{d}" for d in WEEKDAYS[1:]]
# ordered list of model inputs
CONTRACT = MEASURES + ["month"] + STATISTICS + ONE_HOTS

# columns that are never model inputs
NOT_FEATURES = {"date", TIME, "created", "city", KEY, *TARGETS}


def _struct(fields: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


READING_SCHEMA = _struct(
    [(KEY, T.LongType()), ("time", T.TimestampNTZType())] + [(m, T.DoubleType()) for m in MEASURES]
)

FEATURE_SCHEMA = _struct(
    [(KEY, T.LongType()), (TIME, T.TimestampNTZType())]
    + [(m, T.DoubleType()) for m in MEASURES]
    + [("month", T.IntegerType())]
    + [(s, T.DoubleType()) for s in STATISTICS]
    + [(t, T.DoubleType()) for t in TARGETS]
    + [(o, T.IntegerType()) for o in ONE_HOTS]
)

PREDICTION_SCHEMA = _struct(
    [(TIME, T.TimestampNTZType()), ("y_true", T.DoubleType()), ("y_pred", T.DoubleType())]
)

REGISTRY_SCHEMA = _struct(
    [
        ("family", T.StringType()),
        ("horizon", T.StringType()),
        ("created", T.TimestampNTZType()),
        ("path", T.StringType()),
    ]
)


def require_columns(df, required) -> None:
    """Raise when a required column is absent; looks at the schema only."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def check_schema(df, expected: T.StructType) -> None:
    """Raise unless the frame has exactly the expected names and types."""
    got = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    if got != want:
        wrong = sorted(n for n in got.keys() | want.keys() if got.get(n) != want.get(n))
        raise ValueError(f"schema differs in columns {wrong}")
