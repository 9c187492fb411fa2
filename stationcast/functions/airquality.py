"""Air-quality index scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: inclusive upper bounds of categories 1..5; above them 6 ----
CATEGORY_BOUNDS = [50, 100, 150, 200, 300]
CATEGORY_LABELS = [
    "Good",
    "Moderate",
    "Unhealthy for Sensitive Groups",
    "Unhealthy",
    "Very Unhealthy",
    "Hazardous",
]
CATEGORY_COLOURS = ["#00E400", "#D4AF37", "#FF7E00", "#FF0000", "#8F3F97", "#7E0023"]
# ---- fixed values: alert thresholds, highest first ----
ALERTS = [(200, "hazardous"), (150, "unhealthy")]
ALERT_NONE = "ok"

# ---- fixed values: public US EPA breakpoints, (index low, index high, conc. low, conc. high) ----
INDEX_STEPS = [(0, 50), (51, 100), (101, 150), (151, 200), (201, 300), (301, 500)]
BREAKPOINTS = {
    "pm25": [(0.0, 12.0), (12.1, 35.4), (35.5, 55.4), (55.5, 150.4), (150.5, 250.4), (250.5, 500.4)],
    "pm10": [(0, 54), (55, 154), (155, 254), (255, 354), (355, 424), (425, 604)],
    "co": [(0.0, 4.4), (4.5, 9.4), (9.5, 12.4), (12.5, 15.4), (15.5, 30.4), (30.5, 50.4)],
    "so2": [(0, 35), (36, 75), (76, 185), (186, 304), (305, 604), (605, 1004)],
    "no2": [(0, 53), (54, 100), (101, 360), (361, 649), (650, 1249), (1250, 2049)],
}
# digits a concentration is truncated to before it is looked up
TRUNCATION = {"pm25": 1, "pm10": 0, "co": 1, "so2": 0, "no2": 0}
# ---- fixed values: public US EPA steps of fine particles from a date on, and of ozone in ppb ----
REVISED = {"pm25": [("2024-05-06", [(0.0, 9.0), (9.1, 35.4), (35.5, 55.4), (55.5, 125.4), (125.5, 225.4), (225.5, 325.4)])]}
OZONE_8H = [(0, 54), (55, 70), (71, 85), (86, 105), (106, 200)]
OZONE_1H_INDEX = [(101, 150), (151, 200), (201, 300), (301, 500)]
OZONE_1H = [(125, 164), (165, 204), (205, 404), (405, 604)]


def _steps(c: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for bound, value in reversed(list(zip(CATEGORY_BOUNDS, values))):
        out = F.when(c <= bound, F.lit(value)).otherwise(out)
    return F.when(c.isNotNull(), out)


def category(c: Column) -> Column:
    """Category number 1 (good) to 6 (hazardous)."""
    return _steps(c, list(range(1, len(CATEGORY_LABELS) + 1)))


def category_label(c: Column) -> Column:
    return _steps(c, CATEGORY_LABELS)


def category_colour(c: Column) -> Column:
    return _steps(c, CATEGORY_COLOURS)


def alert_level(c: Column) -> Column:
    out = F.lit(ALERT_NONE)
    for threshold, name in reversed(ALERTS):
        out = F.when(c >= threshold, F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)
