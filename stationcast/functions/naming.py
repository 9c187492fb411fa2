"""Names of horizons and features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: name patterns of feature groups, matched on lower-case column names ----
FEATURE_GROUPS = {
    "core": ("aqi|pm|o3|no2|so2|co", "roll|lag"),
    "weather": ("temp|humidity|wind|pressure|rain", "roll|lag"),
    "rolling": ("roll", None),
    "lag": ("lag", None),
    "temporal": ("year|month|day|week|season|weekday", None),
    "target": ("target", None),
}


def horizon_code(target: Column) -> Column:
    """``AQI_t+2`` -> ``hd2``."""
    return F.concat(F.lit("hd"), F.regexp_extract(target, r"\+(\d+)$", 1))


def horizon_target(code: Column) -> Column:
    """``hd2`` -> ``AQI_t+2``."""
    return F.regexp_replace(code, r"^hd(\d+)$", r"AQI_t+$1")


def in_group(name: Column, group: str) -> Column:
    wanted, unwanted = FEATURE_GROUPS[group]
    hit = name.rlike(wanted)
    return hit & ~name.rlike(unwanted) if unwanted else hit
