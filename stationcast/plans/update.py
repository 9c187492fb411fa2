"""Incremental update of stored daily and feature tables.

Three tables lie below one root, all cut into parts of ``span`` days: the daily rows, their features,
and an index with a row per station and part. New readings replace their days. Which other rows a
changed day reaches is counted in rows, not in days: targets look ``AHEAD`` rows forwards, so as many
rows before it change; lags and rollings look ``BACK`` rows backwards; and a filled value lasts until
the next value of its column. The index holds what is needed to find the parts with such rows without
reading them: rows per part, and the columns that have a value of their own there.

Only those parts are read and written (the others are pruned by directory), and of their rows only
those of stations that the change reaches are computed again. Outliers are capped by bounds stored
when the tables were created, as limits that follow the data would change every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import encode, windows
from ..operators.cleaning import cap_to, iqr_bounds
from ..operators.upsert import upsert
from ..schemas import CAPPED, KEY, MEASURES, STATISTICS, TIME
from ..session import stored
from .features import capped_columns, daily_frame, finished

BACK, AHEAD = 2, 3  # rows that lags and rollings look back, and targets ahead
FILLED = [*MEASURES, *STATISTICS]
PART = "part"


def part_of(time: Column, span: int) -> Column:
    days = F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date"))
    return F.floor(days / F.lit(span)).cast("int")


def unfilled(daily: DataFrame, bounds: DataFrame) -> DataFrame:
    """Features before gaps are filled."""
    df = encode.add_logs(daily, ["pm25", "co"])
    df = cap_to(df, bounds, KEY, capped_columns())
    df = windows.add_lags(df, KEY, TIME, "aqi")
    df = windows.add_rolling(df, KEY, TIME, "aqi")
    df = windows.add_diff(df, KEY, TIME, "aqi")
    return windows.add_targets(df, KEY, TIME, "aqi")


def index_of(df: DataFrame) -> DataFrame:
    """(station, part, n, own): rows, and which filled columns have a value that no row outside the part decides."""
    row = F.row_number().over(Window.partitionBy(KEY, PART).orderBy(TIME))
    own = [F.max((F.col(c).isNotNull() & (F.col("_row") > BACK)).cast("int")).alias(c) for c in FILLED]
    counts = df.withColumn("_row", row).groupBy(KEY, PART).agg(F.count(F.lit(1)).alias("n"), *own)
    return counts.select(KEY, PART, "n", F.struct(*FILLED).alias("own"))


def reached(index: DataFrame, changed: DataFrame) -> DataFrame:
    """(station, part, redo, read): parts whose rows change, and those needed to compute them.

    ``index`` has the stored parts of the stations, ``changed`` (station, part, n, before) the parts with
    changed days: their rows now, and the rows before the first changed one. A row per station and
    part is all that the windows see.
    """
    c = changed.select(KEY, PART, F.col("n").alias("_n"), "before")
    known = index.join(changed.select(KEY).distinct(), KEY, "left_semi").join(c, [KEY, PART], "full")
    w = Window.partitionBy(KEY).orderBy(PART)
    past, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    is_changed = F.col("before").isNotNull()
    df = known.withColumns({"n": F.coalesce("_n", "n"), "_at": F.row_number().over(w)})
    df = df.withColumn("_upto", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_above", F.col("_upto") - F.col("n"))
    # before a change: rows whose targets it is
    reach = F.min(F.when(is_changed, F.col("_above") + F.col("before") - AHEAD)).over(later)
    # behind it: until every filled column had a value again that does not depend on it
    last = F.max(F.when(is_changed, F.col("_at"))).over(past)
    seen = [F.coalesce(F.max(F.when(F.col(f"own.{c}") == 1, F.col("_at"))).over(past), F.lit(0)) for c in FILLED]
    df = df.withColumns({"_reach": reach, "_last": last, "_seen": F.least(*seen)})
    after = F.col("_last").isNotNull() & (F.col("_seen") <= F.col("_last"))
    df = df.withColumn("redo", is_changed | F.coalesce(F.col("_upto") > F.col("_reach"), F.lit(False)) | after)
    # rows around the parts to compute
    first = F.min(F.when(F.col("redo"), F.col("_above") - BACK)).over(later)
    end = F.max(F.when(F.col("redo"), F.col("_upto") + AHEAD)).over(past)
    context = F.coalesce(F.col("_upto") > first, F.lit(False)) | F.coalesce(F.col("_above") < end, F.lit(False))
    return df.select(KEY, PART, "redo", (F.col("redo") | context).alias("read"))


class FeatureTables:
    """Daily and feature table below ``root``, created once and updated by new readings.

    Tables are written part by part, each replaced as a whole, first the daily rows, then features,
    then the index: an update that was broken off is repeated with the same readings and ends in the
    same tables (a driver lost while a directory is being swapped is what only a table format guards
    against). Updates of one root run one after the other. Readings without station or time belong to
    no row.
    """

    def __init__(self, spark: SparkSession, root: str, span: int = 30):
        self.spark, self.root, self.span = spark, root.rstrip("/"), span

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def daily(self) -> DataFrame:
        return self.read("daily").drop(PART)

    def features(self) -> DataFrame:
        return self.read("features").drop(PART)

    def _write(self, df: DataFrame, name: str) -> None:
        """Replaces exactly the parts that ``df`` has; large parts are split into several files, small ones are one."""
        df.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.root}/{name}")

    def create(self, daily: DataFrame, bounds: DataFrame | None = None) -> None:
        """First daily rows; ``bounds`` (else those of these rows) cap outliers from now on."""
        daily = stored(daily.dropna(subset=[KEY, TIME]), "daily")
        limits = iqr_bounds(daily, KEY, list(CAPPED)) if bounds is None else bounds
        limits.write.mode("overwrite").parquet(f"{self.root}/bounds")
        raw = unfilled(daily.withColumn(PART, part_of(F.col(TIME), self.span)), self.read("bounds"))
        filled = windows.forward_fill(raw, KEY, TIME, FILLED)
        self._write(daily.withColumn(PART, part_of(F.col(TIME), self.span)), "daily")
        self._write(finished(filled, keep=(PART,)), "features")
        self._write(index_of(raw), "index")

    def update(self, readings: DataFrame, time: str = "time", digits: int | None = None, zone: str | None = None) -> list[int]:
        """Replaces the days of the readings and every feature row that they reach; returns the parts written."""
        new = daily_frame(readings, time, digits, zone).withColumn(PART, part_of(F.col(TIME), self.span))
        return self.replace_days(new)

    def replace_days(self, new: DataFrame) -> list[int]:
        """As ``update``, for rows of the daily table with their ``part``."""
        new = stored(new.dropna(subset=[KEY, TIME]), "new_days")
        touched = self._parts(new)
        if not touched:
            return []
        kept = self.read("daily").where(F.col(PART).isin(touched))
        merged = stored(upsert(kept, new, [KEY, TIME]), "merged_days")
        first = new.groupBy(KEY, PART).agg(F.min(TIME).alias("first"))
        changed = merged.join(first, [KEY, PART]).groupBy(KEY, PART).agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(TIME) < F.col("first"), 1)).alias("before"))
        parts = stored(reached(self.read("index"), changed), "reached")
        redo = self._parts(parts.where("redo"))
        around = [p for p in self._parts(parts.where("read")) if p not in touched]
        self._compute(merged, parts, redo, around)
        return redo

    def _parts(self, df: DataFrame) -> list[int]:
        """Numbers of the parts: bounded by the calendar, not by rows."""
        return sorted(r[0] for r in df.select(PART).distinct().collect())

    def _compute(self, merged: DataFrame, parts: DataFrame, redo: list[int], around: list[int]) -> None:
        rows = merged.unionByName(self.read("daily").where(F.col(PART).isin(around)))
        rows = rows.join(parts.where("read").select(KEY, PART, "redo"), [KEY, PART])
        raw = stored(unfilled(rows, self.read("bounds")), "unfilled")
        old = self.read("features").where(F.col(PART).isin([*redo, *around]))
        # rows around take their stored values, which carry what was filled before them
        carried = old.join(parts.where("read and not redo").select(KEY, PART), [KEY, PART], "left_semi")
        carried = carried.select(KEY, TIME, *[F.col(c).alias(f"_old_{c}") for c in FILLED])
        seeded = raw.join(carried, [KEY, TIME], "left").withColumns(
            {c: F.when(F.col("redo"), F.col(c)).otherwise(F.col(f"_old_{c}")) for c in FILLED})
        filled = windows.forward_fill(seeded.drop(*[f"_old_{c}" for c in FILLED]), KEY, TIME, FILLED).where("redo")
        again = parts.where("redo").select(KEY, PART)
        others = old.where(F.col(PART).isin(redo)).join(again, [KEY, PART], "left_anti")
        features = stored(finished(filled, keep=(PART,)).unionByName(others), "features")
        kept = self.read("index").where(F.col(PART).isin(redo)).join(again, [KEY, PART], "left_anti")
        index = stored(index_of(raw.where("redo")).unionByName(kept), "index")
        self._write(merged, "daily")
        self._write(features, "features")
        self._write(index, "index")
