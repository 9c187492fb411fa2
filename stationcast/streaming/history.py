"""Rows of each station kept as state, from which a stream computes complete feature rows.

``transformWithStateInPandas`` keeps, per station, the days that a late row may still change, the two rows
before them, and the last value of every column before that. So a batch of daily rows is turned into the
feature rows it reaches (those after it, and the three before it whose targets it is) without a look at
anything stored; what is kept is bounded by ``late_days``, not by the length of the history.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import encode
from ..operators.cleaning import cap_to
from ..plans.features import capped_columns, finished
from ..schemas import KEY, MEASURES, STATISTICS, TARGETS, TIME

BEFORE, AHEAD = 2, 3  # rows that lags and rolling values, and targets, reach
LOGS = [c for c in STATISTICS if c.startswith("log_")]
ORDERED = [c for c in STATISTICS if c not in LOGS]
CELLS = ["aqi", *[m for m in MEASURES if m != "aqi"], *LOGS]  # the series comes first
STATE = "days array<bigint>, stamps array<bigint>, cells array<double>, carry array<double>, known bigint, final bigint"
VERSION_BITS = 40  # of the batch in a row's version, behind the run


@dataclass
class History:
    """A station's rows: ``known`` rows in front are only looked back at; NaN stands for null.

    carry: last value of every cell and statistic up to the known rows. final: day up to which nothing
    changes any more.
    """

    days: np.ndarray
    stamps: np.ndarray
    cells: np.ndarray
    carry: np.ndarray
    known: int
    final: int

    @classmethod
    def empty(cls) -> History:
        none = np.zeros(0, np.int64)
        return cls(none, none, np.zeros((0, len(CELLS))), np.full(len(CELLS) + len(ORDERED), np.nan), 0, -(1 << 62))

    @classmethod
    def of(cls, row: tuple) -> History:
        days, stamps, cells, carry, known, final = row
        cells = np.array(cells, float).reshape(len(days), len(CELLS))
        return cls(np.array(days, np.int64), np.array(stamps, np.int64), cells, np.array(carry, float), known, final)

    def row(self) -> tuple:
        return self.days.tolist(), self.stamps.tolist(), self.cells.ravel().tolist(), self.carry.tolist(), int(self.known), int(self.final)


def _statistics(v: np.ndarray) -> np.ndarray:
    """Both lags, rolling mean and deviation of three, and difference, as columns."""
    back = [np.concatenate([np.full(min(k, len(v)), np.nan), v[:len(v) - k]]) if k else v for k in range(BEFORE + 1)]
    three = np.stack(back[::-1])
    there = ~np.isnan(three)
    n = there.sum(0)
    total = np.where(there[0], three[0], 0.0) + np.where(there[1], three[1], 0.0) + np.where(there[2], three[2], 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, total / n, np.nan)
        off = np.where(there, three - mean, 0.0)
        deviation = np.where(n > 1, np.sqrt((off * off).sum(0) / (n - 1)), np.nan)
    return np.stack([back[1], back[2], mean, deviation, v - back[1]], 1)


def _filled(values: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """Each missing value becomes the last one above it, at the top that of ``carry``."""
    rows = np.vstack([carry, values])
    last = np.maximum.accumulate(np.where(np.isnan(rows), 0, np.arange(len(rows))[:, None]))
    return np.take_along_axis(rows, last, 0)[1:]


def advance(past: History, days: np.ndarray, stamps: np.ndarray, cells: np.ndarray, late_days: int) -> tuple[History, np.ndarray, np.ndarray]:
    """(new history, days, columns) after some daily rows: the rows they reach, cells and statistics filled, then targets.

    Of several versions of a day the highest stamp counts, and of equal ones the later row. A row that comes
    after its day is final is left out, as by a watermark.
    """
    fresh = days > past.final
    if not fresh.any():
        return past, np.zeros(0, np.int64), np.zeros((0, len(CELLS) + len(ORDERED) + AHEAD))
    first = days[fresh].min()
    days, stamps = np.concatenate([past.days, days[fresh]]), np.concatenate([past.stamps, stamps[fresh]])
    cells = np.vstack([past.cells, cells[fresh]])
    order = np.lexsort((stamps, days))
    order = order[np.append(days[order[1:]] != days[order[:-1]], True)]
    days, stamps, cells = days[order], stamps[order], cells[order]
    series, known = cells[:, 0], past.known
    values = np.hstack([cells, _statistics(series)])[known:]
    filled = _filled(values, past.carry)
    targets = np.stack([np.append(series[h:], np.full(min(h, len(series)), np.nan)) for h in range(1, AHEAD + 1)], 1)[known:]
    reached = max(0, int(np.searchsorted(days[known:], first)) - AHEAD)
    out = days[known:][reached:], np.hstack([filled, targets])[reached:]
    closed = int(np.searchsorted(days[known:], days[-1] - late_days))
    done = max(0, closed - AHEAD)
    keep = max(0, known + done - BEFORE)
    if done:
        past = History(days[keep:], stamps[keep:], cells[keep:], filled[done - 1], known + done - keep, int(days[known + done - 1]))
    else:
        past = History(days, stamps, cells, past.carry, known, past.final)
    return past, *out


class StationHistory(StatefulProcessor):
    """Daily rows of a station in, feature rows out."""

    def __init__(self, late_days: int) -> None:
        self.late_days = late_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        past = History.of(self.state.get()) if self.state.exists() else History.empty()
        past, days, columns = advance(past, new["epoch_day"].to_numpy(np.int64), new["stamp"].to_numpy(np.int64),
                                      new[CELLS].to_numpy(float), self.late_days)
        self.state.update(past.row())
        if len(days):
            out = pd.DataFrame(columns, columns=[*CELLS, *ORDERED, *TARGETS])
            yield pd.concat([pd.DataFrame({KEY: [key[0]] * len(days), "epoch_day": days}), out.astype(object).where(out.notna(), None)], axis=1)

    def close(self) -> None:
        pass


def feature_rows(daily: DataFrame, bounds: DataFrame, late_days: int) -> DataFrame:
    """Feature rows that a stream of daily rows (with ``run`` and ``batch_id``) reaches, to be written in append mode.

    The columns are those of ``add_features`` with the same bounds.
    """
    number = T.DoubleType()
    schema = T.StructType([T.StructField(KEY, daily.schema[KEY].dataType), T.StructField("epoch_day", T.LongType())]
                          + [T.StructField(c, number) for c in (*CELLS, *ORDERED, *TARGETS)])
    rows = cap_to(encode.add_logs(daily, [c.removeprefix("log_") for c in LOGS]), bounds, KEY, capped_columns())
    stamp = F.shiftleft(F.col("run").cast("bigint"), VERSION_BITS) + F.col("batch_id")
    rows = rows.select(KEY, F.unix_date(F.to_date(TIME)).cast("bigint").alias("epoch_day"), stamp.alias("stamp"), *CELLS)
    found = rows.groupBy(KEY).transformWithStateInPandas(StationHistory(late_days), schema, "Append", "None")
    return finished(found.withColumn(TIME, F.date_from_unix_date(F.col("epoch_day").cast("int")).cast("timestamp_ntz")))
