"""Time-ordered splits. Positions are counted per key over a daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values: shares of the rows at which expanding folds are cut ----
EXPANDING_CUTS = (0.60, 0.75, 0.90)
TRAIN_GROWTH = 0.85
MIN_TRAIN, MIN_VALID, MIN_ROWS, SINGLE_CUT = 10, 3, 5, 0.80


def number_rows(df: DataFrame, key: str, time: str, pos: str = "_pos", n: str = "_n") -> DataFrame:
    """Position from 0 and row count of the key."""
    return df.withColumns(
        {
            pos: F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1,
            n: F.count(F.lit(1)).over(Window.partitionBy(key)),
        }
    )


def holdout_split(df: DataFrame, key: str, time: str, days: int, out: str = "split") -> DataFrame:
    """Newest ``days`` rows of each key are ``test``, the others ``train``.

    A key with too few rows for both, such as a new station, is ``short`` as a whole: it is
    neither trained on nor tested, and stays visible.
    """
    if days < 1:
        raise ValueError("holdout must be at least 1 row")
    numbered = number_rows(df, key, time)
    role = F.when(F.col("_n") <= days, "short").when(F.col("_pos") < F.col("_n") - days, "train").otherwise("test")
    return numbered.withColumn(out, role).drop("_pos", "_n")


def train_val_cut(df: DataFrame, key: str, time: str, share: float = 0.85, out: str = "part") -> DataFrame:
    cut = F.floor(F.col("_n") * F.lit(share))
    role = F.when(F.col("_pos") < cut, "train").otherwise("val")
    return number_rows(df, key, time).withColumn(out, role).drop("_pos", "_n")


def _assign(numbered: DataFrame, folds) -> DataFrame:
    """One row per fold the row takes part in; ``folds`` holds (fold, train_end, val_start, val_end)."""
    pos = F.col("_pos")
    spread = numbered.withColumn("_f", F.explode(folds))
    role = F.when(pos < F.col("_f.train_end"), "train").when(
        (pos >= F.col("_f.val_start")) & (pos < F.col("_f.val_end")), "val"
    )
    return (
        spread.withColumns({"fold": F.col("_f.fold"), "role": role})
        .where(F.col("role").isNotNull())
        .drop("_f", "_pos", "_n")
    )


def _fold(number: int, train_end, val_start, val_end):
    return F.struct(
        F.lit(number).alias("fold"),
        train_end.cast("bigint").alias("train_end"),
        val_start.cast("bigint").alias("val_start"),
        val_end.cast("bigint").alias("val_end"),
    )


def expanding_folds(df: DataFrame, key: str, time: str) -> DataFrame:
    """Validation slices follow one another, each after a longer training slice."""
    n = F.col("_n")
    share = lambda x, r: F.floor(x * F.lit(r))
    ends = [share(n, c) for c in EXPANDING_CUTS[1:]] + [n]
    trains = [share(n, EXPANDING_CUTS[0])] + [share(e, TRAIN_GROWTH) for e in ends[:-1]]
    candidates = F.array(*[_fold(i + 1, t, t, e) for i, (t, e) in enumerate(zip(trains, ends))])
    usable = F.filter(
        candidates,
        lambda f: (f["val_end"] - f["train_end"] >= MIN_VALID) & (f["train_end"] >= MIN_TRAIN),
    )
    short_cut = F.greatest(F.lit(2).cast("bigint"), share(n, SINGLE_CUT))
    short = F.array(_fold(1, short_cut, short_cut, n))
    single = F.array(_fold(1, share(n, SINGLE_CUT), share(n, SINGLE_CUT), n))
    folds = F.when(n < MIN_ROWS, short).when(F.size(usable) > 0, usable).otherwise(single)
    return _assign(number_rows(df, key, time), folds)


def forward_folds(df: DataFrame, key: str, time: str, k: int = 3) -> DataFrame:
    """``k`` equal test slices at the end; each trains on everything before it."""
    size = F.call_function("div", F.col("_n"), F.lit(k + 1))
    folds = []
    for i in range(k):
        start = F.col("_n") - size * F.lit(k - i)
        folds.append(_fold(i + 1, start, start, start + size))
    return _assign(number_rows(df, key, time), F.array(*folds))
