"""Training frames: what every model family starts from."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cleaning import drop_all_null, feature_columns, impute_train_mean, impute_zero
from ..operators.folds import holdout_split
from ..schemas import KEY, TARGETS, TIME, require_columns
from ..session import stored


def training_frame(features: DataFrame, holdout: int, *, impute: str = "train_mean") -> tuple[DataFrame, list[str]]:
    """(rows with ``split`` and imputed features, feature names).

    All horizons share the frame; a row without the target of a horizon is left out when
    that horizon is fitted. The frame is stored once, since every fit reads it many times. A
    feature that is still empty in the training rows after imputation had no value at all
    and is dropped.
    """
    require_columns(features, [KEY, TIME, "aqi", *TARGETS])
    names = feature_columns(features)
    df = features.withColumns({c: F.col(c).cast("double") for c in names})
    df = holdout_split(df, KEY, TIME, holdout)
    if impute == "train_mean":
        df = impute_train_mean(df.withColumn("_t", F.col("split") == "train"), KEY, names, "_t").drop("_t")
    df = stored(df, "training-frame")
    if df.where(F.col("split") == "train").isEmpty():
        raise ValueError(f"no station has more than the {holdout} rows of the holdout")
    df = drop_all_null(df, names, df.where(F.col("split") == "train"))
    names = [c for c in names if c in df.columns]
    # a station without any value of a feature has no mean either
    return impute_zero(df, names), names


def assembler(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="_features", handleInvalid="error")
