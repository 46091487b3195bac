"""Lag, rolling, calendar and scaled features; hold-out split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_columns
from ..spec import DEFAULT, PanelSpec

ENGINE_FEATURES = ("month", "year", "quarter", "lag_1", "lag_2", "lag_3", "rolling_mean_3")


def lag_features(df: DataFrame, lags: int = 3, spec: PanelSpec = DEFAULT) -> DataFrame:
    w = spec.ordered()
    return df.withColumns({f"lag_{i}": F.lag(spec.y, i).over(w) for i in range(1, lags + 1)})


def rolling_features(
    df: DataFrame, window: int = 3, stats: Sequence[str] = ("mean", "std", "min", "max"), spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Statistics over the `window` rows before the current one; null until the window is full."""
    w = spec.ordered().rowsBetween(-window, -1)
    full = F.count(spec.y).over(w) == window
    fn = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    return df.withColumns({f"rolling_{s}_{window}": F.when(full, fn[s](spec.y).over(w)) for s in stats})


def time_features(df: DataFrame, ds: str = "ds", cyclic: bool = True) -> DataFrame:
    cols = calendar_columns(F.col(ds))
    if not cyclic:
        cols = {k: cols[k] for k in ("month", "year", "quarter")}
    return df.withColumns(cols)


def ml_features(df: DataFrame, lags: int = 3, long_form: bool = False, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Complete feature rows: calendar, lags, rolling statistics; rows with any gap are dropped.

    All window columns share one (series, ds) ordering, hence one exchange and one sort.
    """
    out = time_features(df, spec.ds, cyclic=long_form)
    out = lag_features(out, lags, spec)
    out = rolling_features(out, 3, ("mean", "std", "min", "max") if long_form else ("mean",), spec)
    return out.na.drop("any")


def feature_names(lags: int = 3, long_form: bool = False) -> list[str]:
    base = ["month", "year", "quarter"]
    if long_form:
        base += ["day_of_year", "month_sin", "month_cos"]
    base += [f"lag_{i}" for i in range(1, lags + 1)]
    stats = ("mean", "std", "min", "max") if long_form else ("mean",)
    return base + [f"rolling_{s}_3" for s in stats]


def holdout_split(df: DataFrame, periods: int = 12, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Mark the last `periods` rows of every series as test, the rest as train."""
    rn = F.row_number().over(spec.latest_first())
    return df.withColumn("part", F.when(rn <= periods, "test").otherwise("train"))


def standardize(df: DataFrame, cols: Sequence[str], spec: PanelSpec = DEFAULT, part: str = "part") -> DataFrame:
    """Scale features by mean and population deviation of the series' training rows only."""
    w = spec.whole()
    train = lambda c: F.when(F.col(part) == "train", F.col(c))
    mean = {c: F.avg(train(c)).over(w) for c in cols}
    std = {c: F.stddev_pop(train(c)).over(w) for c in cols}
    return df.withColumns(
        {f"{c}_z": F.when(std[c] > 0, (F.col(c) - mean[c]) / std[c]).otherwise(F.col(c) - mean[c]) for c in cols}
    )


def length_gate(df: DataFrame, min_rows: int = 12, min_features: int = 5, lags: int = 3, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row per series: may it be modelled, and if not, why."""
    n = F.count("*")
    feature_rows = n - lags
    return df.groupBy(*spec.keys).agg(
        n.cast("bigint").alias("n"),
        F.when(n < min_rows, "too few rows")
        .when(feature_rows < min_features, "too few feature rows")
        .when(feature_rows - 12 < 1, "no training rows left")
        .otherwise("ok")
        .alias("reason"),
    )
