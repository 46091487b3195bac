"""The forecaster interface and an adapter for user models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import ml_features
from ..spec import DEFAULT, PanelSpec
from . import factor, linear, smoothing


class PanelForecaster(Protocol):
    """`fit` gives a model table, `forecast` gives rows (keys, step, ds, yhat)."""

    name: str

    def fit(self, df: DataFrame) -> DataFrame: ...

    def forecast(self, df: DataFrame, horizon: int) -> DataFrame: ...

    def get_params(self) -> dict: ...

    def set_params(self, **params) -> "PanelForecaster": ...


@dataclass
class _Configured:
    params: dict = field(default_factory=dict)
    spec: PanelSpec = DEFAULT

    def get_params(self) -> dict:
        return dict(self.params)

    def set_params(self, **params):
        self.params.update(params)
        return self


@dataclass
class HoltWinters(_Configured):
    name: str = "Holt-Winters"

    def fit(self, df: DataFrame) -> DataFrame:
        return smoothing.holt_winters_fit(df, self.params.get("grid", smoothing.GRID), self.spec)

    def forecast(self, df: DataFrame, horizon: int) -> DataFrame:
        return smoothing.holt_winters(df, horizon, self.params.get("grid", smoothing.GRID), self.spec)


@dataclass
class TrendFactor(_Configured):
    name: str = "Trend-Factor"

    def fit(self, df: DataFrame) -> DataFrame:
        return factor.fit(df, self.spec)

    def forecast(self, df: DataFrame, horizon: int) -> DataFrame:
        return factor.trend_factor(df, horizon, self.spec)


@dataclass
class LinearAR(_Configured):
    """Linear model on lag and rolling features with a recursive forecast."""

    name: str = "Linear-AR"

    @property
    def features(self) -> list[str]:
        return list(self.params.get("features", ("lag_1", "rolling_mean_3")))

    def fit(self, df: DataFrame) -> DataFrame:
        lags = max([3, *[int(f[4:]) for f in self.features if f.startswith("lag_")]])
        rows = ml_features(df, lags, spec=self.spec)
        return linear.fit_for_recursion(rows, self.features, self.params.get("alpha", 0.0), self.spec)

    def forecast(self, df: DataFrame, horizon: int) -> DataFrame:
        return linear.recursive_linear(self.fit(df), self.features, horizon, spec=self.spec)


def save_model(table: DataFrame, path: str) -> None:
    """Closed-form models are tables of coefficients."""
    table.write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def per_series(
    df: DataFrame, fn: Callable[[pd.DataFrame, int], pd.DataFrame], horizon: int, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Run a user model on every series: `fn(history, horizon)` returns columns (ds, yhat).

    Spark groups the series; each group is one series of monthly rows.
    """
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"{k} {fields[k]}" for k in spec.keys], f"{spec.ds} date", "yhat double"])

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = fn(pdf.sort_values(spec.ds), horizon)
        for name, value in zip(spec.keys, key):
            out[name] = value
        return out[[*spec.keys, spec.ds, "yhat"]]

    return df.select(*spec.keys, spec.ds, F.col(spec.y)).groupBy(*spec.keys).applyInPandas(run, schema)
