"""Per-series linear models from covariances: Spark aggregates, only p x p systems are solved in Python."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import month_ends_after
from ..spec import DEFAULT, PanelSpec
from .arrays import explode_forecast


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(cov: pd.Series, cxy: pd.Series, n: pd.Series, alpha: pd.Series) -> pd.Series:
    """Ridge weights on standardised features, given back on the original scale; batches of series at once."""
    b = np.stack(cxy.to_numpy()).astype(float)
    p = b.shape[1]
    a = np.stack(cov.to_numpy()).astype(float).reshape(-1, p, p)
    sd = np.sqrt(np.clip(np.einsum("sii->si", a), 0, None))
    safe = np.where(sd > 0, sd, 1.0)
    corr = a / (safe[:, :, None] * safe[:, None, :])
    lhs = corr * n.to_numpy()[:, None, None] + alpha.to_numpy()[:, None, None] * np.eye(p)
    rhs = (b / safe) * n.to_numpy()[:, None]
    w = np.einsum("sij,sj->si", np.linalg.pinv(lhs, rcond=1e-12, hermitian=True), rhs)
    return pd.Series(list(w / safe))


def fit_linear(
    df: DataFrame, xs: Sequence[str], y: str = "y", keys: Sequence[str] = ("series",), alpha: float = 0.0, carry: dict[str, Column] | None = None
) -> DataFrame:
    """(keys, n, intercept, coef, means): least squares (alpha = 0) or ridge per key.

    Covariances are mergeable aggregates, so rows combine inside the map tasks and a group of any
    size arrives as p*p numbers. `carry` adds further aggregates of the same rows.
    """
    ok = F.lit(True)
    for c in (*xs, y):
        ok = ok & F.col(c).isNotNull()
    pairs = {(i, j): f"_c{i}_{j}" for i in range(len(xs)) for j in range(i, len(xs))}
    x = [F.col(c).cast("double") for c in xs]
    extra = carry or {}
    g = df.filter(ok).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(y).alias("_my"),
        F.array(*[F.avg(c) for c in x]).alias("means"),
        F.array(*[F.covar_pop(c, F.col(y)) for c in x]).alias("_cxy"),
        *[F.covar_pop(x[i], x[j]).alias(name) for (i, j), name in pairs.items()],
        *[c.alias(name) for name, c in extra.items()],
    )
    flat = F.array(*[F.col(pairs[min(i, j), max(i, j)]) for i in range(len(xs)) for j in range(len(xs))])
    solved = g.withColumn("coef", _solve(flat, F.col("_cxy"), F.col("n").cast("double"), F.lit(float(alpha))))
    shift = F.aggregate(F.zip_with("coef", "means", lambda c, m: c * m), F.lit(0.0), lambda a, v: a + v)
    return solved.select(*keys, "n", (F.col("_my") - shift).alias("intercept"), "coef", "means", *extra)


def linear_value(xs: Sequence[Column], intercept: str = "intercept", coef: str = "coef") -> Column:
    out = F.col(intercept)
    for i, x in enumerate(xs):
        out = out + F.col(coef)[i] * x
    return out


def predict_linear(rows: DataFrame, model: DataFrame, xs: Sequence[str], keys: Sequence[str] = ("series",)) -> DataFrame:
    return rows.join(model.select(*keys, "intercept", "coef"), list(keys)).withColumn(
        "yhat", linear_value([F.col(c) for c in xs])
    ).drop("intercept", "coef")


def fit_for_recursion(feature_rows: DataFrame, features: Sequence[str], alpha: float = 0.0, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Linear model of a feature frame together with the last values and date of every series.

    The last feature row holds the last value and its lags, so one aggregation gives the model and
    the state from which `recursive_linear` starts.
    """
    deepest = max([3, *[int(f[4:]) for f in features if f.startswith("lag_")]])
    lags = [f"lag_{i}" for i in range(deepest - 1, 0, -1)]
    end = F.max_by(F.array(*[F.col(c) for c in (*lags, spec.y)]), F.col(spec.ds))
    return fit_linear(feature_rows, features, spec.y, spec.keys, alpha, {"tail": end, "last": F.max(spec.ds)})


def recursive_linear(
    model: DataFrame, features: Sequence[str], horizon: int, exog: DataFrame | None = None, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Multi-step forecast: each prediction becomes the next row's lags and rolling mean.

    `model` has (keys, intercept, coef, tail, last). One fold over the future months per series.
    `exog` holds one row per step with further columns, the same for all series; features found
    nowhere count as 0.
    """
    deepest = max([3, *[int(f[4:]) for f in features if f.startswith("lag_")]])
    rows = model.filter(F.size("tail") >= deepest)
    exog_cols = [f for f in features if exog is not None and f in exog.columns]
    if exog_cols:
        packed = exog.agg(F.sort_array(F.collect_list(F.struct("step", *exog_cols))).alias("e")).scalar()
        rows = rows.withColumn("_x", packed)
    steps = F.transform(month_ends_after(F.col("last"), horizon), lambda d, i: F.struct(d.alias("d"), i.alias("i")))

    def value(acc: Column, s: Column, f: str) -> Column:
        d = s["d"]
        if f.startswith("lag_"):
            return F.element_at(acc, -int(f[4:]))
        if f == "rolling_mean_3":
            return (F.element_at(acc, -3) + F.element_at(acc, -2) + F.element_at(acc, -1)) / 3
        if f in ("month", "year", "quarter"):
            return {"month": F.month, "year": F.year, "quarter": F.quarter}[f](d).cast("double")
        if f in exog_cols:
            return F.coalesce(F.get(F.col("_x"), s["i"])[f].cast("double"), F.lit(0.0))
        return F.lit(0.0)

    folded = F.aggregate(
        steps, F.col("tail"), lambda acc, s: F.concat(acc, F.array(linear_value([value(acc, s, f) for f in features])))
    )
    return explode_forecast(rows.withColumn("_f", F.slice(folded, deepest + 1, horizon)), F.col("_f"), horizon, spec)
