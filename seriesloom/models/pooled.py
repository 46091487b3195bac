"""Spark ML regressors trained once over all series, each series scaled by its training mean."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.features import ENGINE_FEATURES
from ..spec import DEFAULT, PanelSpec

LEVEL_FEATURES = ("lag_1", "lag_2", "lag_3", "rolling_mean_3")

# fixed values: suggested search ranges per learner
SUGGESTED_GRIDS = {
    "gbt": {"maxIter": [100, 200, 300], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.05, 0.1], "subsamplingRate": [0.8, 0.9, 1.0]},
    "forest": {"numTrees": [100, 200], "maxDepth": [10, 20], "minInstancesPerNode": [2, 5, 10]},
}


def learner(kind: str, **options):
    """Regressor by family name."""
    base = {"featuresCol": "features", "labelCol": "label"}
    if kind == "gbt":
        return GBTRegressor(**base, **{"maxIter": 10, "maxDepth": 3, "seed": 42, **options})
    if kind == "forest":
        return RandomForestRegressor(**base, **{"numTrees": 20, "maxDepth": 5, "seed": 42, "bootstrap": True, **options})
    if kind == "extra":
        return RandomForestRegressor(**base, **{"numTrees": 20, "maxDepth": 5, "seed": 42, "bootstrap": False, "featureSubsetStrategy": "onethird", **options})
    if kind in ("ridge", "lasso", "elastic"):
        mix = {"ridge": 0.0, "lasso": 1.0, "elastic": 0.5}[kind]
        return LinearRegression(**base, **{"regParam": 0.01, "elasticNetParam": mix, "maxIter": 50, **options})
    if kind in ("huber", "poly"):
        extra = {"loss": "huber", "epsilon": 1.35} if kind == "huber" else {"regParam": 1e-4}
        return LinearRegression(**base, **{"maxIter": 50, **extra, **options})
    raise ValueError(f"unknown learner {kind}")


def pipeline(kind: str, features: Sequence[str], **options) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw" if kind in ("poly", "huber") else "features")]
    if kind == "huber":
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    if kind == "poly":
        stages.append(StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True))
        stages.append(PolynomialExpansion(inputCol="scaled", outputCol="features", degree=2))
    return Pipeline(stages=[*stages, learner(kind, **options)])


def scale_by_series(df: DataFrame, part: str = "part", spec: PanelSpec = DEFAULT) -> DataFrame:
    """Express the value and its lags relative to the training mean of the series (`scale`)."""
    mean = F.avg(F.when(F.col(part) == "train", spec.value)).over(spec.whole())
    out = df.withColumn("scale", mean).filter(F.col("scale") > 0)
    return out.withColumns({"label": spec.value / F.col("scale"), **{c: F.col(c) / F.col("scale") for c in LEVEL_FEATURES}})


def fit(df: DataFrame, kind: str, features: Sequence[str] = ENGINE_FEATURES, part: str = "part", **options) -> PipelineModel:
    """Train on the train rows of a scaled feature frame."""
    train = df.filter(F.col(part) == "train").select(*features, "label").persist()
    try:
        return pipeline(kind, features, **options).fit(train)
    finally:
        train.unpersist()


def predict(df: DataFrame, model: PipelineModel, spec: PanelSpec = DEFAULT) -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn("yhat", F.col("prediction") * F.col("scale")).select(*df.columns, "yhat")


def holdout(df: DataFrame, kind: str, spec: PanelSpec = DEFAULT, **options) -> DataFrame:
    """(keys, ds, y, yhat) of the test rows of a feature frame with a `part` column."""
    scaled = scale_by_series(df, spec=spec)
    model = fit(scaled, kind, **options)
    test = scaled.filter("part = 'test'")
    return predict(test, model, spec).select(*spec.keys, spec.ds, spec.y, "yhat")


def recursive(
    last_rows: DataFrame, model: PipelineModel, horizon: int, features: Sequence[str] = ENGINE_FEATURES, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Multi-step forecast of a pooled model: `horizon` narrow passes over one row per series.

    `last_rows` is (keys, last, scale, tail) with the three last scaled values. Every pass appends
    one prediction to the array; no pass shuffles.
    """
    cur = last_rows
    for step in range(1, horizon + 1):
        d = F.last_day(F.add_months("last", step))
        at = lambda k: F.element_at("tail", -k)
        cols = {
            "month": F.month(d).cast("bigint"), "year": F.year(d).cast("bigint"), "quarter": F.quarter(d).cast("bigint"),
            "lag_1": at(1), "lag_2": at(2), "lag_3": at(3), "rolling_mean_3": (at(1) + at(2) + at(3)) / 3,
        }
        scored = model.transform(cur.withColumns({f: cols.get(f, F.lit(0.0)) for f in features}))
        cur = scored.select(*spec.keys, "last", "scale", F.concat("tail", F.array("prediction")).alias("tail"))
    values = F.slice("tail", 4, horizon)
    from .arrays import explode_forecast

    out = explode_forecast(cur.withColumn("_f", F.transform(values, lambda v: v * F.col("scale"))), F.col("_f"), horizon, spec)
    return out


def last_rows(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Input of `recursive` from a history panel scaled by its mean."""
    g = df.groupBy(*spec.keys).agg(
        F.sort_array(F.collect_list(F.struct(spec.ds, spec.y))).alias("_h"), F.avg(spec.y).alias("scale")
    )
    tail = F.transform(F.slice("_h", -3, 3), lambda r: r[spec.y] / F.col("scale"))
    return g.filter((F.size("_h") >= 3) & (F.col("scale") > 0)).select(
        *spec.keys, F.element_at("_h", -1)[spec.ds].alias("last"), "scale", tail.alias("tail")
    )


def _scores(scaled: DataFrame, kind: str, combos: Sequence[dict], share: float, parallel: int, spec: PanelSpec) -> list[float]:
    """Hold-out RMSE of each combination, fitted on a hashed share of the rows; several fits run at a time over one kept frame."""
    draw = F.pmod(F.xxhash64(*spec.keys, spec.ds, F.lit(26)), F.lit(1 << 20)) / float(1 << 20)
    train, test = scaled.filter(draw < share), scaled.filter("part = 'test'")

    def one(options: dict) -> float:
        scored = predict(test, fit(train, kind, **options), spec)
        return float(scored.agg(F.sqrt(F.avg(F.pow(spec.value - F.col("yhat"), 2)))).first()[0])

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(inheritable_thread_target(scaled.sparkSession)(one), combos))


def _named(options: dict) -> str:
    return ", ".join(f"{k}={v}" for k, v in options.items())


def grid_search(df: DataFrame, kind: str, grid: dict[str, Sequence], parallel: int = 4, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Hold-out RMSE of every combination of a bounded grid, best first, on the time split in `part`."""
    scaled = scale_by_series(df, spec=spec).persist()
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    try:
        errors = _scores(scaled, kind, combos, 1.0, parallel, spec)
    finally:
        scaled.unpersist()
    rows = [(kind, _named(c), e) for c, e in zip(combos, errors, strict=True)]
    return df.sparkSession.createDataFrame(rows, "model string, params string, rmse double").orderBy("rmse", "params")


def halving_search(
    df: DataFrame, kind: str, grid: dict[str, Sequence] | None = None, trials: int = 8, rungs: int = 3, parallel: int = 4, seed: int = 42, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Successive halving over trials that a hash draws from the suggested grid.

    Each rung fits what is left on twice as many training rows as the one before, the last one on all of them, and keeps the better half.
    Rows: (model, params, rung, share, rmse, kept), the winner is kept in the last rung.
    """
    grid = grid or SUGGESTED_GRIDS[kind]
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    left = sorted(combos, key=lambda c: hashlib.md5(f"{seed}:{kind}:{_named(c)}".encode()).hexdigest())[:trials]
    scaled, rows = scale_by_series(df, spec=spec).persist(), []
    try:
        for rung in range(rungs):
            share = 0.5 ** (rungs - 1 - rung)
            ranked = sorted(zip(_scores(scaled, kind, left, share, parallel, spec), map(_named, left), left, strict=True), key=lambda r: r[:2])
            keep = max(1, len(ranked) // 2) if rung < rungs - 1 else 1
            rows += [(kind, name, rung, share, error, i < keep) for i, (error, name, _) in enumerate(ranked)]
            left = [c for _, _, c in ranked[:keep]]
    finally:
        scaled.unpersist()
    return df.sparkSession.createDataFrame(rows, "model string, params string, rung int, share double, rmse double, kept boolean")


def importance(model: PipelineModel, features: Sequence[str] = ENGINE_FEATURES):
    """[(feature, importance)] of a fitted tree model, largest first."""
    vec = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, (float(v) for v in vec)), key=lambda t: (-t[1], t[0]))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
