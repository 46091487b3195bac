"""One board for all model families: hold-out and future predictions of every series in one candidate table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import features
from ..operators.align import repeat_last
from ..spec import DEFAULT, PanelSpec
from . import base, factor, linear, neighbours, pooled, seasonal_ar, smoothing

AR_FEATURES = ("lag_1", "rolling_mean_3")
Maker = Callable[[DataFrame, int, PanelSpec], DataFrame]


@dataclass(frozen=True)
class Family:
    """A model family of the board.

    `backtest(panel, periods, spec)` gives (keys, ds, y, yhat) of every series' last `periods` rows, fitted on the rows before;
    `forecast(panel, horizon, spec)` gives (keys, step, ds, yhat). Series with fewer than `needs` rows to fit on are left out.
    """

    name: str
    backtest: Maker
    forecast: Maker
    needs: int
    params: Mapping[str, str] = field(default_factory=dict)


def refitted(forecast: Maker) -> Maker:
    """Backtest of a forecaster over several steps: it sees the training rows only."""

    def backtest(panel: DataFrame, periods: int, spec: PanelSpec) -> DataFrame:
        split = features.holdout_split(panel, periods, spec)
        seen = forecast(split.filter("part = 'train'").drop("part"), periods, spec)
        return matched(split.filter("part = 'test'"), seen, spec)

    return backtest


def matched(test: DataFrame, seen: DataFrame, spec: PanelSpec) -> DataFrame:
    """Test rows with the prediction of their date, paired inside one row a series, so that nothing is dealt out by date."""
    known = test.groupBy(*spec.keys).agg(F.collect_list(F.struct(spec.ds, spec.y)).alias("_t"))
    preds = seen.groupBy(*spec.keys).agg(F.map_from_entries(F.collect_list(F.struct(spec.ds, "yhat"))).alias("_p"))
    rows = known.join(preds, list(spec.keys)).select(*spec.keys, "_p", F.explode("_t").alias("_t"))
    rows = rows.select(*spec.keys, F.col(f"_t.{spec.ds}"), F.col(f"_t.{spec.y}"), F.try_element_at("_p", F.col(f"_t.{spec.ds}")).alias("yhat"))
    return rows.filter(F.col("yhat").isNotNull())


def holt_winters(params: Sequence[tuple[float, float, float]] = smoothing.GRID) -> Family:
    return Family(
        "Holt-Winters", lambda p, n, spec: smoothing.holt_winters_backtest(p, n, params, spec), lambda p, n, spec: smoothing.holt_winters(p, n, params, spec), 24,
        {"sets": str(len(params))},
    )


def linear_ar(name: str = "Linear-AR", xs: Sequence[str] = AR_FEATURES, alpha: float = 0.0) -> Family:
    """Least squares (or ridge) on lag features; the hold-out is predicted one step ahead, the future recursively."""

    def backtest(panel: DataFrame, periods: int, spec: PanelSpec) -> DataFrame:
        ml = features.holdout_split(features.ml_features(panel, spec=spec), periods, spec)
        model = linear.fit_linear(ml.filter("part = 'train'"), list(xs), spec.y, spec.keys, alpha)
        return linear.predict_linear(ml.filter("part = 'test'"), model, list(xs), spec.keys).select(*spec.keys, spec.ds, spec.y, "yhat")

    def forecast(panel: DataFrame, horizon: int, spec: PanelSpec) -> DataFrame:
        return base.LinearAR({"features": tuple(xs), "alpha": alpha}, spec).forecast(panel, horizon)

    return Family(name, backtest, forecast, 3 + len(xs) + 2, {"features": ",".join(xs), "alpha": str(alpha)})


def trend_factor() -> Family:
    return Family(
        "Trend-Factor", lambda p, n, spec: factor.backtest(features.holdout_split(p, n, spec), spec=spec), lambda p, n, spec: factor.trend_factor(p, n, spec), 3
    )


def theta() -> Family:
    ahead = lambda p, n, spec: smoothing.theta(p, n, spec=spec)
    return Family("Theta", refitted(ahead), ahead, 24)


def seasonal() -> Family:
    def ahead(panel: DataFrame, horizon: int, spec: PanelSpec) -> DataFrame:
        return seasonal_ar.forecast(panel, seasonal_ar.fit(panel, spec=spec), horizon, spec=spec)

    return Family("Seasonal-AR", refitted(ahead), ahead, 31, {"lags": ",".join(map(str, seasonal_ar.AR_LAGS))})


def seasonal_x(indicators: DataFrame, cols: Sequence[str], future: DataFrame | None = None) -> Family:
    """The same with indicators; without a `future` their last row is repeated."""

    def ahead(panel: DataFrame, horizon: int, spec: PanelSpec) -> DataFrame:
        slim = indicators.select(spec.ds, *cols)
        later = future if future is not None else repeat_last(slim, horizon + 1, spec.ds)
        known = slim.unionByName(later.select(spec.ds, *cols)).groupBy(spec.ds).agg(*[F.first(c).alias(c) for c in cols])
        return seasonal_ar.forecast(panel, seasonal_ar.fit(panel, slim, cols, spec=spec), horizon, slim, known, cols, spec=spec)

    return Family("Seasonal-ARX", refitted(ahead), ahead, 32 + len(cols), {"indicators": ",".join(cols)})


def nearest(k: int = 5, lags: Sequence[str] = ("lag_1", "lag_2", "lag_3")) -> Family:
    def backtest(panel: DataFrame, periods: int, spec: PanelSpec) -> DataFrame:
        split = features.holdout_split(features.ml_features(panel, spec=spec), periods, spec)
        scaled = features.standardize(split, list(lags), spec)
        return neighbours.knn(scaled, [f"{c}_z" for c in lags], k, spec=spec).select(*spec.keys, spec.ds, spec.y, "yhat")

    return Family("k-Nearest", backtest, lambda p, n, spec: neighbours.recursive_knn(p, n, lags, k, spec), 3 + k + 2, {"k": str(k)})


def pooled_learner(kind: str, **options) -> Family:
    """A learner trained once over all series; it is fitted when the board is made."""

    def backtest(panel: DataFrame, periods: int, spec: PanelSpec) -> DataFrame:
        return pooled.holdout(features.holdout_split(features.ml_features(panel, spec=spec), periods, spec), kind, spec, **options)

    def forecast(panel: DataFrame, horizon: int, spec: PanelSpec) -> DataFrame:
        rows = pooled.scale_by_series(features.ml_features(panel, spec=spec).withColumn("part", F.lit("train")), spec=spec)
        return pooled.recursive(pooled.last_rows(panel, spec), pooled.fit(rows, kind, **options), horizon, spec=spec)

    return Family(f"Pooled-{kind}", backtest, forecast, 6, {k: str(v) for k, v in options.items()})


def closed_form(params: Sequence[tuple[float, float, float]] = smoothing.GRID) -> tuple[Family, ...]:
    """The families that need no search over all series."""
    return (holt_winters(params), linear_ar(), linear_ar("Ridge-AR", alpha=1.0), trend_factor(), theta(), seasonal(), nearest())


def gate(panel: DataFrame, families: Sequence[Family], periods: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """(keys, n, model, reason): why a family can't be fitted or ranked on a series; null where it can."""
    sizes = panel.groupBy(*spec.keys).agg(F.count(spec.y).alias("n"))
    asked = F.array(*[F.struct(F.lit(f.name).alias("model"), F.lit(f.needs).alias("needs")) for f in families])
    rows = sizes.select(*spec.keys, "n", F.explode(asked).alias("f"))
    short = F.when(F.col("n") < F.col("f.needs"), F.format_string("%d rows, the model needs %d", "n", "f.needs"))
    unranked = F.when(F.col("n") < F.col("f.needs") + periods, F.format_string("%d rows, ranking needs %d", "n", F.col("f.needs") + periods))
    return rows.select(*spec.keys, "n", "f.model", F.coalesce(short, unranked).alias("reason"))


def candidates(panel: DataFrame, families: Sequence[Family], periods: int = 12, horizon: int = 12, spec: PanelSpec = DEFAULT) -> DataFrame:
    """(keys, model, holdout, future, params): one row per series and family.

    `holdout` holds (ds, y, yhat) of the last `periods` rows, null if the series is too short to rank the family; `future` holds
    (step, ds, yhat). A panel that is kept partitioned by series is not dealt out again.
    """
    keys = list(spec.keys)
    sized = panel.withColumn("_n", F.count(spec.y).over(spec.whole()))

    def arrays(rows: DataFrame, name: str, *fields: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))

    def one(family: Family) -> DataFrame:
        ranked = sized.filter(F.col("_n") >= family.needs + periods).drop("_n")
        fitted = sized.filter(F.col("_n") >= family.needs).drop("_n")
        held = arrays(family.backtest(ranked, periods, spec), "holdout", spec.ds, spec.y, "yhat")
        ahead = arrays(family.forecast(fitted, horizon, spec), "future", "step", spec.ds, "yhat")
        given = [x for k, v in family.params.items() for x in (F.lit(k), F.lit(v))]
        params = F.create_map(*given) if given else F.create_map().cast("map<string,string>")
        return ahead.join(held, keys, "left").select(*keys, F.lit(family.name).alias("model"), "holdout", "future", params.alias("params"))

    return reduce(DataFrame.unionByName, map(one, families))


def holdout_rows(board: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """(keys, model, ds, y, yhat) of a candidate table."""
    return board.select(*spec.keys, "model", F.inline("holdout"))


def future_rows(board: DataFrame, horizon: int | Column = 1 << 20, spec: PanelSpec = DEFAULT) -> DataFrame:
    """(keys, model, step, ds, yhat) of a candidate table, up to a number of steps."""
    return board.select(*spec.keys, "model", F.inline("future")).filter(F.col("step") <= horizon)
