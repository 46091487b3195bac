"""Seasonally differenced autoregression, optionally with indicators, by conditional least squares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import merge_indicators
from ..spec import DEFAULT, PanelSpec
from .arrays import explode_forecast
from .linear import fit_linear

AR_LAGS = (1, 12, 13)


def _double_diff(c: str, w) -> Column:
    lag = lambda k: F.lag(c, k).over(w)
    return F.col(c) - lag(1) - lag(12) + lag(13)


def fit(df: DataFrame, indicators: DataFrame | None = None, cols: Sequence[str] = (), alpha: float = 0.0, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Coefficients of the double difference on its lags 1, 12, 13 and on differenced indicators."""
    w = spec.ordered()
    rows = df if indicators is None else merge_indicators(df, indicators.select(spec.ds, *cols), "left", True, spec)
    rows = rows.withColumns({"_w": _double_diff(spec.y, w), **{f"_d_{c}": _double_diff(c, w) for c in cols}})
    rows = rows.withColumns({f"_w{k}": F.lag("_w", k).over(w) for k in AR_LAGS})
    xs = [f"_w{k}" for k in AR_LAGS] + [f"_d_{c}" for c in cols]
    model = fit_linear(rows, xs, "_w", spec.keys, alpha)
    return model.filter(F.col("n") > len(xs) + 1)


def forecast(
    df: DataFrame, model: DataFrame, horizon: int, indicators: DataFrame | None = None, future: DataFrame | None = None,
    cols: Sequence[str] = (), by: Sequence[str] = (), spec: PanelSpec = DEFAULT,
) -> DataFrame:
    """Undo both differences step by step in one fold over the future months.

    `future` has rows (by..., ds, indicators): one path, or one per scenario when `by` names its
    key. Paths are bounded by scenarios x horizon and reach the series as one array per path.
    """
    need = 26
    tail = (
        df.groupBy(*spec.keys)
        .agg(F.sort_array(F.collect_list(F.struct(spec.ds, spec.y))).alias("_h"))
        .filter(F.size("_h") >= need)
        .select(*spec.keys, F.transform(F.slice("_h", -need, need), lambda r: r[spec.y]).alias("tail"), F.element_at("_h", -1)[spec.ds].alias("last"))
        .join(model.select(*spec.keys, "intercept", "coef"), list(spec.keys))
    )
    if cols:
        past = indicators.select(spec.ds, *cols)
        known = past.agg(F.sort_array(F.collect_list(F.struct(spec.ds, *cols)))).scalar()
        paths = future.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(spec.ds, *cols))).alias("_f"))
        packed = paths.agg(F.collect_list(F.struct(*by, "_f"))).scalar()
        rows = tail.withColumn("_path", F.explode(packed)).withColumn("_past", known)
        start = F.col("last")
        before = F.slice(F.filter("_past", lambda r: r[spec.ds] <= start), -13, 13)
        after = F.slice(F.filter(F.col("_path._f"), lambda r: r[spec.ds] > start), 1, horizon)
        rows = rows.withColumn("_levels", F.concat(before, after))
        rows = rows.filter(F.size("_levels") == horizon + 13).select("*", *[F.col("_path")[b].alias(b) for b in by])
        shift = lambda i, c: (
            F.get("_levels", i + 13)[c] - F.get("_levels", i + 12)[c] - F.get("_levels", i + 1)[c] + F.get("_levels", i)[c]
        )
    else:
        rows = tail
        shift = None
    at = lambda acc, k: F.element_at(acc, -k)

    def step(acc: Column, i: Column) -> Column:
        dd = F.col("intercept")
        for j, k in enumerate(AR_LAGS):
            wk = at(acc, k) - at(acc, k + 1) - at(acc, k + 12) + at(acc, k + 13)
            dd = dd + F.col("coef")[j] * wk
        for j, c in enumerate(cols):
            dd = dd + F.col("coef")[len(AR_LAGS) + j] * shift(i, c)
        return F.concat(acc, F.array(dd + at(acc, 1) + at(acc, 12) - at(acc, 13)))

    folded = F.aggregate(F.sequence(F.lit(0), F.lit(horizon - 1)), F.col("tail"), step)
    out = rows.withColumn("_y", F.slice(folded, need + 1, horizon))
    keyed = PanelSpec(keys=(*by, *spec.keys), ds=spec.ds, y=spec.y, season=spec.season)
    return explode_forecast(out, F.col("_y"), horizon, keyed)
