"""Forecasting models, selection and ensembles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..models import base, board, factor, linear, neighbours, pooled, seasonal_ar, smoothing
from ..models.arrays import history_arrays
from ..operators import align, explain, features, report, selection
from ..session import ensure_checkpoint_dir
from . import fixtures as fx
from .build import ML, _SPLIT
from .registry import query, sql

FIXED = ((0.3, 0.1, 0.2),)
H = fx.HORIZON


def holt_sql(src: str, n: str, params, horizon: int = H) -> str:
    """Additive smoothing in DuckDB for one or more parameter sets; final table `n`."""
    rows = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {g}::DOUBLE)" for a, b, g in params)
    return f"""{n}_p AS (SELECT * FROM (VALUES {rows}) AS t(pa, pb, pg)),
{n}_a AS (SELECT series, list(y ORDER BY ds) AS ys, max(ds) AS last, count(*) AS n FROM {src} GROUP BY series HAVING count(*) >= 24),
{n}_i AS (SELECT *, list_sum(ys[1:12]) / 12 AS l0, list_sum(ys[13:24]) / 12 AS l1 FROM {n}_a),
{n}_r AS (
  SELECT series, pa, pb, pg, 12 AS t, l0 AS l, (l1 - l0) / 12 AS tr, list_transform(ys[1:12], lambda v: v - l0) AS s, 0.0::DOUBLE AS sse FROM {n}_i, {n}_p
  UNION ALL
  SELECT series, pa, pb, pg, t + 1, nl, pb * (nl - l) + (1 - pb) * tr, list_append(s[2:12], pg * (y - nl) + (1 - pg) * s[1]), sse + (y - (l + tr + s[1])) * (y - (l + tr + s[1]))
  FROM (SELECT r.*, i.ys[r.t + 1] AS y, pa * (i.ys[r.t + 1] - r.s[1]) + (1 - pa) * (r.l + r.tr) AS nl FROM {n}_r r JOIN {n}_i i ON i.series = r.series WHERE r.t < i.n)),
{n}_b AS (SELECT * FROM (SELECT r.*, i.last, row_number() OVER (PARTITION BY r.series ORDER BY sse, pa, pb, pg) AS rn FROM {n}_r r JOIN {n}_i i ON i.series = r.series AND i.n = r.t) WHERE rn = 1),
{n} AS (SELECT series, CAST(h AS BIGINT) AS step, CAST(last_day(CAST(date_trunc('month', last) AS DATE) + to_months(CAST(h AS INTEGER))) AS DATE) AS ds, l + h * tr + s[((h - 1) % 12) + 1] AS yhat
  FROM {n}_b, (SELECT unnest(generate_series(1, {horizon})) AS h))"""


def factor_sql(src: str, n: str, horizon: int = H) -> str:
    return f"""{n}_m AS (SELECT series, ds, ln(y) AS ly, year(ds) * 12 + month(ds) AS mi, min(year(ds) * 12 + month(ds)) OVER (PARTITION BY series) AS t0 FROM {src} WHERE y > 0),
{n}_l AS (SELECT series, regr_intercept(ly, mi - t0) AS a, regr_slope(ly, mi - t0) AS b, min(t0) AS t0 FROM {n}_m GROUP BY series),
{n}_f AS (SELECT m.series, month(ds) AS mm, avg(ly - (a + b * (mi - m.t0))) AS f FROM {n}_m m JOIN {n}_l l ON l.series = m.series GROUP BY 1, 2),
{n}_d AS (SELECT series, CAST(h AS BIGINT) AS step, CAST(last_day(CAST(date_trunc('month', last) AS DATE) + to_months(CAST(h AS INTEGER))) AS DATE) AS ds
  FROM (SELECT series, max(ds) AS last FROM {src} GROUP BY series), (SELECT unnest(generate_series(1, {horizon})) AS h)),
{n} AS (SELECT d.series, d.step, d.ds, exp(a + b * (year(d.ds) * 12 + month(d.ds) - t0) + coalesce(f, 0)) AS yhat
  FROM {n}_d d JOIN {n}_l l ON l.series = d.series LEFT JOIN {n}_f f ON f.series = d.series AND f.mm = month(d.ds))"""


def coef_sql(src: str, n: str) -> str:
    """Two-regressor least squares (lag_1, rolling_mean_3) by Cramer's rule."""
    return f"""{n}_c AS (SELECT series, avg(y) AS my, avg(lag_1) AS m1, avg(rolling_mean_3) AS m2, covar_pop(lag_1, lag_1) AS c11, covar_pop(lag_1, rolling_mean_3) AS c12,
  covar_pop(rolling_mean_3, rolling_mean_3) AS c22, covar_pop(lag_1, y) AS c1, covar_pop(rolling_mean_3, y) AS c2 FROM {src} GROUP BY series),
{n} AS (SELECT *, my - b1 * m1 - b2 * m2 AS a FROM (SELECT *, (c1 * c22 - c2 * c12) / (c11 * c22 - c12 * c12) AS b1, (c2 * c11 - c1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM {n}_c))"""


def recursive_sql(src: str, coef: str, n: str, horizon: int = H) -> str:
    return f"""{n}_t AS (SELECT series, list(y ORDER BY ds)[-3:] AS v, max(ds) AS last FROM {src} GROUP BY series),
{n}_r AS (SELECT series, 0 AS h, v, last FROM {n}_t UNION ALL
  SELECT r.series, h + 1, list_append(r.v[2:3], c.a + c.b1 * r.v[3] + c.b2 * ((r.v[1] + r.v[2] + r.v[3]) / 3)), last FROM {n}_r r JOIN {coef} c ON c.series = r.series WHERE h < {horizon}),
{n} AS (SELECT series, CAST(h AS BIGINT) AS step, CAST(last_day(CAST(date_trunc('month', last) AS DATE) + to_months(h)) AS DATE) AS ds, v[3] AS yhat FROM {n}_r WHERE h > 0)"""


def ridge_sql(src: str, n: str, alpha: float = 1.0) -> str:
    """The same on scaled regressors with a penalty."""
    return f"""{n}_c AS (SELECT series, count(*) AS n, avg(y) AS my, avg(lag_1) AS m1, avg(rolling_mean_3) AS m2, stddev_pop(lag_1) AS s1, stddev_pop(rolling_mean_3) AS s2,
  covar_pop(lag_1, rolling_mean_3) AS c12, covar_pop(lag_1, y) AS c1, covar_pop(rolling_mean_3, y) AS c2 FROM {src} GROUP BY series),
{n}_s AS (SELECT *, n + {alpha} AS d, n * c12 / (s1 * s2) AS o, n * c1 / s1 AS r1, n * c2 / s2 AS r2 FROM {n}_c),
{n} AS (SELECT *, my - b1 * m1 - b2 * m2 AS a FROM (SELECT *, (r1 * d - r2 * o) / (d * d - o * o) / s1 AS b1, (r2 * d - r1 * o) / (d * d - o * o) / s2 AS b2 FROM {n}_s))"""


def theta_sql(src: str, n: str, horizon: int = H) -> str:
    """Seasonally adjusted series, half its drift plus simple smoothing, season again."""
    return f"""{n}_t AS (SELECT *, (sum(y) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(y, 6) OVER w + lead(y, 6) OVER w) * 0.5) / 12 AS trend,
  CAST(row_number() OVER w - 1 AS BIGINT) AS t, count(*) OVER (PARTITION BY series) AS n FROM {src} WINDOW w AS (PARTITION BY series ORDER BY ds)),
{n}_s AS (SELECT series, phase, s / avg(s) OVER (PARTITION BY series) AS seasonal FROM (SELECT series, t % 12 AS phase, avg(y / nullif(trend, 0)) AS s FROM {n}_t WHERE n >= 24 GROUP BY 1, 2)),
{n}_a AS (SELECT t.series, t.ds, t.t, t.n, t.y / seasonal AS a, seasonal FROM {n}_t t JOIN {n}_s s ON s.series = t.series AND s.phase = t.t % 12 WHERE n >= 24),
{n}_l AS (SELECT series, list(a ORDER BY ds) AS ys, list(seasonal ORDER BY ds)[-12:] AS season, max(ds) AS last, max(n) AS n, regr_slope(a, t) AS slope FROM {n}_a GROUP BY series),
{n}_r AS (SELECT series, al, 1 AS t, ys[1] AS l, 0.0::DOUBLE AS sse FROM {n}_l, (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS al)
  UNION ALL SELECT r.series, al, r.t + 1, r.l + al * (i.ys[r.t + 1] - r.l), sse + (i.ys[r.t + 1] - r.l) * (i.ys[r.t + 1] - r.l) FROM {n}_r r JOIN {n}_l i ON i.series = r.series WHERE r.t < i.n),
{n}_b AS (SELECT * FROM (SELECT r.series, al, r.l, i.slope, i.season, i.last, i.n, row_number() OVER (PARTITION BY r.series ORDER BY sse, al) AS rn FROM {n}_r r JOIN {n}_l i ON i.series = r.series AND i.n = r.t) WHERE rn = 1),
{n} AS (SELECT series, CAST(h AS BIGINT) AS step, CAST(last_day(CAST(date_trunc('month', last) AS DATE) + to_months(CAST(h AS INTEGER))) AS DATE) AS ds,
  (l + 0.5 * slope * (h - 1 + (1 - pow(1 - al, n)) / al)) * season[((h - 1) % 12) + 1] AS yhat FROM {n}_b, (SELECT unnest(generate_series(1, {horizon})) AS h))"""


def _det(a, b, c) -> str:
    """Determinant of a 3 x 3 matrix given by its columns."""
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {b[0]} * ({a[1]} * {c[2]} - {a[2]} * {c[1]}) + {c[0]} * ({a[1]} * {b[2]} - {a[2]} * {b[1]}))"


def seasonal_ar_sql(src: str, n: str, horizon: int = H) -> str:
    """Double differences on their lags 1, 12 and 13 by Cramer's rule, undone step by step."""
    cols, rhs = (("v11", "v12", "v13"), ("v12", "v22", "v23"), ("v13", "v23", "v33")), ("p1", "p2", "p3")
    solved = ", ".join(f"{_det(*[rhs if j == i else c for j, c in enumerate(cols)])} / {_det(*cols)} AS b{i + 1}" for i in range(3))
    cov = ", ".join(f"covar_pop(x{i}, x{j}) AS v{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3) if i <= j)
    step = " + ".join(f"k.b{j} * (r.v[{27 - lag}] - r.v[{26 - lag}] - r.v[{15 - lag}] + r.v[{14 - lag}])" for j, lag in ((1, 1), (2, 12), (3, 13)))
    return f"""{n}_w AS (SELECT series, ds, y - lag(y) OVER w - lag(y, 12) OVER w + lag(y, 13) OVER w AS w0 FROM {src} WINDOW w AS (PARTITION BY series ORDER BY ds)),
{n}_x AS (SELECT *, lag(w0) OVER w AS x1, lag(w0, 12) OVER w AS x2, lag(w0, 13) OVER w AS x3 FROM {n}_w WINDOW w AS (PARTITION BY series ORDER BY ds)),
{n}_c AS (SELECT series, avg(w0) AS m0, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, {cov}, covar_pop(x1, w0) AS p1, covar_pop(x2, w0) AS p2, covar_pop(x3, w0) AS p3
  FROM {n}_x WHERE x3 IS NOT NULL AND x2 IS NOT NULL AND x1 IS NOT NULL AND w0 IS NOT NULL GROUP BY series HAVING count(*) > 4),
{n}_k AS (SELECT *, m0 - b1 * m1 - b2 * m2 - b3 * m3 AS a FROM (SELECT *, {solved} FROM {n}_c)),
{n}_t AS (SELECT series, list(y ORDER BY ds)[-26:] AS v, max(ds) AS last FROM {src} GROUP BY series HAVING count(*) >= 26),
{n}_r AS (SELECT series, 0 AS h, v, last FROM {n}_t UNION ALL
  SELECT r.series, h + 1, list_append(r.v[2:26], k.a + {step} + r.v[26] + r.v[15] - r.v[14]), last FROM {n}_r r JOIN {n}_k k ON k.series = r.series WHERE h < {horizon}),
{n} AS (SELECT series, CAST(h AS BIGINT) AS step, CAST(last_day(CAST(date_trunc('month', last) AS DATE) + to_months(h)) AS DATE) AS ds, v[26] AS yhat FROM {n}_r WHERE h > 0)"""


def nearest_sql(features_: str, src: str, n: str, horizon: int = H, k: int = 5) -> str:
    """Recursive forecast by the mean of the rows with the nearest scaled lags."""
    z = lambda x, i: f"({x} - m{i}) / coalesce(nullif(s{i}, 0), 1)"
    away = " + ".join(f"(p.z{i} - {z(f'r.v[{4 - i}]', i)}) ** 2" for i in (1, 2, 3))
    entry = "{'ds': f.ds, 'y': f.y, " + ", ".join(f"'z{i}': {z(f'lag_{i}', i)}" for i in (1, 2, 3)) + "}"
    near = "{'d': sqrt(" + away + "), 'ds': p.ds, 'y': p.y}"
    stats = ", ".join(f"avg(lag_{i}) AS m{i}, stddev_pop(lag_{i}) AS s{i}" for i in (1, 2, 3))
    return f"""{n}_s AS (SELECT series, {stats} FROM {features_} GROUP BY series),
{n}_p AS (SELECT f.series, list({entry}) AS ps FROM {features_} f JOIN {n}_s s ON s.series = f.series GROUP BY f.series),
{n}_t AS (SELECT series, list(y ORDER BY ds)[-3:] AS v, max(ds) AS last FROM {src} GROUP BY series),
{n}_r AS (SELECT series, 0 AS h, v, last FROM {n}_t UNION ALL
  SELECT r.series, h + 1, list_append(r.v[2:3], list_avg(list_transform(list_sort(list_transform(p.ps, lambda p: {near}))[1:{k}], lambda q: q.y))), last
  FROM {n}_r r JOIN {n}_p p ON p.series = r.series JOIN {n}_s s ON s.series = r.series WHERE h < {horizon}),
{n} AS (SELECT series, CAST(h AS BIGINT) AS step, CAST(last_day(CAST(date_trunc('month', last) AS DATE) + to_months(h)) AS DATE) AS ds, v[3] AS yhat FROM {n}_r WHERE h > 0)"""


AR_FEATURES = ["lag_1", "rolling_mean_3"]
PD = (fx.PANEL, fx.DENSE)
WD = (fx.WIDE, fx.WIDE_DENSE)


def rounded(df, digits=2, *cols):
    return df.withColumns({c: F.round(c, digits) for c in (cols or ("yhat",))})


@query("fc_holt_winters", sql(*PD, holt_sql("dense", "hw", FIXED), "SELECT series, step, ds, round(yhat, 2) AS yhat FROM hw"))
def fc_holt_winters(spark, sf_dir):
    return rounded(smoothing.holt_winters(fx.dense(spark, sf_dir), H, FIXED))


@query("fc_holt_winters_grid", sql(*PD, holt_sql("dense", "hw", smoothing.GRID), "SELECT series, step, ds, round(yhat, 2) AS yhat FROM hw"))
def fc_holt_winters_grid(spark, sf_dir):
    return rounded(base.HoltWinters().forecast(fx.dense(spark, sf_dir), H))


@query("fit_holt_winters", sql(*PD, holt_sql("dense", "hw", smoothing.GRID), "SELECT series, pa AS alpha, pb AS beta, pg AS gamma, round(sse / 1e6, 2) AS sse FROM hw_b"))
def fit_holt_winters(spark, sf_dir):
    return base.HoltWinters().fit(fx.dense(spark, sf_dir)).withColumn("sse", F.round(F.col("sse") / 1e6, 2))


@query("fc_trend_factor", sql(*WD, factor_sql("wdense", "tf"), "SELECT series, step, ds, round(yhat, 2) AS yhat FROM tf"))
def fc_trend_factor(spark, sf_dir):
    return rounded(factor.trend_factor(fx.wide_dense(spark, sf_dir), H))


@query("fc_theta", sql(*WD, theta_sql("wdense", "th"), "SELECT series, step, ds, round(yhat, 1) AS yhat FROM th"))
def fc_theta(spark, sf_dir):
    return rounded(smoothing.theta(fx.wide_dense(spark, sf_dir), H), 1)


@query("fc_seasonal_ar", sql(*WD, seasonal_ar_sql("wdense", "sa"), "SELECT series, step, ds, round(yhat, 1) AS yhat FROM sa"))
def fc_seasonal_ar(spark, sf_dir):
    p = fx.wide_dense(spark, sf_dir)
    return rounded(seasonal_ar.forecast(p, seasonal_ar.fit(p), H), 1)


def _future_levels(panel, ind, cols):
    """Indicators after the panel's last month: known values first, then the last row repeated."""
    last = panel.agg(F.max("ds")).scalar()
    known = ind.filter(F.col("ds") > last).select("ds", *cols)
    return known.unionByName(align.repeat_last(ind.select("ds", *cols), H))


@query("fc_seasonal_arx")
def fc_seasonal_arx(spark, sf_dir):
    p, ind, cols = fx.wide_dense(spark, sf_dir), fx.indicators(spark, sf_dir), ["avg_price", "avg_qty"]
    model = seasonal_ar.fit(p, ind, cols)
    return seasonal_ar.forecast(p, model, H, ind, _future_levels(p, ind, cols), cols)


@query(
    "linear_coefficients",
    sql(*WD, ML, coef_sql("ml", "co"), "SELECT series, round(a, 1) AS intercept, round(b1, 6) AS lag_1, round(b2, 6) AS rolling_mean_3 FROM co"),
)
def linear_coefficients(spark, sf_dir):
    m = linear.fit_linear(features.ml_features(fx.wide_dense(spark, sf_dir)), AR_FEATURES)
    return m.select("series", F.round("intercept", 1).alias("intercept"), *[F.round(F.col("coef")[i], 6).alias(c) for i, c in enumerate(AR_FEATURES)])


@query("recursive_linear", sql(*WD, ML, coef_sql("ml", "co"), recursive_sql("wdense", "co", "rc"), "SELECT series, step, ds, round(yhat, 1) AS yhat FROM rc"))
def recursive_linear(spark, sf_dir):
    return rounded(base.LinearAR().forecast(fx.wide_dense(spark, sf_dir), H), 1)


@query("fc_ridge")
def fc_ridge(spark, sf_dir):
    """Per-series ridge on all engine features, forecast recursively."""
    ar = base.LinearAR({"features": features.ENGINE_FEATURES, "alpha": 1.0})
    return ar.forecast(fx.wide_dense(spark, sf_dir), H)


def _split_features(spark, sf_dir):
    return features.holdout_split(features.ml_features(fx.wide_dense(spark, sf_dir)))


_Z = ", ".join(
    f"CASE WHEN stddev_pop({c}) FILTER (part = 'train') OVER s > 0 THEN ({c} - avg({c}) FILTER (part = 'train') OVER s) / stddev_pop({c}) FILTER (part = 'train') OVER s ELSE {c} - avg({c}) FILTER (part = 'train') OVER s END AS z{i}"
    for i, c in enumerate(("lag_1", "lag_2", "lag_3"))
)


@query(
    "fc_knn",
    sql(*WD, ML, f"sp AS (SELECT *, {_SPLIT} FROM ml)", f"zz AS (SELECT series, ds, y, part, {_Z} FROM sp WINDOW s AS (PARTITION BY series))",
        """nb AS (SELECT q.series, q.ds, q.y, t.y AS ty, row_number() OVER (PARTITION BY q.series, q.ds ORDER BY sqrt((t.z0 - q.z0) ** 2 + (t.z1 - q.z1) ** 2 + (t.z2 - q.z2) ** 2), t.ds) AS rn
FROM zz q JOIN zz t ON t.series = q.series AND t.part = 'train' WHERE q.part = 'test')""",
        "SELECT series, ds, y, round(avg(ty), 4) AS yhat FROM nb WHERE rn <= 5 GROUP BY series, ds, y"),
)
def fc_knn(spark, sf_dir):
    lags = ["lag_1", "lag_2", "lag_3"]
    z = features.standardize(_split_features(spark, sf_dir), lags)
    out = neighbours.knn(z, [f"{c}_z" for c in lags], 5)
    return out.select("series", "ds", "y", F.round("yhat", 4).alias("yhat"))


_TRIES = [(k, p, w) for p in (1, 2) for w in ("uniform", "distance") for k in (3, 5, 10)]
_AWAY = {1: "abs(t.z0 - q.z0) + abs(t.z1 - q.z1) + abs(t.z2 - q.z2)", 2: "sqrt((t.z0 - q.z0) ** 2 + (t.z1 - q.z1) ** 2 + (t.z2 - q.z2) ** 2)"}


@query(
    "tune_knn",
    sql(*WD, ML, f"sp AS (SELECT *, {_SPLIT} FROM ml)", f"zz AS (SELECT series, ds, y, part, {_Z} FROM sp WINDOW s AS (PARTITION BY series))",
        "nb AS (" + " UNION ALL ".join(
            f"SELECT q.series, q.ds, q.y, {p} AS p, t.y AS ty, {d} AS d, row_number() OVER (PARTITION BY q.series, q.ds ORDER BY {d}, t.ds) AS rn FROM zz q JOIN zz t ON t.series = q.series AND t.part = 'train' WHERE q.part = 'test'"
            for p, d in _AWAY.items()) + ")",
        "ts AS (" + " UNION ALL ".join(
            f"SELECT series, {k} AS k, {p} AS p, '{w}' AS weights, y, sum(ty * {wt}) / sum({wt}) AS yhat FROM nb WHERE p = {p} AND rn <= {k} GROUP BY series, ds, y"
            for k, p, w in _TRIES for wt in ["1" if w == "uniform" else "(1 / greatest(d, 1e-12::DOUBLE))"]) + ")",
        "sc AS (SELECT series, k, p, weights, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM ts GROUP BY ALL)",
        "SELECT series, k, p, weights, round(rmse, 2) AS rmse, row_number() OVER (PARTITION BY series ORDER BY sc.rmse, k, p, weights) AS rank FROM sc"),
)
def tune_knn(spark, sf_dir):
    lags = ["lag_1", "lag_2", "lag_3"]
    z = features.standardize(_split_features(spark, sf_dir), lags)
    return rounded(neighbours.knn_search(z, [f"{c}_z" for c in lags], ks=(3, 5, 10)), 2, "rmse")


def _pooled(kind):
    def run(spark, sf_dir):
        return pooled.holdout(_split_features(spark, sf_dir), kind)

    run.__doc__ = f"Hold-out predictions of the pooled {kind} learner."
    return run


for _name, _kind in (("fc_gbt", "gbt"), ("fc_rf", "forest"), ("fc_extra_trees", "extra"), ("fc_lasso", "lasso"), ("fc_elastic_net", "elastic"),
                     ("fc_huber", "huber"), ("fc_poly", "poly")):
    query(_name)(_pooled(_kind))


@query("fc_gbt_recursive")
def fc_gbt_recursive(spark, sf_dir):
    panel = fx.wide_dense(spark, sf_dir)
    rows = pooled.scale_by_series(features.ml_features(panel).withColumn("part", F.lit("train")))
    return pooled.recursive(pooled.last_rows(panel), pooled.fit(rows, "gbt", maxIter=5), H)


@query("tune_forest")
def tune_forest(spark, sf_dir):
    return pooled.grid_search(_split_features(spark, sf_dir), "forest", {"numTrees": [10, 20], "maxDepth": [3, 5]})


@query("tune_halving")
def tune_halving(spark, sf_dir):
    """Trials drawn from a small grid, halved twice."""
    grid = {"numTrees": [5, 10, 20], "maxDepth": [3, 5], "minInstancesPerNode": [1, 5]}
    return pooled.halving_search(_split_features(spark, sf_dir), "forest", grid, trials=4)


@query("feature_importance")
def feature_importance(spark, sf_dir):
    rows = pooled.scale_by_series(_split_features(spark, sf_dir))
    return spark.createDataFrame(pooled.importance(pooled.fit(rows, "forest")), "feature string, importance double")


def _seasonal_naive(history: pd.DataFrame, horizon: int) -> pd.DataFrame:
    """A user model: the value of the same month one year before."""
    last = pd.Timestamp(history["ds"].iloc[-1])
    days = pd.date_range(last + pd.offsets.MonthEnd(1), periods=horizon, freq="ME")
    season = history["y"].to_numpy()[-12:]
    return pd.DataFrame({"ds": days.date, "yhat": [float(season[i % len(season)]) for i in range(horizon)]})


@query(
    "user_model",
    sql(*WD, """a AS (SELECT series, list(y ORDER BY ds)[-12:] AS s, max(ds) AS last FROM wdense GROUP BY series)""",
        """SELECT series, CAST(last_day(CAST(date_trunc('month', last) AS DATE) + to_months(CAST(h AS INTEGER))) AS DATE) AS ds, s[h] AS yhat FROM a, (SELECT unnest(generate_series(1, 12)) AS h)"""),
)
def user_model(spark, sf_dir):
    return base.per_series(fx.wide_dense(spark, sf_dir), _seasonal_naive, H)


@query("history_arrays", sql(*WD, "SELECT series, count(*) AS n, max(ds) AS last, list_sum(list(y ORDER BY ds)[-3:]) AS tail_sum FROM wdense GROUP BY series"))
def history_arrays_query(spark, sf_dir):
    a = history_arrays(fx.wide_dense(spark, sf_dir))
    tail = F.aggregate(F.slice("ys", -3, 3), F.lit(0.0), lambda s, v: s + v)
    return a.select("series", F.col("n").cast("bigint").alias("n"), "last", tail.alias("tail_sum"))


# ---- selection over three candidate families ----

NAMES = ("Holt-Winters", "Linear-AR", "Trend-Factor")


def holdout_predictions(spark, sf_dir):
    """(series, model, ds, y, yhat) on the last 12 months, fitted on what is before them."""
    panel = fx.wide_dense(spark, sf_dir)
    ml = features.holdout_split(features.ml_features(panel))
    lin = linear.fit_linear(ml.filter("part = 'train'"), AR_FEATURES)
    one_step = linear.predict_linear(ml.filter("part = 'test'"), lin, AR_FEATURES).select("series", "ds", "y", "yhat")
    return selection.stack(
        {
            NAMES[0]: smoothing.holt_winters_backtest(panel, H, FIXED),
            NAMES[1]: one_step,
            NAMES[2]: factor.backtest(features.holdout_split(panel)),
        }
    )


def future_predictions(spark, sf_dir):
    panel = fx.wide_dense(spark, sf_dir)
    return selection.stack(
        {
            NAMES[0]: smoothing.holt_winters(panel, H, FIXED),
            NAMES[1]: base.LinearAR().forecast(panel, H),
            NAMES[2]: factor.trend_factor(panel, H),
        }
    ).drop("step")


HOLD = ",\n".join(
    [
        f"spw AS (SELECT *, {_SPLIT} FROM wdense)", "trn AS (SELECT series, ds, y FROM spw WHERE part = 'train')", "tst AS (SELECT series, ds, y FROM spw WHERE part = 'test')",
        holt_sql("trn", "hwh", FIXED), factor_sql("trn", "tfh"), ML, f"mls AS (SELECT *, {_SPLIT} FROM ml)", "mlt AS (SELECT * FROM mls WHERE part = 'train')", coef_sql("mlt", "coh"),
        f"""ph AS (SELECT '{NAMES[0]}' AS model, series, ds, yhat FROM hwh UNION ALL SELECT '{NAMES[2]}', series, ds, yhat FROM tfh
  UNION ALL SELECT '{NAMES[1]}', m.series, m.ds, a + b1 * lag_1 + b2 * rolling_mean_3 FROM mls m JOIN coh c ON c.series = m.series WHERE part = 'test'),
hp AS (SELECT tst.*, ph.model, ph.yhat FROM tst JOIN ph ON ph.series = tst.series AND ph.ds = tst.ds),
er AS (SELECT series, model, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) AS mape FROM hp GROUP BY 1, 2),
lb AS (SELECT *, greatest(0, 100 - mape * 100) AS accuracy, row_number() OVER (PARTITION BY series ORDER BY rmse, model) AS rank FROM er)""",
    ]
)
FUT = ",\n".join(
    [holt_sql("wdense", "hwf", FIXED), factor_sql("wdense", "tff"), coef_sql("ml", "cof"), recursive_sql("wdense", "cof", "rcf"),
     f"pf AS (SELECT '{NAMES[0]}' AS model, series, ds, yhat FROM hwf UNION ALL SELECT '{NAMES[1]}', series, ds, yhat FROM rcf UNION ALL SELECT '{NAMES[2]}', series, ds, yhat FROM tff)"]
)


# ---- the board: seven families in one candidate table ----


def _board(spark, sf_dir):
    """The candidate table over a panel that is kept partitioned by series."""
    ensure_checkpoint_dir(spark)
    panel = fx.wide_dense(spark, sf_dir).checkpoint()
    return board.candidates(panel, board.closed_form(FIXED), H, H).checkpoint()


BOARD_HOLD = ",\n".join(
    [
        f"spw AS (SELECT *, {_SPLIT} FROM wdense)", "trn AS (SELECT series, ds, y FROM spw WHERE part = 'train')", "tst AS (SELECT series, ds, y FROM spw WHERE part = 'test')",
        holt_sql("trn", "hwh", FIXED), factor_sql("trn", "tfh"), theta_sql("trn", "thh"), seasonal_ar_sql("trn", "sah"), ML, f"mls AS (SELECT *, {_SPLIT} FROM ml)",
        "mlt AS (SELECT * FROM mls WHERE part = 'train')", coef_sql("mlt", "coh"), ridge_sql("mlt", "rih"), f"zz AS (SELECT series, ds, y, part, {_Z} FROM mls WINDOW s AS (PARTITION BY series))",
        f"nbh AS (SELECT q.series, q.ds, t.y AS ty, row_number() OVER (PARTITION BY q.series, q.ds ORDER BY {_AWAY[2]}, t.ds) AS rn FROM zz q JOIN zz t ON t.series = q.series AND t.part = 'train' WHERE q.part = 'test')",
        """ph AS (SELECT 'Holt-Winters' AS model, series, ds, yhat FROM hwh UNION ALL SELECT 'Trend-Factor', series, ds, yhat FROM tfh
  UNION ALL SELECT 'Theta', series, ds, yhat FROM thh UNION ALL SELECT 'Seasonal-AR', series, ds, yhat FROM sah
  UNION ALL SELECT 'Linear-AR', m.series, m.ds, a + b1 * lag_1 + b2 * rolling_mean_3 FROM mls m JOIN coh c ON c.series = m.series WHERE part = 'test'
  UNION ALL SELECT 'Ridge-AR', m.series, m.ds, a + b1 * lag_1 + b2 * rolling_mean_3 FROM mls m JOIN rih c ON c.series = m.series WHERE part = 'test'
  UNION ALL SELECT 'k-Nearest', series, ds, avg(ty) FROM nbh WHERE rn <= 5 GROUP BY series, ds),
hp AS (SELECT tst.*, ph.model, ph.yhat FROM tst JOIN ph ON ph.series = tst.series AND ph.ds = tst.ds),
er AS (SELECT series, model, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16)) AS mape FROM hp GROUP BY 1, 2),
lb AS (SELECT *, greatest(0, 100 - mape * 100) AS accuracy, row_number() OVER (PARTITION BY series ORDER BY rmse, model) AS rank FROM er)""",
    ]
)
BOARD_FUT = ",\n".join(
    [holt_sql("wdense", "hwf", FIXED), factor_sql("wdense", "tff"), theta_sql("wdense", "thf"), seasonal_ar_sql("wdense", "saf"), coef_sql("ml", "cof"), recursive_sql("wdense", "cof", "rcf"),
     ridge_sql("ml", "rif"), recursive_sql("wdense", "rif", "rrf"), nearest_sql("ml", "wdense", "nnf"),
     """pf AS (SELECT 'Holt-Winters' AS model, series, step, ds, yhat FROM hwf UNION ALL SELECT 'Linear-AR', series, step, ds, yhat FROM rcf UNION ALL SELECT 'Ridge-AR', series, step, ds, yhat FROM rrf
  UNION ALL SELECT 'Trend-Factor', series, step, ds, yhat FROM tff UNION ALL SELECT 'Theta', series, step, ds, yhat FROM thf UNION ALL SELECT 'Seasonal-AR', series, step, ds, yhat FROM saf
  UNION ALL SELECT 'k-Nearest', series, step, ds, yhat FROM nnf)"""]
)


@query("board_holdout", sql(*WD, BOARD_HOLD, "SELECT series, model, ds, y, round(yhat, 1) AS yhat FROM hp"))
def board_holdout(spark, sf_dir):
    return rounded(board.holdout_rows(_board(spark, sf_dir)), 1)


@query("board_future", sql(*WD, ML, BOARD_FUT, "SELECT series, model, step, ds, round(yhat, 1) AS yhat FROM pf"))
def board_future(spark, sf_dir):
    return rounded(board.future_rows(_board(spark, sf_dir)), 1)


@query(
    "board_gate",
    sql(*WD, "f AS (SELECT * FROM (VALUES ('Holt-Winters', 24), ('Linear-AR', 7), ('Ridge-AR', 7), ('Trend-Factor', 3), ('Theta', 24), ('Seasonal-AR', 31), ('k-Nearest', 10)) AS t(model, needs))",
        "n AS (SELECT series, count(y) AS n FROM wide GROUP BY series)",
        """SELECT series, n, model, CASE WHEN n < needs THEN n || ' rows, the model needs ' || needs WHEN n < needs + 12 THEN n || ' rows, ranking needs ' || (needs + 12) END AS reason FROM n, f"""),
)
def board_gate(spark, sf_dir):
    """Which families can be fitted and ranked on the observed rows of each series, before gaps are filled."""
    return board.gate(fx.wide(spark, sf_dir), board.closed_form(FIXED), H)


@query("holdout_predictions", sql(*WD, HOLD, "SELECT series, ds, y, model, round(yhat, 1) AS yhat FROM hp"))
def holdout_predictions_query(spark, sf_dir):
    return rounded(holdout_predictions(spark, sf_dir), 1)


@query("leaderboard", sql(*WD, BOARD_HOLD, "SELECT series, model, round(rmse, 1) AS rmse, round(mape, 6) AS mape, round(accuracy, 4) AS accuracy, rank FROM lb"))
def leaderboard(spark, sf_dir):
    b = selection.leaderboard(board.holdout_rows(_board(spark, sf_dir)))
    return b.withColumns({"rmse": F.round("rmse", 1), "mape": F.round("mape", 6), "accuracy": F.round("accuracy", 4)})


@query("accuracy_summary", sql(*WD, BOARD_HOLD, "SELECT round(avg(accuracy), 4) AS mean_accuracy, round(max(accuracy), 4) AS best_accuracy FROM lb WHERE rank = 1"))
def accuracy_summary(spark, sf_dir):
    s = selection.accuracy_summary(selection.leaderboard(board.holdout_rows(_board(spark, sf_dir))))
    return rounded(s, 4, *s.columns)


ENS_ERR = """jt AS (SELECT series, ds, any_value(y) AS y, avg(yhat) AS yhat FROM hp GROUP BY 1, 2),
full3 AS (SELECT series, string_agg(model, ', ' ORDER BY model) AS members, avg(rmse) AS rm, avg(mape) AS mm FROM lb WHERE rank <= 3 GROUP BY series HAVING count(*) = 3),
ee AS (SELECT f.series, f.members, sqrt(avg((y - yhat) * (y - yhat))) AS rmse, avg(abs(y - yhat) / abs(y)) AS mape FROM jt JOIN full3 f ON f.series = jt.series GROUP BY 1, 2)"""


@query("ensemble_error", sql(*WD, HOLD, ENS_ERR, "SELECT series, members, round(rmse, 1) AS rmse, round(mape, 6) AS mape FROM ee"))
def ensemble_error(spark, sf_dir):
    hp = holdout_predictions(spark, sf_dir)
    e = selection.ensemble_error(hp)
    return e.withColumns({"rmse": F.round("rmse", 1), "mape": F.round("mape", 6)})


@query("ensemble_error_mean", sql(*WD, HOLD, ENS_ERR, "SELECT series, members, round(rm, 1) AS rmse, round(mm, 6) AS mape FROM full3"))
def ensemble_error_mean(spark, sf_dir):
    hp = holdout_predictions(spark, sf_dir)
    e = selection.ensemble_error(hp, metric="mean")
    return e.withColumns({"rmse": F.round("rmse", 1), "mape": F.round("mape", 6)})


_ENS = "SELECT series, ds, avg(yhat) AS yhat, quantile_cont(yhat, 0.025) AS lo, quantile_cont(yhat, 0.975) AS hi, 'Ensemble (' || string_agg(model, ', ' ORDER BY model) || ')' AS model FROM {src} GROUP BY series, ds"
_R1 = "series, ds, round(yhat, 1) AS yhat, round(lo, 1) AS lo, round(hi, 1) AS hi, model"


@query("ensemble_top3", sql(*WD, ML, FUT, f"en AS ({_ENS.format(src='pf')})", f"SELECT {_R1} FROM en"))
def ensemble_top3(spark, sf_dir):
    return rounded(selection.ensemble(future_predictions(spark, sf_dir)), 1, "yhat", "lo", "hi")


@query(
    "ensemble_weighted",
    sql(*WD, ML, FUT, f"""SELECT series, ds, round(sum(w * yhat) / sum(w), 1) AS yhat, 'Custom Weighted' AS model FROM (
SELECT *, CASE model WHEN '{NAMES[0]}' THEN 0.6::DOUBLE WHEN '{NAMES[2]}' THEN 0.3::DOUBLE END AS w FROM pf) WHERE w IS NOT NULL GROUP BY 1, 2"""),
)
def ensemble_weighted(spark, sf_dir):
    return rounded(selection.weighted(future_predictions(spark, sf_dir), {NAMES[0]: 0.6, NAMES[2]: 0.3}), 1)


@query("ensemble_inverse_error", sql(*WD, HOLD, FUT, "SELECT pf.series, pf.ds, round(sum(yhat / rmse) / sum(1 / rmse), 1) AS yhat FROM pf JOIN lb ON lb.series = pf.series AND lb.model = pf.model GROUP BY 1, 2"))
def ensemble_inverse_error(spark, sf_dir):
    board = selection.leaderboard(holdout_predictions(spark, sf_dir))
    return rounded(selection.inverse_error_weighted(future_predictions(spark, sf_dir), board), 1)


_SINGLE = """sg AS (SELECT pf.series, pf.ds, pf.yhat, pf.model, NULL::VARCHAR AS reason FROM pf JOIN lb ON lb.series = pf.series AND lb.model = pf.model AND lb.rank = 1
  UNION ALL SELECT series, ds, arg_min(yhat, model), min(model), 'no hold-out rows' FROM pf WHERE series NOT IN (SELECT series FROM lb) GROUP BY series, ds)"""
_FLAT = "round(yhat, 1) AS yhat, round(yhat * 0.95, 1) AS lo, round(yhat * 1.05, 1) AS hi"


BOARD_ENS = """full3 AS (SELECT series FROM lb WHERE rank <= 3 GROUP BY series HAVING count(*) = 3),
jt AS (SELECT hp.series, hp.ds, any_value(hp.y) AS y, avg(hp.yhat) AS yhat FROM hp JOIN lb ON lb.series = hp.series AND lb.model = hp.model AND lb.rank <= 3 GROUP BY 1, 2),
ee AS (SELECT f.series, sqrt(avg((y - yhat) * (y - yhat))) AS rmse FROM jt JOIN full3 f ON f.series = jt.series GROUP BY 1),
win AS (SELECT ee.series FROM ee JOIN lb ON lb.series = ee.series AND lb.rank = 1 WHERE ee.rmse < lb.rmse),
tp AS (SELECT pf.* FROM pf JOIN lb ON lb.series = pf.series AND lb.model = pf.model AND lb.rank <= 3 WHERE pf.series IN (SELECT series FROM win))"""


_R2 = "series, ds, round(yhat, 2) AS yhat, round(lo, 2) AS lo, round(hi, 2) AS hi, model"
_CENTS = "round(yhat, 2) AS yhat, round(yhat * 0.95, 2) AS lo, round(yhat * 1.05, 2) AS hi"


def _board_forecast(spark, sf_dir, strategy):
    b = _board(spark, sf_dir)
    out = selection.forecast_by_strategy(board.future_rows(b).drop("step"), board.holdout_rows(b), strategy)
    return rounded(out, 2, "yhat", "lo", "hi")


@query("forecast_best", sql(*WD, BOARD_HOLD, BOARD_FUT, _SINGLE, f"SELECT series, ds, {_CENTS}, model, reason FROM sg"))
def forecast_best(spark, sf_dir):
    return _board_forecast(spark, sf_dir, "best")


@query(
    "forecast_auto",
    sql(*WD, BOARD_HOLD, BOARD_FUT, _SINGLE, BOARD_ENS, f"en AS ({_ENS.format(src='tp')})",
        f"SELECT {_R2}, NULL::VARCHAR AS reason FROM en UNION ALL SELECT series, ds, {_CENTS}, model, reason FROM sg WHERE series NOT IN (SELECT series FROM win)"),
)
def forecast_auto(spark, sf_dir):
    return _board_forecast(spark, sf_dir, "auto")


@query(
    "forecast_manual",
    sql(*WD, HOLD, FUT, _SINGLE, f"""nm AS (SELECT * FROM pf WHERE model = '{NAMES[0]}'),
nr AS (SELECT DISTINCT series, reason FROM sg),
u AS (SELECT nm.series, ds, yhat, model, reason FROM nm JOIN nr ON nr.series = nm.series UNION ALL SELECT series, ds, yhat, model || ' (Fallback)', reason FROM sg WHERE series NOT IN (SELECT series FROM nm))""",
        f"SELECT series, ds, {_FLAT}, model, reason FROM u"),
)
def forecast_manual(spark, sf_dir):
    out = selection.forecast_by_strategy(future_predictions(spark, sf_dir), holdout_predictions(spark, sf_dir), "manual", manual=NAMES[0])
    return rounded(out, 1, "yhat", "lo", "hi")


@query(
    "forecast_custom",
    sql(*WD, HOLD, FUT, _SINGLE, "nr AS (SELECT DISTINCT series, reason FROM sg)", f"en AS ({_ENS.format(src=f'''(SELECT * FROM pf WHERE model IN ('{NAMES[1]}', '{NAMES[2]}'))''')})",
        f"SELECT en.{_R1}, reason FROM en JOIN nr ON nr.series = en.series"),
)
def forecast_custom(spark, sf_dir):
    out = selection.forecast_by_strategy(future_predictions(spark, sf_dir), holdout_predictions(spark, sf_dir), "custom", members=NAMES[1:])
    return rounded(out, 1, "yhat", "lo", "hi")


@query(
    "strategy_compare",
    sql(*WD, ML, FUT, """e AS (SELECT series, ds, avg(yhat) AS a FROM pf GROUP BY 1, 2)""",
        f"""w AS (SELECT series, ds, sum(w * yhat) / sum(w) AS b FROM (SELECT *, CASE model WHEN '{NAMES[1]}' THEN 0.8::DOUBLE WHEN '{NAMES[2]}' THEN 0.2::DOUBLE END AS w FROM pf) WHERE w IS NOT NULL GROUP BY 1, 2)""",
        "SELECT e.series, e.ds, round(a, 1) AS yhat_a, round(b, 1) AS yhat_b, round(b - a, 1) AS diff FROM e JOIN w ON w.series = e.series AND w.ds = e.ds"),
)
def strategy_compare(spark, sf_dir):
    preds = future_predictions(spark, sf_dir)
    a = selection.ensemble(preds)
    b = selection.weighted(preds, {NAMES[1]: 0.8, NAMES[2]: 0.2})
    return rounded(selection.compare_strategies(a, b), 1, "yhat_a", "yhat_b", "diff")


@query(
    "error_interval",
    sql(*WD, HOLD, FUT, _SINGLE, "SELECT sg.series, sg.ds, round(yhat, 1) AS yhat, round(yhat - 1.96::DOUBLE * rmse, 1) AS lo, round(yhat + 1.96::DOUBLE * rmse, 1) AS hi, sg.model FROM sg JOIN lb ON lb.series = sg.series AND lb.model = sg.model"),
)
def error_interval(spark, sf_dir):
    board = selection.leaderboard(holdout_predictions(spark, sf_dir)).filter("rank = 1")
    return rounded(selection.with_error_interval(future_predictions(spark, sf_dir), board), 1, "yhat", "lo", "hi")


@query("model_table", sql(*WD, HOLD, """SELECT series, string_agg(model, ', ' ORDER BY rank) AS ranking, 'Ensemble (' || string_agg(model, ', ' ORDER BY model) || ')' AS ensemble_name,
CASE WHEN max(accuracy) FILTER (rank = 1) >= 90 THEN 'green' WHEN max(accuracy) FILTER (rank = 1) >= 75 THEN 'amber' ELSE 'red' END AS band FROM lb GROUP BY series"""))
def model_table(spark, sf_dir):
    from ..functions.bands import accuracy_band

    board = selection.leaderboard(holdout_predictions(spark, sf_dir))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "model"))), lambda r: r["model"])
    return board.groupBy("series").agg(
        F.array_join(ordered, ", ").alias("ranking"),
        F.concat(F.lit("Ensemble ("), F.array_join(F.sort_array(F.collect_list("model")), ", "), F.lit(")")).alias("ensemble_name"),
        accuracy_band(F.max(F.when(F.col("rank") == 1, F.col("accuracy")))).alias("band"),
    )


# ---- explanation ----

_CONTRIB = """ct AS (SELECT m.series, m.ds, 'lag_1' AS feature, b1 * (lag_1 - m1) AS contribution FROM ml m JOIN co ON co.series = m.series
UNION ALL SELECT m.series, m.ds, 'rolling_mean_3', b2 * (rolling_mean_3 - m2) FROM ml m JOIN co ON co.series = m.series)"""


def _contributions(spark, sf_dir):
    ml = features.ml_features(fx.wide_dense(spark, sf_dir))
    return explain.linear_contributions(ml, linear.fit_linear(ml, AR_FEATURES), AR_FEATURES)


@query("linear_contributions", sql(*WD, ML, coef_sql("ml", "co"), _CONTRIB, "SELECT series, ds, feature, round(contribution, 2) AS contribution FROM ct"))
def linear_contributions(spark, sf_dir):
    return rounded(_contributions(spark, sf_dir), 2, "contribution")


@query("contribution_rank", sql(*WD, ML, coef_sql("ml", "co"), _CONTRIB, "SELECT feature, round(avg(abs(contribution)), 2) AS importance FROM ct GROUP BY feature"))
def contribution_rank(spark, sf_dir):
    return rounded(explain.contribution_rank(_contributions(spark, sf_dir)), 2, "importance")


@query(
    "sensitivity_matrix",
    sql(*WD, ML, coef_sql("ml", "co"), _CONTRIB, """SELECT series, round(avg(abs(contribution)) FILTER (feature = 'lag_1'), 2) AS lag_1, round(avg(abs(contribution)) FILTER (feature = 'rolling_mean_3'), 2) AS rolling_mean_3,
0.0::DOUBLE AS month FROM ct GROUP BY series"""),
)
def sensitivity_matrix(spark, sf_dir):
    ranked = explain.contribution_rank(_contributions(spark, sf_dir), ["series"])
    return rounded(explain.sensitivity_matrix(ranked, [*AR_FEATURES, "month"]), 2, *AR_FEATURES)


@query("permutation_importance")
def permutation_importance(spark, sf_dir):
    ml = features.ml_features(fx.wide_dense(spark, sf_dir))
    return explain.permutation_importance(ml, linear.fit_linear(ml, AR_FEATURES), AR_FEATURES)


@query(
    "top_features",
    sql(*WD, ML, coef_sql("ml", "co"), _CONTRIB, "SELECT series, feature, round(avg(abs(contribution)), 2) AS importance FROM ct GROUP BY 1, 2 ORDER BY avg(abs(contribution)) DESC, series, feature LIMIT 5"),
)
def top_features(spark, sf_dir):
    ranked = explain.contribution_rank(_contributions(spark, sf_dir), ["series"])
    return rounded(ranked.orderBy(F.col("importance").desc(), "series", "feature").limit(5), 2, "importance")
