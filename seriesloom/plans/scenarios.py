"""What-if scenarios, shocks and replays of past moves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..models import factor, seasonal_ar
from ..operators import align, report, scenario
from . import fixtures as fx
from .forecasting import H, factor_sql, rounded
from .registry import query, sql

_SCN = fx.literal_sql("scn", fx.SCENARIO_COLUMNS, fx.SCENARIOS)
_LEV = f"""lv AS (SELECT indicator, value AS level FROM indl WHERE ds = (SELECT max(ds) FROM ind)),
sl AS (SELECT n.scenario, lv.indicator, lv.level AS base_level, CASE s.op WHEN 'set' THEN s.arg WHEN 'add' THEN lv.level + s.arg WHEN 'mul' THEN lv.level * s.arg ELSE lv.level END AS level
  FROM (SELECT DISTINCT scenario FROM scn) n CROSS JOIN lv LEFT JOIN scn s ON s.scenario = n.scenario AND s.indicator = lv.indicator)"""
_MERGED = "mg AS (SELECT dense.*, avg_discount, avg_tax, avg_qty, avg_price FROM dense JOIN ind USING (ds))"


def _elimination() -> str:
    """Slopes of one regression on all indicators per series: covariances, elimination column by column, back substitution."""
    xs, n = fx.INDICATORS, len(fx.INDICATORS)
    cells = [(i, j) for i in range(n) for j in range(n)]
    first = ", ".join(f"covar_pop({xs[i]}, {xs[j]}) AS a{i}{j}" for i, j in cells) + ", " + ", ".join(f"covar_pop({x}, y) AS b{i}" for i, x in enumerate(xs))
    steps = [f"e0 AS (SELECT series, {first} FROM mg GROUP BY series)"]
    for k in range(n - 1):
        less = lambda i: f"a{i}{k} / a{k}{k}"  # noqa: B023, E731
        a = [f"a{i}{j} - {less(i)} * a{k}{j} AS a{i}{j}" if i > k and j >= k else f"a{i}{j}" for i, j in cells]
        b = [f"b{i} - {less(i)} * b{k} AS b{i}" if i > k else f"b{i}" for i in range(n)]
        steps.append(f"e{k + 1} AS (SELECT series, {', '.join(a + b)} FROM e{k})")
    last = f"e{n - 1}"
    for i in reversed(range(n)):
        rest = "".join(f" - a{i}{j} * x{j}" for j in range(i + 1, n))
        steps.append(f"s{i} AS (SELECT *, (b{i}{rest}) / a{i}{i} AS x{i} FROM {last})")
        last = f"s{i}"
    return ",\n".join([*steps, "bt AS (" + " UNION ALL ".join(f"SELECT series, '{x}' AS indicator, x{i} AS beta FROM s0" for i, x in enumerate(xs)) + ")"])


_BETA = _elimination()
_SCORED = """mv AS (SELECT series, scenario, sum(beta * (level - base_level)) AS e FROM bt JOIN sl USING (indicator) GROUP BY 1, 2),
sc AS (SELECT n.scenario, tf.series, tf.ds, tf.yhat + coalesce(mv.e, 0) AS yhat FROM tf CROSS JOIN (SELECT DISTINCT scenario FROM sl) n LEFT JOIN mv ON mv.series = tf.series AND mv.scenario = n.scenario)"""
BASE = (fx.PANEL, fx.DENSE, fx.IND, fx.IND_LONG, _SCN, _LEV, _MERGED, _BETA, factor_sql("dense", "tf"), _SCORED)


def _levels(spark, sf_dir):
    return report.last_row_levels(fx.indicators(spark, sf_dir), fx.INDICATORS)


def _scenario_levels(spark, sf_dir):
    return scenario.apply_levels(_levels(spark, sf_dir), fx.literal_table(spark, fx.SCENARIO_COLUMNS, fx.SCENARIOS))


def _betas(spark, sf_dir):
    merged = align.merge_indicators(fx.dense(spark, sf_dir), fx.indicators(spark, sf_dir), "inner")
    return scenario.response(merged, fx.INDICATORS)


def _forecast(spark, sf_dir):
    return factor.trend_factor(fx.dense(spark, sf_dir), H)


def _scored(spark, sf_dir):
    return scenario.score(_forecast(spark, sf_dir), _betas(spark, sf_dir), _scenario_levels(spark, sf_dir))


@query("scenario_levels", sql(fx.IND, fx.IND_LONG, _SCN, _LEV, "SELECT * FROM sl"))
def scenario_levels(spark, sf_dir):
    return _scenario_levels(spark, sf_dir)


@query(
    "indicator_response",
    sql(fx.PANEL, fx.DENSE, fx.IND, _MERGED, _BETA, "SELECT series, indicator, round(beta / power(10, floor(log10(abs(beta)))), 5) AS digits, CAST(floor(log10(abs(beta))) AS BIGINT) AS exponent FROM bt"),
)
def indicator_response(spark, sf_dir):
    """The slopes as six digits and a power of ten, since their sizes differ by many orders."""
    exponent = F.floor(F.log10(F.abs("beta")))
    return _betas(spark, sf_dir).select("series", "indicator", F.round(F.col("beta") / F.pow(F.lit(10.0), exponent), 5).alias("digits"), exponent.alias("exponent"))


@query("scenario_forecast", sql(*BASE, "SELECT scenario, series, ds, round(yhat, 2) AS yhat FROM sc"))
def scenario_forecast(spark, sf_dir):
    return rounded(_scored(spark, sf_dir))


@query(
    "scenario_compare",
    sql(*BASE, """cp AS (SELECT series, sum(yhat) FILTER (scenario = 'normal') AS total_a, sum(yhat) FILTER (scenario = 'crisis') AS total_b FROM sc GROUP BY series)""",
        "SELECT series, round(total_a, 1) AS total_a, round(total_b, 1) AS total_b, round(total_b - total_a, 1) AS delta, round((total_b - total_a) / total_a * 100, 6) AS delta_pct FROM cp"),
)
def scenario_compare(spark, sf_dir):
    c = scenario.compare(_scored(spark, sf_dir), "normal", "crisis").orderBy(F.col("delta").desc(), "series")
    return rounded(c, 1, "total_a", "total_b", "delta").withColumn("delta_pct", F.round("delta_pct", 6))


@query("scenario_consensus", sql(*BASE, "SELECT ds, round(sum(CASE scenario WHEN 'crisis' THEN 0.35::DOUBLE WHEN 'optimistic' THEN 0.65::DOUBLE END * yhat), 1) AS yhat FROM sc WHERE scenario IN ('crisis', 'optimistic') GROUP BY ds"))
def scenario_consensus(spark, sf_dir):
    return rounded(scenario.consensus(_scored(spark, sf_dir), {"crisis": 0.35, "optimistic": 0.65}), 1)


@query("scenario_totals", sql(*BASE, "SELECT coalesce(series, 'Total Aggregated') AS selection, scenario, round(sum(yhat), 1) AS total FROM sc GROUP BY GROUPING SETS ((series, scenario), (scenario))"))
def scenario_totals(spark, sf_dir):
    s = _scored(spark, sf_dir)
    g = s.groupingSets([["series", "scenario"], ["scenario"]], "series", "scenario").agg(F.sum("yhat").alias("t"))
    return g.select(F.coalesce("series", F.lit("Total Aggregated")).alias("selection"), "scenario", F.round("t", 1).alias("total"))


@query(
    "tornado",
    sql(*BASE, "ef AS (SELECT indicator, sum(beta * (level * (1 + 0.1::DOUBLE) - level) * 12) AS up, sum(beta * (level * (1 - 0.1::DOUBLE) - level) * 12) AS down FROM bt JOIN lv USING (indicator) GROUP BY 1)",
        "SELECT indicator, round(up, 1) AS up, round(down, 1) AS down, round(abs(up - down), 1) AS spread FROM ef"),
)
def tornado(spark, sf_dir):
    return rounded(scenario.tornado(_betas(spark, sf_dir), _levels(spark, sf_dir), H), 1, "up", "down", "spread")


@query(
    "elasticity",
    sql(*BASE, """tt AS (SELECT series, sum(yhat) AS total FROM tf GROUP BY series), el AS (SELECT bt.series, indicator, beta * (level * 1.01::DOUBLE - level) * 12 AS effect, total FROM bt JOIN lv USING (indicator) JOIN tt ON tt.series = bt.series)""",
        """SELECT series, indicator, round(effect, 2) AS effect, round(effect / total * 100, 6) AS elasticity,
CASE WHEN effect / total * 100 > 0.5 THEN 'elastic' WHEN effect / total * 100 < -0.5 THEN 'inverse' ELSE 'inelastic' END AS kind FROM el"""),
)
def elasticity(spark, sf_dir):
    e = scenario.elasticity(_forecast(spark, sf_dir), _betas(spark, sf_dir), _levels(spark, sf_dir), H)
    return e.withColumns({"effect": F.round("effect", 2), "elasticity": F.round("elasticity", 6)})


_REPLAY = f"""wk AS (SELECT a.ds AS sim, a.indicator, CAST(t.step AS BIGINT) AS step, lv.level, lv.level * b.value / a.value AS value
  FROM (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY ds) AS k, count(*) OVER (PARTITION BY indicator) AS n FROM indl) a
  JOIN (SELECT unnest(generate_series(1, {H})) AS step) t ON a.k + {H} <= a.n
  JOIN (SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY ds) AS k FROM indl) b ON b.indicator = a.indicator AND b.k = a.k + t.step
  JOIN lv ON lv.indicator = a.indicator WHERE a.value <> 0)"""


def _paths(spark, sf_dir):
    return scenario.replay_paths(fx.indicators_long(spark, sf_dir), _levels(spark, sf_dir), H)


@query("replay_paths", sql(fx.IND, fx.IND_LONG, _SCN, _LEV, _REPLAY, "SELECT sim, indicator, step, round(value, 6) AS value FROM wk"))
def replay_paths(spark, sf_dir):
    return rounded(_paths(spark, sf_dir), 6, "value")


_CUBE = """cb AS (SELECT w.sim, tf.series, tf.ds, tf.yhat + w.e AS yhat FROM tf JOIN (
SELECT bt.series, wk.sim, wk.step, sum(beta * (value - level)) AS e FROM wk JOIN bt USING (indicator) GROUP BY 1, 2, 3) w ON w.series = tf.series AND w.step = tf.step)"""
_BANDS = """bd AS (SELECT series, ds, avg(yhat) AS mean, quantile_cont(yhat, 0.05) AS p05, quantile_cont(yhat, 0.25) AS p25, quantile_cont(yhat, 0.5) AS p50, quantile_cont(yhat, 0.75) AS p75,
quantile_cont(yhat, 0.95) AS p95 FROM cb GROUP BY 1, 2)"""
_COLS = ("mean", "p05", "p25", "p50", "p75", "p95")


def _cube(spark, sf_dir):
    return scenario.replay_cube(_forecast(spark, sf_dir), _betas(spark, sf_dir), _levels(spark, sf_dir), _paths(spark, sf_dir))


@query("replay_cube", sql(*BASE, _REPLAY, _CUBE, "SELECT sim, series, ds, round(yhat, 1) AS yhat FROM cb"))
def replay_cube(spark, sf_dir):
    return rounded(_cube(spark, sf_dir), 1)


@query("replay_bands", sql(*BASE, _REPLAY, _CUBE, _BANDS, "SELECT series, ds, " + ", ".join(f"round({c}, 1) AS {c}" for c in _COLS) + " FROM bd"))
def replay_bands(spark, sf_dir):
    return rounded(scenario.bands_of_cube(_cube(spark, sf_dir)), 1, *_COLS)


@query(
    "risk_metrics",
    sql(*BASE, _REPLAY, _CUBE, _BANDS, """SELECT series, ds, round(mean, 1) AS mean, round(p05, 1) AS p05, round(p50, 1) AS p50, round(p95, 1) AS p95, round(p95 - p05, 1) AS spread
FROM bd b WHERE ds = (SELECT max(ds) FROM bd x WHERE x.series = b.series)"""),
)
def risk_metrics(spark, sf_dir):
    return rounded(scenario.end_risk(scenario.bands_of_cube(_cube(spark, sf_dir))), 1, "mean", "p05", "p50", "p95", "spread")


@query("scenario_seasonal_arx")
def scenario_seasonal_arx(spark, sf_dir):
    """The scenarios through the autoregression with indicators: one path per scenario, one job."""
    p, ind, cols = fx.dense(spark, sf_dir), fx.indicators(spark, sf_dir), fx.INDICATORS
    levels = _scenario_levels(spark, sf_dir).groupBy("scenario").pivot("indicator", cols).agg(F.first("level"))
    last = p.agg(F.max("ds").alias("d"))
    from ..functions.calendar import month_ends_after

    dates = last.select(month_ends_after(F.col("d"), H + 2).alias("c")).scalar()
    future = levels.withColumn("ds", F.explode(dates))
    model = seasonal_ar.fit(p, ind, cols, alpha=1.0)
    return seasonal_ar.forecast(p, model, H, ind, future, cols, by=["scenario"])


_PRESETS = scenario.preset_rows()


@query(
    "preset_levels",
    sql(fx.IND, fx.IND_LONG, fx.literal_sql("pre", fx.SCENARIO_COLUMNS, _PRESETS), "lv AS (SELECT indicator, value AS level FROM indl WHERE ds = (SELECT max(ds) FROM ind))",
        """map_ AS (SELECT * FROM (VALUES ('Harga_Minyak_ICP', 'avg_qty'), ('IHSG', 'avg_price'), ('Inflasi', 'avg_tax'), ('SBN_10Y', 'avg_discount')) AS t(indicator, source))""",
        """b AS (SELECT m.indicator, lv.level FROM map_ m JOIN lv ON lv.indicator = m.source)""",
        """SELECT n.scenario, b.indicator, b.level AS base_level, CASE p.op WHEN 'set' THEN p.arg WHEN 'add' THEN b.level + p.arg WHEN 'mul' THEN b.level * p.arg ELSE b.level END AS level
FROM (SELECT DISTINCT scenario FROM pre) n CROSS JOIN b LEFT JOIN pre p ON p.scenario = n.scenario AND p.indicator = b.indicator"""),
)
def preset_levels(spark, sf_dir):
    """The built-in presets over current levels, with our indicators in the place of four macro columns."""
    names = {"avg_qty": "Harga_Minyak_ICP", "avg_price": "IHSG", "avg_tax": "Inflasi", "avg_discount": "SBN_10Y"}
    base = _levels(spark, sf_dir).replace(names, subset=["indicator"])
    return scenario.apply_levels(base, fx.literal_table(spark, fx.SCENARIO_COLUMNS, _PRESETS))
