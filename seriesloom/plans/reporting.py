"""Report tables: totals, growth, composition, pivots, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..functions import calendar as cal
from ..functions import text as tx
from ..operators import align, report
from . import fixtures as fx
from .registry import query, sql

P, T = fx.PANEL, fx.TOTALS

# a plain forecast table for report queries: the months of the last year repeated one year ahead
NAIVE = """fc AS (SELECT series, CAST(last_day(ds + INTERVAL 12 MONTH) AS DATE) AS ds, y * 1.03125::DOUBLE AS y FROM panel
  WHERE ds >= last_day((SELECT max(ds) FROM panel) - INTERVAL 11 MONTH))"""


def naive_forecast(panel):
    last_year = report.trailing_months(panel, 12)
    return last_year.select("series", F.last_day(F.add_months("ds", 12)).alias("ds"), (F.col("y") * 1.03125).alias("y"))


@query("totals_by_period", sql(P, T, "SELECT * FROM totals"))
def totals_by_period(spark, sf_dir):
    return fx.period_totals(fx.panel(spark, sf_dir))


@query("totals_by_series", sql(P, "SELECT series, sum(y) AS total FROM panel GROUP BY series"))
def totals_by_series(spark, sf_dir):
    return report.totals(fx.panel(spark, sf_dir), ["series"])


@query("single_series", sql(P, "SELECT * FROM panel WHERE series = 'BUILDING'"))
def single_series(spark, sf_dir):
    return fx.panel(spark, sf_dir).filter("series = 'BUILDING'").orderBy("ds")


@query("value_range", sql(fx.WIDE, "SELECT w.* FROM wide w WHERE y BETWEEN 500000 AND 1500000"))
def value_range(spark, sf_dir):
    return fx.wide(spark, sf_dir).filter(F.col("y").between(500000, 1500000))


@query("trailing_year", sql(P, "SELECT * FROM panel WHERE ds >= last_day((SELECT max(ds) FROM panel) - INTERVAL 11 MONTH)"))
def trailing_year(spark, sf_dir):
    return report.trailing_months(fx.panel(spark, sf_dir), 12)


@query(
    "multi_measure",
    sql(P, NAIVE, "SELECT ds, sum(y) AS y, round(sum(y * (1 - 0.05::DOUBLE)), 4) AS lo, round(sum(y * (1 + 0.05::DOUBLE)), 4) AS hi FROM fc GROUP BY ds"),
)
def multi_measure(spark, sf_dir):
    fc = report.with_bounds(naive_forecast(fx.panel(spark, sf_dir)))
    return fc.groupBy("ds").agg(F.sum("y").alias("y"), *[F.round(F.sum(c), 4).alias(c) for c in ("lo", "hi")])


@query(
    "kpis",
    sql(P, NAIVE, """k AS (SELECT sum(y) AS total, count(DISTINCT ds) AS months, sum(y * (1 - 0.05::DOUBLE)) AS total_lo, sum(y * (1 + 0.05::DOUBLE)) AS total_hi,
(SELECT sum(y) FROM panel WHERE ds >= last_day((SELECT max(ds) FROM panel) - INTERVAL 11 MONTH)) AS past FROM fc)""",
        """SELECT total, months, round(total_lo, 2) AS total_lo, round(total_hi, 2) AS total_hi, total / months AS per_month,
CASE WHEN past > 0 THEN (total - past) / past * 100 ELSE 0 END AS growth_pct FROM k"""),
)
def kpis(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    return report.headline_kpis(p, naive_forecast(p)).withColumns({c: F.round(c, 2) for c in ("total_lo", "total_hi")})


@query(
    "run_rate",
    sql(P, """SELECT CAST(floor(date_diff('day', min(ds), max(ds)) / 30) + 1 AS BIGINT) AS horizon, sum(y) / CAST(floor(date_diff('day', min(ds), max(ds)) / 30) + 1 AS BIGINT) AS run_rate FROM panel"""),
)
def run_rate(spark, sf_dir):
    one = fx.panel(spark, sf_dir).agg(cal.horizon_months(F.min("ds"), F.max("ds")).alias("horizon"), F.sum("y").alias("t"))
    return one.select("horizon", (F.col("t") / F.col("horizon")).alias("run_rate"))


@query("peak_period", sql(P, T, "SELECT ds AS peak_ds, total AS peak_total FROM totals ORDER BY total DESC, ds LIMIT 1"))
def peak_period(spark, sf_dir):
    return report.peak_period(fx.period_totals(fx.panel(spark, sf_dir)))


@query(
    "composition_rollup",
    sql(P, "SELECT coalesce(series, 'Total') AS series, sum(y) AS total, sum(y) / (SELECT sum(y) FROM panel) AS share FROM panel GROUP BY ROLLUP (series)"),
)
def composition_rollup(spark, sf_dir):
    return report.composition(fx.panel(spark, sf_dir))


@query("total_selector", sql(P, "SELECT coalesce(series, 'Total Aggregated') AS selection, sum(y) AS total FROM panel GROUP BY GROUPING SETS ((series), ())"))
def total_selector(spark, sf_dir):
    return report.total_or_series(fx.panel(spark, sf_dir))


@query(
    "season_pivot",
    sql(P, """SELECT m.month, y.year, c.total FROM (SELECT CAST(unnest(generate_series(1, 12)) AS BIGINT) AS month) m, (SELECT DISTINCT year(ds) AS year FROM panel) y
LEFT JOIN (SELECT month(ds) AS month, year(ds) AS year, sum(y) AS total FROM panel GROUP BY 1, 2) c ON c.month = m.month AND c.year = y.year"""),
)
def season_pivot(spark, sf_dir):
    """All months by all years found in the data, empty cells included."""
    pivot = align.month_axis(report.season_pivot(fx.panel(spark, sf_dir)), "row")
    return report.long_cells(pivot, "month", "year", "total")


_CELLS = """SELECT d.ds, s.series, c.total{more} FROM (SELECT DISTINCT ds FROM panel) d CROSS JOIN (SELECT DISTINCT series FROM panel) s
LEFT JOIN (SELECT ds, series, {agg}(y) AS total FROM panel GROUP BY 1, 2) c ON c.ds = d.ds AND c.series = s.series"""


@query("series_pivot", sql(P, _CELLS.format(agg="sum", more="")))
def series_pivot(spark, sf_dir):
    return report.long_cells(report.pivot_series(fx.panel(spark, sf_dir)), "ds", "series", "total")


@query("series_pivot_mean", sql(P, _CELLS.format(agg="avg", more="")))
def series_pivot_mean(spark, sf_dir):
    return report.long_cells(report.pivot_series(fx.panel(spark, sf_dir), agg="avg"), "ds", "series", "total")


_CORR = "SELECT x.name AS a, z.name AS b, round(corr(x.v, z.v), 6) AS corr FROM {0} x JOIN {0} z ON x.ds = z.ds GROUP BY 1, 2"


@query("corr_matrix", sql(P, "lp AS (SELECT ds, series AS name, y AS v FROM panel)", _CORR.format("lp")))
def corr_matrix(spark, sf_dir):
    return report.correlation_matrix(report.pivot_series(fx.panel(spark, sf_dir))).withColumn("corr", F.round("corr", 6))


@query(
    "corr_indicators",
    sql(P, fx.IND, fx.IND_LONG, "lg AS (SELECT ds, series AS name, y AS v FROM panel UNION ALL SELECT ds, indicator, value FROM indl)",
        "d AS (SELECT lg.* FROM lg WHERE ds IN (SELECT ds FROM panel) AND ds IN (SELECT ds FROM ind))", _CORR.format("d")),
)
def corr_indicators(spark, sf_dir):
    pivot = report.pivot_series(fx.panel(spark, sf_dir))
    both = align.merge_indicators(pivot.withColumnRenamed("row", "ds"), fx.indicators(spark, sf_dir), how="inner")
    named = F.create_map(*[x for c in fx.INDICATORS for x in (F.lit(c), F.col(c))])
    return report.correlation_matrix(both.select(F.map_concat("cells", named).alias("cells"))).withColumn("corr", F.round("corr", 6))


@query(
    "boxplot_stats",
    sql(fx.WIDE, """q AS (SELECT series, quantile_cont(y, 0.125) AS e1, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q3, quantile_cont(y, 0.875) AS e7 FROM wide GROUP BY series)""",
        """SELECT q.*, min(y) FILTER (y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_lo,
max(y) FILTER (y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_hi,
count(*) FILTER (NOT y BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_out FROM q JOIN wide USING (series) GROUP BY ALL"""),
)
def boxplot_stats(spark, sf_dir):
    return report.boxplot(fx.wide(spark, sf_dir))


_HIST = """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT {by}CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n, lo + CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS BIGINT) * ((hi - lo) / 20) AS bin_lo
FROM lineitem, b GROUP BY ALL"""


@query("histogram20", _HIST.format(by=""))
def histogram20(spark, sf_dir):
    return report.histogram(fx.table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)


@query("density_by_sample", f"SELECT *, n / sum(n) OVER (PARTITION BY l_returnflag) AS density FROM ({_HIST.format(by='l_returnflag, ')})")
def density_by_sample(spark, sf_dir):
    return report.density(fx.table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag", 20)


@query("mom_growth", sql(P, T, "SELECT *, (total / lag(total) OVER (ORDER BY ds) - 1) * 100 AS growth FROM totals"))
def mom_growth(spark, sf_dir):
    return report.period_growth(fx.period_totals(fx.panel(spark, sf_dir)))


@query(
    "yoy_growth",
    sql(P, T, """SELECT *, CASE WHEN growth >= 0 THEN 'up' ELSE 'down' END AS direction FROM (
SELECT *, (total / lag(total, 12) OVER (ORDER BY ds) - 1) * 100 AS growth FROM totals) WHERE growth IS NOT NULL"""),
)
def yoy_growth(spark, sf_dir):
    return report.growth_table(fx.period_totals(fx.panel(spark, sf_dir)), 12)


@query(
    "yoy_forecast",
    sql(P, NAIVE, "u AS (SELECT ds, sum(y) AS total FROM (SELECT * FROM panel UNION ALL SELECT * FROM fc) GROUP BY ds)",
        """SELECT * FROM (SELECT *, (total / lag(total, 12) OVER (ORDER BY ds) - 1) * 100 AS growth FROM u) WHERE ds >= (SELECT min(ds) FROM fc)"""),
)
def yoy_forecast(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    fc = naive_forecast(p)
    both = report.totals(report.combine(p, fc), ["ds"])
    return report.from_date_of(report.period_growth(both, steps=12), fc)


@query("guarded_growth", sql(P, T, "SELECT *, CASE WHEN lag(total) OVER (ORDER BY ds) > 0 THEN (total - lag(total) OVER (ORDER BY ds)) / lag(total) OVER (ORDER BY ds) * 100 ELSE 0 END AS growth FROM totals"))
def guarded_growth(spark, sf_dir):
    return report.guarded_growth(fx.period_totals(fx.panel(spark, sf_dir)))


_PF = """pf AS (SELECT series, sum(y) AS total, coalesce(avg(g) * 100, 0) AS avg_growth, coalesce(stddev_samp(y), 0) AS std, coalesce(stddev_samp(y) / avg(y), 0) AS cv
FROM (SELECT *, y / lag(y) OVER (PARTITION BY series ORDER BY ds) - 1 AS g FROM wide) GROUP BY series)"""


def _portfolio(spark, sf_dir):
    return report.portfolio(fx.wide(spark, sf_dir))


@query("portfolio_matrix", sql(fx.WIDE, _PF, "SELECT series, total, round(avg_growth, 6) AS avg_growth, round(std, 3) AS std, round(cv, 8) AS cv FROM pf"))
def portfolio_matrix(spark, sf_dir):
    return _portfolio(spark, sf_dir).withColumns({"avg_growth": F.round("avg_growth", 6), "std": F.round("std", 3), "cv": F.round("cv", 8)})


@query(
    "portfolio_quadrant",
    sql(fx.WIDE, _PF, "m AS (SELECT median(avg_growth) AS mx, median(total) AS my FROM pf)",
        """SELECT series, total, CASE WHEN avg_growth >= mx AND total >= my THEN 'star' WHEN total >= my THEN 'cash cow' WHEN avg_growth >= mx THEN 'question mark' ELSE 'laggard' END AS quadrant FROM pf, m"""),
)
def portfolio_quadrant(spark, sf_dir):
    return report.quadrants(_portfolio(spark, sf_dir)).select("series", "total", "quadrant")


@query("growth_regression", sql(fx.WIDE, _PF, "SELECT round(regr_slope(total, avg_growth), 3) AS slope, round(regr_intercept(total, avg_growth), 3) AS intercept FROM pf"))
def growth_regression(spark, sf_dir):
    return _portfolio(spark, sf_dir).agg(
        F.round(F.regr_slope("total", "avg_growth"), 3).alias("slope"),
        F.round(F.regr_intercept("total", "avg_growth"), 3).alias("intercept"),
    )


@query("top_risk", sql(fx.WIDE, _PF, "SELECT series, round(cv, 8) AS cv FROM pf ORDER BY pf.cv DESC, series LIMIT 5"))
def top_risk(spark, sf_dir):
    return _portfolio(spark, sf_dir).orderBy(F.col("cv").desc(), "series").limit(5).select("series", F.round("cv", 8).alias("cv"))


@query("buoyancy", sql(P, T, """SELECT round(avg(g), 6) AS avg_growth, round(avg(g) / 5.0, 6) AS buoyancy FROM (SELECT (total / lag(total) OVER (ORDER BY ds) - 1) * 100 AS g FROM totals)"""))
def buoyancy(spark, sf_dir):
    b = report.buoyancy(fx.period_totals(fx.panel(spark, sf_dir)), 5.0)
    return b.select(*[F.round(c, 6).alias(c) for c in b.columns])


@query("top5", sql(fx.WIDE, "SELECT series, sum(y) AS total FROM wide GROUP BY series ORDER BY total DESC, series LIMIT 5"))
def top5(spark, sf_dir):
    return report.top_share(fx.wide(spark, sf_dir), 5)


@query("top1", sql(P, "SELECT arg_max(series, total) AS series, max(total) AS total FROM (SELECT series, sum(y) AS total FROM panel GROUP BY series)"))
def top1(spark, sf_dir):
    t = report.totals(fx.panel(spark, sf_dir), ["series"])
    return t.agg(F.max_by("series", F.struct("total", "series")).alias("series"), F.max("total").alias("total"))


@query(
    "history_forecast_union",
    sql(P, NAIVE, """SELECT series, ds, y, 'Realisasi' AS kind, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi FROM panel
UNION ALL SELECT series, ds, y, 'Forecast', y * (1 - 0.05::DOUBLE), y * (1 + 0.05::DOUBLE) FROM fc"""),
)
def history_forecast_union(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    return report.combine(p, report.with_bounds(naive_forecast(p)))


@query(
    "totals_by_kind",
    sql(P, NAIVE, "SELECT ds, kind, sum(y) AS total FROM (SELECT *, 'Realisasi' AS kind FROM panel UNION ALL SELECT *, 'Forecast' FROM fc) GROUP BY 1, 2"),
)
def totals_by_kind(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    return report.totals(report.combine(p, naive_forecast(p)), ["ds", "kind"])


@query(
    "bridge_points",
    sql(P, NAIVE, """SELECT h.series, h.ds AS from_ds, h.y AS from_y, f.ds AS to_ds, f.y AS to_y
FROM (SELECT series, max(ds) AS ds, arg_max(y, ds) AS y FROM panel GROUP BY series) h JOIN (SELECT series, min(ds) AS ds, arg_min(y, ds) AS y FROM fc GROUP BY series) f USING (series)"""),
)
def bridge_points(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    return report.bridge(report.combine(p, naive_forecast(p)))


@query(
    "run_delta",
    sql(P, NAIVE, """d AS (SELECT (SELECT sum(y) FROM fc) AS current, (SELECT sum(y) FROM panel WHERE ds >= last_day((SELECT max(ds) FROM panel) - INTERVAL 11 MONTH)) AS previous)""",
        "SELECT current, previous, current - previous AS delta, (current - previous) / previous * 100 AS delta_pct, abs((current - previous) / previous * 100) > 1 AS significant FROM d"),
)
def run_delta(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    return report.delta_to_previous(naive_forecast(p), report.trailing_months(p, 12))


@query("current_levels", sql(fx.IND, fx.IND_LONG, "SELECT indicator, value AS level FROM indl WHERE ds = (SELECT max(ds) FROM ind)"))
def current_levels(spark, sf_dir):
    return report.last_row_levels(fx.indicators(spark, sf_dir), fx.INDICATORS)


@query(
    "trailing_mean_levels",
    sql(fx.IND, fx.IND_LONG, "SELECT indicator, round(avg(value), 9) AS level FROM indl WHERE ds IN (SELECT ds FROM ind ORDER BY ds DESC LIMIT 3) GROUP BY 1"),
)
def trailing_mean_levels(spark, sf_dir):
    return report.trailing_mean_levels(fx.indicators(spark, sf_dir), fx.INDICATORS).withColumn("level", F.round("level", 9))


@query(
    "display_values",
    sql(P, """SELECT series, printf('%.2f%%', avg(y) / max(y) * 100) AS acc_text, CAST(replace(printf('%.2f%%', avg(y) / max(y) * 100), '%', '') AS DOUBLE) AS acc,
CASE WHEN CAST(replace(printf('%.2f%%', avg(y) / max(y) * 100), '%', '') AS DOUBLE) >= 90 THEN 'green' WHEN CAST(replace(printf('%.2f%%', avg(y) / max(y) * 100), '%', '') AS DOUBLE) >= 75 THEN 'amber' ELSE 'red' END AS band,
format('{:,}', CAST(sum(y) AS BIGINT)) AS total_text FROM panel GROUP BY series"""),
)
def display_values(spark, sf_dir):
    g = fx.panel(spark, sf_dir).groupBy("series").agg(
        tx.percent_text(F.avg("y") / F.max("y") * 100).alias("acc_text"), tx.thousands_text(F.sum("y")).alias("total_text")
    )
    acc = g.withColumn("acc", tx.parse_percent(F.col("acc_text")))
    return acc.withColumn("band", bands.accuracy_band(F.col("acc")))


@query(
    "event_freshness",
    """SELECT user_id, CASE WHEN h < 24 THEN 'fresh' WHEN h < 168 THEN 'aging' ELSE 'stale' END AS freshness FROM (
SELECT user_id, date_diff('second', max(ts), TIMESTAMP '2024-02-01 00:00:00') / 3600 AS h FROM events GROUP BY user_id)""",
)
def event_freshness(spark, sf_dir):
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    age = F.timestamp_diff("SECOND", F.max("ts"), as_of) / 3600
    return fx.table(spark, sf_dir, "events").groupBy("user_id").agg(bands.freshness_band(age).alias("freshness"))
