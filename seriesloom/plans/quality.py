"""Profiles, data quality, anomalies and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, clean, drift, forest, profile, quality
from ..operators.quantiles import exact_quantiles
from ..spec import DEFAULT
from . import fixtures as fx
from .registry import query, sql

W, WD = fx.WIDE, fx.WIDE_DENSE
AS_OF = "2001-12-15"


def as_of():
    return F.lit(AS_OF).cast("date")


CHARS = """chb AS (SELECT series, ds, y, row_number() OVER (PARTITION BY series ORDER BY ds) - 1 AS t, lag(y, 12) OVER (PARTITION BY series ORDER BY ds) AS y12 FROM wdense),
ch AS (SELECT series, count(*) AS n, avg(y) AS mean, stddev_samp(y) AS std, coalesce(stddev_samp(y) / avg(y), 0) AS cv, 0.0::DOUBLE AS missing_pct, count(*) >= 24 AS sufficient,
  coalesce(regr_slope(y, t) / avg(y) * 100, 0) AS slope_pct, CASE WHEN count(*) >= 24 THEN corr(y, y12) FILTER (y12 IS NOT NULL) END AS acf FROM chb GROUP BY series),
chars AS (SELECT series, n, mean, round(std, 3) AS std, round(cv, 8) AS cv, missing_pct, sufficient, round(slope_pct, 8) AS slope_pct,
  CASE WHEN n < 2 THEN 'insufficient_data' WHEN abs(slope_pct) < 1 THEN 'stable' WHEN slope_pct > 1 THEN 'increasing' ELSE 'decreasing' END AS trend,
  round(acf, 6) AS acf_season, n >= 24 AND coalesce(acf > 0.5, false) AS seasonal,
  CASE WHEN cv < 0.1 THEN 'low' WHEN cv < 0.3 THEN 'medium' ELSE 'high' END AS volatility FROM ch)"""


def _chars(spark, sf_dir):
    c = profile.characteristics(fx.wide_dense(spark, sf_dir))
    return c.withColumns({"std": F.round("std", 3), "cv": F.round("cv", 8), "slope_pct": F.round("slope_pct", 8), "acf_season": F.round("acf_season", 6)})


@query("characteristics", sql(W, WD, CHARS, "SELECT * FROM chars"))
def characteristics(spark, sf_dir):
    return _chars(spark, sf_dir)


@query("trend_class", sql(W, WD, CHARS, "SELECT series, slope_pct, trend FROM chars"))
def trend_class(spark, sf_dir):
    return _chars(spark, sf_dir).select("series", "slope_pct", "trend")


@query("seasonality_flag", sql(W, WD, CHARS, "SELECT series, acf_season, seasonal FROM chars"))
def seasonality_flag(spark, sf_dir):
    return _chars(spark, sf_dir).select("series", "acf_season", "seasonal")


@query("volatility", sql(W, WD, CHARS, "SELECT series, cv, volatility FROM chars"))
def volatility(spark, sf_dir):
    return _chars(spark, sf_dir).select("series", "cv", "volatility")


_MODELS = """CASE WHEN seasonal THEN ['Prophet', 'SARIMAX'] ELSE []::VARCHAR[] END || CASE WHEN volatility IN ('medium', 'high') THEN ['XGBoost', 'LightGBM', 'Random Forest'] ELSE []::VARCHAR[] END
|| CASE WHEN trend = 'stable' AND volatility = 'low' THEN ['Linear Regression', 'Ridge'] ELSE []::VARCHAR[] END || CASE WHEN n > 60 THEN ['LSTM'] ELSE []::VARCHAR[] END || ['Ensemble (Top 3)']"""
_FEATS = """['time parts', 'lags 1, 3, 6, 12'] || CASE WHEN seasonal THEN ['seasonal decomposition', 'sin/cos month'] ELSE []::VARCHAR[] END
|| CASE WHEN trend IN ('increasing', 'decreasing') THEN ['rolling mean and std', 'trend index'] ELSE []::VARCHAR[] END
|| CASE WHEN volatility = 'high' THEN ['rolling std', 'outlier flag'] ELSE []::VARCHAR[] END || ['indicators', 'holiday flags']"""


@query(
    "suggest_models",
    sql(W, WD, CHARS, f"""SELECT series, array_to_string(({_MODELS})[1:5], '; ') AS models, array_to_string({_FEATS}, '; ') AS features,
CASE WHEN n > 60 THEN 'walk-forward' ELSE 'holdout' END AS validation, CASE WHEN n > 40 THEN 'sampler' ELSE 'grid' END AS search FROM chars"""),
)
def suggest_models(spark, sf_dir):
    s = profile.suggestions(profile.characteristics(fx.wide_dense(spark, sf_dir)))
    return s.select("series", F.array_join("models", "; ").alias("models"), F.array_join("features", "; ").alias("features"), "validation", "search")


_RANGES = fx.literal_sql("rg", ("model", "parameter", "choices"), profile.SEARCH_RANGES)


@query(
    "recommend_hyperparameters",
    sql(W, WD, CHARS, _RANGES, f"""sg AS (SELECT series, volatility, ({_MODELS})[1:5] AS models FROM chars)""",
        """SELECT series, rg.model, parameter, choices FROM sg, rg WHERE list_contains(models, rg.model)
UNION ALL SELECT series, 'Prophet', 'seasonality_mode', CASE WHEN volatility = 'high' THEN 'multiplicative' ELSE 'additive' END FROM sg WHERE list_contains(models, 'Prophet')"""),
)
def recommend_hyperparameters(spark, sf_dir):
    """Search ranges of the models that each series is advised to use."""
    return profile.recommend_ranges(profile.characteristics(fx.wide_dense(spark, sf_dir)))


def _decompose_sql(mul: bool) -> str:
    detr = "y / nullif(trend, 0)" if mul else "y - trend"
    seas = "s / avg(s) OVER (PARTITION BY series)" if mul else "s - avg(s) OVER (PARTITION BY series)"
    resid = "y / (trend * seasonal)" if mul else "y - trend - seasonal"
    digits = 8 if mul else 6
    return sql(
        W, WD,
        """dt AS (SELECT *, (sum(y) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(y, 6) OVER w + lead(y, 6) OVER w) * 0.5) / 12 AS trend,
  CAST((row_number() OVER w - 1) % 12 AS BIGINT) AS phase, count(*) OVER (PARTITION BY series) AS n FROM wdense WINDOW w AS (PARTITION BY series ORDER BY ds))""",
        f"dd AS (SELECT *, {detr} AS d FROM dt WHERE n >= 24)",
        f"ds_ AS (SELECT series, phase, {seas} AS seasonal FROM (SELECT series, phase, avg(d) AS s FROM dd GROUP BY 1, 2))",
        f"SELECT series, ds, y, phase, trend, round(seasonal, {digits}) AS seasonal, round({resid}, {digits}) AS resid FROM dd JOIN ds_ USING (series, phase)",
    )


@query("decompose_additive", _decompose_sql(False))
def decompose_additive(spark, sf_dir):
    d = profile.decompose(fx.wide_dense(spark, sf_dir))
    return d.withColumns({c: F.round(c, 6) for c in ("seasonal", "resid")})


@query("decompose_multiplicative", _decompose_sql(True))
def decompose_multiplicative(spark, sf_dir):
    d = profile.decompose(fx.wide_dense(spark, sf_dir), "multiplicative")
    return d.withColumns({c: F.round(c, 8) for c in ("seasonal", "resid")})


@query(
    "indicator_vol",
    sql(fx.IND, fx.IND_LONG, """SELECT indicator, round(coalesce(stddev_samp(g), 0.01), 9) AS vol FROM (
SELECT indicator, value / lag(value) OVER (PARTITION BY indicator ORDER BY ds) - 1 AS g FROM indl) GROUP BY indicator"""),
)
def indicator_vol(spark, sf_dir):
    return profile.indicator_volatility(fx.indicators_long(spark, sf_dir)).withColumn("vol", F.round("vol", 9))


# ---- quality ----

_RULES = fx.literal_sql("rules", fx.RULE_COLUMNS, fx.RULES)


@query(
    "rule_violations",
    sql(fx.IND, fx.IND_LONG, _RULES, """SELECT i.ds, i.indicator, i.value, r.min, r.max, r.critical, CASE WHEN value < r.min THEN 'too low' ELSE 'too high' END AS issue
FROM indl i JOIN rules r USING (indicator) WHERE value < r.min OR value > r.max"""),
)
def rule_violations(spark, sf_dir):
    rules = fx.literal_table(spark, fx.RULE_COLUMNS, fx.RULES)
    return align.rule_breaches(fx.indicators_long(spark, sf_dir), rules)


@query(
    "indicator_score",
    sql(fx.IND, fx.IND_LONG, _RULES, """b AS (SELECT r.indicator, count(*) FILTER (value < r.min) AS below, count(*) FILTER (value > r.max) AS above FROM indl JOIN rules r USING (indicator) GROUP BY r.indicator)""",
        """q AS (SELECT (SELECT count(*) FROM ind) * 5 AS cells, 0::BIGINT AS missing_count, (SELECT CAST(sum(below + above) AS BIGINT) FROM b) AS outlier_count,
CAST(date_diff('day', (SELECT max(ds) FROM ind), DATE '2001-12-15') AS BIGINT) AS days_old)""",
        """s AS (SELECT *, greatest(0.0::DOUBLE, round(100.0::DOUBLE - least(missing_count * 100.0::DOUBLE / cells * 2, 40) - least(outlier_count * 100.0::DOUBLE / cells * 5, 40)
- CASE WHEN days_old > 90 THEN 20 WHEN days_old > 35 THEN 5 ELSE 0 END, 1)) AS score FROM q)""",
        "SELECT CASE WHEN score < 50 THEN 'CRITICAL' WHEN score < 80 THEN 'WARNING' ELSE 'OK' END AS status, score, missing_count, outlier_count, days_old FROM s"),
)
def indicator_score(spark, sf_dir):
    rules = [quality.Rule(*r) for r in fx.RULES]
    return quality.indicator_report(fx.indicators(spark, sf_dir), as_of(), rules).drop("issues")


_ISSUES = " UNION ALL ".join(
    f"SELECT '{i}: ' || count(*) || ' values {kind} {lim}' AS issue FROM ind WHERE {i} {op} {lim} HAVING count(*) > 0"
    for i, lo, hi, _ in fx.RULES for kind, op, lim in (("below", "<", lo), ("above", ">", hi))
)


@query(
    "indicator_issues",
    sql(fx.IND, "age AS (SELECT date_diff('day', max(ds), DATE '2001-12-15') AS d FROM ind)",
        _ISSUES + """ UNION ALL SELECT CASE WHEN d > 90 THEN 'stale' ELSE 'slightly old' END || ': last period ' || d || ' days ago' FROM age WHERE d > 35"""),
)
def indicator_issues(spark, sf_dir):
    rules = [quality.Rule(*r) for r in fx.RULES]
    return quality.indicator_report(fx.indicators(spark, sf_dir), as_of(), rules).select(F.explode("issues").alias("issue"))


@query(
    "history_score",
    sql(W, WD, """q AS (SELECT count(*) AS n, count(*) FILTER (y IS NULL) AS missing_count, count(*) FILTER (y <= 0) AS outlier_count, CAST(date_diff('day', max(ds), DATE '2001-12-15') AS BIGINT) AS days_old
FROM (SELECT c.series, c.ds, w.y FROM wdense_cal c LEFT JOIN wide w ON w.series = c.series AND w.ds = c.ds))""",
        """s AS (SELECT *, greatest(0.0::DOUBLE, round(100.0::DOUBLE - least(missing_count * 100.0::DOUBLE / (n * 3) * 3, 40) - least(outlier_count * 100.0::DOUBLE / n, 40), 1)) AS score FROM q)""",
        "SELECT CASE WHEN score < 40 THEN 'CRITICAL' WHEN score < 60 THEN 'WARNING' ELSE 'OK' END AS status, score, missing_count, outlier_count, days_old FROM s"),
)
def history_score(spark, sf_dir):
    return quality.history_report(clean.densify(fx.wide(spark, sf_dir)), as_of()).drop("issues")


_GAPPY = "gap AS (SELECT c.series, c.ds, w.y FROM wdense_cal c LEFT JOIN wide w ON w.series = c.series AND w.ds = c.ds)"


@query("null_counts", sql(W, WD, _GAPPY, """SELECT count(*) FILTER (y IS NULL) AS missing, count(*) * 3 AS cells, count(*) FILTER (y IS NULL) * 100.0::DOUBLE / (count(*) * 3) AS missing_pct FROM gap"""))
def null_counts(spark, sf_dir):
    return quality.null_counts(clean.densify(fx.wide(spark, sf_dir)))


@query(
    "completeness",
    sql(W, WD, _GAPPY, """SELECT 'y' AS "column", ds, count(*) FILTER (y IS NULL) AS missing FROM gap GROUP BY ds UNION ALL SELECT 'series', ds, count(*) FILTER (series IS NULL) FROM gap GROUP BY ds"""),
)
def completeness(spark, sf_dir):
    return quality.completeness(clean.densify(fx.wide(spark, sf_dir)))


@query(
    "not_positive",
    """SELECT c_custkey, c_acctbal, 'value is not positive' AS issue, 0.01::DOUBLE AS suggested_min FROM customer WHERE c_acctbal <= 0""",
)
def not_positive(spark, sf_dir):
    from ..spec import PanelSpec

    c = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return quality.not_positive(c, PanelSpec(keys=("c_custkey",), y="c_acctbal"))


@query(
    "precheck",
    sql(fx.PANEL, "SELECT count(*) FILTER (y IS NULL OR ds IS NULL OR series IS NULL) AS nulls, count(*) FILTER (y <= 0) AS not_positive, count(*) FILTER (y IS NULL OR ds IS NULL OR series IS NULL) = 0 AND count(*) FILTER (y <= 0) = 0 AS healthy FROM panel"),
)
def precheck(spark, sf_dir):
    p = fx.panel(spark, sf_dir)
    nulls = F.count_if(F.col("y").isNull() | F.col("ds").isNull() | F.col("series").isNull())
    bad = F.count_if(F.col("y") <= 0)
    return p.agg(nulls.alias("nulls"), bad.alias("not_positive"), ((nulls == 0) & (bad == 0)).alias("healthy"))


_STATS = "stt AS (SELECT *, avg(y) OVER s AS m, stddev_samp(y) OVER s AS sd FROM wdense WINDOW s AS (PARTITION BY series))"


@query(
    "outlier_repair",
    sql(W, WD, _STATS, """r AS (SELECT *, coalesce(abs(CASE WHEN sd > 0 THEN (y - m) / sd END) > 2.5, false) AS off,
(sum(y) OVER nb - y) / nullif(count(y) OVER nb - 1, 0) AS others FROM stt WINDOW nb AS (PARTITION BY series ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING))""",
        "SELECT series, ds, y, off AND others IS NOT NULL AS is_fixed, CASE WHEN off AND others IS NOT NULL THEN others ELSE y END AS y_fixed FROM r"),
)
def outlier_repair(spark, sf_dir):
    return clean.repair_outliers(fx.wide_dense(spark, sf_dir))


@query("anomaly_z", sql(W, WD, _STATS, "SELECT series, ds, y, round((y - m) / nullif(sd, 0), 6) AS z, coalesce(abs((y - m) / nullif(sd, 0)) > 3, false) AS is_z FROM stt"))
def anomaly_z(spark, sf_dir):
    return quality.anomaly_z(fx.wide_dense(spark, sf_dir)).withColumn("z", F.round("z", 6))


_IQR = """iq AS (SELECT series, quantile_cont(y, 0.25) AS q1, quantile_cont(y, 0.75) AS q3 FROM wdense GROUP BY series),
fl AS (SELECT s.series, s.ds, s.y, s.m, s.sd, coalesce(abs((y - m) / nullif(sd, 0)) > 2, false) AS is_z, y < q1 - 1.5 * (q3 - q1) OR y > q3 + 1.5 * (q3 - q1) AS is_iqr FROM stt s JOIN iq USING (series))"""


@query("anomaly_iqr", sql(W, WD, _STATS, _IQR, "SELECT series, ds, y, is_iqr FROM fl"))
def anomaly_iqr(spark, sf_dir):
    return quality.anomaly_iqr(fx.wide_dense(spark, sf_dir))


TREES = 20
_U = "(('0x' || substr(md5('42:' || series || ':' || tree || ':' || node || ':{}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
_FOREST = f"""fp AS (SELECT series, ds, y AS f0, coalesce(lag(y) OVER (PARTITION BY series ORDER BY ds), 0) AS f1, CAST(month(ds) AS DOUBLE) AS f2, count(*) OVER (PARTITION BY series) AS n FROM wdense),
ft AS (SELECT series, ds, f0, f1, f2, n, CAST(tree AS BIGINT) AS tree, CAST(1 AS BIGINT) AS node, 0 AS level FROM fp, (SELECT unnest(generate_series(0, {TREES - 1})) AS tree)
  UNION ALL
  SELECT series, ds, f0, f1, f2, n, tree, 2 * node + CAST([f0, f1, f2][pick] > [l0, l1, l2][pick] + {_U.format('cut')} * ([h0, h1, h2][pick] - [l0, l1, l2][pick]) AS BIGINT), level + 1
  FROM (SELECT *, usable[CAST(floor({_U.format('feature')} * len(usable)) AS BIGINT) + 1] AS pick FROM (
    SELECT *, list_filter([1, 2, 3], lambda i: [h0 > l0, h1 > l1, h2 > l2][i]) AS usable FROM (
      SELECT *, count(*) OVER g AS c, min(f0) OVER g AS l0, max(f0) OVER g AS h0, min(f1) OVER g AS l1, max(f1) OVER g AS h1, min(f2) OVER g AS l2, max(f2) OVER g AS h2
      FROM ft WINDOW g AS (PARTITION BY series, tree, node)) WHERE c > 1 AND level < ceil(log2(n))) WHERE len(usable) > 0)),
fe AS (SELECT series, ds, n, level, count(*) OVER (PARTITION BY series, tree, level, node) AS c, row_number() OVER (PARTITION BY series, ds, tree ORDER BY level DESC) AS rn FROM ft),
fo AS (SELECT series, ds, CASE WHEN any_value(n) >= 10 THEN round(pow(2, -(sum(level + CASE WHEN c > 2 THEN 2 * (ln(c - 1) + 0.5772156649015329::DOUBLE) - 2 * (c - 1) / c WHEN c = 2 THEN 1 ELSE 0 END) / {TREES})
  / (2 * (ln(any_value(n) - 1) + 0.5772156649015329::DOUBLE) - 2 * (any_value(n) - 1) / any_value(n))), 9) ELSE 0 END AS forest_score FROM fe WHERE rn = 1 GROUP BY series, ds),
fg AS (SELECT *, forest_score > 0 AND forest_score > quantile_cont(forest_score, 0.9) OVER (PARTITION BY series) AS is_forest FROM fo)"""


def _forest_flags(df):
    """Value, the value before and the calendar month as the features of a forest per series."""
    shaped = df.withColumns({"lag_1": F.coalesce(F.lag("y").over(DEFAULT.ordered()), F.lit(0.0)), "month": F.month("ds")})
    return forest.series_forest(shaped, ["y", "lag_1", "month"], 0.1, TREES).drop("lag_1", "month")


@query("series_forest", sql(W, WD, _FOREST, "SELECT series, ds, forest_score, is_forest FROM fg"))
def series_forest(spark, sf_dir):
    return _forest_flags(fx.wide_dense(spark, sf_dir)).drop("y")


_VOTE = """vt AS (SELECT fl.*, is_forest, CAST(is_z AS BIGINT) + CAST(is_iqr AS BIGINT) + CAST(is_forest AS BIGINT) AS votes FROM fl JOIN fg ON fg.series = fl.series AND fg.ds = fl.ds),
vs AS (SELECT series, ds, y, is_z, is_iqr, is_forest, votes, votes >= 2 AS is_anomaly, (votes + CAST(votes >= 2 AS BIGINT)) / 4 AS score FROM vt)"""


def _votes(spark, sf_dir):
    """Three methods and their ensemble: the score is a share of four."""
    d = quality.anomaly_iqr(quality.anomaly_z(fx.wide_dense(spark, sf_dir), 2.0))
    return quality.vote(_forest_flags(d.drop("z")).drop("forest_score"), ["is_z", "is_iqr", "is_forest"])


@query("anomaly_vote", sql(W, WD, _STATS, _IQR, _FOREST, _VOTE, "SELECT *, CASE WHEN score > 0.8 THEN 'High' WHEN score > 0.5 THEN 'Medium' ELSE 'Low' END AS severity FROM vs"))
def anomaly_vote(spark, sf_dir):
    return _votes(spark, sf_dir)


@query(
    "anomaly_summary",
    sql(W, WD, _STATS, _IQR, _FOREST, _VOTE, "SELECT series, ds, y, score, CASE WHEN score > 0.8 THEN 'High' WHEN score > 0.5 THEN 'Medium' ELSE 'Low' END AS severity FROM vs WHERE is_anomaly"),
)
def anomaly_summary(spark, sf_dir):
    return _votes(spark, sf_dir).filter("is_anomaly").select("series", "ds", "y", "score", "severity")


@query(
    "review_advice",
    sql(W, WD, _STATS, _IQR, _FOREST, _VOTE, "n AS (SELECT series, count(*) FILTER (is_anomaly) AS n_anomalies FROM vs GROUP BY series)",
        """SELECT series, n_anomalies, CASE WHEN n_anomalies = 0 THEN 'no anomalies, quality looks good' WHEN n_anomalies <= 3 THEN 'few anomalies, review them by hand; look for events in those periods'
ELSE 'many anomalies, quality may be poor; verify the source; check entry errors; remove outliers or use robust models; look for external causes' END AS advice,
CASE WHEN n_anomalies > 5 THEN 'HIGH: many outliers; check entry errors and real events; use robust models' WHEN n_anomalies > 0 THEN 'MEDIUM: few outliers; review flagged points' ELSE 'data quality looks good' END AS improvements FROM n"""),
)
def review_advice(spark, sf_dir):
    n = _votes(spark, sf_dir).groupBy("series").agg(F.count_if("is_anomaly").alias("n_anomalies"))
    return n.withColumns(
        {
            "advice": F.array_join(quality.review_advice(F.col("n_anomalies")), "; "),
            "improvements": F.array_join(profile.quality_advice(F.lit(0.0), F.col("n_anomalies")), "; "),
        }
    )


def _decimals_sql(x: str, digits: int) -> str:
    n = f"CAST(floor({x} * {10**digits} + 0.5::DOUBLE) AS BIGINT)"
    return f"CAST({n} // {10**digits} AS VARCHAR) || '.' || lpad(CAST({n} % {10**digits} AS VARCHAR), {digits}, '0')"


_WHOLE = "format('{{:,}}', CAST(floor({} + 0.5::DOUBLE) AS BIGINT))"


@query(
    "anomaly_explain",
    sql(W, WD, _STATS, """ex AS (SELECT *, CASE WHEN sd > 0 THEN abs(y - m) / sd ELSE 0 END AS sg, CASE WHEN m <> 0 THEN abs((y - m) / m * 100) ELSE 0 END AS pc, CASE WHEN y > m THEN 'above' ELSE 'below' END AS direction,
CASE WHEN abs(y - m) / nullif(sd, 0) > 3 THEN 'High' WHEN abs(y - m) / nullif(sd, 0) > 2 THEN 'Medium' ELSE 'Low' END AS severity FROM stt)""",
        f"""SELECT series, ds, y, round(sg, 6) AS sigmas, round(pc, 6) AS pct_off, direction, severity, {_decimals_sql('sg', 2)} || ' standard deviations ' || direction || ' average: value ' || {_WHOLE.format('y')}
|| ', average ' || {_WHOLE.format('m')} || ', off by ' || {_decimals_sql('pc', 1)} || '%, severity ' || severity || '; a data entry error, a special event, a seasonal effect or a change of policy may be behind it' AS explanation FROM ex"""),
)
def anomaly_explain(spark, sf_dir):
    return quality.explain(fx.wide_dense(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("sigmas", "pct_off")})


@query(
    "price_quantiles",
    """SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS p05, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
quantile_cont(l_extendedprice, 0.75) AS q3, quantile_cont(l_extendedprice, 1.0) AS hi FROM lineitem GROUP BY 1""",
)
def price_quantiles(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return exact_quantiles(li, ["l_returnflag"], "l_extendedprice", {"p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "hi": 1.0})


@query(
    "value_outliers",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1)
SELECT event_type, event_id, value, q1 - 1.5 * (q3 - q1) AS fence_lo, q3 + 1.5 * (q3 - q1) AS fence_hi FROM events JOIN q USING (event_type)
WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
)
def value_outliers(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return quality.iqr_outliers(e, ["event_type"], "value")


# ---- drift ----

_DRIFT_FEATURES = {"discount": "l_discount", "price": "l_extendedprice", "qty": "l_quantity", "tax": "l_tax"}


def _drift_long(spark, sf_dir):
    """Line items before 1999 against the later ones, long by feature."""
    li = fx.table(spark, sf_dir, "lineitem")
    sample = (F.col("l_shipdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).cast("int").alias("sample")
    wide = li.select(sample, *[F.col(c).alias(n) for n, c in _DRIFT_FEATURES.items()])
    return wide.unpivot(["sample"], list(_DRIFT_FEATURES), "feature", "value")


_KS = (
    "lng AS (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST(l_shipdate >= TIMESTAMP '1999-01-01' AS INTEGER) AS sample, {c} AS value FROM lineitem" for n, c in _DRIFT_FEATURES.items()) + ")",
    "cnt AS (SELECT feature, value, count(*) FILTER (sample = 0) AS c0, count(*) FILTER (sample = 1) AS c1 FROM lng GROUP BY 1, 2)",
    """cdf AS (SELECT feature, sum(c0) OVER r / sum(c0) OVER f AS f0, sum(c1) OVER r / sum(c1) OVER f AS f1, sum(c0) OVER f AS n0, sum(c1) OVER f AS n1 FROM cnt
WINDOW r AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY feature))""",
    "ks AS (SELECT feature, max(abs(f0 - f1)) AS stat, CAST(min(n0) AS BIGINT) AS n0, CAST(min(n1) AS BIGINT) AS n1 FROM cdf GROUP BY feature)",
)
_KSP = (
    "lam AS (SELECT *, (sqrt(CAST(n0 AS DOUBLE) * n1 / (n0 + n1)) + 0.12 + 0.11 / sqrt(CAST(n0 AS DOUBLE) * n1 / (n0 + n1))) * stat AS l FROM ks)",
    """pv AS (SELECT feature, stat, n0, n1, CASE WHEN l < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(generate_series(1, 100), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END) * exp(-2.0::DOUBLE * j * j * l * l))))) END AS p_value FROM lam)""",
)


@query("drift_ks", sql(*_KS, "SELECT feature, round(stat, 12) AS stat, n0, n1 FROM ks"))
def drift_ks(spark, sf_dir):
    return drift.ks_statistic(_drift_long(spark, sf_dir)).withColumn("stat", F.round("stat", 12))


@query("drift_flags", sql(*_KS, *_KSP, "SELECT feature, round(stat, 12) AS stat, n0, n1, round(p_value, 9) AS p_value, p_value < 0.05 AS drift, max(p_value < 0.05) OVER () AS any_drift FROM pv"))
def drift_flags(spark, sf_dir):
    return drift.drift_report(_drift_long(spark, sf_dir)).withColumns({"p_value": F.round("p_value", 9), "stat": F.round("stat", 12)})


@query("drift_top", sql(*_KS, *_KSP, "SELECT feature, round(stat, 12) AS stat, round(p_value, 9) AS p_value FROM pv ORDER BY pv.p_value, pv.stat DESC, feature LIMIT 4"))
def drift_top(spark, sf_dir):
    top = drift.top_drifted(drift.drift_report(_drift_long(spark, sf_dir)))
    return top.select("feature", F.round("stat", 12).alias("stat"), F.round("p_value", 9).alias("p_value"))
