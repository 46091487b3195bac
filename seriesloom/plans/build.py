"""Building panels and calendars; joins and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import numeric as num
from ..operators import align, clean, features, report
from . import fixtures as fx
from .registry import query, sql


@query("panel_monthly", sql(fx.PANEL, "SELECT * FROM panel"))
def panel_monthly(spark, sf_dir):
    return fx.panel(spark, sf_dir)


@query("panel_wide_dense", sql(fx.WIDE, fx.WIDE_DENSE, "SELECT * FROM wdense"))
def panel_wide_dense(spark, sf_dir):
    return fx.wide_dense(spark, sf_dir)


@query(
    "densify_zero",
    sql(fx.WIDE, fx.WIDE_DENSE, "SELECT c.series, c.ds, coalesce(w.y, 0.0) AS y FROM wdense_cal c LEFT JOIN wide w ON w.series = c.series AND w.ds = c.ds"),
)
def densify_zero(spark, sf_dir):
    return clean.densify(fx.wide(spark, sf_dir), "zero")


@query("indicator_monthly", sql(fx.IND, "SELECT * FROM ind"))
def indicator_monthly(spark, sf_dir):
    return fx.indicators(spark, sf_dir)


@query("indicator_long", sql(fx.IND, fx.IND_LONG, "SELECT * FROM indl"))
def indicator_long(spark, sf_dir):
    return fx.indicators_long(spark, sf_dir)


_STEPS = """SELECT p.series, s.step, CAST(last_day(CAST(date_trunc('month', p.last) AS DATE) + to_months(CAST(s.step AS INTEGER))) AS DATE) AS ds
FROM (SELECT series, max(ds) AS last FROM panel GROUP BY series) p, (SELECT CAST(unnest(generate_series(1, 12)) AS BIGINT) AS step) s"""


@query("calendar_future", sql(fx.PANEL, _STEPS))
def calendar_future(spark, sf_dir):
    return align.future_calendar(fx.panel(spark, sf_dir), fx.HORIZON)


@query("calendar_future_global", sql(fx.PANEL, _STEPS.replace("SELECT series, max(ds) AS last FROM panel GROUP BY series", "SELECT DISTINCT series, (SELECT max(ds) FROM panel) AS last FROM panel")))
def calendar_future_global(spark, sf_dir):
    return align.future_calendar(fx.panel(spark, sf_dir), fx.HORIZON, align="global")


@query(
    "calendar_month_start",
    sql(fx.PANEL, """SELECT p.series, CAST(date_trunc('month', p.last) + to_months(CAST(s.step AS INTEGER)) AS DATE) AS ds
FROM (SELECT series, max(ds) AS last FROM panel GROUP BY series) p, (SELECT unnest(generate_series(1, 12)) AS step) s"""),
)
def calendar_month_start(spark, sf_dir):
    last = fx.panel(spark, sf_dir).groupBy("series").agg(F.max("ds").alias("last"))
    return last.select("series", F.explode(cal.month_starts_after(F.col("last"), 12)).alias("ds"))


@query(
    "resample_month_end",
    """SELECT event_type, CAST(last_day(ts) AS DATE) AS ds, arg_max(value, struct_pack(ts := ts, id := event_id)) AS value
FROM events GROUP BY 1, 2""",
)
def resample_month_end(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.groupBy("event_type", cal.month_end(F.col("ts")).alias("ds")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value")
    )


@query(
    "resample_daily_close",
    """SELECT event_type, CAST(ts AS DATE) AS ds, arg_max(value, struct_pack(ts := ts, id := event_id)) AS value
FROM events GROUP BY 1, 2""",
)
def resample_daily_close(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.groupBy("event_type", F.col("ts").cast("date").alias("ds")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value")
    )


@query(
    "load_metadata",
    sql(fx.PANEL, """SELECT count(*) AS rows, count(DISTINCT series) AS n_series, min(ds) AS first_ds, max(ds) AS last_ds,
strftime(max(ds), '%b %Y') AS data_until FROM panel"""),
)
def load_metadata(spark, sf_dir):
    return fx.panel(spark, sf_dir).agg(
        F.count("*").alias("rows"),
        F.count_distinct("series").alias("n_series"),
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.date_format(F.max("ds"), "MMM yyyy").alias("data_until"),
    )


@query(
    "fetch_window",
    sql(fx.PANEL, """SELECT coalesce(min(ds), DATE '2025-12-31' - INTERVAL 7 YEAR)::DATE AS start_ds, coalesce(max(ds), DATE '2025-12-31') AS end_ds FROM panel"""),
)
def fetch_window(spark, sf_dir):
    as_of = F.lit("2025-12-31").cast("date")
    return fx.panel(spark, sf_dir).agg(
        F.coalesce(F.min("ds"), F.add_months(as_of, -84)).alias("start_ds"), F.coalesce(F.max("ds"), as_of).alias("end_ds")
    )


@query("distinct_series", sql(fx.WIDE, "SELECT DISTINCT series FROM wide"))
def distinct_series(spark, sf_dir):
    return fx.wide(spark, sf_dir).select("series").distinct()


# ---- joins ----


@query("merge_indicators", sql(fx.PANEL, fx.IND, "SELECT panel.*, avg_discount, avg_tax, avg_qty, avg_price FROM panel LEFT JOIN ind USING (ds)"))
def merge_indicators(spark, sf_dir):
    return align.merge_indicators(fx.panel(spark, sf_dir), fx.indicators(spark, sf_dir))


_AHEAD = """ahead AS (SELECT series, ds, y FROM panel UNION ALL
SELECT p.series, CAST(last_day(CAST(date_trunc('month', p.last) AS DATE) + to_months(CAST(s.step AS INTEGER))) AS DATE) AS ds, NULL AS y
FROM (SELECT series, max(ds) AS last FROM panel GROUP BY series) p, (SELECT unnest(generate_series(1, 12)) AS step) s)"""


@query(
    "merge_indicators_filled",
    sql(fx.PANEL, fx.IND, _AHEAD, "m AS (SELECT ahead.*, avg_qty, avg_price FROM ahead LEFT JOIN ind USING (ds))", """SELECT series, ds, y, """ + ", ".join(
        f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
first_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""
        for c in ("avg_qty", "avg_price")
    ) + " FROM m"),
)
def merge_indicators_filled(spark, sf_dir):
    # history plus a year ahead: the indicators end before it, so the fill has work to do
    panel = fx.panel(spark, sf_dir)
    ahead = panel.unionByName(align.future_calendar(panel, fx.HORIZON).drop("step"), allowMissingColumns=True)
    return align.merge_indicators(ahead, fx.indicators(spark, sf_dir).select("ds", "avg_qty", "avg_price"), fill=True)


@query(
    "annual_lookup",
    sql(fx.IND, fx.ANNUAL, """mon AS (SELECT ds FROM ind UNION ALL
SELECT CAST(last_day(date_trunc('month', l.ds) + to_months(CAST(s.step AS INTEGER))) AS DATE) FROM (SELECT max(ds) AS ds FROM ind) l, (SELECT unnest(generate_series(1, 24)) AS step) s)""",
        """SELECT mon.ds, coalesce(a.value, (SELECT arg_max(value, year) FROM annual), 5.0) AS order_value FROM mon LEFT JOIN annual a ON a.year = year(mon.ds)"""),
)
def annual_lookup(spark, sf_dir):
    # two years ahead have no annual figure yet: they take the last available year
    ind = fx.indicators(spark, sf_dir)
    months = ind.select("ds").union(align.repeat_last(ind, 24).select("ds"))
    return align.annual_to_monthly(months, fx.annual(spark, sf_dir), 5.0, "order_value")


@query(
    "asof_indicator",
    """WITH o AS (SELECT DISTINCT last_day(o_orderdate)::TIMESTAMP AS ts, o_orderpriority FROM orders),
p AS (SELECT l_shipdate AS ts, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (CAST(100 AS DOUBLE) * count(*)) AS price
      FROM lineitem GROUP BY 1)
SELECT o.ts::DATE AS ds, o.o_orderpriority AS priority, coalesce(p.price, 4.0) AS price FROM o ASOF LEFT JOIN p ON o.ts >= p.ts""",
)
def asof_indicator(spark, sf_dir):
    left = (
        fx.table(spark, sf_dir, "orders")
        .select(cal.month_end(F.col("o_orderdate")).alias("ds"), F.col("o_orderpriority").alias("priority"))
        .distinct()
    )
    daily = (
        fx.table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("ds"))
        .agg((num.sum_minor(F.col("l_extendedprice")).cast("double") / (F.lit(100.0) * F.count("*"))).alias("price"))
    )
    return align.asof_backward(left, daily, "ds", "price", default=4.0)


@query(
    "asof_by_key",
    """WITH e AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'purchase'),
p AS (SELECT user_id, ts, max(value) AS last_view FROM events WHERE event_type = 'view' GROUP BY 1, 2)
SELECT e.user_id, e.event_id, e.ts, e.value, p.last_view FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""",
)
def asof_by_key(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    left = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts", "value")
    right = e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("last_view"))
    return align.asof_backward(left, right, "ts", "last_view", by=["user_id"])


_HOLIDAYS = fx.literal_sql("hol", fx.HOLIDAY_COLUMNS, fx.HOLIDAYS)


@query(
    "holiday_flags",
    sql(fx.PANEL, _HOLIDAYS, """SELECT p.*, """ + ", ".join(
        f"CAST(EXISTS (SELECT 1 FROM hol WHERE hol.year = year(p.ds) AND hol.month = month(p.ds) AND flag = '{f}') AS BIGINT) AS {f}"
        for f in ("is_eid", "is_christmas")
    ) + " FROM panel p"),
)
def holiday_flags(spark, sf_dir):
    hol = fx.literal_table(spark, fx.HOLIDAY_COLUMNS, fx.HOLIDAYS)
    return align.holiday_flags(fx.panel(spark, sf_dir), hol, ["is_eid", "is_christmas"])


_FIXES = (("BUILDING", "1996-03-31", 1000.0), ("MACHINERY", "1999-12-31", 2000.0), ("NOBODY", "1999-12-31", 3000.0))


@query(
    "override_values",
    sql(fx.PANEL, fx.literal_sql("fix", ("series", "ds", "new_value"), _FIXES),
        "SELECT p.series, p.ds, coalesce(f.new_value, p.y) AS y FROM panel p LEFT JOIN fix f ON f.series = p.series AND CAST(f.ds AS DATE) = p.ds"),
)
def override_values(spark, sf_dir):
    fixes = fx.literal_table(spark, ("series", "ds", "new_value"), _FIXES).withColumn("ds", F.col("ds").cast("date"))
    return clean.override(fx.panel(spark, sf_dir), fixes, ["series", "ds"], "y")


@query(
    "bau_repeat",
    sql(fx.IND, """SELECT CAST(last_day(date_trunc('month', l.ds) + to_months(CAST(s.step AS INTEGER))) AS DATE) AS ds, avg_discount, avg_tax, avg_qty, avg_price
FROM (SELECT * FROM ind ORDER BY ds DESC LIMIT 1) l, (SELECT unnest(generate_series(1, 12)) AS step) s"""),
)
def bau_repeat(spark, sf_dir):
    return align.repeat_last(fx.indicators(spark, sf_dir), fx.HORIZON)


@query(
    "pivot_with_indicators",
    sql(fx.PANEL, fx.IND, """SELECT d.ds, s.series, c.total, avg_discount, avg_tax, avg_qty, avg_price FROM (SELECT DISTINCT ds FROM panel) d CROSS JOIN (SELECT DISTINCT series FROM panel) s
JOIN ind ON ind.ds = d.ds LEFT JOIN (SELECT ds, series, sum(y) AS total FROM panel GROUP BY 1, 2) c ON c.ds = d.ds AND c.series = s.series"""),
)
def pivot_with_indicators(spark, sf_dir):
    pivot = report.pivot_series(fx.panel(spark, sf_dir)).withColumnRenamed("row", "ds")
    merged = align.merge_indicators(pivot, fx.indicators(spark, sf_dir), how="inner")
    return report.long_cells(merged.withColumnRenamed("ds", "row"), "ds", "series", "total")


_MONTH_SIDE = "SELECT CAST(last_day(o_orderdate) AS DATE) AS ds, o_orderpriority, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS v FROM orders WHERE {} GROUP BY 1, 2"


@query(
    "ab_full_join",
    f"""SELECT coalesce(a.ds, b.ds) AS ds, coalesce(a.o_orderpriority, b.o_orderpriority) AS o_orderpriority, a.v AS side_a, b.v AS side_b, b.v - a.v AS delta, (b.v - a.v) / a.v * 100 AS delta_pct
FROM ({_MONTH_SIDE.format("o_orderstatus = 'P'")}) a
FULL JOIN ({_MONTH_SIDE.format("o_orderstatus <> 'P'")}) b ON a.o_orderpriority = b.o_orderpriority AND a.ds = b.ds""",
)
def ab_full_join(spark, sf_dir):
    """Pending orders against all others, by month and priority; a month may have either side only."""
    o = fx.table(spark, sf_dir, "orders")
    grain = [cal.month_end(F.col("o_orderdate")).alias("ds"), "o_orderpriority"]
    side = lambda cond: o.filter(cond).groupBy(*grain).agg((num.sum_minor(F.col("o_totalprice")).cast("double") / 100.0).alias("v"))
    return align.full_outer_delta(side("o_orderstatus = 'P'"), side("o_orderstatus <> 'P'"), ["ds", "o_orderpriority"], "v", ("side_a", "side_b"))


@query(
    "calendar_assembly",
    """WITH o AS (SELECT CAST(last_day(o_orderdate) AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS orders_n FROM orders GROUP BY 1),
l AS (SELECT CAST(last_day(l_shipdate) AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS lines_n FROM lineitem GROUP BY 1),
e AS (SELECT CAST(last_day(ts) AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS events_n FROM events GROUP BY 1),
b AS (SELECT min(ds) AS lo, max(ds) AS hi FROM (SELECT ds FROM o UNION SELECT ds FROM l UNION SELECT ds FROM e)),
c AS (SELECT CAST(last_day(unnest(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH))) AS DATE) AS ds FROM b)
SELECT c.ds, orders_n, lines_n, events_n FROM c LEFT JOIN o USING (ds) LEFT JOIN l USING (ds) LEFT JOIN e USING (ds)""",
)
def calendar_assembly(spark, sf_dir):
    def monthly(name, col):
        return fx.table(spark, sf_dir, name).groupBy(cal.month_end(F.col(col)).alias("ds")).agg(F.count("*").cast("double").alias("value"))

    return align.calendar_assembly(
        {"orders_n": monthly("orders", "o_orderdate"), "lines_n": monthly("lineitem", "l_shipdate"), "events_n": monthly("events", "ts")}
    )


@query(
    "multi_series_select",
    sql(fx.WIDE, """SELECT w.* FROM wide w WHERE split_part(series, '/', 1) IN ('BUILDING', 'MACHINERY')
AND series IN (SELECT series FROM wide GROUP BY series HAVING sum(y) > (SELECT avg(t) FROM (SELECT sum(y) AS t FROM wide GROUP BY series)))"""),
)
def multi_series_select(spark, sf_dir):
    w = fx.wide(spark, sf_dir)
    sums = w.groupBy("series").agg(F.sum("y").alias("t"))
    large = sums.filter(F.col("t") > sums.agg(F.avg("t")).scalar())
    picked = align.isin_or_semi(w.withColumn("segment", F.split_part("series", F.lit("/"), F.lit(1))), "segment", ["BUILDING", "MACHINERY"])
    return align.isin_or_semi(picked, "series", large).select("series", "ds", "y")


# ---- features ----


@query(
    "lag_features",
    sql(fx.WIDE, fx.WIDE_DENSE, "SELECT *, " + ", ".join(f"lag(y, {i}) OVER w AS lag_{i}" for i in (1, 2, 3)) + " FROM wdense WINDOW w AS (PARTITION BY series ORDER BY ds)"),
)
def lag_features(spark, sf_dir):
    return features.lag_features(fx.wide_dense(spark, sf_dir))


_ROLL = "PARTITION BY series ORDER BY ds ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING"


def _roll_sql(expr: str) -> str:
    return f"CASE WHEN count(y) OVER w3 = 3 THEN {expr} END"


@query(
    "rolling_features",
    sql(fx.WIDE, fx.WIDE_DENSE, f"""SELECT series, ds, y, {_roll_sql('avg(y) OVER w3')} AS rolling_mean_3, round({_roll_sql('stddev_samp(y) OVER w3')}, 3) AS rolling_std_3,
{_roll_sql('min(y) OVER w3')} AS rolling_min_3, {_roll_sql('max(y) OVER w3')} AS rolling_max_3 FROM wdense WINDOW w3 AS ({_ROLL})"""),
)
def rolling_features(spark, sf_dir):
    out = features.rolling_features(fx.wide_dense(spark, sf_dir))
    return out.withColumn("rolling_std_3", F.round("rolling_std_3", 3))


_TIME_SQL = """CAST(month(ds) AS BIGINT) AS month, CAST(year(ds) AS BIGINT) AS year, CAST(quarter(ds) AS BIGINT) AS quarter"""
_LONG_TIME_SQL = _TIME_SQL + """, CAST(dayofyear(ds) AS BIGINT) AS day_of_year,
round(sin(6.283185307179586::DOUBLE * month(ds) / 12), 9) AS month_sin, round(cos(6.283185307179586::DOUBLE * month(ds) / 12), 9) AS month_cos"""


@query("time_features", sql(fx.PANEL, f"SELECT series, ds, y, {_LONG_TIME_SQL} FROM panel"))
def time_features(spark, sf_dir):
    out = features.time_features(fx.panel(spark, sf_dir))
    return out.withColumns({c: F.round(c, 9) for c in ("month_sin", "month_cos")})


ML = f"""ml AS (SELECT * FROM (SELECT series, ds, y, {_TIME_SQL}, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 3) OVER w AS lag_3,
{_roll_sql('avg(y) OVER w3')} AS rolling_mean_3 FROM wdense WINDOW w AS (PARTITION BY series ORDER BY ds), w3 AS ({_ROLL})) WHERE lag_3 IS NOT NULL)"""


@query("ml_features", sql(fx.WIDE, fx.WIDE_DENSE, ML, "SELECT * FROM ml"))
def ml_features(spark, sf_dir):
    return features.ml_features(fx.wide_dense(spark, sf_dir))


@query(
    "ml_features_long",
    sql(fx.WIDE, fx.WIDE_DENSE, f"""SELECT * FROM (SELECT series, ds, y, {_LONG_TIME_SQL}, lag(y, 1) OVER w AS lag_1, lag(y, 2) OVER w AS lag_2, lag(y, 3) OVER w AS lag_3,
{_roll_sql('avg(y) OVER w3')} AS rolling_mean_3, round({_roll_sql('stddev_samp(y) OVER w3')}, 3) AS rolling_std_3, {_roll_sql('min(y) OVER w3')} AS rolling_min_3,
{_roll_sql('max(y) OVER w3')} AS rolling_max_3 FROM wdense WINDOW w AS (PARTITION BY series ORDER BY ds), w3 AS ({_ROLL})) WHERE lag_3 IS NOT NULL"""),
)
def ml_features_long(spark, sf_dir):
    out = features.ml_features(fx.wide_dense(spark, sf_dir), long_form=True)
    return out.withColumns({**{c: F.round(c, 9) for c in ("month_sin", "month_cos")}, "rolling_std_3": F.round("rolling_std_3", 3)})


_SPLIT = "CASE WHEN row_number() OVER (PARTITION BY series ORDER BY ds DESC) <= 12 THEN 'test' ELSE 'train' END AS part"


@query("holdout_split", sql(fx.WIDE, fx.WIDE_DENSE, f"SELECT *, {_SPLIT} FROM wdense"))
def holdout_split(spark, sf_dir):
    return features.holdout_split(fx.wide_dense(spark, sf_dir))


def _z_sql(c: str) -> str:
    m = f"avg({c}) FILTER (part = 'train') OVER s"
    d = f"stddev_pop({c}) FILTER (part = 'train') OVER s"
    return f"round(CASE WHEN {d} > 0 THEN ({c} - {m}) / {d} ELSE {c} - {m} END, 6) AS {c}_z"


@query(
    "standardized_features",
    sql(fx.WIDE, fx.WIDE_DENSE, ML, f"sp AS (SELECT *, {_SPLIT} FROM ml)",
        f"SELECT series, ds, part, {_z_sql('lag_1')}, {_z_sql('rolling_mean_3')} FROM sp WINDOW s AS (PARTITION BY series)"),
)
def standardized_features(spark, sf_dir):
    ml = features.holdout_split(features.ml_features(fx.wide_dense(spark, sf_dir)))
    out = features.standardize(ml, ["lag_1", "rolling_mean_3"])
    return out.select("series", "ds", "part", *[F.round(f"{c}_z", 6).alias(f"{c}_z") for c in ("lag_1", "rolling_mean_3")])


@query(
    "align_columns",
    sql(fx.PANEL, fx.IND, "SELECT series, ds, coalesce(avg_price, 0.0) AS avg_price, 0.0::DOUBLE AS is_eid, coalesce(avg_qty, 0.0) AS avg_qty FROM panel LEFT JOIN ind USING (ds)"),
)
def align_columns(spark, sf_dir):
    merged = align.merge_indicators(fx.panel(spark, sf_dir), fx.indicators(spark, sf_dir))
    return num.align_columns(merged, ["avg_price", "is_eid", "avg_qty"], keep=["series", "ds"])


@query(
    "source_fallbacks",
    sql(fx.IND, """SELECT ds, CASE WHEN year(ds) < 1998 THEN avg_qty END AS primary_rate,
coalesce(CASE WHEN year(ds) < 1998 THEN avg_qty END, avg_tax + 2.45::DOUBLE) AS rate, 80.0::DOUBLE AS oil,
CASE WHEN year(ds) <= 1997 THEN 3.5::DOUBLE WHEN year(ds) = 1998 THEN 4.75::DOUBLE WHEN year(ds) = 1999 THEN 5.75::DOUBLE ELSE 6.0::DOUBLE END AS policy_rate,
50.5::DOUBLE + (avg_qty - 25.0::DOUBLE) AS activity FROM ind"""),
)
def source_fallbacks(spark, sf_dir):
    ind = fx.indicators(spark, sf_dir)
    primary = F.when(F.year("ds") < 1998, F.col("avg_qty"))
    policy = cal.step_by_year(F.col("ds"), {1998: 4.75, 1999: 5.75}, 6.0)
    out = ind.withColumns(
        {
            "primary_rate": primary,
            "rate": F.coalesce(primary, F.col("avg_tax") + 2.45),
            "policy_rate": F.when(F.year("ds") <= 1997, 3.5).otherwise(policy),
            "activity": 50.5 + (F.col("avg_qty") - 25.0),
        }
    )
    # a source that delivered nothing is replaced by its constant
    return num.conform(out, {"oil": 80.0}, keep=["ds", "primary_rate", "rate", "policy_rate", "activity"])


@query(
    "length_gate",
    sql(fx.WIDE, """SELECT series, count(*) AS n, CASE WHEN count(*) < 12 THEN 'too few rows' WHEN count(*) - 3 < 5 THEN 'too few feature rows'
WHEN count(*) - 15 < 1 THEN 'no training rows left' ELSE 'ok' END AS reason FROM wide GROUP BY series"""),
)
def length_gate(spark, sf_dir):
    return features.length_gate(fx.wide(spark, sf_dir))


@query(
    "period_labels",
    sql(fx.PANEL, """SELECT series AS label, strftime(ds, '%d/%m/%Y') AS day_first, strftime(ds, '%Y-%m') AS period, strftime(ds, '%b') AS mon,
strftime(ds, '%B %Y') AS month_name, CAST(date_diff('day', DATE '1995-01-31', ds) AS BIGINT) AS days, CAST(floor(date_diff('day', DATE '1995-01-31', ds) / 30) + 1 AS BIGINT) AS horizon FROM panel"""),
)
def period_labels(spark, sf_dir):
    start = F.lit("1995-01-31").cast("date")
    ds = F.col("ds")
    return fx.panel(spark, sf_dir).select(
        F.col("series").alias("label"),
        F.date_format(ds, "dd/MM/yyyy").alias("day_first"),
        F.date_format(ds, "yyyy-MM").alias("period"),
        F.date_format(ds, "MMM").alias("mon"),
        F.date_format(ds, "MMMM yyyy").alias("month_name"),
        F.datediff(ds, start).cast("bigint").alias("days"),
        cal.horizon_months(start, ds).alias("horizon"),
    )


@query("rounded_indicators", sql(fx.IND, "SELECT ds, round(avg_discount, 2) AS avg_discount, round(avg_tax, 2) AS avg_tax, round(avg_qty, 2) AS avg_qty, round(avg_price, 2) AS avg_price FROM ind"))
def rounded_indicators(spark, sf_dir):
    return num.round_numeric(fx.indicators(spark, sf_dir), 2)


@query("calendar_udtf", sql(fx.PANEL, _STEPS.replace("s.step, CAST", "CAST(s.step AS INTEGER) AS step, CAST")))
def calendar_udtf(spark, sf_dir):
    """The same calendar through the SQL table function."""
    cal.register_month_ends(spark)
    last = fx.panel(spark, sf_dir).groupBy("series").agg(F.max("ds").alias("last"))
    return spark.sql("SELECT p.series, m.step, m.ds FROM {last} p, LATERAL month_ends(p.last, 12) m", last=last)
