"""Parsing of landed text, headlines and insights, snapshots, exports, streams, isolation forest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.calendar import parse_day_first
from ..functions.numeric import minor_units, sum_minor
from ..operators import forest, insight, report
from ..operators.quality import Rule
from ..session import shared_dir
from ..sources import files, store
from ..streaming import refresh as stream
from . import fixtures as fx
from .reporting import NAIVE, naive_forecast
from .registry import query, sql


# ---- landed text ----


@query(
    "history_from_csv",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS ds, o_orderstatus AS series, o_totalprice AS y FROM orders""",
)
def history_from_csv(spark, sf_dir):
    """Orders written as day-first CSV lines, some with an invalid date, and parsed again."""
    o = fx.table(spark, sf_dir, "orders")
    day = F.when(F.col("o_orderpriority") == "5-LOW", F.date_format("o_orderdate", "'99'/MM/yyyy")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    line = F.to_csv(F.struct(day.alias("ds"), F.col("o_orderstatus").alias("series"), F.col("o_totalprice").alias("y")))
    parsed = o.select("o_orderkey", F.from_csv(line, "ds string, series string, y double").alias("r"))
    return parsed.select("o_orderkey", parse_day_first(F.col("r.ds")).alias("ds"), "r.series", "r.y")


def annual_payloads(spark, sf_dir):
    """Yearly sums wrapped as `[meta, [ {date, value} ]]`, one text for each priority; a year without open orders has a null value."""
    y = (
        fx.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("indicator"), F.year("o_orderdate").cast("string").alias("date"))
        .agg(
            F.when(F.count_if(F.col("o_orderstatus") == "P") > 0, sum_minor(F.col("o_totalprice")).cast("double") / 100.0).alias("value")
        )
    )
    body = F.to_json(F.sort_array(F.collect_list(F.struct("date", "value"))), {"ignoreNullFields": "false"})
    return y.groupBy("indicator").agg(F.concat(F.lit('[{"page":1},'), body, F.lit("]")).alias("payload"))


@query(
    "annual_from_json",
    """SELECT o_orderpriority AS indicator, CAST(year(o_orderdate) AS BIGINT) AS year, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 AS value
FROM orders GROUP BY 1, 2 HAVING count(*) FILTER (o_orderstatus = 'P') > 0""",
)
def annual_from_json(spark, sf_dir):
    return files.parse_annual(annual_payloads(spark, sf_dir))


@query(
    "feed_items",
    """SELECT doc_id, source, coalesce(nullif(regexp_replace(left(text, 60), '[^A-Za-z]', '', 'g'), ''), 'No Title') AS title, CASE WHEN lang = 'fr' THEN '#' ELSE 'https://example.org/' || doc_id END AS link,
CASE WHEN lang = 'es' THEN '' ELSE '05 Aug 10:0' || (doc_id % 10) END AS published FROM documents""",
)
def feed_items(spark, sf_dir):
    """Feed items as XML text, titled by the letters a text starts with, with missing parts; parsed back with defaults."""
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.regexp_replace(F.left("text", F.lit(60)), "[^A-Za-z]", "").alias("letters"))
    tag = lambda name, keep, body: F.when(keep, F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))).otherwise(F.lit(""))
    day = F.concat(F.lit("Mon, 05 Aug 2024 10:0"), (F.col("doc_id") % 10).cast("string"), F.lit(":30 GMT"))
    xml = F.concat(
        F.lit("<item>"),
        tag("title", F.col("letters") != "", F.col("letters")),
        tag("link", F.col("lang") != "fr", F.concat(F.lit("https://example.org/"), "doc_id")),
        tag("pubDate", F.col("lang") != "es", day),
        F.lit("</item>"),
    )
    return files.parse_feed_column(d.select("doc_id", "source", xml.alias("xml")), "xml")


@query(
    "bold_text",
    r"""SELECT item_id, regexp_replace('**' || item_id || '** ' || text || ' **end**', '\*\*(.+?)\*\*', '<b>\1</b>', 'g') AS html FROM benchmark""",
)
def bold_text(spark, sf_dir):
    b = fx.table(spark, sf_dir, "benchmark")
    marked = F.concat(F.lit("**"), F.col("item_id").cast("string"), F.lit("** "), F.col("text"), F.lit(" **end**"))
    return b.select("item_id", tx.bold_to_tag(marked).alias("html"))


# ---- headlines ----

_RANKED = "rk AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)"


@query("headline_round_robin", sql(_RANKED, "SELECT doc_id, source, lang, rank FROM rk WHERE rank <= 3 ORDER BY rank, source LIMIT 140"))
def headline_round_robin(spark, sf_dir):
    return insight.round_robin(fx.headlines(spark, sf_dir), ["doc_id"]).select("doc_id", "source", "lang", "rank")


@query("headline_category", sql(_RANKED, "SELECT doc_id, source, lang, rank FROM rk WHERE coalesce(nullif(lang, 'fr'), 'en') LIKE '%en%' AND rank <= 3 ORDER BY rank, source LIMIT 30"))
def headline_category(spark, sf_dir):
    """Items of one category; a missing category counts as the default one."""
    items = insight.round_robin(fx.headlines(spark, sf_dir), ["doc_id"], limit=None)
    tagged = items.withColumn("category", F.nullif("lang", F.lit("fr")))
    return insight.by_category(tagged, "category", "en", "en").select("doc_id", "source", "lang", "rank")


def _words_sql(words) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("headline_signals", f"SELECT doc_id, {_words_sql(insight.RISK_WORDS)} AS is_risk, {_words_sql(insight.OPPORTUNITY_WORDS)} AS is_opportunity FROM documents")
def headline_signals(spark, sf_dir):
    return insight.headline_signals(fx.headlines(spark, sf_dir)).select("doc_id", "is_risk", "is_opportunity")


# fixed values: thresholds on the latest monthly averages
_LEVEL_COLUMNS = ("indicator", "side", "lim", "kind", "message")
_LEVEL_RULES = (
    ("avg_price", "above", 50000.0, "opportunity", "prices are high"),
    ("avg_price", "below", 20000.0, "risk", "prices are low"),
    ("avg_qty", "above", 20.0, "opportunity", "volumes are high"),
    ("avg_discount", "above", 0.01, "risk", "discounts are high"),
)


@query(
    "insight_rows",
    sql(fx.PANEL, fx.TOTALS, fx.IND, fx.IND_LONG, fx.literal_sql("lr", _LEVEL_COLUMNS, _LEVEL_RULES), _RANKED,
        "top3 AS (SELECT d.text FROM rk JOIN documents d ON d.doc_id = rk.doc_id WHERE rk.rank <= 3 ORDER BY rk.rank, rk.source LIMIT 3)",
        f"""SELECT 'summary' AS kind, 'projected total ' || format('{{:,}}', CAST(sum(total) AS BIGINT)) || ', run rate ' || format('{{:,}}', CAST(round_even(avg(total), 0) AS BIGINT)) || ' a month' AS message FROM totals
UNION ALL (SELECT 'summary', 'peak in ' || strftime(ds, '%B %Y') || ' with ' || format('{{:,}}', CAST(total AS BIGINT)) FROM totals ORDER BY total DESC, ds LIMIT 1)
UNION ALL SELECT kind, message || ' (' || indl.indicator || ')' FROM indl JOIN lr USING (indicator) WHERE ds = (SELECT max(ds) FROM ind) AND CASE side WHEN 'above' THEN value > lim ELSE value < lim END
UNION ALL SELECT 'risk', 'headlines are cautious' FROM top3 HAVING bool_or({_words_sql(insight.RISK_WORDS)})
UNION ALL SELECT 'opportunity', 'headlines point to growth' FROM top3 HAVING bool_or({_words_sql(insight.OPPORTUNITY_WORDS)})"""),
)
def insight_rows(spark, sf_dir):
    totals = fx.period_totals(fx.panel(spark, sf_dir))
    levels = report.last_row_levels(fx.indicators(spark, sf_dir), fx.INDICATORS)
    rules = fx.literal_table(spark, _LEVEL_COLUMNS, _LEVEL_RULES)
    first = insight.round_robin(fx.headlines(spark, sf_dir), ["doc_id"], limit=3)
    return insight.summary_insights(totals).unionByName(insight.level_insights(levels, rules)).unionByName(insight.headline_insights(first))


# ---- isolation forest ----


@query("iso_forest")
def iso_forest(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem").withColumn("line_id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return forest.anomaly_forest(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "line_id", 0.1, trees=50)


# ---- corrections, snapshots, exports ----

_FIX_COLUMNS = ("c_custkey", "column", "new_value")
_FIX_ROWS = ((1, "c_acctbal", 100.0), (2, "c_acctbal", 200.0), (3, "c_nationkey", 7.0))


@query(
    "point_corrections",
    sql(fx.literal_sql("fx_", ("c_custkey", "col", "new_value"), _FIX_ROWS),
        """SELECT c.c_custkey, coalesce((SELECT max(new_value) FROM fx_ f WHERE f.c_custkey = c.c_custkey AND col = 'c_acctbal'), c_acctbal) AS c_acctbal,
coalesce((SELECT max(new_value) FROM fx_ f WHERE f.c_custkey = c.c_custkey AND col = 'c_nationkey'), c_nationkey) AS c_nationkey FROM customer c"""),
)
def point_corrections(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    fixes = fx.literal_table(spark, ("c_custkey", "`column`", "new_value"), _FIX_ROWS)
    return store.apply_corrections(c, fixes, ["c_custkey"], ["c_acctbal", "c_nationkey"])


@query("snapshot_roundtrip", sql(fx.PANEL, "SELECT * FROM panel"))
def snapshot_roundtrip(spark, sf_dir):
    """Save two snapshots, load the first by id, restore it as the active table."""
    root, p = shared_dir(spark, "snapshots"), fx.panel(spark, sf_dir)
    sid = store.save_snapshot(p, f"{root}/history", "20240101_000000", "first load")
    store.save_snapshot(p.withColumn("y", F.col("y") * 2), f"{root}/history", "20240102_000000", "doubled")
    return store.restore_snapshot(spark, f"{root}/history", sid, f"{root}/active")


@query(
    "snapshot_list",
    sql(fx.PANEL, fx.IND, """SELECT '20240102_000000_indicators' AS snapshot_id, 'indicators' AS description, (SELECT count(*) FROM ind) AS rows
UNION ALL SELECT '20240101_000000_first_load', 'first load', (SELECT count(*) FROM panel) UNION ALL SELECT '20240103_000000_nothing', 'nothing', 0"""),
)
def snapshot_list(spark, sf_dir):
    """Three tables of different shape saved under one root, the last without rows, and listed."""
    root, p = shared_dir(spark, "snapshots"), fx.panel(spark, sf_dir)
    store.save_snapshot(p, root, "20240101_000000", "first load")
    store.save_snapshot(fx.indicators(spark, sf_dir), root, "20240102_000000", "indicators")
    store.save_snapshot(p.limit(0), root, "20240103_000000", "nothing")
    return store.list_snapshots(spark, root).select("snapshot_id", "description", "rows")


@query(
    "export_roundtrip",
    sql(fx.PANEL, NAIVE, """SELECT 'Realisasi' AS part, series, count(*) AS n, sum(y) AS total FROM panel GROUP BY series
UNION ALL SELECT 'Forecast', series, count(*), sum(y) FROM fc GROUP BY series UNION ALL SELECT 'summary', series, 1, sum(y) FROM panel GROUP BY series"""),
)
def export_roundtrip(spark, sf_dir):
    """History, forecast and summary exported in parts; all of them are read back."""
    root, p = shared_dir(spark, "export"), fx.panel(spark, sf_dir)
    combined = report.combine(p, report.with_bounds(naive_forecast(p)))
    store.export_parts(root, combined, {"summary": report.totals(p, ["series"])})
    back = spark.read.parquet(f"{root}/forecast").groupBy(F.col("kind").alias("part"), F.col("series").cast("string").alias("series"))
    summary = spark.read.parquet(f"{root}/summary").select(F.lit("summary").alias("part"), "series", F.lit(1).cast("bigint").alias("n"), "total")
    return back.agg(F.count("*").alias("n"), F.sum("y").alias("total")).unionByName(summary)


@query("csv_roundtrip", sql(fx.PANEL, "SELECT * FROM panel"))
def csv_roundtrip(spark, sf_dir):
    root, p = shared_dir(spark, "csv"), fx.panel(spark, sf_dir)
    lines = p.select(F.date_format("ds", "dd/MM/yyyy").alias("ds"), "series", "y")
    return files.read_history(spark, store.export_csv(lines, root, "20240101"))


# ---- streams ----


def _events_stream(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    return stream.landed_stream(spark, sf_dir, schema, "parquet", pathGlobFilter="events.parquet")


@query(
    "stream_daily",
    """WITH d AS (SELECT CAST(ts AS DATE) AS ds, event_type, sum(CAST(round(value * 100) AS BIGINT)) AS cents, count(*) AS n FROM events GROUP BY 1, 2)
SELECT ds, event_type, CAST(cents AS BIGINT) AS total, n FROM d WHERE CAST(ds + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def stream_daily(spark, sf_dir):
    """Daily totals in cents; the days still open under the watermark are not emitted."""
    root = shared_dir(spark, "daily")
    events = _events_stream(spark, sf_dir).withColumn("cents", minor_units(F.col("value")))
    return stream.run_to_table(stream.daily_totals(events, "cents", by=["event_type"]), f"{root}/out", f"{root}/state")


@query(
    "stream_monthly",
    """WITH d AS (SELECT CAST(ts AS DATE) AS ds, sum(CAST(round(value * 100) AS BIGINT)) AS cents, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(last_day(ds) AS DATE) AS ds, CAST(sum(cents) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS n FROM d WHERE CAST(ds + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1""",
)
def stream_monthly(spark, sf_dir):
    root = shared_dir(spark, "monthly")
    events = _events_stream(spark, sf_dir).withColumn("cents", minor_units(F.col("value")))
    daily = stream.run_to_table(stream.daily_totals(events, "cents"), f"{root}/out", f"{root}/state")
    return stream.monthly_from_daily(daily)


@query(
    "incremental_refresh",
    """SELECT event_type, count(*) AS n, count(*) FILTER (value < 0.5 OR value > 200) AS bad FROM events GROUP BY 1""",
)
def incremental_refresh(spark, sf_dir):
    """Landed events checked by rule and appended; accepted and rejected rows counted afterwards."""
    root = shared_dir(spark, "refresh")
    stream.refresh(_events_stream(spark, sf_dir), [Rule("value", 0.5, 200.0)], root, f"{root}/state")
    ok = spark.read.parquet(f"{root}/accepted").select("event_type", F.lit(0).alias("b"))
    bad = spark.read.parquet(f"{root}/rejected").select("event_type", F.lit(1).alias("b"))
    return ok.unionByName(bad).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("b").cast("bigint").alias("bad"))


_SCORED = (
    ("avg_discount", 0.048, 0.052), ("avg_tax", 0.038, 0.042), ("avg_qty", 24.5, 26.5), ("avg_price", 40000.0, 60000.0),
)


@query(
    "stream_scores",
    sql(fx.IND, fx.IND_LONG, "lv AS (SELECT indicator, ds, CASE WHEN month(ds) = 2 THEN NULL ELSE value END AS value FROM indl)", fx.literal_sql("sr", ("indicator", "lo", "hi"), _SCORED),
        """st AS (SELECT lv.indicator, count(*) AS rows, count(*) FILTER (value IS NULL) AS missing, count(*) FILTER (value < lo OR value > hi) AS outliers, max(ds) AS last_ds FROM lv JOIN sr ON sr.indicator = lv.indicator GROUP BY 1)""",
        """sc AS (SELECT greatest(0.0::DOUBLE, round(100.0::DOUBLE - least(sum(missing) * 100.0::DOUBLE / sum(rows) * 2, 40) - least(sum(outliers) * 100.0::DOUBLE / sum(rows) * 5, 40)
- CASE WHEN date_diff('day', max(last_ds), DATE '2001-12-15') > 90 THEN 20 WHEN date_diff('day', max(last_ds), DATE '2001-12-15') > 35 THEN 5 ELSE 0 END, 1)) AS score FROM st)""",
        "SELECT st.*, score FROM st, sc"),
)
def stream_scores(spark, sf_dir):
    """Indicators landed in three files, years out of order, taken one file a batch: the last batch's state and score."""
    root = shared_dir(spark, "scores")
    long = fx.indicators_long(spark, sf_dir).withColumn("value", F.when(F.month("ds") != 2, F.col("value")))
    for part in (2, 0, 1):
        long.where(F.year("ds") % 3 == part).coalesce(1).write.mode("append").parquet(f"{root}/landed")
    source = stream.landed_stream(spark, f"{root}/landed", long.schema, "parquet", maxFilesPerTrigger=1)
    rules = [Rule(*r) for r in _SCORED]
    stream.refresh_scores(source, rules, root, f"{root}/checkpoint", F.lit("2001-12-15").cast("date"))
    last = spark.read.parquet(f"{root}/state").agg(F.max("batch_id")).first()[0]
    score = spark.read.parquet(f"{root}/scores/batch_id={last}").select("score").scalar()
    return spark.read.parquet(f"{root}/state/batch_id={last}").withColumn("score", score)
