"""Files landed in the shared folder and read back by the source readers; structure, preview and stored models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as num
from ..models import base, linear
from ..operators import features, quality
from ..session import shared_dir
from ..sources import files, store
from ..sources.loader import PanelLoader
from . import fixtures as fx
from .build import ML
from .forecasting import AR_FEATURES
from .registry import ORACLES, query, sql
from .sources import annual_payloads

DAY_FIRST = "dd/MM/yyyy"


def _landed_indicators(spark, sf_dir) -> str:
    path = shared_dir(spark, "landed-indicators")
    wide = fx.indicators(spark, sf_dir).select(F.date_format("ds", DAY_FIRST).alias("Tanggal"), *fx.INDICATORS)
    wide.write.option("header", True).csv(path)
    return path


@query("indicators_from_file", sql(fx.IND, "SELECT * FROM ind"))
def indicators_from_file(spark, sf_dir):
    return files.read_indicators(spark, _landed_indicators(spark, sf_dir), "Tanggal", fx.INDICATORS)


@query("annual_from_file", ORACLES["annual_from_json"])
def annual_from_file(spark, sf_dir):
    """Annual payloads landed as one text file for each indicator."""
    path = shared_dir(spark, "landed-annual")
    annual_payloads(spark, sf_dir).write.partitionBy("indicator").text(path)
    return files.read_annual(spark, path)


@query(
    "prices_from_file",
    "SELECT CAST(o_orderdate AS DATE) AS ds, arg_max(o_totalprice, o_orderkey) AS value, 'orders' AS name FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1",
)
def prices_from_file(spark, sf_dir):
    """The last counted price of every day; a day without one lands empty and is dropped by the reader."""
    path, o = shared_dir(spark, "landed-prices"), fx.table(spark, sf_dir, "orders")
    counted = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey"))
    days = o.groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date")).agg(F.max_by("o_totalprice", counted).alias("Close"))
    days.write.option("header", True).csv(path)
    return files.read_prices(spark, path, "orders")


@query(
    "feed_from_file",
    """SELECT CASE WHEN lang = 'de' THEN 'No Title' ELSE lang || ' text of ' || coalesce(length(text), 0) || ' characters' END AS title,
CASE WHEN lang = 'fr' THEN '#' ELSE 'https://example.org/' || doc_id END AS link,
CASE WHEN lang = 'es' THEN '' ELSE '05 Aug 10:0' || (doc_id % 10) END AS published, 'feed' AS source, 'Local' AS category FROM documents""",
)
def feed_from_file(spark, sf_dir):
    """Feed items landed as XML files, some without a title, link or date."""
    path, d = shared_dir(spark, "landed-feed"), fx.table(spark, sf_dir, "documents")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("string")
    day = F.concat(F.lit("Mon, 05 Aug 2024 10:0"), (F.col("doc_id") % 10).cast("string"), F.lit(":30 GMT"))
    items = d.select(
        F.when(F.col("lang") != "de", F.concat("lang", F.lit(" text of "), size, F.lit(" characters"))).alias("title"),
        F.when(F.col("lang") != "fr", F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string"))).alias("link"),
        F.when(F.col("lang") != "es", day).alias("pubDate"),
    )
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return files.read_feed(spark, path, "feed")


_FILLED = ", ".join(
    f"""coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value({c} IGNORE NULLS) OVER (PARTITION BY series ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"""
    for c in fx.INDICATORS
)


@query(
    "loaded_panel",
    sql(fx.PANEL, fx.IND, f"mi AS (SELECT p.series, p.ds, p.y, {', '.join(fx.INDICATORS)} FROM panel p LEFT JOIN ind ON ind.ds = p.ds)", f"SELECT series, ds, y, {_FILLED} FROM mi"),
)
def loaded_panel(spark, sf_dir):
    """History and indicator files landed, loaded, merged and filled by the loader."""
    path = shared_dir(spark, "landed-history")
    fx.panel(spark, sf_dir).select(F.date_format("ds", DAY_FIRST).alias("ds"), "series", "y").write.option("header", True).csv(path)
    loader = PanelLoader(spark, path, _landed_indicators(spark, sf_dir), fx.INDICATORS)
    return loader.load().select("series", "ds", "y", *loader.indicator_columns())


@query(
    "structure_check",
    sql(fx.PANEL, "SELECT 'missing column oil' AS problem UNION ALL SELECT 'fewer than 500 rows' FROM panel HAVING count(*) < 500"),
)
def structure_check(spark, sf_dir):
    found = quality.structure_problems(fx.panel(spark, sf_dir), ["series", "ds", "y", "oil"], 500)
    return spark.createDataFrame([(p,) for p in found], "problem string")


@query("panel_preview", sql(fx.PANEL, "SELECT * FROM panel ORDER BY ds, series LIMIT 5"))
def panel_preview(spark, sf_dir):
    return store.preview(fx.panel(spark, sf_dir), "ds", "series")


def _filled_counts(df, columns):
    """Rows with a value, and their rounded mean, of every column."""
    kept = df.select([F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "name", "value")
    return kept.groupBy("name").agg(F.count("value").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


def _filled_sql(table: str, columns) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, round(avg(CAST({c} AS DOUBLE)), 4) AS mean FROM {table}" for c in columns)


@query("numeric_columns_found", _filled_sql("customer", ("c_nationkey", "c_acctbal")))
def numeric_columns_found(spark, sf_dir):
    """Every numeric column of a table but its key, as found from the schema."""
    c = fx.table(spark, sf_dir, "customer")
    return _filled_counts(c, num.indicator_columns(c, ("c_custkey",)))


@query("columns_without_calendar", sql(fx.WIDE, fx.WIDE_DENSE, ML, _filled_sql("ml", ("y", "lag_1", "rolling_mean_3"))))
def columns_without_calendar(spark, sf_dir):
    ml = features.ml_features(fx.wide_dense(spark, sf_dir)).select("series", "ds", "year", "month", "y", "lag_1", "rolling_mean_3")
    return _filled_counts(ml, num.without_calendar(ml))


@query("columns_in_common", sql(fx.IND, _filled_sql("ind", ("avg_discount", "avg_price"))))
def columns_in_common(spark, sf_dir):
    """Indicators that a history shares with a later table of which two columns are missing."""
    past = fx.indicators(spark, sf_dir)
    later = past.drop("avg_tax", "avg_qty", "ds")
    return _filled_counts(past, num.common_columns(past, later))


@query("stored_model", ORACLES["linear_coefficients"])
def stored_model(spark, sf_dir):
    """A linear model per series, saved as a table of coefficients and loaded again."""
    path = shared_dir(spark, "model")
    base.save_model(linear.fit_linear(features.ml_features(fx.wide_dense(spark, sf_dir)), AR_FEATURES), path)
    m = base.load_model(spark, path)
    return m.select("series", F.round("intercept", 1).alias("intercept"), *[F.round(F.col("coef")[i], 6).alias(c) for i, c in enumerate(AR_FEATURES)])


@query("observed_metrics", sql(fx.PANEL, "SELECT count(*) AS rows, min(ds) AS first, max(ds) AS last, count(DISTINCT series) AS n_series, true AS has_indicators FROM panel"))
def observed_metrics(spark, sf_dir):
    """Facts about a load as seen by the first action on it, without a pass of their own."""
    path = shared_dir(spark, "landed-history")
    fx.panel(spark, sf_dir).select(F.date_format("ds", DAY_FIRST).alias("ds"), "series", "y").write.option("header", True).csv(path)
    loader = PanelLoader(spark, path, _landed_indicators(spark, sf_dir), fx.INDICATORS)
    loader.load().write.format("noop").mode("overwrite").save()
    seen = loader.metadata()
    kinds = "rows long, first date, last date, n_series long, has_indicators boolean"
    return spark.createDataFrame([tuple(seen[k.split()[0]] for k in kinds.split(", "))], kinds)
