"""Landed files to typed tables: history and indicator CSV, annual JSON, price series, feed XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.calendar import parse_day_first
from ..functions.numeric import nan_to_null
from ..functions.text import feed_date

HISTORY = T.StructType(
    [T.StructField("ds", T.StringType()), T.StructField("series", T.StringType()), T.StructField("y", T.DoubleType())]
)
ANNUAL = "array<struct<date:string,value:double>>"
FEED_ITEM = "title string, link string, pubDate string"


def read_history(spark: SparkSession, path: str, date_format: str = "dd/MM/yyyy") -> DataFrame:
    """History CSV (date, series, value with a header line); a bad date becomes a null `ds`."""
    raw = spark.read.schema(HISTORY).option("header", True).option("enforceSchema", True).csv(path)
    return nan_to_null(raw.withColumn("ds", parse_day_first(F.col("ds"), date_format)))


def read_indicators(spark: SparkSession, path: str, date_column: str, columns: list[str], date_format: str = "dd/MM/yyyy") -> DataFrame | None:
    """Wide indicator CSV; None when the file is missing or holds no usable date."""
    schema = T.StructType([T.StructField(date_column, T.StringType()), *[T.StructField(c, T.DoubleType()) for c in columns]])
    try:
        raw = spark.read.schema(schema).option("header", True).csv(path)
        parsed = raw.withColumn("ds", parse_day_first(F.col(date_column), date_format)).drop(*([date_column] if date_column != "ds" else []))
        if parsed.filter(F.col("ds").isNotNull()).limit(1).count() == 0:
            return None
    except AnalysisException:
        return None
    return nan_to_null(parsed.filter(F.col("ds").isNotNull()).select("ds", *columns))


def annual_rows(payload: Column) -> Column:
    """Array of (date, value) from `[meta, [ {date, value}, ... ]]`, one payload per indicator."""
    return F.from_json(F.get_json_object(payload, "$[1]"), ANNUAL)


def parse_annual(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(indicator, year, value) of landed payloads; entries without a value are dropped."""
    rows = payloads.select("indicator", F.explode(annual_rows(F.col(payload))).alias("r"))
    return rows.select("indicator", F.col("r.date").try_cast("bigint").alias("year"), F.col("r.value").alias("value")).filter(
        F.col("value").isNotNull() & F.col("year").isNotNull()
    )


def read_annual(spark: SparkSession, path: str) -> DataFrame:
    """Annual JSON files, one payload per file; the indicator is the file's `indicator=` folder, else its name."""
    raw = spark.read.text(path, wholetext=True)
    name = F.col("indicator") if "indicator" in raw.columns else F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return parse_annual(raw.select(name.alias("indicator"), F.col("value").alias("payload")))


def read_prices(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Daily price CSV (Date, Close) to (ds, value)."""
    schema = "Date string, Close double"
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.select(F.to_date("Date").alias("ds"), F.col("Close").alias("value"), F.lit(name).alias("name")).filter("value is not null")


def feed_items(raw: DataFrame) -> DataFrame:
    """Defaults for missing title and link, short publication date."""
    return raw.withColumns(
        {
            "title": F.coalesce("title", F.lit("No Title")),
            "link": F.coalesce("link", F.lit("#")),
            "published": feed_date(F.coalesce("pubDate", F.lit(""))),
        }
    ).drop("pubDate")


def read_feed(spark: SparkSession, path: str, source: str, category: str = "Local") -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "item").schema(FEED_ITEM).load(path)
    return feed_items(raw).withColumns({"source": F.lit(source), "category": F.lit(category)})


def parse_feed_column(df: DataFrame, xml: str) -> DataFrame:
    """The same for items that arrive as an XML text column."""
    item = F.from_xml(F.col(xml), FEED_ITEM)
    return feed_items(df.withColumn("_i", item).select(*[c for c in df.columns if c != xml], "_i.*"))
