"""The panel, indicator and headline tables that the named queries derive from the given tables.

Each builder has its DuckDB text next to it. Values of a panel are whole currency units, so sums
and means come out the same in any order of addition.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month_end
from ..functions.numeric import sum_minor
from ..operators.clean import densify

INDICATORS = ["avg_discount", "avg_tax", "avg_qty", "avg_price"]
HORIZON = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, columns: Sequence[str], rows: Iterable[Sequence]) -> DataFrame:
    """A small fixed table from code, planned as a local relation."""
    return spark.sql(f"SELECT * FROM VALUES {values_text(rows)} AS t({', '.join(columns)})")


def values_text(rows: Iterable[Sequence]) -> str:
    def one(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return f"CAST({v} AS BIGINT)"
        return "'" + str(v) + "'"

    return ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def literal_sql(name: str, columns: Sequence[str], rows: Iterable[Sequence]) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {values_text(rows)}) AS t({', '.join(columns)}))"


def _customer_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cents per (customer, month).

    Orders collapse before they meet the customer table: a customer holding a third of all
    orders shrinks to one row per month inside the map tasks.
    """
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey", month_end(F.col("o_orderdate")).alias("ds"))
        .agg(sum_minor(F.col("o_totalprice")).alias("cents"))
    )


def _units(cents: Column) -> Column:
    return ((cents + 50) - F.pmod(cents + 50, F.lit(100))).cast("double") / 100


def _by_series(spark: SparkSession, sf_dir: str, series: Column) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return (
        _customer_months(spark, sf_dir)
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(series.alias("series"), "ds")
        .agg(_units(F.sum("cents")).alias("y"))
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per market segment and month."""
    return _by_series(spark, sf_dir, F.col("c_mktsegment"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per (market segment, nation) and month: the many-series case."""
    return _by_series(spark, sf_dir, F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")))


def wide_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(wide(spark, sf_dir), "ffill")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(panel(spark, sf_dir), "ffill")


def period_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("ds").agg(F.sum("y").alias("total"))


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly averages of line items: the macro table."""
    n = F.count("*")
    mean = lambda c: sum_minor(F.col(c)).cast("double") / (F.lit(100.0) * n)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(month_end(F.col("l_shipdate")).alias("ds"))
        .agg(
            mean("l_discount").alias("avg_discount"),
            mean("l_tax").alias("avg_tax"),
            mean("l_quantity").alias("avg_qty"),
            mean("l_extendedprice").alias("avg_price"),
        )
    )


def indicators_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators(spark, sf_dir).unpivot(["ds"], INDICATORS, "indicator", "value")


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value per year."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.year("o_orderdate").cast("bigint").alias("year"))
        .agg((sum_minor(F.col("o_totalprice")).cast("double") / (F.lit(100.0) * F.count("*"))).alias("value"))
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")


# fixed values: months that held Eid al-Fitr or Christmas
HOLIDAY_COLUMNS = ("year", "month", "flag")
HOLIDAYS = (
    (1995, 3, "is_eid"), (1996, 2, "is_eid"), (1997, 2, "is_eid"), (1998, 1, "is_eid"), (1999, 1, "is_eid"),
    (2000, 1, "is_eid"), (2000, 12, "is_eid"), (2001, 12, "is_eid"), (2002, 12, "is_eid"),
    *((y, 12, "is_christmas") for y in range(1995, 2003)),
)

# fixed values: range rules over the monthly averages of line items
RULE_COLUMNS = ("indicator", "min", "max", "critical")
RULES = (
    ("avg_discount", 0.048, 0.052, True),
    ("avg_tax", 0.038, 0.042, False),
    ("avg_qty", 24.5, 26.5, False),
    ("avg_price", 40000.0, 60000.0, True),
)

# fixed values: what-if scenarios over the same indicators
SCENARIO_COLUMNS = ("scenario", "indicator", "op", "arg")
SCENARIOS = (
    ("crisis", "avg_price", "mul", 0.8), ("crisis", "avg_discount", "add", 0.02), ("crisis", "avg_qty", "mul", 0.9),
    ("optimistic", "avg_price", "mul", 1.1), ("optimistic", "avg_qty", "add", 1.5), ("optimistic", "avg_tax", "set", 0.03),
    ("normal", "avg_price", "mul", 1.0),
)

PANEL = """panel AS (
  SELECT c_mktsegment AS series, CAST(last_day(o_orderdate) AS DATE) AS ds,
         CAST((sum(CAST(round(o_totalprice * 100) AS BIGINT)) + 50) // 100 AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""

WIDE = """wide AS (
  SELECT c_mktsegment || '/' || CAST(c_nationkey AS VARCHAR) AS series, CAST(last_day(o_orderdate) AS DATE) AS ds,
         CAST((sum(CAST(round(o_totalprice * 100) AS BIGINT)) + 50) // 100 AS DOUBLE) AS y
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


def dense_sql(source: str, name: str) -> str:
    """Every month between first and last month per series, gaps filled forward."""
    return f"""{name}_cal AS (
  SELECT series, CAST(last_day(m) AS DATE) AS ds FROM (
    SELECT series, unnest(generate_series(CAST(date_trunc('month', min(ds)) AS TIMESTAMP), CAST(max(ds) AS TIMESTAMP), INTERVAL 1 MONTH)) AS m
    FROM {source} GROUP BY series)),
{name} AS (
  SELECT c.series, c.ds, last_value(p.y IGNORE NULLS) OVER (PARTITION BY c.series ORDER BY c.ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y
  FROM {name}_cal c LEFT JOIN {source} p ON p.series = c.series AND p.ds = c.ds)"""


DENSE = dense_sql("panel", "dense")
WIDE_DENSE = dense_sql("wide", "wdense")

TOTALS = "totals AS (SELECT ds, sum(y) AS total FROM panel GROUP BY ds)"


def _mean_sql(c: str) -> str:
    return f"CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / (CAST(100 AS DOUBLE) * count(*))"


IND = f"""ind AS (
  SELECT CAST(last_day(l_shipdate) AS DATE) AS ds, {_mean_sql('l_discount')} AS avg_discount, {_mean_sql('l_tax')} AS avg_tax,
         {_mean_sql('l_quantity')} AS avg_qty, {_mean_sql('l_extendedprice')} AS avg_price
  FROM lineitem GROUP BY 1)"""

IND_LONG = "indl AS (" + " UNION ALL ".join(
    f"SELECT ds, '{c}' AS indicator, {c} AS value FROM ind" for c in INDICATORS
) + ")"

ANNUAL = f"annual AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, {_mean_sql('o_totalprice')} AS value FROM orders GROUP BY 1)"
