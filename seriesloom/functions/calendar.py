"""Month arithmetic, calendar columns and date text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def month_end(c: Column) -> Column:
    return F.last_day(c.cast("date"))


def month_index(c: Column) -> Column:
    """Months since year 0; differences of it are whole month steps."""
    return F.year(c) * 12 + F.month(c)


def month_ends_after(ds: Column, periods: int) -> Column:
    """The next `periods` month ends as an array; month end again after a 28/29 February."""
    return F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda i: F.last_day(F.add_months(ds, i)))


def month_starts_after(ds: Column, periods: int) -> Column:
    first = F.trunc(ds, "month")
    return F.transform(F.sequence(F.lit(1), F.lit(periods)), lambda i: F.add_months(first, i))


def month_ends_between(lo: Column, hi: Column) -> Column:
    months = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("interval 1 month"))
    return F.transform(months, lambda d: F.last_day(d))


def calendar_columns(ds: Column) -> dict[str, Column]:
    return {
        "month": F.month(ds).cast("bigint"),
        "year": F.year(ds).cast("bigint"),
        "quarter": F.quarter(ds).cast("bigint"),
        "day_of_year": F.dayofyear(ds).cast("bigint"),
        "month_sin": F.sin(F.lit(6.283185307179586) * F.month(ds) / 12),
        "month_cos": F.cos(F.lit(6.283185307179586) * F.month(ds) / 12),
    }


def parse_day_first(c: Column, fmt: str = "dd/MM/yyyy") -> Column:
    """Day-first date text to DATE; text that is no date becomes null."""
    return F.try_to_timestamp(F.trim(c), F.lit(fmt)).cast("date")


def month_steps_back(as_of: Column, months: int) -> Column:
    return F.last_day(F.add_months(as_of, -months))


def horizon_months(first: Column, last: Column) -> Column:
    """Whole 30-day blocks between two dates plus one."""
    return (F.floor(F.datediff(last, first) / 30) + 1).cast("bigint")


def step_by_year(ds: Column, steps: dict[int, float], default: float) -> Column:
    out = F.lit(float(default))
    for year, value in sorted(steps.items(), reverse=True):
        out = F.when(F.year(ds) == year, float(value)).otherwise(out)
    return out


def register_month_ends(spark: SparkSession) -> None:
    """SQL table function `month_ends(start, n)`: the `n` month ends after a date, no rows for a null."""
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION month_ends(start DATE, n INT) RETURNS TABLE (step INT, ds DATE)
        RETURN SELECT i, last_day(add_months(start, i)) FROM explode(sequence(1, n)) AS t(i) WHERE start IS NOT NULL"""
    )
