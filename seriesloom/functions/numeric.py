"""Numeric helpers: null-safe ratios, exact money sums, column alignment."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by null in every floating column, so aggregates skip it."""
    floats = [c for c, t in df.dtypes if t in ("float", "double")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    out = F.try_divide(a, b)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def pct_change(c: Column, w: WindowSpec, steps: int = 1) -> Column:
    return F.try_divide(c, F.lag(c, steps).over(w)) - 1


def minor_units(c: Column) -> Column:
    """Amount with two decimals as a whole number of cents.

    Sums of whole numbers do not depend on the order in which tasks deliver their parts, so
    totals are the same after a retry or with another partitioning.
    """
    return F.rint(c * 100).cast("bigint")


def sum_minor(c: Column) -> Column:
    return F.sum(minor_units(c))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [c for c, t in df.dtypes if c not in skip and (t in NUMERIC or t.startswith("decimal"))]


def indicator_columns(df: DataFrame, reserved: Iterable[str] = ("series", "ds", "y", "is_eid", "is_christmas")) -> list[str]:
    """Every numeric column that is not a key, date, value or holiday flag."""
    return numeric_columns(df, reserved)


def without_calendar(df: DataFrame, calendar: Iterable[str] = ("year", "month", "quarter", "day_of_year")) -> list[str]:
    return numeric_columns(df, calendar)


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    there = set(right.columns)
    return [c for c in left.columns if c in there]


def align_columns(df: DataFrame, wanted: Iterable[str], keep: Iterable[str] = (), fill: float = 0.0) -> DataFrame:
    """Project to `wanted` in that order: add missing ones as `fill`, drop extra ones."""
    return conform(df, {c: fill for c in wanted}, keep)


def conform(df: DataFrame, defaults: Mapping[str, float], keep: Iterable[str] = ()) -> DataFrame:
    """Like `align_columns` with one default per column; nulls in present columns are filled too."""
    have = set(df.columns)
    cols = [F.col(c) for c in keep]
    for c, default in defaults.items():
        fill = F.lit(float(default))
        cols.append(F.coalesce(F.col(c).cast("double"), fill).alias(c) if c in have else fill.alias(c))
    return df.select(cols)


def round_numeric(df: DataFrame, digits: int = 2) -> DataFrame:
    floats = [c for c, t in df.dtypes if t in ("float", "double")]
    return df.withColumns({c: F.round(c, digits) for c in floats})


def clip_zero(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))
