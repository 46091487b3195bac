"""Gaps, fills, repairs and corrections of a panel."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_ends_between
from ..spec import DEFAULT, PanelSpec


def forward_fill(df: DataFrame, cols: Iterable[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    w = spec.ordered().rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def backward_fill(df: DataFrame, cols: Iterable[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    w = spec.ordered().rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns({c: F.first(c, ignorenulls=True).over(w) for c in cols})


def fill_both(df: DataFrame, cols: Iterable[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Forward fill, then backward fill what is left at the start of the series."""
    before = spec.ordered().rowsBetween(Window.unboundedPreceding, 0)
    after = spec.ordered().rowsBetween(0, Window.unboundedFollowing)
    return df.withColumns(
        {c: F.coalesce(F.last(c, ignorenulls=True).over(before), F.first(c, ignorenulls=True).over(after)) for c in cols}
    )


def densify(df: DataFrame, fill: str = "null", spec: PanelSpec = DEFAULT) -> DataFrame:
    """Give every series one row for each month between its own first and last month.

    `fill` says what a gap month gets: null, 0 ("zero") or the value before it ("ffill"). Each row
    looks at the next date of its series and expands over the months up to it: one window, no
    join, and the rows stay partitioned by series for what follows.
    """
    w = spec.ordered()
    nxt = F.lead(spec.ds).over(w)
    months = F.when(nxt.isNull(), F.array(spec.ds)).otherwise(month_ends_between(F.col(spec.ds), F.add_months(nxt, -1)))
    rest = [c for c in df.columns if c not in (*spec.keys, spec.ds, spec.y)]
    cols = {"_months": months}
    if fill == "ffill":
        cols["_y"] = F.last(spec.y, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumns(cols).select(*spec.keys, spec.y, *rest, *list(cols)[1:], F.posexplode("_months").alias("_i", "_d"))
    own = F.col("_i") == 0
    y = {
        "null": F.when(own, F.col(spec.y)),
        "zero": F.when(own, F.coalesce(F.col(spec.y), F.lit(0.0))).otherwise(F.lit(0.0)),
        "ffill": F.col("_y") if fill == "ffill" else None,
    }[fill]
    return out.select(*spec.keys, F.col("_d").alias(spec.ds), y.alias(spec.y), *[F.when(own, F.col(c)).alias(c) for c in rest])


def repair_outliers(df: DataFrame, threshold: float = 2.5, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Replace values more than `threshold` sigmas off by the mean of their neighbours.

    The neighbours are the rows from three before to two after, without the row itself, and
    always the original values. Adds `y_fixed` and `is_fixed`.
    """
    y, whole = spec.value, spec.whole()
    near = spec.ordered().rowsBetween(-3, 2)
    mean, std = F.avg(y).over(whole), F.stddev_samp(y).over(whole)
    z = F.when(std > 0, (y - mean) / std)
    others = F.try_divide(F.sum(y).over(near) - y, F.count(y).over(near) - 1)
    return (
        df.withColumns({"_z": z, "_others": others})
        .withColumn("is_fixed", F.coalesce((F.abs("_z") > threshold) & F.col("_others").isNotNull(), F.lit(False)))
        .withColumn("y_fixed", F.when(F.col("is_fixed"), F.col("_others")).otherwise(y))
        .drop("_z", "_others")
    )


def override(df: DataFrame, replacements: DataFrame, on: list[str], col: str, new: str = "new_value") -> DataFrame:
    """Take the replacement where one exists, else keep the value (point fixes, presets, loaded results)."""
    return (
        df.join(replacements.select(*on, new), on, "left")
        .withColumn(col, F.coalesce(F.col(new), F.col(col)))
        .drop(new)
    )


def drop_incomplete(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(cols) if cols else None)
