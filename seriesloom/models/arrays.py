"""One row per series with its history as an array, the input of recursive models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_ends_after
from ..spec import DEFAULT, PanelSpec


def history_arrays(df: DataFrame, spec: PanelSpec = DEFAULT, dates: bool = False) -> DataFrame:
    """(keys, ys, last, n): values in date order, with `dates` also the (ds, y) pairs as `hist`.

    A series has one row per month, so the array is bounded by the calendar, not by the data volume.
    """
    hist = df.groupBy(*spec.keys).agg(F.sort_array(F.collect_list(F.struct(spec.ds, spec.y))).alias("hist"))
    return hist.select(
        *spec.keys,
        F.transform("hist", lambda r: r[spec.y]).alias("ys"),
        F.element_at("hist", -1)[spec.ds].alias("last"),
        F.size("hist").alias("n"),
        *(["hist"] if dates else []),
    )


def explode_forecast(df: DataFrame, yhat: Column, horizon: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rows (keys, step, ds, yhat) from an array of `horizon` predictions and the last date."""
    pairs = F.arrays_zip(month_ends_after(F.col("last"), horizon).alias("d"), yhat.alias("v"))
    return df.select(*spec.keys, F.posexplode(pairs).alias("_i", "_p")).select(
        *spec.keys, (F.col("_i") + 1).cast("bigint").alias("step"), F.col("_p.d").alias(spec.ds), F.col("_p.v").alias("yhat")
    )


def mean_of(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
