"""Multiplicative trend x calendar-month model on the log scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_ends_after, month_index
from ..spec import DEFAULT, PanelSpec


def _lines(df: DataFrame, train: Column, spec: PanelSpec) -> DataFrame:
    """Rows with the series' line `_a + _b * (_t - _t0)` through the logs of its training rows.

    Everything is a window over the series, so the rows are shuffled at most once.
    """
    use = train & (spec.value > 0)
    whole = spec.whole()
    rows = df.withColumns({"_t": month_index(F.col(spec.ds)), "_ln": F.when(use, F.ln(spec.value))})
    rows = rows.withColumn("_t0", F.min(F.when(use, F.col("_t"))).over(whole))
    x = F.when(use, F.col("_t") - F.col("_t0"))
    return rows.withColumns({"_a": F.regr_intercept("_ln", x).over(whole), "_b": F.regr_slope("_ln", x).over(whole)})


def fit(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """(keys, a, b, t0, last, factors): ln y = a + b * t + factor of the month."""
    rows = _lines(df, F.lit(True), spec)
    resid = F.col("_ln") - (F.col("_a") + F.col("_b") * (F.col("_t") - F.col("_t0")))
    keep = {"a": "_a", "b": "_b", "t0": "_t0"}
    by_month = rows.groupBy(*spec.keys, F.month(spec.ds).alias("_m")).agg(
        F.avg(resid).alias("_f"), F.max(spec.ds).alias("last"), *[F.first(c).alias(n) for n, c in keep.items()]
    )
    factors = F.map_from_entries(F.filter(F.collect_list(F.struct("_m", "_f")), lambda e: e["_f"].isNotNull()))
    return by_month.groupBy(*spec.keys).agg(
        *[F.first(n).alias(n) for n in keep], F.max("last").alias("last"), factors.alias("factors")
    )


def trend_factor(df: DataFrame, horizon: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Forecast rows (keys, step, ds, yhat); a month without history gets no factor."""
    model = fit(df, spec).filter(F.col("b").isNotNull())
    rows = model.select("*", F.posexplode(month_ends_after(F.col("last"), horizon)).alias("_i", spec.ds))
    t = month_index(F.col(spec.ds)) - F.col("t0")
    factor = F.coalesce(F.try_element_at("factors", F.month(spec.ds)), F.lit(0.0))
    return rows.select(
        *spec.keys, (F.col("_i") + 1).cast("bigint").alias("step"), spec.ds, F.exp(F.col("a") + F.col("b") * t + factor).alias("yhat")
    )


def backtest(df: DataFrame, part: str = "part", spec: PanelSpec = DEFAULT) -> DataFrame:
    """(keys, ds, y, yhat) of the test rows of a split panel, fitted on its training rows; no join."""
    rows = _lines(df, F.col(part) == "train", spec)
    line = F.col("_a") + F.col("_b") * (F.col("_t") - F.col("_t0"))
    month = Window.partitionBy(*spec.keys, F.month(spec.ds))
    factor = F.coalesce(F.avg(F.col("_ln") - line).over(month), F.lit(0.0))
    scored = rows.withColumn("yhat", F.exp(line + factor)).filter((F.col(part) == "test") & F.col("yhat").isNotNull())
    return scored.select(*spec.keys, spec.ds, spec.y, "yhat")
