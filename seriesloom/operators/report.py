"""Totals, growth, composition, pivots and distributions behind a revenue report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import growth_band
from ..functions.numeric import pct_change
from ..session import ensure_checkpoint_dir
from ..spec import DEFAULT, PanelSpec
from .quantiles import exact_quantiles


def totals(df: DataFrame, by: Sequence[str], col: str = "y", name: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(col).alias(name))


def with_bounds(df: DataFrame, y: str = "y", pct: float = 0.05) -> DataFrame:
    """Give a forecast default bounds of +-5 % wherever it has none."""
    for name, factor in (("lo", 1 - pct), ("hi", 1 + pct)):
        default = F.col(y) * factor
        df = df.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)
    return df


def trailing_months(df: DataFrame, months: int, ds: str = "ds") -> DataFrame:
    """Rows of the last `months` months up to the latest date of the whole table."""
    newest = df.agg(F.max(ds)).scalar()
    return df.filter(F.col(ds) >= F.last_day(F.add_months(newest, -(months - 1))))


def from_date_of(df: DataFrame, start_of: DataFrame, ds: str = "ds") -> DataFrame:
    """Rows from the first date of another table on."""
    return df.filter(F.col(ds) >= start_of.agg(F.min(ds)).scalar())


def period_growth(totals_by_period: DataFrame, col: str = "total", steps: int = 1, ds: str = "ds") -> DataFrame:
    """Percent change of period totals. The input has one row per period, so one ordered window is enough."""
    w = Window.orderBy(ds)
    return totals_by_period.withColumn("growth", pct_change(F.col(col), w, steps) * 100)


def guarded_growth(totals_by_period: DataFrame, col: str = "total", ds: str = "ds") -> DataFrame:
    """Month-over-month growth in percent, 0 where the month before is not positive."""
    prev = F.lag(col).over(Window.orderBy(ds))
    return totals_by_period.withColumn("growth", F.when(prev > 0, (F.col(col) - prev) / prev * 100).otherwise(0.0))


def headline_kpis(history: DataFrame, forecast: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row: forecast total, mean per month, bounds, and growth against the last 12 history months."""
    y = spec.y
    past = trailing_months(history, 12, spec.ds).agg(F.sum(y).alias("p")).scalar()
    out = with_bounds(forecast, y).agg(
        F.sum(y).alias("total"), F.count_distinct(spec.ds).alias("months"),
        F.sum("lo").alias("total_lo"), F.sum("hi").alias("total_hi"),
    )
    return out.select(
        "total", "months", "total_lo", "total_hi",
        (F.col("total") / F.col("months")).alias("per_month"),
        F.when(past > 0, (F.col("total") - past) / past * 100).otherwise(0.0).alias("growth_pct"),
    )


def composition(df: DataFrame, by: str = "series", col: str = "y") -> DataFrame:
    """Total and share per key plus the grand-total row, from one rollup."""
    per_key = df.groupBy(by).agg(F.sum(col).alias("t"))
    grand = per_key.agg(F.sum("t")).scalar()
    return per_key.rollup(by).agg(F.sum("t").alias("total"), F.grouping(by).alias("_g")).select(
        F.when(F.col("_g") == 1, F.lit("Total")).otherwise(F.col(by)).alias(by),
        "total",
        F.try_divide(F.col("total"), grand).alias("share"),
    )


def total_or_series(df: DataFrame, by: str = "series", col: str = "y") -> DataFrame:
    """Per-key totals and the all-keys total under the label 'Total Aggregated'."""
    per_key = df.groupBy(by).agg(F.sum(col).alias("t"))
    return per_key.groupingSets([[by], []], by).agg(F.sum("t").alias("total"), F.grouping(by).alias("_g")).select(
        F.when(F.col("_g") == 1, F.lit("Total Aggregated")).otherwise(F.col(by)).alias("selection"), "total"
    )


def peak_period(totals_by_period: DataFrame, col: str = "total", ds: str = "ds") -> DataFrame:
    """Period with the largest total; the earliest one when several tie."""
    best = F.max_by(F.col(ds), F.struct(F.col(col), -F.datediff(F.col(ds), F.lit("1970-01-01").cast("date"))))
    return totals_by_period.agg(best.alias("peak_ds"), F.max(col).alias("peak_total"))


def top_share(df: DataFrame, n: int, by: str = "series", col: str = "y") -> DataFrame:
    return totals(df, [by], col).orderBy(F.col("total").desc(), by).limit(n)


def pivot_cells(df: DataFrame, row: Column, column: Column, value: Column) -> DataFrame:
    """A pivot with a fixed schema: (row, cells), cells mapping every column name found in the data to its value or null.

    The names come from the data, one array for the table; rows and cells are aggregated first, so a map is built from one entry
    for each cell that is filled.
    """
    filled = df.groupBy(row.alias("row"), column.alias("_c")).agg(value.alias("_v")).where(F.col("_c").isNotNull())
    names = filled.agg(F.array_sort(F.collect_set("_c"))).scalar()
    cells = filled.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("_c", "_v"))).alias("_m")).withColumn("_names", names)
    every = F.map_from_arrays("_names", F.transform("_names", lambda n: F.try_element_at("_m", n)))
    return cells.select("row", every.alias("cells"))


def long_cells(pivot: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """The cells of a pivot as rows, the empty ones too; further columns stay."""
    rest = [c for c in pivot.columns if c not in ("row", "cells")]
    return pivot.select(F.col("row").alias(row), F.explode("cells").alias(column, value), *rest)


def pivot_series(df: DataFrame, spec: PanelSpec = DEFAULT, agg: str = "sum") -> DataFrame:
    """Periods by series: (row, cells)."""
    return pivot_cells(df, F.col(spec.ds), F.col(spec.keys[0]), F.sum(spec.y) if agg == "sum" else F.avg(spec.y))


def season_pivot(df: DataFrame, spec: PanelSpec = DEFAULT, agg: str = "sum") -> DataFrame:
    """Calendar months by years: (row, cells)."""
    return pivot_cells(df, F.month(spec.ds).cast("bigint"), F.year(spec.ds).cast("bigint"), F.sum(spec.y) if agg == "sum" else F.avg(spec.y))


def correlation_matrix(pivot: DataFrame) -> DataFrame:
    """Pairwise correlation of the columns of a pivot (row, cells) as rows (a, b, corr).

    A pivot has one row per period, so pairing its cells inside each row stays small; equal pairs
    combine in the map tasks. For more than a few hundred columns use `pyspark.ml.stat.Correlation`.
    """
    entries = F.array_sort(F.transform(F.map_entries("cells"), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].cast("double").alias("value"))))
    pairs = F.flatten(F.transform(entries, lambda x, i: F.transform(F.slice(entries, i + 1, F.size(entries) - i), lambda y: F.struct(
        x["key"].alias("a"), y["key"].alias("b"), x["value"].alias("x"), y["value"].alias("y")))))
    half = pivot.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.corr("p.x", "p.y").alias("corr"))
    mirrored = half.filter(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    return half.unionByName(mirrored)


def boxplot(df: DataFrame, spec: PanelSpec = DEFAULT, k: float = 1.5) -> DataFrame:
    """Quartiles, eighths, whiskers (extremes inside the fences) and outlier count per series."""
    names = ("e1", "q1", "median", "q3", "e7")
    rows = df.withColumn("_q", F.percentile(spec.y, [0.125, 0.25, 0.5, 0.75, 0.875]).over(spec.whole()))
    q1, q3 = F.col("_q")[1], F.col("_q")[3]
    inside = F.col(spec.y).between(q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return (
        rows.groupBy(*spec.keys)
        .agg(
            F.first("_q").alias("_q"),
            F.min(F.when(inside, F.col(spec.y))).alias("whisker_lo"),
            F.max(F.when(inside, F.col(spec.y))).alias("whisker_hi"),
            F.count_if(~inside).cast("bigint").alias("n_out"),
        )
        .select(*spec.keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)], "whisker_lo", "whisker_hi", "n_out")
    )


def histogram(df: DataFrame, col: str, bins: int = 20, by: Sequence[str] = (), bounds: DataFrame | None = None) -> DataFrame:
    """Equal-width bins between the minimum and maximum of the column; the maximum counts in the last bin.

    Rows with the same (bin, by) are pre-aggregated before the shuffle, so skew does not matter.
    """
    ends = (bounds if bounds is not None else df).agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("b"))
    x = df.filter(F.col(col).isNotNull()).withColumn("_b", ends.scalar())
    width = (F.col("_b.hi") - F.col("_b.lo")) / bins
    slot = F.when(F.col("_b.hi") > F.col("_b.lo"), F.floor((F.col(col) - F.col("_b.lo")) / width)).otherwise(0)
    return (
        x.groupBy(*by, F.least(slot, F.lit(bins - 1)).cast("bigint").alias("bin"))
        .agg(F.count("*").alias("n"), F.first(F.col("_b.lo")).alias("_lo"), F.first(width).alias("_w"))
        .select(*by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_lo"), "n")
    )


def density(df: DataFrame, col: str, sample: str, bins: int = 20) -> DataFrame:
    """Histogram per sample over common bins, normalised to 1 per sample."""
    h = histogram(df, col, bins, [sample])
    return h.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(sample)))


def portfolio(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per series: total, mean month-over-month growth %, deviation and variation; gaps count as 0."""
    grown = df.withColumn("_g", pct_change(spec.value, spec.ordered()))
    mean, std = F.avg(spec.y), F.stddev_samp(spec.y)
    return (
        grown.groupBy(*spec.keys)
        .agg(
            F.sum(spec.y).alias("total"),
            (F.avg("_g") * 100).alias("avg_growth"),
            std.alias("std"),
            F.try_divide(std, mean).alias("cv"),
        )
        .fillna(0.0)
    )


def quadrants(metrics: DataFrame, x: str = "avg_growth", y: str = "total") -> DataFrame:
    """Label each series by its side of the two medians.

    The metrics are one row per series and are read three times, so they are kept; the medians come
    from the sketch-and-refine quantiles because there may be very many series.
    """
    ensure_checkpoint_dir(metrics.sparkSession)
    kept = metrics.checkpoint()
    mx, my = (exact_quantiles(kept, [], c, {"m": 0.5}).scalar() for c in (x, y))
    out = kept.withColumns({"_mx": mx, "_my": my})
    fast, big = F.col(x) >= F.col("_mx"), F.col(y) >= F.col("_my")
    label = F.when(fast & big, "star").when(big, "cash cow").when(fast, "question mark").otherwise("laggard")
    return out.withColumn("quadrant", label).drop("_mx", "_my")


def buoyancy(totals_by_period: DataFrame, indicator_growth: float = 5.0, col: str = "total") -> DataFrame:
    """Mean month-over-month growth of the total over the growth of the economy (0 when that is 0)."""
    g = period_growth(totals_by_period, col)
    return g.agg(F.avg("growth").alias("avg_growth")).select(
        "avg_growth", F.coalesce(F.try_divide("avg_growth", F.lit(float(indicator_growth))), F.lit(0.0)).alias("buoyancy")
    )


def growth_table(totals_by_period: DataFrame, steps: int = 12) -> DataFrame:
    g = period_growth(totals_by_period, steps=steps)
    return g.filter(F.col("growth").isNotNull()).withColumn("direction", growth_band(F.col("growth")))


def combine(history: DataFrame, forecast: DataFrame, tags: tuple[str, str] = ("Realisasi", "Forecast")) -> DataFrame:
    """History and forecast in one long table with a type tag; columns of one side only become null."""
    return history.withColumn("kind", F.lit(tags[0])).unionByName(
        forecast.withColumn("kind", F.lit(tags[1])), allowMissingColumns=True
    )


def bridge(combined: DataFrame, tags: tuple[str, str] = ("Realisasi", "Forecast"), spec: PanelSpec = DEFAULT) -> DataFrame:
    """Last history point and first forecast point per series, to join the two lines."""
    hist, fut = F.col("kind") == tags[0], F.col("kind") == tags[1]
    return combined.groupBy(*spec.keys).agg(
        F.max(F.when(hist, F.col(spec.ds))).alias("from_ds"),
        F.max_by(F.when(hist, spec.value), F.when(hist, spec.period)).alias("from_y"),
        F.min(F.when(fut, F.col(spec.ds))).alias("to_ds"),
        F.min_by(F.when(fut, spec.value), F.when(fut, spec.period)).alias("to_y"),
    )


def delta_to_previous(now: DataFrame, before: DataFrame, col: str = "y", gate: float = 1.0) -> DataFrame:
    """Total of this run against the last one; reported as significant beyond the gate in percent."""
    prev = before.agg(F.sum(col)).scalar()
    cur = now.agg(F.sum(col).alias("current")).withColumn("previous", prev)
    d = F.col("current") - F.col("previous")
    pct = F.when(F.col("previous") > 0, d / F.col("previous") * 100).otherwise(0.0)
    return cur.withColumns({"delta": d, "delta_pct": pct}).withColumn("significant", F.abs("delta_pct") > gate)


def last_row_levels(indicators: DataFrame, cols: Sequence[str], ds: str = "ds") -> DataFrame:
    """Current level of each indicator: its value in the latest row."""
    last = indicators.agg(*[F.max_by(c, ds).alias(c) for c in cols])
    return last.unpivot([], list(cols), "indicator", "level")


def trailing_mean_levels(indicators: DataFrame, cols: Sequence[str], rows: int = 3, ds: str = "ds") -> DataFrame:
    """Mean of the last rows per indicator, the default of a scenario form."""
    tail = indicators.orderBy(F.col(ds).desc()).limit(rows)
    return tail.agg(*[F.avg(c).alias(c) for c in cols]).unpivot([], list(cols), "indicator", "level")
