"""Joins that bring history, indicators, calendars and scenarios onto one grain."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_ends_after, month_ends_between
from ..session import ensure_checkpoint_dir
from ..spec import DEFAULT, PanelSpec
from .clean import fill_both


def merge_indicators(
    panel: DataFrame, indicators: DataFrame, how: str = "left", fill: bool = False, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Join a one-row-per-month indicator table to the panel by date.

    A small indicator table is broadcast by its measured size; there is no hint.
    """
    out = panel.join(indicators, spec.ds, how)
    if not fill:
        return out
    return fill_both(out, [c for c in indicators.columns if c != spec.ds], spec)


def annual_to_monthly(months: DataFrame, annual: DataFrame, default: float, name: str, ds: str = "ds") -> DataFrame:
    """Give each month the value of its year, else of the last available year, else `default`.

    `annual` is one row per year of one indicator: (year, value).
    """
    # years of a calendar: a map of them is small and read once
    known = annual.filter(F.col("value").isNotNull())
    table = known.agg(
        F.struct(
            F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("bigint"), "value"))).alias("by_year"),
            F.max_by("value", "year").alias("last"),
        ).alias("t")
    ).scalar()
    own = F.try_element_at(F.col("_t.by_year"), F.year(ds).cast("bigint"))
    return (
        months.withColumn("_t", table)
        .withColumn(name, F.coalesce(own, F.col("_t.last"), F.lit(float(default))))
        .drop("_t")
    )


#: Rows of one (key, month) that are filled in one piece.
PIECE_ROWS = 1_000_000


def asof_backward(
    left: DataFrame, right: DataFrame, on: str, value: str, by: Sequence[str] = (), default: float | None = None, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """For every left row the latest right value at or before it, per `by` key.

    Rows are cut into calendar months, and a (key, month) with more than `piece_rows` rows further into ranges of `on` between
    approximate percentiles. Each piece is filled on its own; what it inherits comes from the last values of the pieces before it,
    which are one row per piece. A hot key, or a hot month of it, is therefore spread over many tasks; rows of one
    moment stay together.
    """
    keys = list(by)
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast("double")})
    r = right.select(*keys, on, F.col(value).cast("double").alias("_v"), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_m", F.trunc(on, "month"))
    ensure_checkpoint_dir(left.sparkSession)
    grain = [F.col(k) for k in (*keys, "_m")]
    percents = [i / 256 for i in range(1, 256)]
    # kept, since the cuts are read by both branches below; a row for each hot (key, month)
    cuts = both.groupBy(*grain).agg(F.count("*").alias("_n"), F.percentile_approx(on, percents, 2560).alias("_cuts")).where(F.col("_n") > piece_rows).checkpoint()
    both = both.join(cuts.drop("_n"), [*keys, "_m"], "left") if not cuts.isEmpty() else both.withColumn("_cuts", F.lit(None))
    hot = F.size(F.filter("_cuts", lambda c: c <= F.col(on))) if dict(both.dtypes)["_cuts"] != "void" else F.lit(0)
    both = both.withColumn("_p", F.when(F.col("_cuts").isNotNull(), hot).otherwise(0)).drop("_cuts")
    piece = [*keys, "_m", "_p"]
    within = Window.partitionBy(*piece).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col("_v").isNotNull(), F.col(on))
    closes = both.groupBy(*piece).agg(F.max_by("_v", known).alias("_close"))
    before = Window.partitionBy(*keys).orderBy("_m", "_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = closes.select(*piece, F.last("_close", ignorenulls=True).over(before).alias("_carry"))
    filled = both.withColumn("_in", F.last("_v", ignorenulls=True).over(within)).filter("_side = 1")
    got = F.coalesce("_in", "_carry") if default is None else F.coalesce("_in", "_carry", F.lit(float(default)))
    return (
        filled.join(carry, piece, "left")
        .withColumn(value, got)
        .select(*left.columns, value)
    )


def holiday_flags(df: DataFrame, holidays: DataFrame, flags: Sequence[str], ds: str = "ds") -> DataFrame:
    """0/1 flags for months that hold a holiday; `holidays` is (year, month, flag).

    One row per month and flag: bounded by the calendar, so it is broadcast.
    """
    marks = holidays.groupBy(F.col("year").alias("_y"), F.col("month").alias("_m")).agg(
        *[F.max(F.when(F.col("flag") == f, 1)).alias(f) for f in flags]
    )
    return (
        df.join(F.broadcast(marks), (F.year(ds) == F.col("_y")) & (F.month(ds) == F.col("_m")), "left")
        .drop("_y", "_m")
        .withColumns({f: F.coalesce(F.col(f), F.lit(0)).cast("bigint") for f in flags})
    )


def calendar_assembly(frames: dict[str, DataFrame], ds: str = "ds") -> DataFrame:
    """Put many (ds, value) series side by side on the master calendar spanned by all of them.

    The series are stacked and pivoted in one aggregation instead of joined one after another.
    """
    names = list(frames)
    stacked = None
    for name, frame in frames.items():
        part = frame.select(F.last_day(ds).alias(ds), F.col("value").cast("double").alias("value"), F.lit(name).alias("_n"))
        stacked = part if stacked is None else stacked.unionByName(part)
    wide = stacked.groupBy(ds).agg(*[F.max(F.when(F.col("_n") == n, F.col("value"))).alias(n) for n in names])
    span = wide.agg(F.min(ds).alias("_lo"), F.max(ds).alias("_hi"))
    master = span.select(F.explode(month_ends_between(F.col("_lo"), F.col("_hi"))).alias(ds))
    return master.join(wide, ds, "left")


def month_axis(df: DataFrame, month: str = "month") -> DataFrame:
    """Twelve rows, January to December; months without data stay null."""
    axis = df.sparkSession.range(1, 13).select(F.col("id").alias(month))
    return axis.join(df, month, "left")


def future_calendar(panel: DataFrame, horizon: int, align: str = "series", spec: PanelSpec = DEFAULT) -> DataFrame:
    """`horizon` month ends per series after its own last date (or after the global last date)."""
    last = panel.groupBy(*spec.keys).agg(F.max(spec.ds).alias("_last"))
    if align == "global":
        last = last.withColumn("_last", panel.agg(F.max(spec.ds)).scalar())
    return last.select(
        *spec.keys, F.posexplode(month_ends_after(F.col("_last"), horizon)).alias("_p", spec.ds)
    ).select(*spec.keys, (F.col("_p") + 1).cast("bigint").alias("step"), spec.ds)


def repeat_last(indicators: DataFrame, horizon: int, ds: str = "ds") -> DataFrame:
    """Business as usual: the last indicator row repeated for every future month."""
    cols = [c for c in indicators.columns if c != ds]
    last = indicators.agg(F.max(ds).alias("_last"), *[F.max_by(c, ds).alias(c) for c in cols])
    return last.select(F.explode(month_ends_after(F.col("_last"), horizon)).alias(ds), *cols)


def full_outer_delta(a: DataFrame, b: DataFrame, on: list[str], col: str, names: tuple[str, str]) -> DataFrame:
    """Align two per-key aggregates, keep keys of either side, and compare them."""
    left = a.select(*on, F.col(col).alias(names[0]))
    right = b.select(*on, F.col(col).alias(names[1]))
    x, y = F.col(names[0]), F.col(names[1])
    return left.join(right, on, "full").withColumns(
        {"delta": y - x, "delta_pct": F.try_divide(y - x, x) * 100}
    )


def rule_breaches(long: DataFrame, rules: DataFrame, indicator: str = "indicator", value: str = "value") -> DataFrame:
    """Rows of a long indicator table outside the [min, max] of their rule.

    `rules` holds one row per indicator name, i.e. per column of a table.
    """
    v = F.col(value)
    return (
        long.join(rules, indicator)
        .filter((v < F.col("min")) | (v > F.col("max")))
        .withColumn("issue", F.when(v < F.col("min"), "too low").otherwise("too high"))
    )


def isin_or_semi(df: DataFrame, col: str, values: Iterable[str] | DataFrame) -> DataFrame:
    """Multi-value selection: a literal list, or a semi join when the list is a table."""
    if isinstance(values, DataFrame):
        return df.join(values.select(col), col, "left_semi")
    return df.filter(F.col(col).isin(list(values)))
