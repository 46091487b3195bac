"""Exponential smoothing: additive Holt-Winters (fixed or grid) and Theta."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.profile import decompose
from ..spec import DEFAULT, PanelSpec
from .arrays import explode_forecast, history_arrays, mean_of

# a bounded grid of smoothing weights (level, trend, season)
GRID = tuple(product((0.1, 0.3, 0.6), (0.01, 0.1, 0.3), (0.05, 0.2, 0.5)))


def _fold(ys: Column, a: Column, b: Column, g: Column, m: int) -> Column:
    """Run the recursion over the values after the first season; state (l, t, s[m], sse)."""
    first, second = F.slice(ys, 1, m), F.slice(ys, m + 1, m)
    level = mean_of(first)
    start = F.struct(
        level.alias("l"),
        ((mean_of(second) - level) / m).alias("t"),
        F.transform(first, lambda v: v - level).alias("s"),
        F.lit(0.0).alias("sse"),
    )

    def step(st: Column, y: Column) -> Column:
        s0 = st["s"][0]
        l = a * (y - s0) + (1 - a) * (st["l"] + st["t"])
        t = b * (l - st["l"]) + (1 - b) * st["t"]
        s = g * (y - l) + (1 - g) * s0
        miss = y - (st["l"] + st["t"] + s0)
        return F.struct(
            l.alias("l"), t.alias("t"), F.concat(F.slice(st["s"], 2, m - 1), F.array(s)).alias("s"), (st["sse"] + miss * miss).alias("sse")
        )

    return F.aggregate(F.slice(ys, F.lit(m + 1), F.size(ys) - m), start, step)


def _extrapolate(state: Column, horizon: int, m: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.lit(horizon)), lambda h: state["l"] + h * state["t"] + F.get(state["s"], F.pmod(h - 1, F.lit(m)))
    )


def _sets(params: Sequence[tuple[float, float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"), F.lit(float(g)).alias("g")) for a, b, g in params])


def _best(arrays: DataFrame, params: Sequence[tuple[float, float, float]], carry: Sequence[str], spec: PanelSpec) -> DataFrame:
    """Fitted state `st` and weights `p` of the parameter set with the least squared error.

    Every (series, parameter set) is an own row, so the search runs in parallel over both.
    """
    m = spec.season
    tries = arrays.filter(F.size("ys") >= 2 * m).withColumn("p", F.explode(_sets(params)))
    tries = tries.withColumn("st", _fold(F.col("ys"), F.col("p.a"), F.col("p.b"), F.col("p.g"), m)).drop("ys")
    if len(params) == 1:
        return tries
    rank = F.struct(F.col("st.sse"), F.col("p"))
    return tries.groupBy(*spec.keys).agg(F.min_by("st", rank).alias("st"), F.min_by("p", rank).alias("p"), *[F.first(c).alias(c) for c in carry])


def holt_winters(
    df: DataFrame, horizon: int, params: Sequence[tuple[float, float, float]] = GRID, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Additive trend and season; with several parameter sets the one with the least squared error wins.

    Series shorter than two seasons are left out.
    """
    best = _best(history_arrays(df, spec), params, ["last"], spec)
    return explode_forecast(best.withColumn("_f", _extrapolate(F.col("st"), horizon, spec.season)), F.col("_f"), horizon, spec)


def holt_winters_backtest(
    df: DataFrame, periods: int = 12, params: Sequence[tuple[float, float, float]] = GRID, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """(keys, ds, y, yhat) of the last `periods` rows of every series, fitted on the rows before; one pass."""
    full = history_arrays(df, spec, dates=True).filter(F.col("n") > periods)
    cut = full.withColumn("test", F.slice("hist", -periods, periods)).withColumn("ys", F.slice("ys", F.lit(1), F.col("n") - periods)).drop("hist")
    best = _best(cut, params, ["test"], spec).withColumn("_f", _extrapolate(F.col("st"), periods, spec.season))
    pairs = F.zip_with("test", "_f", lambda t, f: F.struct(t[spec.ds].alias(spec.ds), t[spec.y].alias(spec.y), f.alias("yhat")))
    return best.select(*spec.keys, F.explode(pairs).alias("r")).select(*spec.keys, f"r.{spec.ds}", f"r.{spec.y}", "r.yhat")


def holt_winters_fit(df: DataFrame, params: Sequence[tuple[float, float, float]] = GRID, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Chosen weights and squared error per series."""
    best = _best(history_arrays(df, spec), params, [], spec)
    return best.select(*spec.keys, F.col("p.a").alias("alpha"), F.col("p.b").alias("beta"), F.col("p.g").alias("gamma"), F.col("st.sse").alias("sse"))


def theta(df: DataFrame, horizon: int, alphas: Sequence[float] = (0.1, 0.2, 0.3, 0.5, 0.7, 0.9), spec: PanelSpec = DEFAULT) -> DataFrame:
    """Seasonally adjusted series: half the linear drift plus simple smoothing, then season again."""
    m = spec.season
    parts = decompose(df, "multiplicative", spec)
    rows = parts.withColumn("_adj", F.try_divide(spec.value, F.col("seasonal")))
    arrays = (
        rows.groupBy(*spec.keys)
        .agg(F.sort_array(F.collect_list(F.struct(spec.ds, "_adj", "seasonal"))).alias("_h"))
        .select(
            *spec.keys,
            F.transform("_h", lambda r: r["_adj"]).alias("ys"),
            F.transform(F.slice("_h", -m, m), lambda r: r["seasonal"]).alias("season"),
            F.element_at("_h", -1)[spec.ds].alias("last"),
            F.size("_h").alias("n"),
        )
    )
    ys, n = F.col("ys"), F.col("n")
    t_mean = (n - 1) / 2.0
    y_mean = mean_of(ys)
    sxy = F.aggregate(F.zip_with(ys, F.sequence(F.lit(0), n - 1), lambda v, t: (v - y_mean) * (t - t_mean)), F.lit(0.0), lambda s, x: s + x)
    slope = sxy / (n * (n * n - 1) / 12.0)

    def ses(a: Column) -> Column:
        start = F.struct(ys[0].alias("l"), F.lit(0.0).alias("sse"))
        return F.aggregate(
            F.slice(ys, F.lit(2), n - 1), start,
            lambda st, y: F.struct((st["l"] + a * (y - st["l"])).alias("l"), (st["sse"] + (y - st["l"]) * (y - st["l"])).alias("sse")),
        )

    tries = arrays.withColumn("slope", slope).withColumn("a", F.explode(F.array(*[F.lit(float(a)) for a in alphas]))).withColumn("st", ses(F.col("a")))
    best = tries.groupBy(*spec.keys).agg(
        F.min_by(F.struct("st", "a", "slope", "season", "n"), F.struct("st.sse", "a")).alias("b"), F.first("last").alias("last")
    )
    b = F.col("b")
    drift0 = (1 - F.pow(1 - b["a"], b["n"])) / b["a"]
    yhat = F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda h: (b["st"]["l"] + 0.5 * b["slope"] * (h - 1 + drift0)) * F.get(b["season"], F.pmod(h - 1, F.lit(m))),
    )
    return explode_forecast(best.withColumn("_f", yhat), F.col("_f"), horizon, spec)
