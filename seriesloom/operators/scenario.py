"""What-if levels, joint linear response, comparison, shocks and replays of past moves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import elasticity_band
from ..models.linear import fit_linear
from ..spec import DEFAULT, PanelSpec


# fixed values: preset levels per scenario
PRESET_INDICATORS = (
    "Inflasi", "Pertumbuhan_Ekonomi", "Kurs_USD", "Harga_Minyak_ICP", "SBN_10Y", "Lifting_Minyak", "Lifting_Gas", "IHSG",
    "BI_Rate", "Harga_Batubara", "Harga_CPO", "Ekspor_Growth", "Impor_Growth", "Konsumsi_RT_Growth", "PMI_Manufaktur",
)
PRESET_LEVELS = {
    "Economic Crisis": (8.5, 2.0, 17500.0, 45.0, 8.5, 550.0, 950.0, 5500.0, 7.5, 90.0, 650.0, -2.0, -3.0, 2.5, 45.0),
    "Optimistic Growth": (2.5, 6.5, 14000.0, 95.0, 6.0, 650.0, 1100.0, 8500.0, 5.5, 180.0, 950.0, 8.0, 7.0, 6.0, 55.0),
    "Commodity Boom": (4.5, 5.8, 14500.0, 120.0, 6.5, 620.0, 1050.0, 7800.0, 6.0, 220.0, 1100.0, 9.5, 6.5, 5.5, 53.5),
    "Moderate Baseline": (3.0, 5.0, 15000.0, 80.0, 6.6, 605.0, 1005.0, 7300.0, 6.25, 145.0, 820.0, 5.0, 4.0, 4.9, 51.0),
    "Stagflation": (7.0, 3.0, 16500.0, 110.0, 7.8, 580.0, 980.0, 6200.0, 7.0, 160.0, 900.0, 3.5, 2.0, 3.2, 48.5),
}
# fixed values: relative presets as (indicator, operation, argument)
RELATIVE_PRESETS = {
    "Normal": (),
    "Optimis": (
        ("Pertumbuhan_Ekonomi", "add", 1.2), ("Kurs_USD", "add", -500.0), ("Harga_Minyak_ICP", "add", 5.0), ("IHSG", "mul", 1.05),
        ("SBN_10Y", "add", -0.5), ("PMI_Manufaktur", "set", 53.0), ("Harga_CPO", "mul", 1.1),
    ),
    "Krisis": (
        ("Inflasi", "add", 4.0), ("Pertumbuhan_Ekonomi", "add", -2.5), ("Kurs_USD", "add", 1500.0), ("Harga_Minyak_ICP", "add", 20.0),
        ("IHSG", "mul", 0.8), ("SBN_10Y", "add", 2.0), ("PMI_Manufaktur", "set", 45.0), ("Harga_CPO", "mul", 0.8),
    ),
}


def preset_rows() -> list[tuple[str, str, str, float]]:
    """All presets as scenario rows (scenario, indicator, op, arg)."""
    rows = [(s, i, "set", v) for s, levels in PRESET_LEVELS.items() for i, v in zip(PRESET_INDICATORS, levels)]
    # a preset without changes keeps one rule that changes nothing, so that it stays a scenario
    unchanged = ((PRESET_INDICATORS[0], "mul", 1.0),)
    return rows + [(s, *r) for s, changes in RELATIVE_PRESETS.items() for r in changes or unchanged]


def apply_levels(base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Levels of every indicator under every scenario: set, add or mul, unchanged where not named.

    Both tables are small by nature (columns of a table, named scenarios); the scenario rules
    become one array that each base level looks up, so nothing is crossed.
    """
    rules = scenarios.groupBy("scenario").agg(
        F.map_from_entries(F.collect_list(F.struct("indicator", F.struct("op", "arg").alias("r")))).alias("rules")
    )
    packed = rules.agg(F.sort_array(F.collect_list(F.struct("scenario", F.map_entries("rules").alias("rules"))))).scalar()
    each = base.withColumn("s", F.explode(packed))
    rule = F.element_at(F.filter(F.col("s.rules"), lambda e: e["key"] == F.col("indicator")), 1)
    each = each.withColumn("r", F.when(F.exists(F.col("s.rules"), lambda e: e["key"] == F.col("indicator")), rule["value"]))
    level = (
        F.when(F.col("r.op") == "set", F.col("r.arg"))
        .when(F.col("r.op") == "add", F.col("level") + F.col("r.arg"))
        .when(F.col("r.op") == "mul", F.col("level") * F.col("r.arg"))
        .otherwise(F.col("level"))
    )
    return each.select(F.col("s.scenario").alias("scenario"), "indicator", F.col("level").alias("base_level"), level.alias("level"))


def response(merged: DataFrame, indicators: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Effect of each indicator on the value per series, (keys, indicator, beta), from one regression on all of them.

    Indicators that move together share their effect instead of counting it twice. One pass over the panel;
    rows with a null in the value or in an indicator are left out, a constant indicator has no effect.
    """
    model = fit_linear(merged, indicators, spec.y, spec.keys)
    named = F.arrays_zip(F.array(*map(F.lit, indicators)).alias("indicator"), F.col("coef").alias("beta"))
    return model.select(*spec.keys, F.explode(named).alias("b")).select(*spec.keys, "b.indicator", "b.beta")


def score(forecast: DataFrame, betas: DataFrame, levels: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Move a base forecast by sum(beta * (level - base level)) per scenario.

    The effect is one number per (scenario, series) before it meets the forecast rows; a series
    without betas stays where it is under every scenario. Bounds `lo` and `hi`, where the forecast has
    them, move with it.
    """
    moved = betas.join(levels, "indicator").groupBy(*spec.keys, "scenario").agg(
        F.sum(F.col("beta") * (F.col("level") - F.col("base_level"))).alias("_e")
    )
    names = levels.agg(F.sort_array(F.collect_set("scenario")).alias("s")).scalar()  # named scenarios: a handful
    each = forecast.withColumn("scenario", F.explode(names))
    effect = F.coalesce("_e", F.lit(0.0))
    value = [(F.col(c) + effect).alias(c) for c in ("yhat", "lo", "hi") if c in forecast.columns]
    return each.join(moved, [*spec.keys, "scenario"], "left").select("scenario", *spec.keys, spec.ds, *value)


def totals_by(scored: DataFrame, scenario: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    return scored.filter(F.col("scenario") == scenario).groupBy(*spec.keys).agg(F.sum("yhat").alias("total"))


def compare(scored: DataFrame, a: str, b: str, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Per-series totals of two scenarios, their difference and percent difference, from one scan."""
    side = lambda s: F.sum(F.when(F.col("scenario") == s, F.col("yhat")))
    t = scored.filter(F.col("scenario").isin(a, b)).groupBy(*spec.keys).agg(side(a).alias("total_a"), side(b).alias("total_b"))
    d = F.col("total_b") - F.col("total_a")
    return t.withColumns({"delta": d, "delta_pct": F.try_divide(d, F.col("total_a")) * 100})


def consensus(scored: DataFrame, probabilities: dict[str, float], ds: str = "ds") -> DataFrame:
    """Probability-weighted total per date."""
    p = F.element_at(F.create_map(*[x for k, v in probabilities.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("scenario"))
    return scored.filter(F.col("scenario").isin(list(probabilities))).groupBy(ds).agg(F.sum(p * F.col("yhat")).alias("yhat"))


def shock_effects(betas: DataFrame, levels: DataFrame, factors: Sequence[float], horizon: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Change of the horizon total when one indicator is multiplied by a factor: all shocks in one job."""
    grid = betas.join(levels.select("indicator", "level"), "indicator")
    grid = grid.withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    return grid.withColumn("effect", F.col("beta") * (F.col("level") * F.col("factor") - F.col("level")) * horizon).select(
        *spec.keys, "indicator", "factor", "effect"
    )


def tornado(betas: DataFrame, levels: DataFrame, horizon: int, pct: float = 0.10) -> DataFrame:
    """Effect of +-pct on the grand total per indicator and the range between them, largest range first."""
    e = shock_effects(betas, levels, (1 + pct, 1 - pct), horizon)
    up, down = F.col("factor") > 1, F.col("factor") < 1
    t = e.groupBy("indicator").agg(
        F.sum(F.when(up, F.col("effect"))).alias("up"), F.sum(F.when(down, F.col("effect"))).alias("down")
    )
    return t.withColumn("spread", F.abs(F.col("up") - F.col("down"))).orderBy(F.col("spread").desc(), "indicator")


def elasticity(forecast: DataFrame, betas: DataFrame, levels: DataFrame, horizon: int, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Percent change of each series' total for +1 % on one indicator, with its class."""
    total = forecast.groupBy(*spec.keys).agg(F.sum("yhat").alias("total"))
    e = shock_effects(betas, levels, (1.01,), horizon, spec).join(total, list(spec.keys))
    pct = F.coalesce(F.try_divide(F.col("effect"), F.col("total")) * 100, F.lit(0.0))
    return e.select(*spec.keys, "indicator", "effect", pct.alias("elasticity")).withColumn("kind", elasticity_band(F.col("elasticity")))


def replay_paths(history: DataFrame, levels: DataFrame, horizon: int, ds: str = "ds") -> DataFrame:
    """Rows (sim, indicator, step, value): today's level moved as the indicator moved after each past month.

    `history` has (ds, indicator, value), one row per month. A replay is named by its month and exists for
    an indicator if the month's value is not zero and `horizon` months follow it.
    """
    w = Window.partitionBy("indicator").orderBy(ds)
    later = F.array(*[F.lead("value", t).over(w) for t in range(1, horizon + 1)])
    starts = history.withColumn("_next", later).filter((F.col("value") != 0) & ~F.exists("_next", lambda v: v.isNull()))
    path = F.transform("_next", lambda v: F.col("level") * v / F.col("value"))
    rows = starts.join(levels, "indicator").select(F.col(ds).alias("sim"), "indicator", F.posexplode(path).alias("_s", "moved"))
    return rows.select("sim", "indicator", (F.col("_s") + 1).cast("bigint").alias("step"), F.col("moved").alias("value"))


def replay_cube(forecast: DataFrame, betas: DataFrame, levels: DataFrame, paths: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """(sim, keys, ds, yhat): the base forecast moved along every replay; a series without betas does not move."""
    moves = paths.join(levels.select("indicator", F.col("level").alias("_now")), "indicator")
    effects = moves.join(betas, "indicator").groupBy(*spec.keys, "sim", "step").agg(F.sum(F.col("beta") * (F.col("value") - F.col("_now"))).alias("_e"))
    per_step = effects.groupBy(*spec.keys, "step").agg(F.collect_list(F.struct("sim", "_e")).alias("_m"))  # one entry per replay
    rows = forecast.join(per_step, [*spec.keys, "step"], "left").select(*spec.keys, spec.ds, "yhat", F.explode_outer("_m").alias("m"))
    return rows.select(F.col("m.sim").alias("sim"), *spec.keys, spec.ds, (F.col("yhat") + F.coalesce("m._e", F.lit(0.0))).alias("yhat"))


def bands_of_cube(cube: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Mean and percentiles 5, 25, 50, 75, 95 per (series, ds) of long (sim, keys, ds, yhat) rows of any origin."""
    probs = [0.05, 0.25, 0.5, 0.75, 0.95]
    g = cube.groupBy(*spec.keys, spec.ds).agg(F.avg("yhat").alias("mean"), F.percentile("yhat", probs).alias("_p"))
    return g.select(*spec.keys, spec.ds, "mean", *[F.col("_p")[i].alias(f"p{int(p * 100):02d}") for i, p in enumerate(probs)])


def end_risk(bands: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Bands of the last forecast month per series and the spread between P95 and P05."""
    cols = ("mean", "p05", "p50", "p95")
    last = bands.groupBy(*spec.keys).agg(F.max(spec.ds).alias(spec.ds), F.max_by(F.struct(*cols), spec.ds).alias("_b"))
    return last.select(*spec.keys, spec.ds, *[F.col("_b")[c].alias(c) for c in cols], (F.col("_b.p95") - F.col("_b.p05")).alias("spread"))
