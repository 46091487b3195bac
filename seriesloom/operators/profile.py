"""What kind of series is it: trend, seasonality, volatility, decomposition, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bands import trend_band, volatility_band
from ..functions.numeric import pct_change
from ..spec import DEFAULT, PanelSpec
from .clean import fill_both


def characteristics(df: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row per series: mean, std, cv, missing %, length, sufficiency, trend, seasonality, volatility."""
    y, w = spec.value, spec.ordered()
    prepared = fill_both(df.withColumn("_raw", y), [spec.y], spec).withColumns(
        {"_t": F.row_number().over(w) - 1, "_lag": F.lag("_raw", spec.season).over(w)}
    )
    n, mean, std = F.count("*"), F.avg("_raw"), F.stddev_samp("_raw")
    slope_pct = F.coalesce(F.try_divide(F.regr_slope(y, F.col("_t")), mean) * 100, F.lit(0.0))
    acf = F.corr(F.when(F.col("_lag").isNotNull(), F.col("_raw")), F.when(F.col("_raw").isNotNull(), F.col("_lag")))
    cv = F.coalesce(F.try_divide(std, mean), F.lit(0.0))
    return prepared.groupBy(*spec.keys).agg(
        n.cast("bigint").alias("n"),
        mean.alias("mean"),
        std.alias("std"),
        cv.alias("cv"),
        (F.count_if(F.col("_raw").isNull()) / n * 100).alias("missing_pct"),
        (n >= 24).alias("sufficient"),
        slope_pct.alias("slope_pct"),
        F.when(n < 2, "insufficient_data").otherwise(trend_band(slope_pct)).alias("trend"),
        F.when(n >= 24, acf).alias("acf_season"),
        ((n >= 24) & F.coalesce(acf > 0.5, F.lit(False))).alias("seasonal"),
        volatility_band(cv).alias("volatility"),
    )


# fixed values: names offered as model and feature suggestions
SEASONAL_MODELS = ("Prophet", "SARIMAX")
TREE_MODELS = ("XGBoost", "LightGBM", "Random Forest")
LINEAR_MODELS = ("Linear Regression", "Ridge")
LONG_MODEL = "LSTM"
ENSEMBLE = "Ensemble (Top 3)"


def _list(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def _all(cond: Column, names: tuple[str, ...]) -> list[Column]:
    return [F.when(cond, n) for n in names]


def suggestions(chars: DataFrame) -> DataFrame:
    """Model, feature and validation suggestions per series, in rule order, at most five models."""
    seasonal, n = F.col("seasonal"), F.col("n")
    models = _list(
        *_all(seasonal, SEASONAL_MODELS),
        *_all(F.col("volatility").isin("medium", "high"), TREE_MODELS),
        *_all((F.col("trend") == "stable") & (F.col("volatility") == "low"), LINEAR_MODELS),
        F.when(n > 60, LONG_MODEL),
        F.lit(ENSEMBLE),
    )
    trending = F.col("trend").isin("increasing", "decreasing")
    features = _list(
        F.lit("time parts"), F.lit("lags 1, 3, 6, 12"),
        *_all(seasonal, ("seasonal decomposition", "sin/cos month")),
        *_all(trending, ("rolling mean and std", "trend index")),
        *_all(F.col("volatility") == "high", ("rolling std", "outlier flag")),
        F.lit("indicators"), F.lit("holiday flags"),
    )
    return chars.withColumns(
        {
            "models": F.slice(models, 1, 5),
            "features": features,
            "validation": F.when(n > 60, "walk-forward").otherwise("holdout"),
            "search": F.when(n > 40, "sampler").otherwise("grid"),
        }
    )


# fixed values: suggested search ranges (model, parameter, choices)
SEARCH_RANGES = (
    ("XGBoost", "n_estimators", "100, 200, 300"), ("XGBoost", "max_depth", "3, 5, 7"), ("XGBoost", "learning_rate", "0.01, 0.05, 0.1"), ("XGBoost", "subsample", "0.8, 0.9, 1.0"),
    ("Prophet", "changepoint_prior_scale", "0.05, 0.1, 0.5"), ("Prophet", "seasonality_prior_scale", "1.0, 5.0, 10.0"),
    ("Random Forest", "n_estimators", "100, 200"), ("Random Forest", "max_depth", "none, 10, 20"), ("Random Forest", "min_samples_split", "2, 5, 10"),
)


def recommend_ranges(chars: DataFrame) -> DataFrame:
    """(keys..., model, parameter, choices): search ranges of the models that a series is advised to use; the season's mode follows its volatility."""
    mode = F.when(F.col("volatility") == "high", "multiplicative").otherwise("additive")
    entry = lambda model, name, choices: F.struct(F.lit(model).alias("model"), F.lit(name).alias("parameter"), choices.alias("choices"))
    ranges = F.array(*[entry(m, p, F.lit(c)) for m, p, c in SEARCH_RANGES], entry("Prophet", "seasonality_mode", mode))
    advised = F.filter(ranges, lambda r: F.array_contains("models", r["model"]))
    keep = [c for c in suggestions(chars).columns if c in ("series",)]
    return suggestions(chars).select(*keep, F.inline(advised))


def quality_advice(missing_pct: Column, outliers: Column) -> Column:
    """Advice lines from the share of missing values and the number of outliers."""
    advice = _list(
        *_all(missing_pct > 10, ("HIGH: much is missing", "fill forward or interpolate", "drop incomplete periods")),
        *_all((missing_pct > 0) & (missing_pct <= 10), ("MEDIUM: some is missing", "interpolate small gaps")),
        *_all(outliers > 5, ("HIGH: many outliers", "check entry errors and real events", "use robust models")),
        *_all((outliers > 0) & (outliers <= 5), ("MEDIUM: few outliers", "review flagged points")),
    )
    return F.when(F.size(advice) == 0, F.array(F.lit("data quality looks good"))).otherwise(advice)


def decompose(df: DataFrame, model: str = "additive", spec: PanelSpec = DEFAULT) -> DataFrame:
    """Classical decomposition by a centred 2x12 moving average; series under 24 rows are left out.

    The first and last six trend values are null. The series must have no gaps (`densify`).
    """
    y, w, half = spec.value, spec.ordered(), spec.season // 2
    n = F.count("*").over(spec.whole())
    inner = w.rowsBetween(-(half - 1), half - 1)
    ends = (F.lag(spec.y, half).over(w) + F.lead(spec.y, half).over(w)) * 0.5
    trend = (F.sum(spec.y).over(inner) + ends) / spec.season
    mul = model == "multiplicative"
    base = (
        df.withColumns({"_n": n, "trend": trend, "phase": ((F.row_number().over(w) - 1) % spec.season).cast("bigint")})
        .filter(F.col("_n") >= 2 * spec.season)
        .drop("_n")
        .withColumn("_d", F.try_divide(y, F.col("trend")) if mul else y - F.col("trend"))
    )
    phase = Window.partitionBy(*spec.keys, "phase")
    out = base.withColumns({"_s": F.avg("_d").over(phase), "_k": F.count("*").over(phase)})
    # every phase counts once in the centre, however many rows it has
    centre = F.sum(F.col("_s") / F.col("_k")).over(spec.whole()) / spec.season
    out = out.withColumn("seasonal", F.try_divide(F.col("_s"), centre) if mul else F.col("_s") - centre)
    if mul:
        resid = F.try_divide(y, F.col("trend") * F.col("seasonal"))
    else:
        resid = y - F.col("trend") - F.col("seasonal")
    return out.select(*spec.keys, spec.ds, spec.y, "phase", "trend", "seasonal", resid.alias("resid"))


def indicator_volatility(long: DataFrame, floor: float = 0.01, ds: str = "ds") -> DataFrame:
    """Deviation of the step-to-step percent change per indicator; `floor` where there is none."""
    spec = PanelSpec(keys=("indicator",), ds=ds, y="value")
    filled = fill_both(long, ["value"], spec).withColumn("_g", pct_change(F.col("value"), spec.ordered()))
    return filled.groupBy("indicator").agg(F.coalesce(F.stddev_samp("_g"), F.lit(float(floor))).alias("vol"))
