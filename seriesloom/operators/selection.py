"""Hold-out errors, leaderboard, strategies, ensembles and intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import DEFAULT, PanelSpec


def stack(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Tag the predictions of several models with their name and stack them."""
    out = None
    for name, df in parts.items():
        tagged = df.withColumn("model", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def errors(preds: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """RMSE, MAPE and accuracy per (series, model) of hold-out rows (keys, model, ds, y, yhat)."""
    miss = spec.value - F.col("yhat")
    return (
        preds.groupBy(*spec.keys, "model")
        .agg(
            F.sqrt(F.avg(miss * miss)).alias("rmse"),
            F.avg(F.abs(miss) / F.greatest(F.abs(spec.value), F.lit(2.220446049250313e-16))).alias("mape"),
        )
        .withColumn("accuracy", F.greatest(F.lit(0.0), 100 - F.col("mape") * 100))
    )


def leaderboard(preds: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Errors with the rank of each model inside its series (by RMSE, then name)."""
    w = Window.partitionBy(*spec.keys).orderBy("rmse", "model")
    return errors(preds, spec).withColumn("rank", F.row_number().over(w).cast("bigint"))


def ensemble(preds: DataFrame, alpha: float = 0.95, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Mean of the member predictions and their (1 -+ alpha)/2 percentiles per (series, ds)."""
    tails = [(1 - alpha) / 2, alpha + (1 - alpha) / 2]
    return (
        preds.groupBy(*spec.keys, spec.ds)
        .agg(F.avg("yhat").alias("yhat"), F.percentile("yhat", tails).alias("_p"), F.sort_array(F.collect_set("model")).alias("_m"))
        .select(
            *spec.keys, spec.ds, "yhat", F.col("_p")[0].alias("lo"), F.col("_p")[1].alias("hi"),
            F.concat(F.lit("Ensemble ("), F.array_join("_m", ", "), F.lit(")")).alias("model"),
        )
    )


def top_members(preds: DataFrame, board: DataFrame, k: int = 3, spec: PanelSpec = DEFAULT) -> DataFrame:
    return preds.join(board.filter(F.col("rank") <= k).select(*spec.keys, "model"), [*spec.keys, "model"], "left_semi")


def weighted(preds: DataFrame, weights: Mapping[str, float], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Weighted mean over the models named in `weights`, normalised by the weights that are present."""
    w = F.element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("model"))
    return (
        preds.filter(F.col("model").isin(list(weights)))
        .groupBy(*spec.keys, spec.ds)
        .agg(F.try_divide(F.sum(w * F.col("yhat")), F.sum(w)).alias("yhat"))
        .withColumn("model", F.lit("Custom Weighted"))
    )


def inverse_error_weighted(preds: DataFrame, board: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Weights 1/RMSE per series, an option next to the plain mean."""
    rated = preds.join(board.select(*spec.keys, "model", "rmse"), [*spec.keys, "model"])
    w = F.try_divide(F.lit(1.0), F.col("rmse"))
    return rated.groupBy(*spec.keys, spec.ds).agg(F.try_divide(F.sum(w * F.col("yhat")), F.sum(w)).alias("yhat"))


def evaluate(holdout: DataFrame, k: int = 3, spec: PanelSpec = DEFAULT) -> DataFrame:
    """One row per series: best model, top-k members, and both errors of their ensemble.

    The hold-out rows are hashed by series once; the per-model errors, the ranks and the member
    mean per date are windows inside that partitioning.
    """
    keys = list(spec.keys)
    per_model = Window.partitionBy(*keys, "model")
    floor = F.lit(2.220446049250313e-16)
    miss = spec.value - F.col("yhat")
    ape = F.abs(miss) / F.greatest(F.abs(spec.value), floor)
    rows = holdout.repartition(*keys).withColumns(
        {"_rmse": F.sqrt(F.avg(miss * miss).over(per_model)), "_mape": F.avg(ape).over(per_model)}
    )
    rows = rows.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy("_rmse", "model")))
    top, first = F.col("_rank") <= k, F.col("_rank") == 1
    rows = rows.withColumn("_joint", F.avg(F.when(top, F.col("yhat"))).over(Window.partitionBy(*keys, spec.ds)))
    joint_miss = spec.value - F.col("_joint")
    each = F.sort_array(F.collect_set(F.when(top, F.struct("model", "_rmse", "_mape"))))
    out = rows.groupBy(*keys).agg(
        F.max(F.when(first, F.col("model"))).alias("best"),
        F.max(F.when(first, F.col("_rmse"))).alias("best_rmse"),
        F.sqrt(F.avg(F.when(first, joint_miss * joint_miss))).alias("rmse_joint"),
        F.avg(F.when(first, F.abs(joint_miss) / F.greatest(F.abs(spec.value), floor))).alias("mape_joint"),
        each.alias("_top"),
    )
    mean = lambda c: F.aggregate("_top", F.lit(0.0), lambda s, r: s + r[c]) / F.size("_top")
    return out.select(
        *keys, "best", "best_rmse", "rmse_joint", "mape_joint", F.transform("_top", lambda r: r["model"]).alias("members"),
        mean("_rmse").alias("rmse_mean"), mean("_mape").alias("mape_mean"), (F.size("_top") == k).alias("has_ensemble"),
    )


def ensemble_error(holdout: DataFrame, k: int = 3, metric: str = "joint", spec: PanelSpec = DEFAULT) -> DataFrame:
    """Error of the top-k ensemble per series; series with fewer than k models have none.

    "joint" scores the mean of the members' hold-out predictions, "mean" averages their errors.
    """
    return evaluate(holdout, k, spec).filter("has_ensemble").select(
        *spec.keys, F.array_join("members", ", ").alias("members"), F.col(f"rmse_{metric}").alias("rmse"), F.col(f"mape_{metric}").alias("mape")
    )


def with_interval(forecast: DataFrame, pct: float = 0.05) -> DataFrame:
    """Flat bounds where a forecast has no percentile bounds."""
    lo = F.coalesce("lo", F.col("yhat") * (1 - pct)) if "lo" in forecast.columns else F.col("yhat") * (1 - pct)
    hi = F.coalesce("hi", F.col("yhat") * (1 + pct)) if "hi" in forecast.columns else F.col("yhat") * (1 + pct)
    return forecast.withColumns({"lo": lo, "hi": hi})


def with_error_interval(preds: DataFrame, board: DataFrame, z: float = 1.96, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Predictions of the models on the board with bounds of +-z hold-out errors instead of a flat share."""
    rated = preds.join(board.select(*spec.keys, "model", "rmse"), [*spec.keys, "model"])
    return rated.withColumns({"lo": F.col("yhat") - z * F.col("rmse"), "hi": F.col("yhat") + z * F.col("rmse")}).drop("rmse")


def forecast_by_strategy(
    preds: DataFrame, holdout: DataFrame, strategy: str = "auto", manual: str | None = None, members: Sequence[str] = (),
    weights: Mapping[str, float] | None = None, metric: str = "joint", alpha: float = 0.95, spec: PanelSpec = DEFAULT,
) -> DataFrame:
    """The forecast frame (keys, ds, yhat, lo, hi, model, reason) under one selection strategy.

    best      the model with the lowest hold-out RMSE
    ensemble  mean of the top three, the best single where there are fewer
    auto      the ensemble where its error is lower than the best single's
    manual    one named model, the best single tagged "(Fallback)" where it is missing
    custom    mean of the named members, the best single where none exists
    weights   weighted mean of named models

    A series without hold-out rows cannot be ranked: the first of its models by name stands in for the best
    one, and `reason` says so; elsewhere `reason` is null.

    Predictions are read once: they meet one verdict row per series, and one aggregation by
    (series, ds) yields the single, the group mean and the group percentiles together.
    """
    if weights:
        return with_interval(weighted(preds, weights, spec)).withColumn("reason", F.lit(None).cast("string"))
    name = F.col("model")
    in_group = {
        "best": lambda: F.lit(False),
        "ensemble": lambda: F.col("has_ensemble") & F.array_contains("members", name),
        "auto": lambda: F.col("has_ensemble") & (F.col(f"rmse_{metric}") < F.col("best_rmse")) & F.array_contains("members", name),
        "manual": lambda: name == F.lit(manual),
        "custom": lambda: name.isin(list(members)),
    }[strategy]()
    rows = preds.join(evaluate(holdout, spec=spec), list(spec.keys), "left")
    grouped = F.when(in_group, F.col("yhat"))
    g = rows.groupBy(*spec.keys, spec.ds).agg(
        F.coalesce(F.max(F.when(name == F.col("best"), F.col("yhat"))), F.min_by(F.when(F.col("best").isNull(), F.col("yhat")), name)).alias("_one"),
        F.coalesce(F.first("best"), F.min(name)).alias("_best"),
        F.when(F.first("best").isNull(), F.lit("no hold-out rows")).alias("reason"),
        F.avg(grouped).alias("_mean"),
        F.percentile(grouped, [(1 - alpha) / 2, alpha + (1 - alpha) / 2]).alias("_p"),
        F.sort_array(F.collect_set(F.when(in_group, name))).alias("_names"),
    )
    found = F.col("_mean").isNotNull()
    out = g.withColumn("yhat", F.coalesce("_mean", "_one")).filter(F.col("yhat").isNotNull())
    if strategy == "manual":
        out = out.withColumn("model", F.when(found, F.lit(manual)).otherwise(F.concat("_best", F.lit(" (Fallback)"))))
    else:
        joined = F.concat(F.lit("Ensemble ("), F.array_join("_names", ", "), F.lit(")"))
        out = out.withColumns({"model": F.when(found, joined).otherwise(F.col("_best")), "lo": F.col("_p")[0], "hi": F.col("_p")[1]})
    return with_interval(out.drop("_one", "_best", "_mean", "_p", "_names"))


def compare_strategies(a: DataFrame, b: DataFrame, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Two forecasts side by side by (series, ds) with their difference."""
    on = [*spec.keys, spec.ds]
    return (
        a.select(*on, F.col("yhat").alias("yhat_a"))
        .join(b.select(*on, F.col("yhat").alias("yhat_b")), on)
        .withColumn("diff", F.col("yhat_b") - F.col("yhat_a"))
    )


def accuracy_summary(board: DataFrame) -> DataFrame:
    """Mean and best accuracy over the best model of every series."""
    return board.filter(F.col("rank") == 1).agg(F.avg("accuracy").alias("mean_accuracy"), F.max("accuracy").alias("best_accuracy"))
