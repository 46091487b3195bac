"""Which features move a prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..models.linear import linear_value
from ..spec import DEFAULT, PanelSpec


def linear_contributions(rows: DataFrame, model: DataFrame, xs: Sequence[str], spec: PanelSpec = DEFAULT) -> DataFrame:
    """Exact contributions coef * (x - mean) of a linear model, long by feature."""
    parts = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), (F.col("coef")[i] * (F.col(c) - F.col("means")[i])).alias("contribution"))
            for i, c in enumerate(xs)
        ]
    )
    joined = rows.join(model.select(*spec.keys, "coef", "means"), list(spec.keys))
    return joined.select(*spec.keys, spec.ds, F.explode(parts).alias("p")).select(*spec.keys, spec.ds, "p.feature", "p.contribution")


def contribution_rank(contributions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    return contributions.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("importance")).orderBy(
        *by, F.col("importance").desc(), "feature"
    )


def permutation_importance(rows: DataFrame, model: DataFrame, xs: Sequence[str], seed: int = 42, spec: PanelSpec = DEFAULT) -> DataFrame:
    """Rise of the RMSE when one feature is shuffled inside its series.

    The shuffle pairs date order with hash order, so it is the same on every run.
    """
    w = spec.ordered()
    h = Window.partitionBy(*spec.keys).orderBy(F.xxhash64(F.col(spec.ds), F.lit(seed)), spec.ds)
    num = rows.withColumns({"_i": F.row_number().over(w), "_j": F.row_number().over(h)})
    other = num.select(*spec.keys, F.col("_j").alias("_i"), *[F.col(c).alias(f"_s_{c}") for c in xs])
    both = num.join(other, [*spec.keys, "_i"]).join(model.select(*spec.keys, "intercept", "coef"), list(spec.keys))
    err = lambda cols: F.sqrt(F.avg(F.pow(spec.value - linear_value(cols), 2)))
    plain = [F.col(c) for c in xs]
    shuffled = [[F.col(f"_s_{c}") if j == i else F.col(c) for j, c in enumerate(xs)] for i in range(len(xs))]
    one = both.agg(
        err(plain).alias("base"), F.array(*[F.struct(F.lit(c).alias("feature"), err(cols).alias("rmse")) for c, cols in zip(xs, shuffled)]).alias("f")
    )
    return one.select("base", F.explode("f").alias("e")).select("e.feature", (F.col("e.rmse") - F.col("base")).alias("importance"))


def sensitivity_matrix(importances: DataFrame, features: Sequence[str], key: str = "series") -> DataFrame:
    """Series by feature, 0 where a series has no value for a feature."""
    return importances.groupBy(key).pivot("feature", list(features)).agg(F.first("importance")).na.fill(0.0)
