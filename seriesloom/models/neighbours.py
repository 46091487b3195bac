"""k-nearest-neighbour regression inside each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.features import ml_features
from ..spec import DEFAULT, PanelSpec
from .arrays import explode_forecast


def knn(
    df: DataFrame, features: Sequence[str], k: int = 5, p: int = 2, weights: str = "uniform", part: str = "part", spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Predict the test rows of every series from the k training rows with the nearest features.

    The training rows of a series (at most one a month) travel as one array next to the test row;
    distances are computed and cut to k inside that row, so no pair of rows is ever emitted.
    """
    xs = F.array(*[F.col(c).cast("double") for c in features])
    train = (
        df.filter(F.col(part) == "train").groupBy(*spec.keys)
        .agg(F.collect_list(F.struct(xs.alias("x"), F.col(spec.ds).alias("d"), spec.value.alias("y"))).alias("_t"))
    )
    test = df.filter(F.col(part) == "test").withColumn("_q", xs)

    def dist(row: Column) -> Column:
        diff = F.zip_with(row["x"], F.col("_q"), lambda a, b: F.abs(a - b) if p == 1 else (a - b) * (a - b))
        total = F.aggregate(diff, F.lit(0.0), lambda s, v: s + v)
        return total if p == 1 else F.sqrt(total)

    near = F.slice(F.array_sort(F.transform("_t", lambda r: F.struct(dist(r).alias("dist"), r["d"].alias("d"), r["y"].alias("y")))), 1, k)
    joined = test.join(train, list(spec.keys)).withColumn("_n", near)
    if weights == "distance":
        w = lambda r: 1.0 / F.greatest(r["dist"], F.lit(1e-12))
    else:
        w = lambda r: F.lit(1.0)
    num = F.aggregate("_n", F.lit(0.0), lambda s, r: s + w(r) * r["y"])
    den = F.aggregate("_n", F.lit(0.0), lambda s, r: s + w(r))
    return joined.withColumn("yhat", num / den).drop("_q", "_t", "_n")


def recursive_knn(
    df: DataFrame, horizon: int, lags: Sequence[str] = ("lag_1", "lag_2", "lag_3"), k: int = 5, spec: PanelSpec = DEFAULT
) -> DataFrame:
    """Future values (keys, step, ds, yhat): each is the mean of the k rows whose scaled lags are nearest to the values before it."""
    depth = max(int(c[4:]) for c in lags)
    rows = ml_features(df, depth, spec=spec)
    xs = F.array(*[F.col(c).cast("double") for c in lags])
    tail = F.max_by(F.array(*[F.col(f"lag_{i}") for i in range(depth - 1, 0, -1)], spec.value), F.col(spec.ds))
    series = rows.groupBy(*spec.keys).agg(
        F.array(*[F.avg(c) for c in lags]).alias("_m"), F.array(*[F.stddev_pop(c) for c in lags]).alias("_s"),
        F.collect_list(F.struct(xs.alias("x"), F.col(spec.ds).alias("d"), spec.value.alias("y"))).alias("_t"),
        tail.alias("tail"), F.max(spec.ds).alias("last"),
    )
    scaled = lambda x, i: F.when(F.get("_s", i) > 0, (x - F.get("_m", i)) / F.get("_s", i)).otherwise(x - F.get("_m", i))
    train = F.transform("_t", lambda r: F.struct(F.transform(r["x"], scaled).alias("z"), r["d"].alias("d"), r["y"].alias("y")))
    series = series.withColumn("_z", train)

    def step(acc: Column, _: Column) -> Column:
        query = F.array(*[scaled(F.element_at(acc, -int(c[4:])), F.lit(i)) for i, c in enumerate(lags)])

        def distance(r: Column) -> Column:
            squares = F.zip_with(r["z"], query, lambda a, b: (a - b) * (a - b))
            return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, v: total + v))

        near = F.slice(F.array_sort(F.transform("_z", lambda r: F.struct(distance(r).alias("dist"), r["d"].alias("d"), r["y"].alias("y")))), 1, k)
        mean = F.aggregate(near, F.lit(0.0), lambda total, r: total + r["y"]) / F.size(near)
        return F.concat(acc, F.array(mean))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("tail"), step)
    return explode_forecast(series.withColumn("_f", F.slice(folded, depth + 1, horizon)), F.col("_f"), horizon, spec)


def knn_search(
    df: DataFrame, features: Sequence[str], ks: Sequence[int] = (3, 5, 10, 20), ps: Sequence[int] = (1, 2),
    weights: Sequence[str] = ("uniform", "distance"), spec: PanelSpec = DEFAULT,
) -> DataFrame:
    """Hold-out RMSE per series and setting of a bounded grid, with its rank inside the series.

    The training rows of a series travel once; for each distance the nearest rows are put in order once, cut to the largest k, and
    every k and weighting is read from them.
    """
    xs = F.array(*[F.col(c).cast("double") for c in features])
    most = max(ks)
    train = (
        df.filter("part = 'train'").groupBy(*spec.keys)
        .agg(F.collect_list(F.struct(xs.alias("x"), F.col(spec.ds).alias("d"), spec.value.alias("y"))).alias("_t"))
    )
    test = df.filter("part = 'test'").select(*spec.keys, spec.ds, spec.y, xs.alias("_q")).join(train, list(spec.keys))

    def nearest(p: int) -> Column:
        def dist(row: Column) -> Column:
            diff = F.zip_with(row["x"], F.col("_q"), lambda a, b: F.abs(a - b) if p == 1 else (a - b) * (a - b))
            total = F.aggregate(diff, F.lit(0.0), lambda s, v: s + v)
            return total if p == 1 else F.sqrt(total)

        return F.slice(F.array_sort(F.transform("_t", lambda r: F.struct(dist(r).alias("dist"), r["d"].alias("d"), r["y"].alias("y")))), 1, most)

    near = test.select(*spec.keys, spec.y, F.explode(F.array(*[F.struct(F.lit(p).alias("p"), nearest(p).alias("n")) for p in ps])).alias("_n"))
    near = near.select(*spec.keys, spec.y, F.col("_n.p").alias("p"), F.col("_n.n").alias("_n"))

    def guess(k: int, how: str) -> Column:
        w = (lambda r: 1.0 / F.greatest(r["dist"], F.lit(1e-12))) if how == "distance" else (lambda r: F.lit(1.0))
        cut = F.slice("_n", 1, k)
        return F.aggregate(cut, F.lit(0.0), lambda s, r: s + w(r) * r["y"]) / F.aggregate(cut, F.lit(0.0), lambda s, r: s + w(r))

    tried = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(how).alias("weights"), F.pow(spec.value - guess(k, how), 2).alias("e")) for how in weights for k in ks])
    scored = near.select(*spec.keys, "p", F.explode(tried).alias("_r")).groupBy(*spec.keys, "_r.k", "p", "_r.weights").agg(F.sqrt(F.avg("_r.e")).alias("rmse"))
    rank = F.row_number().over(Window.partitionBy(*spec.keys).orderBy("rmse", "k", "p", "weights"))
    return scored.withColumn("rank", rank.cast("bigint"))
