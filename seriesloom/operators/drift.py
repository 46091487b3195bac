"""Two-sample Kolmogorov-Smirnov drift between a reference sample and a new one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


#: Distinct values of one range of the running sum.
RANGE_VALUES = 250_000


def ks_statistic(long: DataFrame, k: int = 8, range_values: int = RANGE_VALUES) -> DataFrame:
    """Largest gap of the two empirical distributions per feature, by a running sum in two levels.

    `long` is (feature, sample, value) with sample 0 or 1. Equal values collapse inside the map tasks; the distinct ones are dealt
    out to ranges of (feature, value) of even size, at least `k` and more as their number grows. Each range sums up its own
    counts; what lies before a range comes from the ranges' totals, one small row per feature and range.
    """
    ensure_checkpoint_dir(long.sparkSession)
    rows = long.filter(F.col("value").isNotNull())
    counts = rows.groupBy("feature", "value").agg(F.count_if(F.col("sample") == 0).alias("c0"), F.count_if(F.col("sample") == 1).alias("c1")).checkpoint()
    ranges = max(k, counts.count() // range_values + 1)
    ranged = counts.repartitionByRange(ranges, "feature", "value").withColumn("piece", F.spark_partition_id()).checkpoint()
    totals = ranged.groupBy("feature", "piece").agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"))
    whole = Window.partitionBy("feature")
    before = whole.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "feature", "piece", *[F.coalesce(F.sum(f"t{i}").over(before), F.lit(0)).alias(f"o{i}") for i in (0, 1)], *[F.sum(f"t{i}").over(whole).alias(f"n{i}") for i in (0, 1)]
    )
    run = Window.partitionBy("feature", "piece").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("feature", "piece", *[F.sum(f"c{i}").over(run).alias(f"r{i}") for i in (0, 1)])
    share = lambda i: F.try_divide(F.col(f"o{i}") + F.col(f"r{i}"), F.col(f"n{i}"))
    # a row for each range: small
    gaps = summed.join(F.broadcast(offsets), ["feature", "piece"]).withColumn("gap", F.abs(share(0) - share(1)))
    return gaps.groupBy("feature", "n0", "n1").agg(F.max("gap").alias("stat"))


def ks_p_value(stat: Column, n0: Column, n1: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value; 1 where the series does not converge for a tiny statistic."""
    en = F.sqrt(n0.cast("double") * n1 / (n0 + n1))
    lam = (en + 0.12 + 0.11 / en) * stat
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def drift_report(long: DataFrame, threshold: float = 0.05, k: int = 8) -> DataFrame:
    """Statistic, p-value, per-feature flag and the any-feature flag."""
    ks = ks_statistic(long, k).withColumn("p_value", ks_p_value(F.col("stat"), F.col("n0"), F.col("n1")))
    flagged = ks.withColumn("drift", F.col("p_value") < threshold)
    return flagged.withColumn("any_drift", F.max("drift").over(Window.partitionBy()))


def top_drifted(report: DataFrame, n: int = 4) -> DataFrame:
    return report.orderBy("p_value", F.col("stat").desc(), "feature").limit(n)
