"""Classification of numbers into named bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accuracy_band(pct: Column) -> Column:
    return F.when(pct >= 90, "green").when(pct >= 75, "amber").otherwise("red")


def growth_band(g: Column) -> Column:
    return F.when(g >= 0, "up").otherwise("down")


def freshness_band(age_hours: Column) -> Column:
    return F.when(age_hours < 24, "fresh").when(age_hours < 168, "aging").otherwise("stale")


def volatility_band(cv: Column) -> Column:
    return F.when(cv < 0.1, "low").when(cv < 0.3, "medium").otherwise("high")


def score_severity(score: Column) -> Column:
    return F.when(score > 0.8, "High").when(score > 0.5, "Medium").otherwise("Low")


def sigma_severity(sigmas: Column) -> Column:
    return F.when(sigmas > 3, "High").when(sigmas > 2, "Medium").otherwise("Low")


def trend_band(slope_pct: Column) -> Column:
    return F.when(F.abs(slope_pct) < 1, "stable").when(slope_pct > 1, "increasing").otherwise("decreasing")


def elasticity_band(e: Column) -> Column:
    return F.when(e > 0.5, "elastic").when(e < -0.5, "inverse").otherwise("inelastic")
