import math

import numpy as np
import pytest
from panels import month_end
from pyspark.sql import functions as F

from seriesloom.operators import drift, forest, profile, quality, report
from seriesloom.operators.quantiles import exact_quantiles


def test_injected_outliers_are_found(make_panel):
    rng = np.random.default_rng(42)
    y = rng.normal(100, 10, 100)
    y[10], y[50] = 200, 20
    p = make_panel({"a": list(y)})
    z = {r["ds"] for r in quality.anomaly_z(p).filter("is_z").collect()}
    iqr = {r["ds"] for r in quality.anomaly_iqr(p).filter("is_iqr").collect()}
    assert {month_end(10), month_end(50)} <= z and {month_end(10), month_end(50)} <= iqr
    voted = quality.vote(quality.anomaly_iqr(quality.anomaly_z(p)), ["is_z", "is_iqr"])
    high = voted.filter("is_anomaly").collect()
    assert {r["severity"] for r in high} == {"High"} and len(high) >= 2
    text = quality.explain(p).orderBy(F.col("sigmas").desc()).first()
    assert text["direction"] in ("above", "below") and text["severity"] == "High"


def test_flat_and_single_row_series_have_no_anomaly(make_panel):
    p = make_panel({"flat": [5] * 20, "one": [3]})
    assert quality.anomaly_z(p).filter("is_z").count() == 0
    assert quality.anomaly_iqr(p).filter("is_iqr").count() == 0
    assert profile.characteristics(p).count() == 2


def test_trend_seasonality_and_volatility_classes(make_panel):
    rng = np.random.default_rng(42)
    i = np.arange(60)
    p = make_panel(
        {
            "up": list(np.linspace(100, 200, 60) + rng.normal(0, 5, 60)),
            "down": list(np.linspace(200, 20, 60)),
            "season": list(100 + 20 * np.sin(2 * math.pi * i / 12) + rng.normal(0, 3, 60)),
            "calm": list(100 + rng.normal(0, 1, 60)),
            "wild": list(np.abs(rng.normal(100, 80, 60)) + 1),
            "short": [1.0],
        }
    )
    c = {r["series"]: r for r in profile.characteristics(p).collect()}
    # slope is per step in percent of the mean: linspace 100 -> 200 gives 1.13
    assert c["up"]["trend"] == "increasing" and c["down"]["trend"] == "decreasing" and c["calm"]["trend"] == "stable"
    assert c["season"]["seasonal"] and not c["calm"]["seasonal"]
    assert c["calm"]["volatility"] == "low" and c["wild"]["volatility"] == "high"
    assert c["short"]["trend"] == "insufficient_data" and not c["short"]["sufficient"]
    s = {r["series"]: r for r in profile.suggestions(profile.characteristics(p)).collect()}
    assert all(1 <= len(r["models"]) <= 5 for r in s.values())
    assert s["season"]["models"][:2] == ["Prophet", "SARIMAX"]
    assert s["calm"]["models"] == ["Linear Regression", "Ridge", "Ensemble (Top 3)"]
    assert "outlier flag" in s["wild"]["features"]


def test_decomposition_recovers_trend_and_season(make_panel):
    season = [3, 1, -2, 0, 2, -1, -3, 1, 0, 2, -2, -1]
    y = [50 + 0.5 * i + season[i % 12] for i in range(48)]
    d = profile.decompose(make_panel({"a": y, "short": [1] * 20})).orderBy("ds").collect()
    assert len(d) == 48 and {r["series"] for r in d} == {"a"}
    assert [r["trend"] is None for r in d] == [True] * 6 + [False] * 36 + [True] * 6
    mid = d[12]
    assert mid["trend"] == pytest.approx(50 + 6) and mid["seasonal"] == pytest.approx(3) and mid["resid"] == pytest.approx(0, abs=1e-9)
    m = [(50 + 0.5 * i) * (1 + season[i % 12] / 20) for i in range(60)]
    mul = profile.decompose(make_panel({"a": m}), "multiplicative").orderBy("ds").collect()
    assert mul[24]["resid"] == pytest.approx(1, abs=0.02)


def test_scores(spark, make_panel):
    rows = [(month_end(i), 5.0 if i else 99.0, None if i == 3 else 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "ds date, Inflasi double, other double")
    r = quality.indicator_report(df, F.lit("2020-11-01").cast("date")).first()
    # 1 of 30 cells missing, 1 breach, one day old
    assert r["missing_count"] == 1 and r["outlier_count"] == 1
    assert r["score"] == pytest.approx(round(100 - 2 * 100 / 30 - 5 * 100 / 30, 1)) and r["status"] == "WARNING"
    stale = quality.indicator_report(df, F.lit("2021-11-01").cast("date")).first()
    assert stale["score"] == pytest.approx(r["score"] - 20) and any("stale" in i for i in stale["issues"])
    empty = quality.indicator_report(df.limit(0), F.lit("2021-11-01").cast("date")).first()
    assert empty["status"] == "ERROR" and empty["score"] == 0
    p = make_panel({"a": [1, 0, -5, 4]})
    h = quality.history_report(p, F.lit("2020-05-01").cast("date")).first()
    assert h["outlier_count"] == 2 and h["score"] == 60.0 and h["status"] == "OK"
    assert quality.not_positive(p).count() == 2
    assert quality.structure_problems(p, ["series", "nope"]) == ["missing column nope", "fewer than 12 rows"]


def test_volatility_floor_and_gap(spark):
    rows = [(month_end(i), "flat", 5.0) for i in range(5)] + [(month_end(0), "one", 1.0)]
    out = {r["indicator"]: r["vol"] for r in profile.indicator_volatility(spark.createDataFrame(rows, "ds date, indicator string, value double")).collect()}
    assert out == {"flat": 0.0, "one": 0.01}


@pytest.mark.parametrize("n", [1, 2, 7, 5000])
def test_exact_quantiles_match_numpy_with_a_hot_group(spark, n):
    rng = np.random.default_rng(n)
    data = {"hot": np.round(rng.lognormal(3, 2, n), 2), "tie": np.repeat(4.0, n), "small": rng.normal(size=max(1, n // 50))}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    probs = {"lo": 0.0, "p10": 0.1, "med": 0.5, "p90": 0.9, "hi": 1.0}
    for r in exact_quantiles(df, ["k"], "v", probs, accuracy=100).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(float(np.quantile(data[r["k"]], p)), rel=1e-12)
    whole = exact_quantiles(df, [], "v", {"q": 0.3}, accuracy=100).first()["q"]
    assert whole == pytest.approx(float(np.quantile(np.concatenate(list(data.values())), 0.3)), rel=1e-12)


def brute_ks(a, b):
    xs = np.concatenate([a, b])
    return max(abs((a <= x).mean() - (b <= x).mean()) for x in xs)


def test_ks_matches_brute_force_and_flags_drift(spark):
    rng = np.random.default_rng(3)
    cases = {
        "same": (rng.normal(size=300), rng.normal(size=200)),
        "shift": (rng.normal(size=300), rng.normal(1, 1, 200)),
        "ties": (rng.integers(0, 4, 300).astype(float), rng.integers(0, 5, 200).astype(float)),
    }
    rows = [(f, s, float(v)) for f, pair in cases.items() for s, vs in enumerate(pair) for v in vs]
    df = spark.createDataFrame(rows, "feature string, sample int, value double").repartition(4)
    out = {r["feature"]: r for r in drift.drift_report(df, k=3).collect()}
    for f, (a, b) in cases.items():
        assert out[f]["stat"] == pytest.approx(brute_ks(a, b), abs=1e-12)
    assert out["shift"]["drift"] and not out["same"]["drift"] and out["same"]["any_drift"]


@pytest.mark.parametrize("extra", [0, 30000])
def test_isolation_forest_ranks_far_points_first(spark, extra):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(400 + extra, 2))
    pts[:5] += 12
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id bigint, a double, b double")
    out = forest.anomaly_forest(df, ["a", "b"], "id", 0.05, trees=40).orderBy(F.col("score").desc()).collect()
    assert {r["id"] for r in out[:5]} == set(range(5))
    assert sum(r["is_forest"] for r in out) == pytest.approx(0.05 * len(pts), rel=0.15)
    assert forest.anomaly_forest(df.limit(5), ["a", "b"], "id").filter("is_forest").count() == 0


def test_isolation_forest_uses_every_feature(spark):
    rng = np.random.default_rng(2)
    pts = rng.normal(size=(400, 6))
    pts[:4, 5] += 15
    names = list("abcdef")
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(pts)], "id bigint, " + ", ".join(f"{c} double" for c in names))
    flagged = {r["id"] for r in forest.anomaly_forest(df, names, "id", 0.05, trees=100).filter("is_forest").collect()}
    assert set(range(4)) <= flagged


def test_report_edges(make_panel):
    p = make_panel({"a": [0, 10, 20], "b": [5, 5, 5]})
    t = report.totals(p, ["ds"])
    assert [r["growth"] for r in report.guarded_growth(t).orderBy("ds").collect()][1] == pytest.approx(200.0)
    zero = report.totals(p.filter("series = 'a'"), ["ds"])
    assert [r["growth"] for r in report.guarded_growth(zero).orderBy("ds").collect()] == [0.0, 0.0, 100.0]
    tie = report.totals(p.filter("series = 'b'"), ["ds"])
    assert report.peak_period(tie).first()["peak_ds"] == month_end(0)
    m = {r["series"]: r for r in report.portfolio(make_panel({"one": [4]})).collect()}
    assert m["one"]["std"] == 0 and m["one"]["avg_growth"] == 0
    hist = report.histogram(p, "y", 20)
    assert hist.agg(F.sum("n")).first()[0] == 6 and hist.agg(F.max("bin")).first()[0] == 19
    assert report.histogram(tie, "total", 20).collect()[0]["n"] == 3
