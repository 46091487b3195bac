import numpy as np
import pandas as pd
import pytest
from panels import month_end
from pyspark.sql import functions as F

from seriesloom.models import base, factor, linear, neighbours, pooled, seasonal_ar, smoothing
from seriesloom.operators import explain, features, selection

SEASON = [3, 1, -2, 0, 2, -1, -3, 1, 0, 2, -2, -1]


def linear_season(n, level=100.0, slope=2.0, scale=5.0):
    return [level + slope * i + scale * SEASON[i % 12] for i in range(n)]


def series_of(df, key="a"):
    return [r["yhat"] for r in df.filter(F.col("series") == key).orderBy("ds").collect()]


def test_holt_winters_recovers_exact_trend_and_season(make_panel):
    y = linear_season(72)
    # the first season's terms start tilted by the drift, which the recursion levels out
    out = series_of(smoothing.holt_winters(make_panel({"a": y, "short": [1] * 20}), 12))
    assert len(out) == 12
    assert np.abs(np.array(out) - np.array(linear_season(84)[72:])).max() < 25
    assert series_of(smoothing.holt_winters(make_panel({"short": [1] * 20}), 12), "short") == []


def test_holt_winters_fold_matches_plain_loop(make_panel):
    rng = np.random.default_rng(0)
    y = list(np.round(100 + rng.normal(0, 10, 40), 2))
    a, b, g, m = 0.3, 0.1, 0.2, 12
    l, t = np.mean(y[:m]), (np.mean(y[m:2 * m]) - np.mean(y[:m])) / m
    s = [v - l for v in y[:m]]
    for i in range(m, len(y)):
        l2 = a * (y[i] - s[i - m]) + (1 - a) * (l + t)
        t = b * (l2 - l) + (1 - b) * t
        l = l2
        s.append(g * (y[i] - l) + (1 - g) * s[i - m])
    want = [l + h * t + s[len(y) - m + (h - 1) % m] for h in range(1, 15)]
    got = series_of(smoothing.holt_winters(make_panel({"a": y}), 14, ((a, b, g),)))
    assert got == pytest.approx(want, rel=1e-12)


def test_grid_takes_the_smallest_error(make_panel):
    rng = np.random.default_rng(5)
    p = make_panel({"a": list(100 + np.cumsum(rng.normal(0, 5, 60)))})
    best = smoothing.holt_winters_fit(p).first()
    each = [smoothing.holt_winters_fit(p, (g,)).first()["sse"] for g in smoothing.GRID]
    assert best["sse"] == pytest.approx(min(each))
    assert (best["alpha"], best["beta"], best["gamma"]) in smoothing.GRID


def test_backtest_uses_only_the_training_rows(make_panel):
    y = linear_season(60)
    spiked = y[:48] + [10_000.0] * 12
    for test in (
        lambda p: smoothing.holt_winters_backtest(p, 12, ((0.3, 0.1, 0.2),)),
        lambda p: factor.backtest(features.holdout_split(p)),
    ):
        plain, other = test(make_panel({"a": y})), test(make_panel({"a": spiked}))
        assert series_of(plain) == pytest.approx(series_of(other), rel=1e-12)
        assert plain.count() == 12 and {r["y"] for r in other.collect()} == {10_000.0}


def test_backtests_agree_with_forecasts_of_the_training_part(make_panel):
    rng = np.random.default_rng(9)
    p = make_panel({"a": list(100 + rng.normal(0, 5, 50)), "b": list(50 + rng.normal(0, 5, 40))})
    train = features.holdout_split(p).filter("part = 'train'").drop("part")
    for back, fwd in (
        (smoothing.holt_winters_backtest(p, 12), smoothing.holt_winters(train, 12)),
        (factor.backtest(features.holdout_split(p)), factor.trend_factor(train, 12)),
    ):
        assert series_of(back) == pytest.approx(series_of(fwd), rel=1e-9)
        assert series_of(back, "b") == pytest.approx(series_of(fwd, "b"), rel=1e-9)


def test_trend_factor_is_exact_on_its_own_model(make_panel):
    y = [float(np.exp(4 + 0.01 * i + 0.05 * SEASON[i % 12])) for i in range(60)]
    want = [float(np.exp(4 + 0.01 * i + 0.05 * SEASON[i % 12])) for i in range(60, 72)]
    assert series_of(factor.trend_factor(make_panel({"a": y}), 12)) == pytest.approx(want, rel=0.02)
    out = factor.trend_factor(make_panel({"a": y, "neg": [-1] * 12}), 3)
    assert {r["series"] for r in out.collect()} == {"a"}


def test_theta_continues_a_straight_seasonal_series(make_panel):
    y = [(100 + i) * (1 + SEASON[i % 12] / 50) for i in range(60)]
    got = series_of(smoothing.theta(make_panel({"a": y}), 12))
    want = [(100 + i) * (1 + SEASON[i % 12] / 50) for i in range(60, 72)]
    assert got == pytest.approx(want, rel=0.06)


def test_linear_fit_matches_numpy_and_ridge_formula(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [1, 10, 100] + [5, 0, 2000]
    y = x @ [2.0, -1.0, 0.5] + 7 + rng.normal(size=200)
    rows = [("a" if i % 3 else "b", *map(float, x[i]), float(y[i])) for i in range(200)]
    df = spark.createDataFrame(rows, "series string, x1 double, x2 double, x3 double, y double")
    for alpha in (0.0, 3.0):
        for r in linear.fit_linear(df, ["x1", "x2", "x3"], alpha=alpha).collect():
            pick = np.array([row[0] == r["series"] for row in rows])
            xs, ys = x[pick], y[pick]
            z = (xs - xs.mean(0)) / xs.std(0)
            w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (ys - ys.mean())) / xs.std(0)
            assert r["coef"] == pytest.approx(list(w), rel=1e-8)
            assert r["intercept"] == pytest.approx(ys.mean() - w @ xs.mean(0), rel=1e-8)


def test_recursion_feeds_predictions_back(make_panel, spark):
    p = make_panel({"a": [1, 2, 4, 8, 16, 32, 64, 128]})
    model = spark.createDataFrame(
        [("a", 1.0, [0.5, 0.25, 2.0, 3.0], [32.0, 64.0, 128.0], month_end(7))], "series string, intercept double, coef array<double>, tail array<double>, last date"
    )
    feats = ["lag_1", "rolling_mean_3", "month", "extra"]
    exog = spark.createDataFrame([(1, 10.0), (2, 20.0)], "step bigint, extra double")
    got = series_of(linear.recursive_linear(model, feats, 3, exog))
    vals, want = [32.0, 64.0, 128.0], []
    for i, x in enumerate([10.0, 20.0, 0.0]):
        v = 1 + 0.5 * vals[-1] + 0.25 * np.mean(vals[-3:]) + 2 * (9 + i) + 3 * x
        want.append(v)
        vals.append(v)
    assert got == pytest.approx(want)
    fitted = base.LinearAR().fit(p).first()
    assert fitted["tail"] == [32.0, 64.0, 128.0] and fitted["last"] == month_end(7)


def test_seasonal_ar_matches_numpy(make_panel):
    rng = np.random.default_rng(4)
    y = list(100 + np.cumsum(rng.normal(0, 3, 80)) + 5 * np.array([SEASON[i % 12] for i in range(80)]))
    w = np.array([np.nan] * 13 + [y[i] - y[i - 1] - y[i - 12] + y[i - 13] for i in range(13, 80)])
    rows = [(w[i], w[i - 1], w[i - 12], w[i - 13]) for i in range(26, 80)]
    a = np.array(rows)
    beta, *_ = np.linalg.lstsq(np.c_[np.ones(len(a)), a[:, 1:]], a[:, 0], rcond=None)
    hist = list(y)
    for _ in range(6):
        d = lambda k: hist[-k] - hist[-k - 1] - hist[-k - 12] + hist[-k - 13]
        hist.append(beta[0] + beta[1] * d(1) + beta[2] * d(12) + beta[3] * d(13) + hist[-1] + hist[-12] - hist[-13])
    p = make_panel({"a": y, "short": y[:20]})
    model = seasonal_ar.fit(p)
    assert {r["series"] for r in model.collect()} == {"a"}
    assert series_of(seasonal_ar.forecast(p, model, 6)) == pytest.approx(hist[80:], rel=1e-6)


def test_seasonal_arx_moves_with_the_scenario(make_panel, spark):
    rng = np.random.default_rng(6)
    x = list(50 + np.cumsum(rng.normal(0, 2, 92)))
    y = [3 * v + 10 * SEASON[i % 12] for i, v in enumerate(x[:80])]
    p = make_panel({"a": y})
    ind = spark.createDataFrame([(month_end(i), float(v)) for i, v in enumerate(x[:80])], "ds date, x double")
    rows = [("flat", month_end(80 + i), float(x[79])) for i in range(6)] + [("up", month_end(80 + i), float(x[79]) + 10) for i in range(6)]
    future = spark.createDataFrame(rows, "scenario string, ds date, x double")
    model = seasonal_ar.fit(p, ind, ["x"])
    assert model.first()["coef"][3] == pytest.approx(3, abs=1e-6)
    out = seasonal_ar.forecast(p, model, 6, ind, future, ["x"], by=["scenario"])
    by = {s: [r["yhat"] for r in out.filter(F.col("scenario") == s).orderBy("ds").collect()] for s in ("flat", "up")}
    assert np.array(by["up"]) - np.array(by["flat"]) == pytest.approx([30.0] * 6, abs=1e-4)


def test_knn_matches_brute_force(make_panel):
    rng = np.random.default_rng(8)
    p = make_panel({"a": list(rng.normal(100, 20, 60)), "b": list(rng.normal(10, 2, 40))})
    split = features.holdout_split(features.ml_features(p))
    for weights, power in (("uniform", 2), ("distance", 1)):
        got = neighbours.knn(split, ["lag_1", "lag_2"], 3, power, weights).collect()
        pdf = split.toPandas()
        for r in got:
            tr = pdf[(pdf.series == r["series"]) & (pdf.part == "train")]
            d = (np.abs(tr[["lag_1", "lag_2"]].to_numpy() - [r["lag_1"], r["lag_2"]]) ** power).sum(1) ** (1 / power)
            near = np.argsort(d, kind="stable")[:3]
            w = np.ones(3) if weights == "uniform" else 1 / np.maximum(d[near], 1e-12)
            assert r["yhat"] == pytest.approx((w * tr.y.to_numpy()[near]).sum() / w.sum())
        assert len(got) == 24


@pytest.mark.parametrize("kind", ["gbt", "forest", "extra", "ridge", "lasso", "elastic", "huber", "poly"])
def test_pooled_learners_beat_nothing_sensible(make_panel, kind):
    p = make_panel({"a": linear_season(60), "b": linear_season(60, 1000, 5, 20)})
    out = pooled.holdout(features.holdout_split(features.ml_features(p)), kind).collect()
    assert len(out) == 24
    assert np.mean([abs(r["yhat"] - r["y"]) / r["y"] for r in out]) < 0.25


def test_pooled_recursion_and_search(make_panel):
    p = make_panel({"a": linear_season(40)})
    rows = pooled.scale_by_series(features.ml_features(p).withColumn("part", F.lit("train")))
    model = pooled.fit(rows, "forest", numTrees=5)
    out = pooled.recursive(pooled.last_rows(p), model, 4).orderBy("step").collect()
    assert [r["ds"] for r in out] == [month_end(40 + i) for i in range(4)]
    # a forest averages training labels, so every step stays inside their range
    y = linear_season(40)
    assert all(min(y) <= r["yhat"] <= max(y) for r in out)
    grid = pooled.grid_search(features.holdout_split(features.ml_features(p)), "forest", {"numTrees": [2, 4]}).collect()
    assert len(grid) == 2 and grid[0]["rmse"] <= grid[1]["rmse"]


def test_user_model_and_saved_tables(make_panel, tmp_path, spark):
    p = make_panel({"a": range(1, 15), "b": [2.0] * 13})

    def last_value(history, horizon):
        end = pd.Timestamp(history["ds"].iloc[-1])
        return pd.DataFrame({"ds": pd.date_range(end + pd.offsets.MonthEnd(1), periods=horizon, freq="ME").date, "yhat": [float(history["y"].iloc[-1])] * horizon})

    out = base.per_series(p, last_value, 2)
    assert sorted((r["series"], r["yhat"]) for r in out.collect()) == [("a", 14.0), ("a", 14.0), ("b", 2.0), ("b", 2.0)]
    model = base.TrendFactor()
    base.save_model(model.fit(p), str(tmp_path / "m"))
    assert base.load_model(spark, str(tmp_path / "m")).count() == 2
    assert base.HoltWinters().set_params(grid=((0.3, 0.1, 0.2),)).get_params() == {"grid": ((0.3, 0.1, 0.2),)}


def board_fixture(spark):
    rows = []
    for s, errs in {"a": {"m1": 1.0, "m2": -1.0, "m3": 5.0, "m4": 90.0}, "b": {"m1": 2.0, "m2": 9.0}, "c": {"m2": 1.0, "m1": 1.0, "m3": 2.0}}.items():
        for m, e in errs.items():
            rows += [(s, m, month_end(i), 100.0, 100.0 + e) for i in range(3)]
    return spark.createDataFrame(rows, "series string, model string, ds date, y double, yhat double")


def test_leaderboard_ranks_ties_by_name(spark):
    b = {(r["series"], r["model"]): r for r in selection.leaderboard(board_fixture(spark)).collect()}
    assert b["c", "m1"]["rank"] == 1 and b["c", "m2"]["rank"] == 2
    assert b["a", "m4"]["rank"] == 4 and b["a", "m3"]["rmse"] == pytest.approx(5)
    assert b["a", "m1"]["accuracy"] == pytest.approx(99)


def test_ensemble_error_joint_and_mean(spark):
    joint = {r["series"]: r for r in selection.ensemble_error(board_fixture(spark)).collect()}
    mean = {r["series"]: r for r in selection.ensemble_error(board_fixture(spark), metric="mean").collect()}
    assert set(joint) == {"a", "c"} and joint["a"]["members"] == "m1, m2, m3"
    assert joint["a"]["rmse"] == pytest.approx(5 / 3) and mean["a"]["rmse"] == pytest.approx(7 / 3)
    assert joint["c"]["rmse"] == pytest.approx(4 / 3)


def test_strategies(spark):
    hold = board_fixture(spark)
    preds = spark.createDataFrame(
        [(s, m, month_end(9), v) for s in "abc" for m, v in {"m1": 10.0, "m2": 20.0, "m3": 40.0, "m4": 80.0}.items() if not (s == "b" and m in ("m3", "m4"))],
        "series string, model string, ds date, yhat double",
    )
    run = lambda *a, **k: {r["series"]: r for r in selection.forecast_by_strategy(preds, hold, *a, **k).collect()}
    best = run("best")
    assert {s: r["yhat"] for s, r in best.items()} == {"a": 10.0, "b": 10.0, "c": 10.0}
    assert (best["a"]["lo"], best["a"]["hi"]) == (9.5, 10.5)
    ens = run("ensemble")
    assert ens["a"]["yhat"] == pytest.approx(70 / 3) and ens["a"]["model"] == "Ensemble (m1, m2, m3)" and ens["b"]["model"] == "m1"
    assert ens["a"]["lo"] == pytest.approx(np.percentile([10, 20, 40], 2.5)) and ens["a"]["hi"] == pytest.approx(np.percentile([10, 20, 40], 97.5))
    # a: the best single misses by 1, the ensemble by 5/3; c: 1 against 4/3
    assert run("auto")["a"]["model"] == "m1" and run("auto", metric="mean")["c"]["model"] == "m1"
    manual = run("manual", manual="m3")
    assert manual["a"]["model"] == "m3" and manual["b"]["model"] == "m1 (Fallback)"
    custom = run("custom", members=["m3", "m4"])
    assert custom["a"]["yhat"] == 60 and custom["a"]["model"] == "Ensemble (m3, m4)" and custom["b"]["yhat"] == 10
    w = run(weights={"m1": 3.0, "m4": 1.0})
    assert w["a"]["yhat"] == pytest.approx((30 + 80) / 4) and w["b"]["yhat"] == 10 and w["a"]["model"] == "Custom Weighted"


def test_auto_takes_a_better_ensemble(spark):
    rows = [("a", m, month_end(i), 100.0, 100.0 + e) for m, e in (("m1", 10.0), ("m2", -11.0), ("m3", 12.0)) for i in range(3)]
    hold = spark.createDataFrame(rows, "series string, model string, ds date, y double, yhat double")
    out = selection.forecast_by_strategy(hold.drop("y"), hold, "auto").first()
    assert out["model"].startswith("Ensemble")


def test_contributions_sum_to_the_prediction(make_panel):
    rng = np.random.default_rng(11)
    ml = features.ml_features(make_panel({"a": list(100 + np.cumsum(rng.normal(0, 5, 40)))}))
    xs = ["lag_1", "lag_2"]
    model = linear.fit_linear(ml, xs)
    parts = explain.linear_contributions(ml, model, xs).groupBy("ds").agg(F.sum("contribution").alias("c"))
    pred = linear.predict_linear(ml, model, xs)
    mean = pred.agg(F.avg("yhat")).first()[0]
    gap = pred.join(parts, "ds").select(F.max(F.abs(F.col("yhat") - mean - F.col("c")))).first()[0]
    assert gap < 1e-8
    imp = {r["feature"]: r["importance"] for r in explain.permutation_importance(ml, model, xs).collect()}
    assert imp["lag_1"] > 0
