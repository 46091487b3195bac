import numpy as np
import pytest
from panels import month_end
from pyspark.sql import functions as F

from seriesloom.operators import scenario


@pytest.fixture
def small(spark):
    levels = spark.createDataFrame([("oil", 80.0), ("rate", 5.0)], "indicator string, level double")
    vol = spark.createDataFrame([("oil", 0.05), ("rate", 0.02)], "indicator string, vol double")
    betas = spark.createDataFrame([("a", "oil", 2.0), ("a", "rate", -10.0), ("b", "oil", 1.0)], "series string, indicator string, beta double")
    fc = spark.createDataFrame(
        [(s, i + 1, month_end(i), 1000.0 + i) for s in ("a", "b") for i in range(3)], "series string, step bigint, ds date, yhat double"
    )
    return levels, vol, betas, fc


def test_levels_ignore_unknown_indicators(spark, small):
    rows = [("crisis", "oil", "add", 20.0), ("crisis", "moon", "set", 1.0), ("boom", "rate", "mul", 2.0), ("fix", "rate", "set", 0.0)]
    scn = spark.createDataFrame(rows, "scenario string, indicator string, op string, arg double")
    out = {(r["scenario"], r["indicator"]): r["level"] for r in scenario.apply_levels(small[0], scn).collect()}
    assert out == {("crisis", "oil"): 100, ("crisis", "rate"): 5, ("boom", "oil"): 80, ("boom", "rate"): 10, ("fix", "oil"): 80, ("fix", "rate"): 0}


def test_presets_are_complete():
    rows = scenario.preset_rows()
    assert len(rows) == 5 * 15 + 7 + 8 + 1 and len({r[0] for r in rows}) == 8 and {r[2] for r in rows} == {"set", "add", "mul"}


def test_scoring_comparison_and_consensus(spark, small):
    levels, _, betas, fc = small
    scn = spark.createDataFrame([("x", "oil", "add", 10.0), ("y", "rate", "add", 1.0)], "scenario string, indicator string, op string, arg double")
    scored = scenario.score(fc, betas, scenario.apply_levels(levels, scn))
    got = {(r["scenario"], r["series"]): r["t"] for r in scored.groupBy("scenario", "series").agg(F.sum("yhat").alias("t")).collect()}
    assert got == {("x", "a"): 3063, ("x", "b"): 3033, ("y", "a"): 2973, ("y", "b"): 3003}
    cmp_ = {r["series"]: r for r in scenario.compare(scored, "x", "y").collect()}
    assert cmp_["a"]["delta"] == -90 and cmp_["a"]["delta_pct"] == pytest.approx(-90 / 3063 * 100)
    mix = scenario.consensus(scored, {"x": 0.25, "y": 0.75}).agg(F.sum("yhat")).first()[0]
    assert mix == pytest.approx(0.25 * 6096 + 0.75 * 5976)


def test_tornado_and_elasticity(small):
    levels, _, betas, fc = small
    t = scenario.tornado(betas, levels, 3).collect()
    assert [r["indicator"] for r in t] == ["oil", "rate"]
    assert t[0]["up"] == pytest.approx(3 * 8 * 3) and t[0]["spread"] == pytest.approx(144)
    e = {(r["series"], r["indicator"]): r for r in scenario.elasticity(fc, betas, levels, 3).collect()}
    assert e["a", "oil"]["elasticity"] == pytest.approx(2 * 0.8 * 3 / 3003 * 100) and e["a", "oil"]["kind"] == "inelastic"


def test_collinear_indicators_share_one_effect(spark):
    """y = 3 a + noise, b follows a closely: slopes on one variable each would count the effect twice."""
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, 200)
    b, c = a + rng.normal(0, 0.3, 200), rng.normal(0, 1, 200)
    y = 3 * a - 2 * c + rng.normal(0, 0.1, 200)
    rows = [("s", *map(float, r)) for r in zip(a, b, c, y)]
    got = {r["indicator"]: r["beta"] for r in scenario.response(spark.createDataFrame(rows, "series string, a double, b double, c double, y double"), ["a", "b", "c"]).collect()}
    want = np.linalg.lstsq(np.c_[np.ones(200), a, b, c], y, rcond=None)[0][1:]
    assert [got[x] for x in "abc"] == pytest.approx(want, rel=1e-8) and abs(got["b"]) < 0.1


def test_series_without_betas_stay_and_bounds_move(spark, small):
    levels, _, betas, fc = small
    scn = spark.createDataFrame([("x", "oil", "add", 10.0)], "scenario string, indicator string, op string, arg double")
    wide = fc.union(spark.createDataFrame([("c", 1, month_end(0), 7.0)], fc.schema)).withColumns({"lo": F.col("yhat") - 1, "hi": F.col("yhat") + 3})
    rows = {(r["series"], r["ds"]): r for r in scenario.score(wide, betas, scenario.apply_levels(levels, scn)).collect()}
    assert len(rows) == 7 and rows["c", month_end(0)]["yhat"] == 7
    a = rows["a", month_end(0)]
    assert (a["yhat"], a["lo"], a["hi"]) == (1020, 1019, 1023)


def test_replays_and_bands(spark, small):
    levels, _, betas, fc = small
    history = [(month_end(i), k, v) for k, vs in {"oil": [40.0, 44, 20, 80, 80], "rate": [1.0, 0.0, 2, 4, 5]}.items() for i, v in enumerate(map(float, vs))]
    paths = scenario.replay_paths(spark.createDataFrame(history, "ds date, indicator string, value double"), levels, 3)
    got = {(r["sim"], r["indicator"], r["step"]): r["value"] for r in paths.collect()}
    assert got == pytest.approx({
        (month_end(0), "oil", 1): 88, (month_end(0), "oil", 2): 40, (month_end(0), "oil", 3): 160, (month_end(1), "oil", 1): 80 * 20 / 44,
        (month_end(1), "oil", 2): 80 * 80 / 44, (month_end(1), "oil", 3): 80 * 80 / 44, (month_end(0), "rate", 1): 0, (month_end(0), "rate", 2): 10, (month_end(0), "rate", 3): 20,
    })
    cube = scenario.replay_cube(fc, betas, levels, paths)
    assert cube.count() == 2 * 6
    last = sorted(r["yhat"] for r in cube.filter("series = 'a'").filter(F.col("ds") == month_end(2)).collect())
    assert last == pytest.approx(sorted([1002 + 2 * 80 - 10 * 15, 1002 + 2 * (80 * 80 / 44 - 80)]))
    bands = scenario.bands_of_cube(cube)
    row = bands.filter("series = 'a'").filter(F.col("ds") == month_end(2)).first()
    assert row["p05"] == pytest.approx(np.percentile(last, 5)) and row["p95"] == pytest.approx(np.percentile(last, 95))
    risk = {r["series"]: r for r in scenario.end_risk(bands).collect()}
    assert risk["a"]["ds"] == month_end(2) and risk["a"]["spread"] == pytest.approx(row["p95"] - row["p05"])
