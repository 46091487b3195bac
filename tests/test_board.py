"""The candidate table of all families, the forest per series, and searches, against plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom import PanelEngine
from seriesloom.models import board, neighbours, pooled
from seriesloom.operators import features, forest, selection


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    season = 10 * np.sin(np.arange(60) * 2 * np.pi / 12)
    return {"a": list(100 + np.arange(60) + season + rng.normal(0, 1, 60)), "b": list(80 + season + rng.normal(0, 4, 60)), "mid": list(50 + rng.normal(0, 1, 27)), "tiny": [1.0, 2.0]}


def test_candidates_equal_the_families_on_their_own(make_panel, values):
    p = make_panel(values).checkpoint()
    families = board.closed_form(((0.3, 0.1, 0.2),))
    table = board.candidates(p, families, 12, 6).checkpoint()
    found = {(r["series"], r["model"]): r for r in table.collect()}
    assert {m for s, m in found if s == "a"} == {f.name for f in families}
    assert {m for s, m in found if s == "mid"} == {f.name for f in families if f.needs <= 27} and not any(s == "tiny" for s, _ in found)
    long = p.where("series IN ('a', 'b')")
    for f in families:
        held = {(r["series"], r["ds"]): r["yhat"] for r in f.backtest(long, 12, board.DEFAULT).collect()}
        got = {(s, x["ds"]): x["yhat"] for (s, m), r in found.items() if m == f.name and s in "ab" for x in r["holdout"]}
        assert got == pytest.approx(held) and len(got) == 24
        assert all(len(r["future"]) == 6 and [x["step"] for x in r["future"]] == [1, 2, 3, 4, 5, 6] for (s, m), r in found.items() if m == f.name)
    assert found["mid", "Theta"]["holdout"] is None and found["mid", "Linear-AR"]["holdout"] is not None
    best = selection.leaderboard(board.holdout_rows(table)).where("rank = 1 AND series = 'a'").first()
    assert best["model"] in {f.name for f in families}
    assert board.future_rows(table, 2).agg(F.max("step")).first()[0] == 2


def test_a_kept_panel_is_not_dealt_out_again(make_panel, values):
    """Every family works inside the partitions by series of the kept panel."""
    p = make_panel(values).repartition(4, "series").checkpoint()
    plan = board.candidates(p, board.closed_form(((0.3, 0.1, 0.2),)))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "hashpartitioning(series#" not in plan or plan.count("Exchange hashpartitioning(") <= 60


def test_gate_says_why(make_panel, values):
    rows = {(r["series"], r["model"]): r["reason"] for r in board.gate(make_panel(values), board.closed_form(), 12).collect()}
    assert rows["a", "Theta"] is None and rows["tiny", "Theta"] == "2 rows, the model needs 24"
    assert rows["mid", "Theta"] == "27 rows, ranking needs 36" and rows["mid", "Linear-AR"] is None


def test_engine_picks_any_family(make_panel, spark, values):
    from panels import month_end

    ind = spark.createDataFrame([(month_end(i), float(50 + i % 5), float(i)) for i in range(60)], "ds date, oil double, rate double")
    engine = PanelEngine(make_panel(values), ind)
    ranked = engine.fit(grid=((0.3, 0.1, 0.2),), families=[*engine.families(((0.3, 0.1, 0.2),)), board.pooled_learner("ridge")], ahead=8).checkpoint()
    names = {r["model"] for r in ranked.where("series = 'a'").collect()}
    assert {"Theta", "Seasonal-AR", "Seasonal-ARX", "k-Nearest", "Ridge-AR", "Pooled-ridge"} <= names
    for name in ("Seasonal-ARX", "Pooled-ridge"):
        fc = engine.predict(5, strategy="manual", manual=name).where("series = 'a'").collect()
        assert len(fc) == 5 and {r["model"] for r in fc} == {name} and all(20 < r["yhat"] < 300 for r in fc)
    with pytest.raises(ValueError, match="8 steps"):
        engine.predict(9)
    assert engine.gate.where("series = 'tiny' AND reason IS NULL").count() == 0


def test_recursive_neighbours_match_a_loop(make_panel, values):
    p = make_panel({k: values[k] for k in ("a", "mid")})
    got = {}
    for r in neighbours.recursive_knn(p, 6, k=3).collect():
        got.setdefault(r["series"], {})[r["step"]] = r["yhat"]
    for name in ("a", "mid"):
        y = np.array(values[name])
        x = np.stack([y[3 - j : len(y) - j] for j in (1, 2, 3)], 1)
        m, s, target, tail = x.mean(0), x.std(0), y[3:], list(y[-3:])
        for step in range(1, 7):
            away = np.sqrt((((x - m) / s - (np.array(tail[:-4:-1]) - m) / s) ** 2).sum(1))
            tail.append(target[np.argsort(away, kind="stable")[:3]].mean())
            assert got[name][step] == pytest.approx(tail[-1])


def plain_forest(x, name, trees, seed=42):
    """Depths by plain recursion, a tree and a node at a time."""
    draw = lambda *p: int(hashlib.md5(":".join(map(str, p)).encode()).hexdigest()[:8], 16) / 2**32
    c = lambda n: 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n == 2)
    limit, depth = math.ceil(math.log2(max(len(x), 2))), [0.0] * len(x)

    def grow(rows, tree, node, level):
        usable = [f for f in range(len(x[0])) if max(x[i][f] for i in rows) > min(x[i][f] for i in rows)]
        if level == limit or len(rows) < 2 or not usable:
            for i in rows:
                depth[i] += level + c(len(rows))
            return
        f = usable[int(draw(seed, name, tree, node, "feature") * len(usable))]
        low, high = (g(x[i][f] for i in rows) for g in (min, max))
        cut = low + draw(seed, name, tree, node, "cut") * (high - low)
        grow([i for i in rows if x[i][f] <= cut], tree, 2 * node, level + 1)
        grow([i for i in rows if x[i][f] > cut], tree, 2 * node + 1, level + 1)

    for tree in range(trees):
        grow(list(range(len(x))), tree, 1, 0)
    return [round(2 ** (-d / trees / c(len(x))), 9) for d in depth]


def test_forest_per_series_matches_a_loop(make_panel):
    rng = np.random.default_rng(3)
    data = {"a": list(rng.normal(100, 5, 40)), "ties": [1.0] * 14 + [9.0], "short": [1.0] * 9}
    data["a"][17] = 400.0
    df = make_panel(data).withColumn("month", F.month("ds")).repartition(3)
    out = {}
    for r in forest.series_forest(df, ["y", "month"], 0.1, trees=30).orderBy("series", "ds").collect():
        out.setdefault(r["series"], []).append(r)
    for name in ("a", "ties"):
        want = plain_forest([(r["y"], r["month"]) for r in out[name]], name, 30)
        assert [r["forest_score"] for r in out[name]] == pytest.approx(want, abs=2e-9)
        assert [r["is_forest"] for r in out[name]] == [s > np.quantile(want, 0.9) for s in want]
    assert out["a"][17]["is_forest"] and not any(r["is_forest"] or r["forest_score"] for r in out["short"])


def test_long_series_are_sampled_by_hash(make_panel):
    y = list(np.random.default_rng(4).normal(0, 1, 300))
    y[123] = 50.0
    df = make_panel({"long": y}, year=1950)
    one, two = (sorted((r["ds"], r["forest_score"], r["is_forest"]) for r in forest.series_forest(d, ["y"], 0.05, trees=25).collect()) for d in (df, df.orderBy(F.rand(1))))
    assert one == two and max(one, key=lambda r: r[1])[1] == one[123][1] and 5 <= sum(r[2] for r in one) <= 15


def test_halving_keeps_the_better_half(make_panel, values):
    rows = features.holdout_split(features.ml_features(make_panel({k: values[k] for k in ("a", "b")})))
    out = pooled.halving_search(rows, "forest", {"numTrees": [2, 3], "maxDepth": [2, 3]}, trials=4, rungs=2).collect()
    first, last = ([r for r in out if r["rung"] == k] for k in (0, 1))
    assert len(first) == 4 and len(last) == 2 and {r["params"] for r in last} == {r["params"] for r in first if r["kept"]}
    assert max(r["rmse"] for r in first if r["kept"]) <= min(r["rmse"] for r in first if not r["kept"])
    assert sum(r["kept"] for r in last) == 1 and last[0]["share"] == 1.0
