"""Operators that split hot groups, against plain versions; pivots, snapshots and batch scores."""

import datetime as dt
import random

import numpy as np
import pytest
from panels import month_end
from pyspark.sql import functions as F

from seriesloom.operators import align, drift, quality, report
from seriesloom.operators.quality import Rule
from seriesloom.operators.quantiles import exact_quantiles
from seriesloom.sources import store
from seriesloom.streaming import refresh as stream


@pytest.mark.parametrize("most", [1, 40, 10**6])
def test_quantiles_by_counting_rounds(spark, most):
    """Half of all rows in one group of mostly distinct values over many decades, beside ties and a single value."""
    rng = np.random.default_rng(1)
    data = {"hot": np.r_[rng.lognormal(0, 9, 3000), -1e300, 1e300], "tie": np.repeat([2.0, 7.0], 700), "one": np.array([5.0]), "few": rng.normal(size=900)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("hot", None), ("few", float("nan")), ("gone", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"p01": 0.01, "q1": 0.25, "med": 0.5, "p97": 0.97, "hi": 1.0}
    out = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs, accuracy=50, most=most).collect()}
    assert set(out) == set(data)
    for k, vs in data.items():
        for name, p in probs.items():
            assert out[k][name] == pytest.approx(float(np.quantile(vs, p)), rel=1e-9), (k, name)


def test_no_task_orders_more_than_the_bound(spark):
    """After the rounds, the values that are put in order are as few as asked for."""
    from seriesloom.operators import quantiles as q

    df = spark.range(20_000).select(F.lit("a").alias("k"), (F.xxhash64("id") % 10**9).cast("double").alias("_x"))
    targets = spark.createDataFrame([("a", "m", 0, 10_000, -1e9, 1e9)], "k string, q string, side int, rank long, lo double, hi double")
    once = q.narrowed(df, targets, ["k"])
    assert once.first()["n"] < 200
    twice = q.narrowed(df, once.drop("n"), ["k"]).first()
    assert twice["n"] <= 3 and twice["lo"] <= sorted(r["_x"] for r in df.collect())[10_000] <= twice["hi"]


@pytest.mark.parametrize("values", [7, 10**6])
def test_ks_in_ranges(spark, values):
    rng = np.random.default_rng(2)
    data = {"hot": (rng.normal(size=2000), rng.normal(0.1, 1, 1500)), "ties": (rng.integers(0, 3, 90).astype(float), rng.integers(0, 4, 60).astype(float)), "half": (rng.normal(size=5), np.zeros(0))}
    rows = [(f, s, float(v)) for f, pair in data.items() for s, vs in enumerate(pair) for v in vs] + [("ties", 0, None)]
    df = spark.createDataFrame(rows, "feature string, sample int, value double").repartition(3)
    out = {r["feature"]: r for r in drift.ks_statistic(df, range_values=values).collect()}
    for f in ("hot", "ties"):
        a, b = data[f]
        xs = np.concatenate([a, b])
        want = max(abs((a <= x).mean() - (b <= x).mean()) for x in xs)
        assert out[f]["stat"] == pytest.approx(want, abs=1e-12) and (out[f]["n0"], out[f]["n1"]) == (len(a), len(b))
    assert out["half"]["stat"] is None


def test_ks_ranges_are_even(spark):
    """Half of the values belong to one feature: no range holds much more than the others."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("f"), (F.col("id") % 31).cast("string"))).alias("feature"), (F.col("id") % 3 == 0).cast("int").alias("sample"),
        F.xxhash64("id").cast("double").alias("value"),
    )
    counts = df.groupBy("feature", "value").count()
    sizes = [r["count"] for r in counts.repartitionByRange(16, "feature", "value").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sorted(sizes)[8]


def test_asof_with_a_hot_key_and_month(spark):
    rng = random.Random(3)
    at = lambda: dt.datetime(2024, rng.choice([1, 1, 1, 2, 4]), rng.randint(1, 28), rng.randint(0, 23), rng.choice([0, 0, 30]))
    key = lambda: rng.choice(["hot", "hot", "a", "b", None])
    right = {(key(), at()): float(i) for i in range(700)}
    left = [(key(), at(), i) for i in range(900)]
    r = spark.createDataFrame([(k, t, v) for (k, t), v in right.items()], "k string, ts timestamp_ntz, v double").repartition(3)
    l = spark.createDataFrame(left, "k string, ts timestamp_ntz, n int").repartition(3)
    out = {x["n"]: x["v"] for x in align.asof_backward(l, r, "ts", "v", by=["k"], piece_rows=50).where("k IS NOT NULL").collect()}
    for k, t, n in left:
        if k is not None:
            before = [(s, v) for (j, s), v in right.items() if j == k and s <= t]
            assert out[n] == (max(before)[1] if before else None)
    whole = {x["n"]: x["v"] for x in align.asof_backward(l, r, "ts", "v", by=["k"]).where("k IS NOT NULL").collect()}
    assert whole == out


def test_pivots_hold_what_the_data_hold(spark, make_panel):
    """A sixth segment, an unusual name and a year beyond any list appear in the result."""
    names = [f"S{i}" for i in range(5)] + ["a new one"]
    p = make_panel({n: [float(i + j) for j in range(30)] for i, n in enumerate(names)}, year=2035).unionByName(make_panel({"late": [5.0]}, year=2001))
    cells = report.long_cells(report.pivot_series(p), "ds", "series", "total").collect()
    assert len(cells) == 31 * 7 and {r["series"] for r in cells} == {*names, "late"}
    assert sum(r["total"] is None for r in cells) == 30 + 6
    years = report.long_cells(align.month_axis(report.season_pivot(p), "row"), "month", "year", "total").where("total IS NOT NULL")
    assert {r["year"] for r in years.collect()} == {2001, 2035, 2036, 2037}
    corr = {(r["a"], r["b"]): r["corr"] for r in report.correlation_matrix(report.pivot_series(p)).collect()}
    assert len(corr) == 49 and corr["S0", "a new one"] == pytest.approx(1.0) and corr["S0", "late"] is None
    assert report.pivot_series(p.limit(0)).count() == 0


def test_snapshot_manifest(spark, make_panel, tmp_path):
    p, root = make_panel({"a": [1, 2]}), str(tmp_path / "s")
    assert store.list_snapshots(spark, root).count() == 0
    none = store.save_snapshot(p.limit(0), root, "1", "empty")
    some = store.save_snapshot(p.withColumn("more", F.lit(1)), root, "2", "two rows")
    lines = {r["snapshot_id"]: (r["rows"], r["description"]) for r in store.list_snapshots(spark, root).collect()}
    assert lines == {none: (0, "empty"), some: (2, "two rows")}
    assert store.load_snapshot(spark, root, none).columns == p.columns and store.load_snapshot(spark, root, none).count() == 0
    assert store.load_snapshot(spark, root, some).columns == [*p.columns, "more"]
    # data without a line, left by a write that failed, is no snapshot and does not stand in the way
    p.write.parquet(f"{root}/data/snapshot_id=3_half")
    with pytest.raises(ValueError, match="no snapshot"):
        store.load_snapshot(spark, root, "3_half")
    store.save_snapshot(p.limit(1), root, "3", "half")
    assert store.load_snapshot(spark, root, "3_half").count() == 1


def test_batch_scores_equal_a_batch_run(spark, tmp_path):
    rules, as_of = [Rule("x", 0, 10), Rule("y", 0, 1)], F.lit("2020-12-31").cast("date")
    schema = "indicator string, ds date, value double"
    rng = random.Random(5)
    rows = [(k, month_end(i), rng.choice([None, 0.5, 5.0, 50.0])) for k in "xyz" for i in range(9)]
    rng.shuffle(rows)  # late dates come with early ones
    land, out = str(tmp_path / "land"), str(tmp_path / "out")

    def run():
        src = stream.landed_stream(spark, land, spark.createDataFrame([], schema).schema, maxFilesPerTrigger=1)
        stream.refresh_scores(src, rules, out, str(tmp_path / "checkpoint"), as_of)

    for i in range(0, 27, 9):
        spark.createDataFrame(rows[i : i + 9], schema).coalesce(1).write.mode("append").parquet(land)
        run()
    run()
    for batch in range(3):
        seen = spark.createDataFrame(rows[: 9 * batch + 9], schema)
        want = quality.state_score(quality.indicator_state(seen, rules), as_of).first()
        assert spark.read.parquet(f"{out}/scores/batch_id={batch}").first() == want
    assert sorted(r["rows"] for r in store.list_snapshots(spark, f"{out}/snapshots").collect()) == [9, 9, 9]
    empty = quality.state_score(quality.indicator_state(spark.createDataFrame([], schema), rules), as_of).first()
    assert (empty["status"], empty["score"], empty["rows"]) == ("ERROR", 0.0, 0)


def test_states_of_parts_merge(spark):
    rows = [("x", month_end(i), v) for i, v in enumerate([1.0, None, 99.0, 3.0])]
    df = spark.createDataFrame(rows, "indicator string, ds date, value double")
    rules = [Rule("x", 0, 10)]
    parts = [quality.indicator_state(df.where(c), rules) for c in ("value < 2", "value IS NULL OR value > 2")]
    assert quality.merge_states(*parts).collect() == quality.indicator_state(df, rules).select(*quality.merge_states(*parts).columns).collect()
