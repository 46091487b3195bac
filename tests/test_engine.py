import numpy as np
import pytest
from panels import month_end
from pyspark.sql import functions as F

from seriesloom import PanelEngine
from seriesloom.models import pooled
from seriesloom.operators import features
from seriesloom.sources.loader import PanelLoader


@pytest.fixture
def engine(make_panel, spark):
    rng = np.random.default_rng(0)
    x = 50 + np.cumsum(rng.normal(0, 1, 60))
    p = make_panel({"a": list(2 * x + rng.normal(0, 1, 60)), "b": list(500 - 3 * x + rng.normal(0, 5, 60)), "short": [1.0] * 5})
    ind = spark.createDataFrame([(month_end(i), float(v), 1.0 + i % 3) for i, v in enumerate(x)], "ds date, oil double, rate double")
    return PanelEngine(p, ind)


def test_chain(engine, spark, tmp_path):
    board = engine.fit()
    assert board.filter("rank = 1").count() == 2
    fc = engine.predict(6)
    assert fc.filter("lo > yhat or hi < yhat").count() == 0
    reasons = {r["series"]: r["reason"] for r in fc.collect()}
    assert reasons.pop("short", "no hold-out rows") == "no hold-out rows" and reasons == {"a": None, "b": None}
    levels = spark.createDataFrame([("up", "oil", "add", 10.0), ("same", "oil", "mul", 1.0)], "scenario string, indicator string, op string, arg double")
    s = {(r["scenario"], r["series"]): r["t"] for r in engine.predict(6, levels).groupBy("scenario", "series").agg(F.sum("yhat").alias("t")).collect()}
    assert s["up", "a"] > s["same", "a"] and s["up", "b"] < s["same", "b"]
    assert engine.predict(6, strategy="manual", manual="Trend-Factor").select("model").distinct().count() == 1
    bands = engine.replay(3).filter("series = 'a'")
    assert bands.filter("p05 <= p25 and p25 <= p50 and p50 <= p75 and p75 <= p95").count() == 3
    assert engine.tornado(3).count() == 2
    far = engine.indicators.withColumn("oil", F.col("oil") + 100)
    flags = {r["feature"]: r["drift"] for r in engine.check_drift(far).collect()}
    assert flags == {"oil": True, "rate": False}
    engine.save_results(fc, str(tmp_path / "out"))
    kinds = {r["kind"]: r["n"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"Realisasi": 125, "Forecast": fc.count()}


def test_repair_counts_outliers(make_panel):
    y = [100.0, 101, 99, 100, 102, 98, 100, 101, 99, 100, 101, 99]
    y[6] = 900
    e = PanelEngine(make_panel({"a": y}))
    assert e.repair() == 1 and e.panel.agg(F.max("y")).first()[0] < 110


def test_loader(spark, tmp_path):
    lines = ["Tanggal,Jenis Pajak,Nominal"] + [f"28/{m:02d}/2020,A,{m}" for m in range(1, 13)] + ["28/01/2020,B,5"]
    (tmp_path / "h.csv").write_text("\n".join(lines))
    (tmp_path / "m.csv").write_text("Tanggal,oil\n28/03/2020,3\n28/05/2020,5\n")
    loader = PanelLoader(spark, str(tmp_path / "h.csv"), str(tmp_path / "m.csv"), ["oil"])
    loader.load().write.format("noop").mode("overwrite").save()
    meta = loader.metadata()
    assert meta["rows"] == 13 and meta["n_series"] == 2 and meta["has_indicators"]
    assert [r["oil"] for r in loader.one_series("A").collect()] == [3, 3, 3, 3, 5, 5, 5, 5, 5, 5, 5, 5]
    assert loader.indicator_columns() == ["oil"] and loader.series_names().count() == 2
    assert not PanelLoader(spark, str(tmp_path / "h.csv"), str(tmp_path / "none.csv"), ["oil"]).load().columns[3:]
    (tmp_path / "s.csv").write_text("\n".join(lines[:4]))
    with pytest.raises(ValueError, match="fewer than 12 rows"):
        PanelLoader(spark, str(tmp_path / "s.csv")).load()


def test_pipeline_round_trip(make_panel, tmp_path):
    rows = pooled.scale_by_series(features.holdout_split(features.ml_features(make_panel({"a": [float(i % 7 + i) for i in range(40)]}))))
    model = pooled.fit(rows, "ridge")
    pooled.save(model, str(tmp_path / "m"))
    a = pooled.predict(rows, model).agg(F.sum("yhat")).first()[0]
    b = pooled.predict(rows, pooled.load(str(tmp_path / "m"))).agg(F.sum("yhat")).first()[0]
    assert a == pytest.approx(b)
