import datetime as dt

import pytest
from panels import month_end
from pyspark.sql import functions as F

from seriesloom.operators import insight
from seriesloom.operators.quality import Rule
from seriesloom.sources import files, store
from seriesloom.streaming import refresh as stream


def test_history_and_indicator_files(spark, tmp_path):
    h = tmp_path / "h.csv"
    h.write_text("Tanggal,Jenis Pajak,Nominal (Milyar)\n31/01/2020,A,10.5\n29/02/2020,A,NaN\nnonsense,A,3\n")
    rows = files.read_history(spark, str(h)).collect()
    assert [(r["ds"], r["y"]) for r in rows] == [(dt.date(2020, 1, 31), 10.5), (dt.date(2020, 2, 29), None), (None, 3.0)]
    m = tmp_path / "m.csv"
    m.write_text("Tanggal,Inflasi\n31/01/2020,2.5\n")
    assert files.read_indicators(spark, str(m), "Tanggal", ["Inflasi"]).first()["Inflasi"] == 2.5
    bad = tmp_path / "bad.csv"
    bad.write_text("Tanggal,Inflasi\n2020-13-99,2.5\n")
    assert files.read_indicators(spark, str(bad), "Tanggal", ["Inflasi"]) is None
    assert files.read_indicators(spark, str(tmp_path / "none.csv"), "Tanggal", ["Inflasi"]) is None


def test_annual_prices_and_feed_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "gdp.json").write_text('[{"page":1},[{"date":"2021","value":3.7},{"date":"2020","value":null},{"date":"2019","value":5.0}]]')
    got = files.read_annual(spark, str(tmp_path / "a")).orderBy("year").collect()
    assert [tuple(r) for r in got] == [("gdp", 2019, 5.0), ("gdp", 2021, 3.7)]
    p = tmp_path / "p.csv"
    p.write_text("Date,Close\n2020-01-02,1.5\n2020-01-03,\n")
    assert files.read_prices(spark, str(p), "oil").collect()[0]["value"] == 1.5
    x = tmp_path / "f.xml"
    x.write_text("<rss><channel><item><title>T</title><link>L</link><pubDate>Mon, 05 Aug 2024 10:01:30 GMT</pubDate></item><item><link>M</link></item></channel></rss>")
    items = {r["link"]: r for r in files.read_feed(spark, str(x), "src").collect()}
    assert items["L"]["published"] == "05 Aug 10:01" and items["M"]["title"] == "No Title" and items["M"]["published"] == ""


def test_snapshots(spark, make_panel, tmp_path):
    root = str(tmp_path / "snap")
    p = make_panel({"a": [1, 2]})
    one = store.save_snapshot(p, root, "20240101_000000", "first load!")
    two = store.save_snapshot(p.withColumn("y", F.col("y") + 1), root, "20240301_000000")
    assert [r[0] for r in store.list_snapshots(spark, root).collect()] == [two, one] == ["20240301_000000_auto", "20240101_000000_first_load"]
    with pytest.raises(Exception):
        store.save_snapshot(p, root, "20240101_000000", "first load!")
    with pytest.raises(ValueError):
        store.load_snapshot(spark, root, "none")
    active = str(tmp_path / "active")
    assert store.restore_snapshot(spark, root, one, active).agg(F.sum("y")).first()[0] == 3
    assert store.restore_snapshot(spark, root, two, active).agg(F.sum("y")).first()[0] == 5
    plan = store.load_snapshot(spark, root, one)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan
    assert store.preview(p, "ds", rows=1).collect()[0]["y"] == 1


def test_exports(spark, make_panel, tmp_path):
    p = make_panel({"a": [1, 2], "b": [3]})
    paths = store.export_parts(str(tmp_path), p, {"performance": p.limit(1)})
    assert (tmp_path / "forecast" / "series=a").is_dir() and len(paths) == 2
    back = spark.read.parquet(paths[0])
    assert back.count() == 3
    csv = store.export_csv(p, str(tmp_path), "20240101")
    assert spark.read.option("header", True).csv(csv).count() == 3


def test_refresh_takes_each_landing_once(spark, tmp_path):
    land, out = tmp_path / "land", str(tmp_path / "out")
    schema = "ds string, value double"

    def drop(i, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(land))

    def run():
        src = stream.landed_stream(spark, str(land), spark.createDataFrame([], schema).schema)
        stream.refresh(src, [Rule("value", 0, 10)], out, str(tmp_path / "state"))

    drop(0, [("a", 1.0), ("b", 50.0)])
    run()
    run()
    drop(1, [("c", 2.0), ("d", None)])
    run()
    assert {r["ds"] for r in spark.read.parquet(f"{out}/accepted").collect()} == {"a", "c"}
    assert {r["ds"] for r in spark.read.parquet(f"{out}/rejected").collect()} == {"b", "d"}
    scores = spark.read.parquet(f"{out}/scores").collect()
    assert len(scores) == 2 and all(r["rows"] == 2 and r["bad"] == 1 and r["score"] == 0.0 for r in scores)


def test_late_rows_are_dropped_and_open_days_wait(spark, tmp_path):
    land, schema = tmp_path / "land", "ts timestamp, value double"
    at = lambda day, h=12: dt.datetime(2024, 1, day, h)

    def drop(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(land))

    def run():
        src = stream.landed_stream(spark, str(land), spark.createDataFrame([], schema).schema)
        return stream.run_to_table(stream.daily_totals(src), str(tmp_path / "out"), str(tmp_path / "state"))

    drop([(at(1), 1.0), (at(2), 2.0), (at(5), 5.0)])
    first = {r["ds"].day: r["total"] for r in run().collect()}
    assert first == {1: 1.0, 2: 2.0}
    # day 1 is closed: its late row is lost; day 5 is open: its row counts
    drop([(at(1, 13), 100.0), (at(5, 13), 50.0), (at(9), 9.0)])
    second = {r["ds"].day: r["total"] for r in run().collect()}
    assert second == {1: 1.0, 2: 2.0, 5: 55.0}
    months = stream.monthly_from_daily(run()).collect()
    assert len(months) == 1 and months[0]["total"] == 58.0


def test_round_robin_and_signals(spark):
    rows = [(i, f"s{i % 2}" if i < 90 else "rare", t) for i, t in enumerate(["plain"] * 50 + ["Growth ahead"] * 50)]
    df = spark.createDataFrame(rows, "id int, source string, text string")
    out = insight.round_robin(df, ["id"]).orderBy("rank", "source").collect()
    assert [(r["rank"], r["source"]) for r in out] == [(k, s) for k in (1, 2, 3) for s in ("rare", "s0", "s1")]
    assert insight.round_robin(df, ["id"], limit=4).count() == 4
    sig = insight.headline_signals(spark.createDataFrame([("Big DEFICIT",), ("profit",), (None,)], "text string")).collect()
    assert [(r["is_risk"], r["is_opportunity"]) for r in sig] == [(True, False), (False, True), (None, None)]


def test_insights(spark):
    totals = spark.createDataFrame([(month_end(0), 10.0), (month_end(1), 30.0), (month_end(2), 30.0)], "ds date, total double")
    text = [r["message"] for r in insight.summary_insights(totals).collect()]
    assert text == ["projected total 70, run rate 23 a month", "peak in February 2020 with 30"]
    levels = spark.createDataFrame([("Harga_Minyak_ICP", 90.0), ("Kurs_USD", 16500.0), ("Inflasi", 4.5), ("Harga_Emas", 1.0)], "indicator string, level double")
    rules = spark.createDataFrame(list(insight.LEVEL_RULES), "indicator string, side string, lim double, kind string, message string")
    kinds = sorted(r["kind"] for r in insight.level_insights(levels, rules).collect())
    assert kinds == ["opportunity", "opportunity", "risk"]
