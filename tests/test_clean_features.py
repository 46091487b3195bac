import datetime as dt

import pytest
from panels import month_end
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriesloom.functions import calendar as cal
from seriesloom.functions import numeric as num
from seriesloom.functions import text as tx
from seriesloom.operators import align, clean, features
from seriesloom.operators.features import feature_names


def values(df, col, *order):
    return [r[0] for r in df.orderBy(*order).select(col).collect()]


def test_month_steps_from_leap_february(spark):
    df = spark.createDataFrame([(dt.date(2020, 2, 29),), (dt.date(2021, 1, 31),)], "d date")
    got = df.select(cal.month_ends_after(F.col("d"), 3)).collect()
    assert got[0][0] == [dt.date(2020, 3, 31), dt.date(2020, 4, 30), dt.date(2020, 5, 31)]
    assert got[1][0] == [dt.date(2021, 2, 28), dt.date(2021, 3, 31), dt.date(2021, 4, 30)]


def test_day_first_parse(spark):
    df = spark.createDataFrame([("31/01/2020",), ("2020-01-31",), ("31/02/2020",), (None,)], "t string")
    assert [r[0] for r in df.select(cal.parse_day_first(F.col("t"))).collect()] == [dt.date(2020, 1, 31), None, None, None]


def test_nan_becomes_null(spark):
    df = num.nan_to_null(spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "a double, b int"))
    assert df.agg(F.avg("a")).first()[0] == 2.0


def test_densify_and_fills(make_panel):
    p = make_panel({"a": [1, None, 3, None, None, 6], "b": [5]})
    assert values(clean.densify(p), "y", "series", "ds") == [1, None, 3, None, None, 6, 5]
    assert values(clean.densify(p, "zero"), "y", "series", "ds") == [1, 0, 3, 0, 0, 6, 5]
    assert values(clean.densify(p, "ffill"), "y", "series", "ds") == [1, 1, 3, 3, 3, 6, 5]
    assert values(clean.densify(p), "ds", "series", "ds")[:6] == [month_end(i) for i in range(6)]


def test_fill_is_per_series_and_by_date_not_row_order(spark):
    rows = [("b", month_end(1), None), ("a", month_end(2), None), ("a", month_end(0), 1.0), ("b", month_end(2), 9.0), ("a", month_end(1), None)]
    df = spark.createDataFrame(rows, "series string, ds date, y double")
    assert values(clean.fill_both(df, ["y"]), "y", "series", "ds") == [1.0, 1.0, 1.0, 9.0, 9.0]
    assert values(clean.forward_fill(df, ["y"]), "y", "series", "ds") == [1.0, 1.0, 1.0, None, 9.0]
    assert values(clean.backward_fill(df, ["y"]), "y", "series", "ds") == [1.0, None, None, 9.0, 9.0]


def test_outlier_repair_uses_original_neighbours(make_panel):
    base = [100.0, 101, 99, 100, 102, 98, 100, 101, 99, 100]
    base[5] = 500.0
    out = clean.repair_outliers(make_panel({"a": base, "flat": [7] * 10})).filter("series = 'a'").orderBy("ds").collect()
    assert [r["is_fixed"] for r in out].count(True) == 1
    near = base[2:5] + base[6:8]
    assert out[5]["y_fixed"] == pytest.approx(sum(near) / len(near))
    assert out[5]["y"] == 500.0


def test_override_and_corrections(make_panel, spark):
    from seriesloom.sources.store import apply_corrections

    p = make_panel({"a": [1, 2]})
    fix = spark.createDataFrame([("a", month_end(1), 20.0), ("zz", month_end(1), 5.0)], "series string, ds date, new_value double")
    assert values(clean.override(p, fix, ["series", "ds"], "y"), "y", "ds") == [1.0, 20.0]
    cells = spark.createDataFrame([("a", month_end(0), "y", 7.0)], "series string, ds date, column string, new_value double")
    assert values(apply_corrections(p, cells, ["series", "ds"], ["y"]), "y", "ds") == [7.0, 2.0]


def test_lags_and_rolling_wait_for_a_full_window(make_panel):
    p = make_panel({"a": [1, 2, 4, 8, 16]})
    out = features.rolling_features(features.lag_features(p)).orderBy("ds").collect()
    assert [r["lag_1"] for r in out] == [None, 1, 2, 4, 8]
    assert [r["rolling_mean_3"] for r in out][:3] == [None] * 3
    assert out[3]["rolling_mean_3"] == pytest.approx(7 / 3)
    assert out[4]["rolling_max_3"] == 8 and out[4]["rolling_min_3"] == 2


def test_ml_features_have_no_nulls_and_the_named_columns(make_panel):
    p = make_panel({"a": range(1, 51)})
    for long_form in (False, True):
        out = features.ml_features(p, long_form=long_form)
        assert set(feature_names(long_form=long_form)) <= set(out.columns)
        assert out.count() == 47
        assert out.na.drop("any").count() == 47


def test_holdout_never_enters_the_scaler(make_panel):
    p = make_panel({"a": [1.0] * 12 + [1000.0] * 12})
    out = features.standardize(features.holdout_split(p), ["y"])
    assert {r[0] for r in out.filter("part = 'train'").select("y_z").collect()} == {0.0}
    assert out.filter("part = 'test'").count() == 12


def test_length_gate(make_panel):
    p = make_panel({"short": [1] * 8, "mid": [1] * 13, "long": [1] * 30})
    got = {r["series"]: r["reason"] for r in features.length_gate(p).collect()}
    assert got == {"short": "too few rows", "mid": "no training rows left", "long": "ok"}


def test_asof_takes_last_known_value_across_months(spark):
    left = spark.createDataFrame([("k", dt.date(2020, m, 15)) for m in range(1, 7)] + [("q", dt.date(2020, 1, 1))], "k string, ds date")
    right = spark.createDataFrame([("k", dt.date(2020, 2, 20), 2.0), ("k", dt.date(2020, 4, 15), 4.0), ("k", dt.date(2020, 5, 1), None)], "k string, ds date, v double")
    out = align.asof_backward(left, right, "ds", "v", by=["k"])
    assert values(out, "v", "k", "ds") == [None, None, 2.0, 4.0, 4.0, 4.0, None]
    assert values(align.asof_backward(left, right, "ds", "v", by=["k"], default=0.5), "v", "k", "ds")[0] == 0.5


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 400), st.booleans()), min_size=1, max_size=40))
def test_asof_matches_brute_force(spark, items):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    right = {i: float(i) for i, is_right in items if is_right}
    left = sorted({i for i, is_right in items if not is_right})
    if not left or not right:
        return
    l = spark.createDataFrame([(day(i),) for i in left], "ds date")
    r = spark.createDataFrame([(day(i), v) for i, v in right.items()], "ds date, v double")
    want = [right[max((j for j in right if j <= i), default=None)] if any(j <= i for j in right) else None for i in left]
    assert values(align.asof_backward(l, r, "ds", "v"), "v", "ds") == want


def test_annual_lookup_prefers_own_year_then_last_then_default(spark):
    months = spark.createDataFrame([(dt.date(2019, 1, 31),), (dt.date(2021, 1, 31),), (dt.date(2030, 1, 31),)], "ds date")
    annual = spark.createDataFrame([(2020, 2.0), (2021, 3.0), (2022, None)], "year bigint, value double")
    assert values(align.annual_to_monthly(months, annual, 5.0, "v"), "v", "ds") == [3.0, 3.0, 3.0]
    assert values(align.annual_to_monthly(months, annual.filter("year < 0"), 5.0, "v"), "v", "ds") == [5.0, 5.0, 5.0]


def test_repeat_last_and_future_calendar(spark, make_panel):
    ind = spark.createDataFrame([(month_end(0), 1.0), (month_end(1), 2.0)], "ds date, x double")
    assert align.repeat_last(ind, 3).orderBy("ds").collect()[-1]["ds"] == month_end(4)
    p = make_panel({"a": [1, 2, 3], "b": [1]})
    per = {r["series"]: r["ds"] for r in align.future_calendar(p, 1).collect()}
    assert per == {"a": month_end(3), "b": month_end(1)}
    glob = {r["ds"] for r in align.future_calendar(p, 1, align="global").collect()}
    assert glob == {month_end(3)}


def test_holiday_flags(make_panel, spark):
    hol = spark.createDataFrame([(2020, 3, "is_eid"), (2020, 3, "is_eid"), (2020, 12, "is_christmas")], "year int, month int, flag string")
    out = align.holiday_flags(make_panel({"a": range(12)}), hol, ["is_eid", "is_christmas"]).orderBy("ds").collect()
    assert [r["is_eid"] for r in out] == [0, 0, 1] + [0] * 9
    assert out[11]["is_christmas"] == 1 and len(out) == 12


def test_align_and_indicator_discovery(spark):
    df = spark.createDataFrame([("a", 1, 2.0, None)], "series string, year int, x double, z double")
    out = num.align_columns(df, ["z", "new", "x"], keep=["series"])
    assert out.columns == ["series", "z", "new", "x"]
    assert out.first()[1:] == (0.0, 0.0, 2.0)
    assert num.indicator_columns(df) == ["year", "x", "z"]
    assert num.without_calendar(df) == ["x", "z"]
    assert num.common_columns(df, out) == ["series", "x", "z"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("Mon, 05 Aug 2024 10:01:30 GMT", "91.20%", "a **b** c"), ("yesterday at noon o", "x", "none")], "d string, p string, b string")
    out = df.select(tx.feed_date(F.col("d")), tx.parse_percent(F.col("p")), tx.bold_to_tag(F.col("b"))).collect()
    assert out[0] == ("05 Aug 10:01", 91.2, "a <b>b</b> c")
    assert out[1] == ("yesterday at noo", None, "none")
