"""Shapes of the physical plans that must hold at any scale."""

import re

import pytest

from seriesloom.plans import load_all

SF = "/root/testdata/sf0.001"
Q = load_all()[0]
# queries that run jobs while they are built or read text columns only
EAGER = {"iso_forest", "tune_forest", "feature_importance", "snapshot_roundtrip", "snapshot_list", "export_roundtrip", "csv_roundtrip",
         "stream_daily", "stream_monthly", "incremental_refresh", "stream_scores", "tune_halving"} | {n for n in Q if re.match(r"fc_(gbt|rf|extra|lasso|elastic|huber|poly)", n)}


def plan(spark, name):
    return Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in Q if n not in EAGER])
def test_no_cross_product(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_indicators_are_broadcast_and_scans_are_pruned(spark):
    text = plan(spark, "merge_indicators")
    assert "BroadcastHashJoin" in text
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert any(s == "o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz" for s in schemas)
    assert all("o_orderpriority" not in s and "l_tax" not in s or "l_discount" in s for s in schemas)


def test_filters_reach_the_scan(spark):
    text = plan(spark, "asof_by_key")
    assert "EqualTo(event_type,purchase)" in text and "EqualTo(event_type,view)" in text


def test_top_per_source_is_cut_before_the_shuffle(spark):
    text = plan(spark, "headline_round_robin")
    # the tree is printed from the top: the final limit, the exchange, and below it the limit of each task
    assert re.search(r"WindowGroupLimit [^\n]*Final.*Exchange hashpartitioning\(source.*WindowGroupLimit [^\n]*Partial", text, re.S)


def test_one_exchange_for_all_series_windows(spark):
    """Densify, features, split and scaling share one hash partitioning by series."""
    text = plan(spark, "standardized_features")
    assert len(re.findall(r"hashpartitioning\(series#\d+, \d+\)", text)) == 1


def test_orders_collapse_before_the_customer_join(spark):
    text = plan(spark, "panel_monthly")
    join = text.find("HashJoin") if "HashJoin" in text else text.find("SortMergeJoin")
    assert text[join:].count("HashAggregate") >= 2 and "partial_sum" in text[join:]


def test_unpartitioned_windows_only_over_period_totals(spark):
    for name in ("yoy_growth", "mom_growth", "guarded_growth", "buoyancy"):
        text = plan(spark, name)
        at = text.find("Exchange SinglePartition")
        # what reaches the single partition is already one row per month
        assert at >= 0 and "HashAggregate(keys=[ds" in text[at:].split("Scan")[0]
