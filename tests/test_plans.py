"""Physical-plan properties the design relies on (checked on the smoke data)."""

import pytest

import __spark_entry__ as E

SMOKE = "/root/testdata/sf0.001"


def plan(spark, name):
    return _explain(E.queries()[name](spark, SMOKE))


def _explain(df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_top_k_limits_before_the_shuffle(spark):
    p = plan(spark, "history_latest")
    assert p.count("WindowGroupLimit") >= 2          # partial (map side) and final
    first_limit = p.index("WindowGroupLimit")
    assert "Exchange" in p[first_limit:]              # a limit sits above and below the shuffle


def test_page_total_is_not_a_single_partition_window(spark):
    p = plan(spark, "assets_page")
    assert "SinglePartition" not in p.split("===== Subqueries =====")[0]
    assert "TakeOrderedAndProject" in p


def test_scans_are_pruned(spark):
    p = plan(spark, "maintenance_by_rig")
    orders_schema = [l for l in p.splitlines() if "ReadSchema" in l and "o_orderkey" in l][0]
    assert "o_totalprice" not in orders_schema and "o_orderdate" in orders_schema
    cust = [l for l in p.splitlines() if "ReadSchema" in l and "c_custkey" in l][0]
    assert "c_name" not in cust and "c_acctbal" not in cust


def test_filters_reach_the_scan(spark):
    p = plan(spark, "complete_maintenance_logs")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in p


def test_pre_aggregation_before_exchange(spark):
    p = plan(spark, "maintenance_by_rig")
    assert "partial_count" in p and "partial_sum" in p


def test_kpis_use_scalar_subqueries_not_joins(spark):
    p = plan(spark, "dashboard_summary")
    assert "Subquery" in p and "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_lookup_is_equi_joins_not_nested_loop(spark):
    p = plan(spark, "asset_lookup_either_key")
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
