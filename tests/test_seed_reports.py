"""Facts that follow by hand from the demo data at as_of = 2025-01-20 (FIXTURES §2)."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rigflow.functions import status as S
from rigflow.operators import enrich as E
from rigflow.operators import reports as R
from seed import AS_OF, frames


@pytest.fixture(scope="module")
def f(spark):
    return frames(spark)


def test_asset_summary(f):
    row = R.asset_summary(f["assets"]).first()
    assert row.total == 24 and row.total_value == Decimal("12750000.00")
    by = {r.status: r["count"] for r in f["assets"].groupBy("status").count().collect()}
    assert by == {"Active": 17, "Maintenance": 3, "Contracted": 2, "Inactive": 1, "Standby": 1}
    assert row.active == 17 and row.contracted == 2 and row.rigs_with_assets == 14


def test_rig_status(f):
    by = {r.status: r["count"] for r in f["rigs"].groupBy("status").count().collect()}
    assert by == {"Active": 10, "Maintenance": 2, "Standby": 2}


def test_maintenance_classification(f):
    s = f["schedules"].withColumn("live", S.due_status(as_of=AS_OF))
    live = {r.pm_id: r.live for r in s.collect()}
    assert sorted(k for k, v in live.items() if v == "Overdue") == ["PM-003", "PM-004", "PM-005", "PM-011", "PM-013"]
    assert sorted(k for k, v in live.items() if v == "Due Soon") == ["PM-002", "PM-006", "PM-007", "PM-010"]
    assert sorted(k for k, v in live.items() if v == "Scheduled") == ["PM-001", "PM-008", "PM-009"]
    assert sum(v == "Completed" for v in live.values()) == 2
    k = R.maintenance_kpis(f["schedules"], AS_OF).first()
    assert (k.total, k.overdue, k.due_soon, k.completed) == (14, 5, 4, 2)


def test_fan_out_counts(f):
    rows = {r.rig_name: r for r in R.dashboard_by_rig(f["rigs"], f["assets"], f["schedules"], AS_OF).collect()}
    assert (rows["Rig 1"].asset_count, rows["Rig 1"].asset_count_distinct) == (4, 2)
    assert (rows["Rig 2"].asset_count, rows["Rig 2"].asset_count_distinct) == (4, 2)
    assert (rows["Rig 3"].asset_count, rows["Rig 4"].asset_count) == (3, 3)
    assert rows["Rig 10"].asset_count == 1
    by_rig = {r.rig_name: r for r in R.maintenance_by_rig(f["rigs"], f["assets"], f["schedules"], AS_OF).collect()}
    assert by_rig["Rig 1"].total_tasks == 4 and by_rig["Rig 1"].overdue == 2
    assert by_rig["Rig 2"].total_tasks == 4 and by_rig["Rig 2"].completed == 1
    assert by_rig["Rig 14"].total_tasks == 0


def test_contract_expiry_forms(f):
    exp = [r.contract_no for r in R.contracts_expiring(f["contracts"], f["companies"], f["rigs"], AS_OF).collect()]
    assert "CON-2024-001" not in exp
    lapsing = [r.contract_no for r in R.contracts_lapsing(f["contracts"], f["companies"], f["rigs"], AS_OF).collect()]
    assert "CON-2024-001" in lapsing
    live = {r.contract_no: r.live_status for r in
            E.enrich_contracts(f["contracts"], f["companies"], f["rigs"], f["assets"], AS_OF).collect()}
    assert live["CON-2024-001"] == "Expired"
    assert live["CON-2024-003"] == "Expired"
    assert live["CON-2025-001"] == "Pending"


def test_broadcast_notices_count_for_every_user(f):
    rows = R.notification_counts(f["notifications"], f["users"]).collect()
    assert len(rows) == 6 and all(r.unread == 4 and r.visible == 4 for r in rows)


def test_dashboard_kpis_one_row(spark, f):
    t = spark.createDataFrame([("T1", "Pending"), ("T2", "Completed")], "id string, status string")
    k = R.dashboard_kpis(spark, f["assets"], f["rigs"], f["contracts"], f["schedules"], t,
                         f["notifications"], AS_OF).collect()
    assert len(k) == 1
    r = k[0]
    assert r.assets_total == 24 and r.rigs_total == 14 and r.maintenance_overdue == 5
    assert r.transfers_pending == 1 and r.notifications_broadcast_unread == 4
    assert r.contracts_expiring_soon == 0 and r.contracts_active == 2


def test_upcoming_top_k(f):
    up = R.upcoming_maintenance(f["schedules"], f["assets"], f["rigs"], AS_OF, k=10).collect()
    assert len(up) == 9
    assert [r.pm_id for r in up][:3] == ["PM-011", "PM-003", "PM-004"]
    assert up[0].alert_type == "Overdue" and up[-1].alert_type == "Due Soon"
