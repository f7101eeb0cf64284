import datetime as dt

import pytest
from decimal import Decimal

from pyspark.sql import functions as F

from rigflow.operators import changes as C


def test_patch_update_coalesce_and_order(spark):
    base = spark.createDataFrame([("1", "AST-1", "Active", "Site A"), ("2", "AST-2", "Active", "Site B")],
                                 "id string, asset_id string, status string, location string")
    patches = spark.createDataFrame(
        [(1, "AST-1", "Admin", "Maintenance", None), (2, "1", "Editor", None, "Yard"),
         (3, "1", "Editor", "Standby", None), (4, "2", "Viewer", "Retired", None),
         (5, "AST-9", "Admin", "Active", None), (6, "2", "Admin", None, None)],
        "seq long, key string, role string, status string, location string")
    now = F.lit(dt.datetime(2025, 1, 20))
    r = C.patch_update(base, patches, ["status", "location"], key_cols=["id", "asset_id"], now=now)
    t = {x.id: (x.status, x.location, x.updated_at is not None) for x in r["table"].collect()}
    assert t == {"1": ("Standby", "Yard", True), "2": ("Active", "Site B", True)}
    rej = {x.seq: x.reason for x in r["rejected"].collect()}
    assert rej == {4: "role", 5: "not_found"}


def test_insert_ignore_first_wins_and_idempotent(spark):
    base = spark.createDataFrame([("AST-1", "old")], "asset_id string, name string")
    batch = spark.createDataFrame([(2, "AST-2", "second"), (1, "AST-2", "first"), (3, "AST-1", "dup")],
                                  "seq long, asset_id string, name string")
    once = C.insert_ignore(base, batch, "asset_id")
    assert {r.asset_id: r.name for r in once.collect()} == {"AST-1": "old", "AST-2": "first"}
    twice = C.insert_ignore(once, batch, "asset_id")
    assert twice.count() == 2


def test_delete_cascade_and_set_null(spark):
    assets = spark.createDataFrame([("A1", "R1"), ("A2", "R2")], "id string, rig_id string")
    rigs = spark.createDataFrame([("R1",), ("R2",)], "id string")
    sched = spark.createDataFrame([("S1", "A1"), ("S2", "A2")], "id string, asset_id string")
    bom = spark.createDataFrame([("B1", "A2", None), ("B2", "A1", "B1"), ("B3", "A1", None)],
                                "id string, asset_id string, parent_id string")
    out = C.delete_cascade({"assets": assets, "rigs": rigs, "maintenance_schedules": sched, "bom_items": bom},
                           "assets", spark.createDataFrame([("A2",)], "id string"), complete=False)
    assert [r.id for r in out["maintenance_schedules"].collect()] == ["S1"]
    assert sorted(r.id for r in out["bom_items"].collect()) == ["B3"]   # B2 goes with its parent B1
    out2 = C.delete_cascade({"assets": assets, "rigs": rigs}, "rigs", spark.createDataFrame([("R1",)], "id string"), complete=False)
    with pytest.raises(ValueError):           # a referring table that is not given is not passed over
        C.delete_cascade({"assets": assets, "rigs": rigs}, "rigs", spark.createDataFrame([("R1",)], "id string"))
    assert {r.id: r.rig_id for r in out2["assets"].collect()} == {"A1": None, "A2": "R2"}


def test_complete_maintenance(spark):
    sched = spark.createDataFrame([("S1", "PM-1", 30, dt.date(2025, 1, 1), "Scheduled")],
                                  "id string, pm_id string, frequency_days int, next_due_date date, status string")
    comp = spark.createDataFrame(
        [(1, "PM-1", dt.date(2025, 1, 5), "tech", None), (2, "S1", dt.date(2025, 1, 10), "tech", dt.date(2025, 3, 1)),
         (3, "S1", None, "tech", None), (4, "PM-9", dt.date(2025, 1, 5), "tech", None)],
        "seq long, schedule_key string, completion_date date, completed_by string, next_due_date date")
    r = C.complete_maintenance(sched, comp)
    s = r["schedules"].first()
    assert (s.next_due_date, s.last_done_date, s.status) == (dt.date(2025, 3, 1), dt.date(2025, 1, 10), "Scheduled")
    logs = {x.seq: x.next_due_date for x in r["logs"].collect()}
    assert logs == {1: dt.date(2025, 2, 4), 2: dt.date(2025, 3, 1)}
    assert {x.seq: x.reason for x in r["rejected"].collect()} == {3: "missing_fields", 4: "not_found"}


def test_notifications_read_all_and_clear(spark):
    n = spark.createDataFrame([("N1", "U1", False), ("N2", "U2", False), ("N3", None, False), ("N4", None, True)],
                              "id string, user_id string, is_read boolean")
    req = spark.createDataFrame([("U1",)], "user_id string")
    after = {r.id: r.is_read for r in C.mark_read_all(n, req).collect()}
    assert after == {"N1": True, "N2": False, "N3": True, "N4": True}
    none = spark.createDataFrame([], "user_id string")
    assert {r.id: r.is_read for r in C.mark_read_all(n, none).collect()}["N3"] is False
    kept = sorted(r.id for r in C.clear_read(C.mark_read_all(n, req), req).collect())
    assert kept == ["N2"]


def test_capture_changes_created_updated_deleted(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    new = spark.createDataFrame([("1", "a2"), ("3", "c")], "id string, v string")
    rows = {r.asset_id: r.action for r in C.capture_changes(old, new).collect()}
    assert rows == {"1": "Updated", "2": "Deleted", "3": "Created"}


def test_roles(spark):
    base = spark.createDataFrame([("A1", "old")], "id string, location string")
    patches = spark.createDataFrame([(1, "A1", None, "x"), (2, "A1", "Viewer", "y"), (3, "A1", "Editor", "z")], "seq long, key string, role string, location string")
    r = C.patch_update(base, patches, ["location"], now=None)
    assert r["table"].first().location == "z"
    assert {x.seq: x.reason for x in r["rejected"].collect()} == {1: "role", 2: "role"}
    asked = C.check_delete_role(spark.createDataFrame([("A1", None), ("A1", "Editor"), ("A1", "Admin")], "id string, role string"))
    assert [x.role for x in asked["accepted"].collect()] == ["Admin"] and asked["rejected"].count() == 2


def test_completion_role_and_blank_author(spark):
    sched = spark.createDataFrame([("S1", "PM-1", 30, None, "Scheduled")], "id string, pm_id string, frequency_days int, next_due_date date, status string")
    comp = spark.createDataFrame([(1, "S1", dt.date(2025, 1, 5), " ", None, "Editor"), (2, "S1", dt.date(2025, 1, 6), "", None, "Editor"), (3, "S1", dt.date(2025, 1, 7), "t", None, None)],
                                 "seq long, schedule_key string, completion_date date, completed_by string, next_due_date date, role string")
    r = C.complete_maintenance(sched, comp, role_col="role")
    assert [x.seq for x in r["logs"].collect()] == [1]
    assert {x.seq: x.reason for x in r["rejected"].collect()} == {2: "missing_fields", 3: "role"}


def test_capture_only_changed(spark):
    old = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, v string")
    assert {r.asset_id for r in C.capture_changes(old, old).collect()} == {"1", "2"}
    assert C.capture_changes(old, old, only_changed=True).count() == 0
    one = old.where("id = '1'").select("id")
    assert [r.asset_id for r in C.capture_changes(old, old, touched=one).collect()] == ["1"]
