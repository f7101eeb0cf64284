"""Registered queries on tables as of other times, mergeable counts, rig creates, deletes by
role, and the value rules of the tables that ``coverage`` leaves."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import history as V
from ..operators import paging as P
from ..operators import quality as Q
from ..operators import sketches as K
from ..session import ensure_checkpoint_dir, materialize
from ..sources.adapters import with_views_and
from ..sources.layout import KeyedTable
from .catalog import register
from .coverage import _quoted, _rules_query
from .jobs import WRITE, register_sql

# ====================================================================== tables as of other times
INSTANTS = (dt.datetime(2024, 1, 6), dt.datetime(2024, 1, 13, 12), dt.datetime(2024, 1, 27, 6, 30))
_PATCHES = """SELECT event_id AS seq, ts, user_id AS id,
  CASE event_type WHEN 'error' THEN 'Maintenance' WHEN 'purchase' THEN 'Active' END AS status,
  CASE WHEN event_type = 'view' THEN concat('Yard ', CAST(user_id % 7 AS STRING)) END AS location FROM events"""


def _patches(d):
    d.t.events.createOrReplaceTempView("rigflow_events")
    return d.spark.sql(_PATCHES.replace("FROM events", "FROM rigflow_events"))


@register_sql("assets_at_instants", with_views_and(f"""patches AS ({_PATCHES}),
instants(as_of) AS (VALUES {", ".join(f"(TIMESTAMP '{t}')" for t in INSTANTS)})
SELECT i.as_of, a.id, coalesce(arg_max(p.status, (p.ts, p.seq)) FILTER (WHERE p.status IS NOT NULL), any_value(a.status)) AS status,
  coalesce(arg_max(p.location, (p.ts, p.seq)) FILTER (WHERE p.location IS NOT NULL), any_value(a.location)) AS location
FROM assets a CROSS JOIN instants i LEFT JOIN patches p ON p.id = a.id AND p.ts <= i.as_of GROUP BY i.as_of, a.id""", ["assets"]))
def q_assets_at_instants(spark, d):
    return V.table_at(d.assets.select("id", "status", "location"), _patches(d), list(INSTANTS), ["status", "location"])


@register_sql("status_at_request", f"""
WITH patches AS ({_PATCHES}),
known AS (SELECT id, ts, max_by(status, seq) AS status, max(seq) AS version FROM patches WHERE status IS NOT NULL GROUP BY id, ts)
SELECT q.event_id, q.user_id, q.ts, k.status, k.version
FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') q ASOF LEFT JOIN known k ON k.id = q.user_id AND k.ts <= q.ts""")
def q_status_at_request(spark, d):
    """The status an asset had when each request on it was made."""
    asked = d.t.events.where(F.col("event_type") == "click").select("event_id", "user_id", "ts")
    known = _patches(d).where(F.col("status").isNotNull()).withColumn("version", F.col("seq"))
    return V.as_of_join(asked, known, "user_id", "ts", "id", "ts", "seq", ["status", "version"])


@register("history_validity", ["asset_history"], """
SELECT id, asset_id, created_at AS valid_from, lead(created_at) OVER (PARTITION BY asset_id ORDER BY created_at, id) AS valid_to FROM asset_history""")
def q_history_validity(spark, d):
    return V.validity_intervals(d.asset_history, "asset_id", "created_at", "id").select("id", "asset_id", "valid_from", "valid_to")


# ====================================================================== distinct counts that add up
@register_sql("distinct_users_by_week", """
SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS week, count(DISTINCT user_id) AS users, true AS estimate_holds
FROM events GROUP BY ALL""")
def q_distinct_users_by_week(spark, d):
    """Daily sketches merged into weeks; the estimate is held against the exact count."""
    ev = d.t.events.withColumns({"day": F.to_date("ts"), "week": F.date_trunc("week", "ts").cast("timestamp_ntz")})
    daily = K.distinct_sketches(ev, ["event_type", "day", "week"], "user_id")
    weeks = K.merge_sketches(daily, ["event_type", "week"]).select(F.col("event_type").alias("_e"), F.col("week").alias("_w"), K.estimate().alias("_n"))
    exact = ev.select("event_type", "week", "user_id").distinct().groupBy("event_type", "week").agg(F.count("user_id").alias("users"))
    j = exact.join(weeks, F.col("event_type").eqNullSafe(F.col("_e")) & F.col("week").eqNullSafe(F.col("_w")))
    return j.select("event_type", "week", "users", (F.abs(F.col("_n") - F.col("users")) <= F.col("users") * K.bound()).alias("estimate_holds"))


# ====================================================================== rig creates
_RIG_CREATES = """SELECT event_id AS seq, concat('RIG', lpad(CAST(user_id % 60 AS STRING), 2, '0')) AS rig_id,
  CASE user_id % 60 WHEN 30 THEN 'NATION_7' WHEN 31 THEN NULL ELSE concat('Rig ', CAST(user_id % 60 AS STRING)) END AS name,
  CASE event_id % 5 WHEN 0 THEN 'Bogus' WHEN 1 THEN NULL ELSE 'SCR' END AS type,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE CAST(event_id % 5 AS STRING) END AS company_id,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('Field ', CAST(user_id % 9 AS STRING)) END AS location,
  CASE event_id % 7 WHEN 0 THEN 0 WHEN 1 THEN -5 ELSE 1500 END AS horsepower,
  CASE event_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'Lost' WHEN 2 THEN NULL ELSE 'Standby' END AS status,
  CASE event_id % 6 WHEN 0 THEN 'Viewer' WHEN 1 THEN NULL ELSE 'Editor' END AS role FROM events"""


@register_sql("create_rigs", with_views_and(f"""batch AS ({_RIG_CREATES}),
judged AS (SELECT seq, rig_id, name, type, nullif(company_id, '') AS company_id, nullif(location, '') AS location, nullif(horsepower, 0) AS horsepower,
    coalesce(nullif(status, ''), 'Active') AS status, CASE WHEN role IS NULL OR role NOT IN {WRITE} THEN 'role' WHEN name IS NULL THEN 'missing_fields'
    WHEN type NOT IN ({_quoted("rigs", "type")}) THEN 'type_allowed' WHEN status <> '' AND status NOT IN ({_quoted("rigs", "status")}) THEN 'status_allowed'
    WHEN horsepower < 0 THEN 'horsepower_positive' WHEN rig_id IN (SELECT rig_id FROM rigs) OR name IN (SELECT name FROM rigs) THEN 'exists' END AS reason
  FROM batch)
SELECT seq, rig_id, name, type, company_id, location, horsepower, status,
  CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY reason, rig_id ORDER BY seq) > 1 THEN 'duplicate' ELSE reason END AS reason FROM judged""", ["rigs"]))
def q_create_rigs(spark, d):
    d.t.events.createOrReplaceTempView("rigflow_events")
    out = Q.create_rigs(d.rigs, spark.sql(_RIG_CREATES.replace("FROM events", "FROM rigflow_events")))
    rows = out["accepted"].withColumn("reason", F.lit(None).cast("string")).unionByName(out["rejected"])
    return rows.drop("role")


# ====================================================================== deletes asked for under a role
_DELETES = """SELECT event_id AS seq, user_id AS asset_id,
  CASE user_id % 5 WHEN 0 THEN 'Admin' WHEN 1 THEN 'Editor' WHEN 2 THEN 'Asset Manager' END AS role FROM events WHERE event_type = 'error'"""
_GONE = f"""gone AS (SELECT DISTINCT asset_id AS id FROM ({_DELETES}) WHERE role IN ('Admin', 'Asset Manager'))"""


def _deleted(d, *tables: str):
    d.t.events.createOrReplaceTempView("rigflow_events")
    ok = C.check_delete_role(d.spark.sql(_DELETES.replace("FROM events", "FROM rigflow_events")))
    given = {"assets": d.assets, **{t: getattr(d, t) for t in tables}}
    return C.delete_cascade(given, "assets", ok["accepted"], "asset_id", complete=False), ok["rejected"]


@register_sql("delete_requests_rejected", f"SELECT seq, asset_id, role, 'role' AS reason FROM ({_DELETES}) WHERE role IS NULL OR role = 'Editor'")
def q_delete_requests_rejected(spark, d):
    return _deleted(d)[1]


@register_sql("delete_by_role", with_views_and(f"{_GONE} SELECT * FROM assets WHERE id NOT IN (SELECT id FROM gone)", ["assets"]))
def q_delete_by_role(spark, d):
    return _deleted(d)[0]["assets"]


@register_sql("delete_by_role_history", with_views_and(f"{_GONE} SELECT * FROM asset_history WHERE asset_id NOT IN (SELECT id FROM gone)", ["asset_history"]))
def q_delete_by_role_history(spark, d):
    return _deleted(d, "asset_history")[0]["asset_history"]


@register_sql("delete_by_role_transfers", with_views_and(f"""{_GONE} SELECT id, asset_id, transfer_id, status FROM transfers
WHERE asset_id NOT IN (SELECT id FROM gone)""", ["transfers"]))
def q_delete_by_role_transfers(spark, d):
    return _deleted(d, "transfers")[0]["transfers"].select("id", "asset_id", "transfer_id", "status")


# ====================================================================== unread in the returned page
@register("feed_unread", ["notifications", "users"], """
SELECT u.id AS user_id, count(f.id) AS returned, count(f.id) FILTER (WHERE NOT f.is_read) AS unread
FROM users u LEFT JOIN (SELECT v.id AS viewer_id, n.id, n.is_read FROM users v JOIN notifications n ON n.user_id = v.id OR n.user_id IS NULL
  QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY n.created_at DESC, n.id DESC) <= 50) f ON f.viewer_id = u.id GROUP BY u.id""")
def q_feed_unread(spark, d):
    return P.unread_in_page(P.notification_feed(d.notifications, d.users, d.assets, k=50), d.users)


# ====================================================================== value rules of the other tables
def _one_of(table: str, column: str) -> str:
    return f"{column} NOT IN ({_quoted(table, column)})"


_rules_query("check_users", "users", "users", {
    "role": "CASE WHEN id % 40 = 0 THEN 'Owner' ELSE role END", "status": "CASE id % 30 WHEN 0 THEN 'Gone' WHEN 1 THEN NULL ELSE status END"},
    lambda d: d.users, {"role_allowed": _one_of("users", "role"), "status_allowed": _one_of("users", "status")})
_rules_query("check_companies", "companies", "companies", {
    "type": "CASE id % 3 WHEN 0 THEN 'Bank' WHEN 1 THEN NULL ELSE 'Operator' END", "status": "CASE WHEN id % 2 = 0 THEN 'Lost' ELSE status END"},
    lambda d: d.companies, {"type_allowed": _one_of("companies", "type"), "status_allowed": _one_of("companies", "status")})
_rules_query("check_rigs", "rigs", "rigs", {
    "type": "CASE id % 5 WHEN 0 THEN 'Steam' WHEN 1 THEN NULL ELSE 'SCR' END", "status": "CASE WHEN id % 6 = 0 THEN 'Lost' ELSE status END",
    "depth_capacity_ft": "CASE WHEN id % 7 = 0 THEN 0 ELSE 9000 END", "horsepower": "CASE id % 8 WHEN 0 THEN -1 WHEN 1 THEN NULL ELSE 1500 END",
    "mast_height_ft": "CASE WHEN id % 9 = 0 THEN 0 ELSE 140 END", "max_hook_load_ton": "CASE WHEN id % 10 = 0 THEN -3 ELSE 300 END"},
    lambda d: d.rigs, {"type_allowed": _one_of("rigs", "type"), "status_allowed": _one_of("rigs", "status"),
                       "depth_capacity_ft_positive": "depth_capacity_ft <= 0", "horsepower_positive": "horsepower <= 0",
                       "mast_height_ft_positive": "mast_height_ft <= 0", "max_hook_load_ton_positive": "max_hook_load_ton <= 0"})
_rules_query("check_schedules", "maintenance_schedules", "maintenance_schedules", {
    "task_type": "CASE WHEN id % 50 = 0 THEN 'Nap' ELSE task_type END", "priority": "CASE WHEN id % 60 = 0 THEN 'Soon' ELSE priority END",
    "status": "CASE WHEN id % 70 = 0 THEN '' ELSE status END", "frequency_days": "CASE WHEN id % 80 = 0 THEN 0 ELSE frequency_days END",
    "alert_days": "CASE WHEN id % 90 = 0 THEN -1 ELSE alert_days END", "estimated_hours": "CASE id % 55 WHEN 0 THEN -0.5 WHEN 1 THEN NULL ELSE 2.0 END",
    "estimated_cost": "CASE WHEN id % 65 = 0 THEN -1 ELSE 0 END", "next_due_date": "next_due_date",
    "last_done_date": "CASE WHEN id % 75 = 0 THEN DATE '2001-01-01' WHEN id % 75 = 1 THEN NULL ELSE DATE '1990-01-01' END"},
    lambda d: d.schedules, {"task_type_allowed": "task_type = 'Nap'", "priority_allowed": "priority = 'Soon'", "status_allowed": "status = ''",
                            "frequency_positive": "frequency_days < 1", "alert_days_non_negative": "alert_days < 0",
                            "estimated_hours_non_negative": "estimated_hours < 0", "estimated_cost_non_negative": "estimated_cost < 0",
                            "next_due_after_last_done": "last_done_date > next_due_date"})
_rules_query("check_work_orders", "work_orders", "work_orders", {
    "priority": "CASE id % 50 WHEN 0 THEN 'Soon' WHEN 1 THEN NULL ELSE 'High' END", "status": "CASE WHEN id % 60 = 0 THEN 'Lost' ELSE status END",
    "estimated_hours": "CASE WHEN id % 70 = 0 THEN -1 ELSE 1 END", "actual_hours": "CASE WHEN id % 80 = 0 THEN -1 ELSE NULL END",
    "estimated_cost": "CASE WHEN id % 90 = 0 THEN -1 ELSE 1 END", "actual_cost": "CASE WHEN id % 55 = 0 THEN -1 ELSE 0 END",
    "planned_start": "DATE '1998-01-10'", "planned_end": "CASE id % 65 WHEN 0 THEN DATE '1998-01-09' WHEN 1 THEN NULL ELSE DATE '1998-01-10' END"},
    lambda d: d.work_orders, {"priority_allowed": _one_of("work_orders", "priority"), "status_allowed": _one_of("work_orders", "status"),
                              "estimated_hours_non_negative": "estimated_hours < 0", "actual_hours_non_negative": "actual_hours < 0",
                              "estimated_cost_non_negative": "estimated_cost < 0", "actual_cost_non_negative": "actual_cost < 0",
                              "planned_end_after_start": "planned_end < planned_start"})
_rules_query("check_notifications", "notifications", "notifications", {
    "type": "CASE id % 20 WHEN 0 THEN 'shout' WHEN 1 THEN NULL ELSE 'info' END", "entity_type": "CASE WHEN id % 30 = 0 THEN 'rig' ELSE entity_type END"},
    lambda d: d.notifications, {"type_allowed": _one_of("notifications", "type"), "entity_type_allowed": _one_of("notifications", "entity_type")})


# ====================================================================== history laid out by asset and month
@register("history_latest_stored", ["asset_history", "users"], """
SELECT h.id, h.asset_id, h.action, h.changed_by, h.created_at, u.full_name AS changed_by_name
FROM (SELECT * FROM asset_history QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY created_at DESC, id DESC) <= 50) h
LEFT JOIN users u ON u.id = h.changed_by""")
def q_history_latest_stored(spark, d):
    """Two appended batches, compacted; the newest rows per asset without a shuffle of history."""
    table = KeyedTable(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}", "asset_id", "created_at", 8)
    created = F.col("action") == "Created"
    for batch in (d.asset_history.where(created), d.asset_history.where(~created)):
        table.append(batch)
    table.compact()
    latest, _ = materialize(P.history_latest(table.read(), d.users, 50), "latest")
    table.forget()
    return latest.select("id", "asset_id", "action", "changed_by", "created_at", "changed_by_name")
