"""Registered queries for the remaining forms: list filters and searches, create batches,
value rules of further tables, per-user dashboard numbers, declared-schema reads."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import enrich as E
from ..operators import filters as B
from ..operators import paging as P
from ..operators import quality as Q
from ..operators import reports as R
from ..operators.search_index import TrigramIndex
from ..session import ensure_checkpoint_dir
from ..sources.adapters import with_views_and
from ..sources.schemas import ENUMS
from ..sources.tables import read_table, write_table
from .catalog import AS_OF, register
from .jobs import WRITE, register_sql


def _quoted(table: str, column: str) -> str:
    return ",".join(f"'{v}'" for v in ENUMS[(table, column)])


# ====================================================================== list filters and searches
@register("maintenance_filtered", ["maintenance_schedules", "assets", "rigs"], """
SELECT s.id, s.pm_id FROM maintenance_schedules s SEMI JOIN
  (SELECT a.id FROM assets a WHERE a.name LIKE '%7%' AND a.rig_id IN (SELECT id FROM rigs WHERE name = 'NATION_7')) x ON x.id = s.asset_id
WHERE s.priority = 'Critical' AND s.task_type = 'Inspection'""")
def q_maintenance_filtered(spark, d):
    rows = E.enrich_maintenance(d.schedules, d.assets, d.rigs, AS_OF)
    hits = B.filter_by(rows, rig_name="NATION_7", priority="Critical", task_type="Inspection", status=None)
    return B.search(hits, "7", ["asset_name"]).select("id", "pm_id")


@register("bom_filtered", ["bom_items", "assets", "rigs"], """
SELECT b.id, b.name FROM bom_items b SEMI JOIN
  (SELECT a.id FROM assets a SEMI JOIN (SELECT id FROM rigs WHERE name = 'NATION_7') r ON r.id = a.rig_id) x ON x.id = b.asset_id
WHERE b.item_type = 'Bulk' AND b.status = 'Active' AND contains(lower(b.name), 'item 1')""")
def q_bom_filtered(spark, d):
    rows = E.bom_labels(d.bom_items, d.assets, d.rigs)
    hits = B.filter_by(rows, rig_name="NATION_7", item_type="Bulk", status="Active")
    return B.search(hits, "ITEM 1", ["name"]).select("id", "name")


@register("transfers_search", ["transfers", "assets"], """
SELECT t.id, t.transfer_id FROM transfers t LEFT JOIN assets a ON a.id = t.asset_id
WHERE t.status = 'Pending' AND (contains(lower(t.transfer_id), '00001') OR contains(lower(a.name), '00001') OR contains(lower(t.destination), '00001'))""")
def q_transfers_search(spark, d):
    rows = E.enrich_transfers(d.transfers, d.assets, d.rigs, d.companies, d.users)
    return B.search(B.filter_by(rows, status="Pending", priority=None), "00001", ["transfer_id", "asset_name", "destination"]).select("id", "transfer_id")


@register("contracts_search", ["contracts", "companies"], """
SELECT ct.id, ct.contract_no FROM contracts ct
WHERE ct.status = 'Active' AND (contains(lower(ct.contract_no), 'asia') OR ct.company_id IN (SELECT id FROM companies WHERE contains(lower(name), 'asia')))""")
def q_contracts_search(spark, d):
    rows = E.enrich_contracts(d.contracts, d.companies, d.rigs, None, AS_OF, live_status=False)
    return B.search(B.filter_by(rows, status="Active"), "asia", ["contract_no", "company_name"]).select("id", "contract_no")


@register("companies_search", ["companies"], "SELECT id, name FROM companies WHERE status = 'Active' AND contains(lower(name), 'a')")
def q_companies_search(spark, d):
    return B.search(B.filter_by(d.companies, status="Active"), "A", ["name"]).select("id", "name")


@register("users_search", ["users"], "SELECT id, full_name, role, status FROM users WHERE role = 'Editor' AND contains(lower(full_name), '1')")
def q_users_search(spark, d):
    return B.safe_users(B.search(B.filter_by(d.users, role="Editor"), "1", ["full_name"]))


# ====================================================================== dashboard numbers of the asking user
@register("dashboard_user_notices", ["notifications", "users"], """
SELECT u.id AS user_id, (SELECT count(*) FROM notifications n WHERE n.user_id IS NULL AND NOT n.is_read)
  + (SELECT count(*) FROM notifications n WHERE n.user_id = u.id AND NOT n.is_read) AS unread
FROM users u WHERE u.role IN ('Admin', 'Asset Manager', 'Operations Manager')""")
def q_dashboard_user_notices(spark, d):
    asking = d.users.where(F.col("role").isin("Admin", "Asset Manager", "Operations Manager"))
    return R.notification_counts(d.notifications, asking).select("user_id", "unread")


@register("alerts_overdue_count", ["maintenance_schedules"], """
SELECT count(*) AS alerts, sum((next_due_date < DATE '1998-06-01')::INT)::BIGINT AS overdue FROM maintenance_schedules
WHERE NOT list_contains(['Completed', 'Cancelled'], status) AND date_diff('day', DATE '1998-06-01', next_due_date) <= alert_days""")
def q_alerts_overdue_count(spark, d):
    alerts = R.maintenance_alerts(d.schedules, d.assets, d.rigs, AS_OF)
    return alerts.agg(F.count("*").alias("alerts"), F.count_if(F.col("alert_type") == "Overdue").cast("bigint").alias("overdue"))


# ====================================================================== create batches
# Each batch is one command per event, with fields that break every rule now and then.
_ROLE = "CASE event_id % 6 WHEN 0 THEN 'Viewer' WHEN 1 THEN NULL ELSE 'Editor' END AS role"
BATCHES = {
    "company_create": f"""event_id AS seq, concat('CMP', lpad(CAST(user_id % 40 AS STRING), 3, '0')) AS company_code,
      CASE WHEN event_id % 11 = 0 THEN ' ' ELSE concat('Company ', CAST(event_id AS STRING)) END AS name,
      CASE event_id % 5 WHEN 0 THEN 'Bogus' WHEN 1 THEN NULL ELSE 'Operator' END AS type, {_ROLE}""",
    "contract_create": f"""event_id AS seq, CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('CON-', lpad(CAST(user_id * 2 AS STRING), 6, '0')) END AS contract_no,
      CASE event_id % 7 WHEN 0 THEN '1998-02-30' WHEN 1 THEN NULL ELSE '1998-02-28' END AS start_date,
      CASE WHEN event_id % 9 = 0 THEN 'soon' ELSE '1999-12-31' END AS end_date, {_ROLE}""",
    "user_create": f"""event_id AS seq, CASE WHEN event_id % 8 = 0 THEN NULL ELSE concat('User ', CAST(event_id AS STRING)) END AS full_name,
      CASE event_id % 5 WHEN 0 THEN 'no-at-sign' ELSE concat('u', CAST(user_id AS STRING), '@example.org') END AS email,
      CASE WHEN event_id % 10 = 3 THEN 'short' ELSE 'long enough' END AS password,
      CASE WHEN event_id % 7 = 0 THEN 'Owner' ELSE 'Viewer' END AS role""",
    "schedule_create": f"""event_id AS seq, concat('PM-', lpad(CAST(user_id * 108 AS STRING), 7, '0')) AS pm_id,
      CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING) ELSE concat('AST-', lpad(CAST(user_id * 11 AS STRING), 6, '0')) END AS asset_key,
      'Check' AS task_name, 'Inspection' AS task_type, CASE WHEN event_id % 9 = 0 THEN 'x' ELSE '1998-07-01' END AS next_due_date,
      CASE event_id % 8 WHEN 0 THEN '0' WHEN 1 THEN '1.5' ELSE '30' END AS frequency_days, {_ROLE}""",
    "bom_create": f"""event_id AS seq, concat('BOM-', CAST(user_id AS STRING)) AS bom_id,
      CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING) ELSE concat('AST-', lpad(CAST(user_id * 11 AS STRING), 6, '0')) END AS asset_key,
      CASE WHEN event_id % 12 = 0 THEN ' ' ELSE 'Part' END AS name, CASE WHEN event_id % 7 = 0 THEN 'Liquid' ELSE 'Bulk' END AS item_type,
      CASE event_id % 9 WHEN 0 THEN 'NaN' WHEN 1 THEN '-1' WHEN 2 THEN 'many' ELSE '2.5' END AS quantity, {_ROLE}""",
}


def _batch(d, kind: str):
    """The commands of a kind: the SQL text above runs in both engines."""
    d.t.events.createOrReplaceTempView("rigflow_events")
    return d.spark.sql(f"SELECT {BATCHES[kind]} FROM rigflow_events")


def _present(c: str) -> str:
    return f"{c} IS NOT NULL AND trim({c}) <> ''"


_OK = f"role IN {WRITE}"


@register_sql("create_companies", with_views_and(f"""batch AS (SELECT {BATCHES["company_create"]} FROM events),
ok AS (SELECT * FROM batch WHERE {_OK} AND {_present("company_code")} AND {_present("name")} AND type IN ({_quoted("companies", "type")})),
fresh AS (SELECT company_code, arg_min(name, seq) AS name, arg_min(type, seq) AS type FROM ok
          WHERE company_code NOT IN (SELECT company_code FROM companies) GROUP BY company_code)
SELECT company_code, name, status, NULL AS type FROM companies UNION ALL SELECT company_code, name, 'Active', type FROM fresh""", ["companies"]))
def q_create_companies(spark, d):
    ok = Q.validate_commands(_batch(d, "company_create"), "company_create")["accepted"].drop("role")
    new = C.insert_ignore(d.companies.drop("id"), C.with_defaults(ok, {"status": "Active"}), "company_code")
    return new.select("company_code", "name", "status", "type")


@register_sql("create_contracts", with_views_and(f"""batch AS (SELECT {BATCHES["contract_create"]} FROM events),
ok AS (SELECT * FROM batch WHERE {_OK} AND {_present("contract_no")} AND try_cast(start_date AS DATE) IS NOT NULL AND try_cast(end_date AS DATE) IS NOT NULL)
SELECT contract_no, min(seq) AS seq, 'Pending' AS status FROM ok WHERE contract_no NOT IN (SELECT contract_no FROM contracts) GROUP BY contract_no""", ["contracts"]))
def q_create_contracts(spark, d):
    ok = Q.validate_commands(_batch(d, "contract_create"), "contract_create")["accepted"].drop("role")
    new = C.insert_ignore(d.contracts.select("contract_no", F.lit(None).cast("string").alias("status")),
                          C.with_defaults(ok, {"status": "Pending"}).withColumn("command", F.col("seq")), "contract_no")
    return new.where("command IS NOT NULL").select("contract_no", F.col("command").alias("seq"), "status")


@register_sql("create_users_checked", with_views_and(f"""batch AS (SELECT {BATCHES["user_create"]} FROM events)
SELECT seq, concat_ws(',', CASE WHEN NOT coalesce({_present("full_name")}, false) THEN 'full_name' END,
  CASE WHEN NOT contains(email, '@') THEN 'email' END, CASE WHEN length(password) < 8 THEN 'password' END,
  CASE WHEN role NOT IN ({_quoted("users", "role")}) THEN 'role' END) AS reasons FROM batch""", ["users"]))
def q_create_users_checked(spark, d):
    # (the actor's right to manage users is checked on its own column)
    batch = _batch(d, "user_create").withColumn("actor_role", F.lit("Admin"))
    tagged = Q.tag_commands(batch, "user_create", action="manage_users", role_col="actor_role")
    return tagged.select("seq", F.array_join("reasons", ",").alias("reasons"))


_ASSET_OF = "JOIN assets a ON CAST(a.id AS STRING) = b.asset_key OR a.asset_id = b.asset_key"


@register_sql("create_schedules", with_views_and(f"""batch AS (SELECT {BATCHES["schedule_create"]} FROM events)
SELECT b.seq, b.pm_id, a.id AS asset_id, 'Scheduled' AS status FROM batch b {_ASSET_OF}
WHERE {_OK} AND try_cast(b.next_due_date AS DATE) IS NOT NULL AND try_cast(b.frequency_days AS BIGINT) >= 1 AND NOT contains(b.frequency_days, '.')""", ["assets"]))
def q_create_schedules(spark, d):
    ok = Q.validate_commands(_batch(d, "schedule_create"), "schedule_create")["accepted"].withColumnRenamed("asset_key", "key")
    found = C.resolve_keys(ok, d.assets, ["id", "asset_id"]).where(F.col("_id").isNotNull())
    return C.with_defaults(found, {"status": "Scheduled"}).select("seq", "pm_id", F.col("_id").alias("asset_id"), "status")


@register_sql("create_bom_items", with_views_and(f"""batch AS (SELECT {BATCHES["bom_create"]} FROM events)
SELECT b.seq, b.bom_id, a.id AS asset_id, 'Active' AS status FROM batch b {_ASSET_OF}
WHERE {_OK} AND trim(b.name) <> '' AND b.item_type IN ('Serialized', 'Bulk') AND isfinite(try_cast(b.quantity AS DOUBLE)) AND try_cast(b.quantity AS DOUBLE) >= 0""",
                                                 ["assets"]))
def q_create_bom_items(spark, d):
    ok = Q.validate_commands(_batch(d, "bom_create"), "bom_create")["accepted"].withColumnRenamed("asset_key", "key")
    found = C.resolve_keys(ok, d.assets, ["id", "asset_id"]).where(F.col("_id").isNotNull())
    return C.with_defaults(found, {"status": "Active"}).select("seq", "bom_id", F.col("_id").alias("asset_id"), "status")


# ====================================================================== value rules of further tables
def _rules_query(name: str, table: str, view: str, columns: dict[str, str], frame, failing: dict[str, str]):
    """Rows of a view with each rule broken now and then; ``failing``: rule -> SQL that is true when it fails."""
    listed = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    cases = ", ".join(f"CASE WHEN {e} THEN '{r}' END" for r, e in failing.items())
    sql = with_views_and(f"""made AS (SELECT id, {listed} FROM {view}), named AS (SELECT id, concat_ws(',', {cases}) AS violations FROM made)
SELECT * FROM named WHERE violations <> ''""", [view])

    @register_sql(name, sql)
    def query(spark, d):
        made = frame(d).select("id", *[F.expr(e).alias(c) for c, e in columns.items()])
        return Q.check_violations(made, table).select("id", F.array_join("violations", ",").alias("violations"))


_rules_query("check_contracts", "contracts", "contracts", {
    "status": "CASE WHEN id % 5 = 0 THEN 'Lost' ELSE status END", "value_usd": "CASE WHEN id % 7 = 0 THEN -1.0 ELSE 1.0 END",
    "start_date": "start_date", "end_date": "CASE WHEN id % 6 = 0 THEN DATE '1990-01-01' WHEN id % 6 = 1 THEN NULL ELSE end_date END"},
    lambda d: d.contracts, {"status_allowed": f"status NOT IN ({_quoted('contracts', 'status')})",
                            "value_usd_non_negative": "value_usd < 0", "end_after_start": "end_date < start_date"})
_rules_query("check_bom_items", "bom_items", "bom_items", {
    "item_type": "CASE WHEN id % 50 = 0 THEN 'Gas' ELSE item_type END", "uom": "CASE id % 40 WHEN 0 THEN 'YD' WHEN 1 THEN NULL ELSE 'EA' END",
    "status": "CASE WHEN id % 60 = 0 THEN '' ELSE status END", "quantity": "CASE WHEN id % 70 = 0 THEN -quantity ELSE quantity END",
    "unit_cost_usd": "CASE WHEN id % 80 = 0 THEN -1 ELSE 1 END", "lead_time_days": "CASE WHEN id % 90 = 0 THEN -1 ELSE NULL END"},
    lambda d: d.bom_items, {"item_type_allowed": "item_type NOT IN ('Serialized', 'Bulk')", "uom_allowed": f"uom NOT IN ({_quoted('bom_items', 'uom')})",
                            "status_allowed": f"status NOT IN ({_quoted('bom_items', 'status')})", "quantity_non_negative": "quantity < 0",
                            "unit_cost_non_negative": "unit_cost_usd < 0", "lead_time_non_negative": "lead_time_days < 0"})
_rules_query("check_certificates", "certificates", "certificates", {
    "status": "CASE WHEN id % 20 = 0 THEN 'Old' ELSE status END", "asset_id": "asset_id", "rig_id": "CASE WHEN id % 30 = 0 THEN NULL ELSE rig_id END",
    "issue_date": "CASE WHEN id % 25 = 0 THEN DATE '2001-01-01' ELSE DATE '1990-01-01' END", "expiry_date": "expiry_date"},
    lambda d: d.certificates, {"status_allowed": f"status NOT IN ({_quoted('certificates', 'status')})",
                               "has_owner": "asset_id IS NULL AND rig_id IS NULL", "expiry_after_issue": "expiry_date < issue_date"})
_rules_query("check_transfers", "transfers", "transfers", {
    "priority": "CASE WHEN id % 8 = 0 THEN 'Urgent' ELSE 'High' END", "transfer_type": "CASE WHEN id % 9 = 0 THEN 'By sea' ELSE 'Rig to Rig' END",
    "status": "status", "ops_action": "CASE WHEN id % 10 = 0 THEN 'maybe' ELSE NULL END", "mgr_action": "CASE WHEN id % 11 = 0 THEN 'maybe' ELSE 'hold' END",
    "request_date": "request_date", "required_date": "CASE WHEN id % 12 = 0 THEN DATE '1990-01-01' ELSE NULL END"},
    lambda d: d.transfers, {"priority_allowed": "priority = 'Urgent'", "transfer_type_allowed": "transfer_type = 'By sea'", "status_allowed": "false",
                            "ops_action_allowed": "ops_action = 'maybe'", "mgr_action_allowed": "mgr_action = 'maybe'",
                            "required_after_request": "required_date < request_date"})


# ====================================================================== declared-schema read, appended rows (A1, A3)
@register("history_appended", ["companies"], """
SELECT company_code, name, count(*) AS copies FROM (SELECT * FROM companies UNION ALL SELECT * FROM companies WHERE status = 'Active') GROUP BY ALL""")
def q_history_appended(spark, d):
    """A table written, read again with its declared schema, and appended to: INSERT without a conflict key."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rigflow-tables-{dt.datetime.now():%Y%m%d%H%M%S%f}"
    write_table(d.companies.withColumn("id", F.col("id").cast("string")), root, "companies")
    stored = read_table(spark, root, "companies")
    both = C.append_rows(stored, stored.where(F.col("status") == "Active"))
    return both.groupBy("company_code", "name").agg(F.count("*").alias("copies"))


# ====================================================================== pages at any depth, search through an index
_BOM_ORDER = "ORDER BY asset_id NULLS LAST, name NULLS LAST, id NULLS LAST"


def _bom_pages(d):
    rows = d.bom_items.select("id", "asset_id", "name")
    return P.OrderedPages(rows, [F.col(c).asc_nulls_last() for c in ("asset_id", "name", "id")])


@register("bom_deep_page", ["bom_items"], f"SELECT id, asset_id, name FROM bom_items {_BOM_ORDER} LIMIT 100 OFFSET 1100")
def q_bom_deep_page(spark, d):
    return _bom_pages(d).page(12, 100)


@register("bom_next_page", ["bom_items"], f"SELECT id, asset_id, name FROM bom_items {_BOM_ORDER} LIMIT 100 OFFSET 1200")
def q_bom_next_page(spark, d):
    """The page after the last row of page 12, found by that row's key."""
    pages = _bom_pages(d)
    return pages.after(pages.page(1200, 1), 100)


def _indexed(spark, df, key, cols, term):
    index = TrigramIndex(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/trigrams-{uuid.uuid4().hex}", key, cols)
    index.add(df)
    return index.search(df, term)


@register("assets_search_indexed", ["assets"], """
SELECT id, asset_id, name, location FROM assets
WHERE contains(lower(asset_id), 'site 1') OR contains(lower(name), 'site 1') OR contains(lower(location), 'site 1')""")
def q_assets_search_indexed(spark, d):
    return _indexed(spark, d.assets.select("id", "asset_id", "name", "location"), "id", ["asset_id", "name", "location"], "Site 1")


@register("bom_search_indexed", ["bom_items"], "SELECT id, name FROM bom_items WHERE contains(lower(name), 'item 12')")
def q_bom_search_indexed(spark, d):
    return _indexed(spark, d.bom_items.select("id", "name"), "id", ["name"], "ITEM 12")


@register("transfers_search_indexed", ["transfers"], """
SELECT id, transfer_id, destination FROM transfers WHERE contains(lower(transfer_id), '00001') OR contains(lower(destination), '00001')""")
def q_transfers_search_indexed(spark, d):
    return _indexed(spark, d.transfers.select("id", "transfer_id", "destination"), "id", ["transfer_id", "destination"], "00001")


# ====================================================================== changes of accounts
# Every user asks for a new name, role and status: a third of them for the next account, a third
# for their own by number, a third for "me".
@register("user_updates", ["users"], """, asked AS (
  SELECT id AS actor_id, role AS actor_role, full_name, CASE id % 3 WHEN 0 THEN id + 1 ELSE id END AS target FROM users)
SELECT target::VARCHAR AS user_id, actor_id, actor_role, 'New ' || full_name AS full_name,
  CASE actor_role WHEN 'Admin' THEN 'Viewer' END AS role, CASE actor_role WHEN 'Admin' THEN 'Inactive' END AS status,
  actor_role = 'Admin' OR target = actor_id AS accepted
FROM asked""")
def q_user_updates(spark, d):
    place = F.pmod("id", F.lit(3))
    batch = d.users.select(F.when(place == 0, (F.col("id") + 1).cast("string")).when(place == 1, F.col("id").cast("string")).otherwise("me").alias("user_id"),
                           F.col("id").alias("actor_id"), F.col("role").alias("actor_role"), F.concat(F.lit("New "), "full_name").alias("full_name"),
                           F.lit("Viewer").alias("role"), F.lit("Inactive").alias("status"))
    out = Q.validate_user_updates(batch)
    refused = out["rejected"].drop("reasons").withColumns({c: F.when(F.col("actor_role") == "Admin", F.col(c)) for c in ("role", "status")})
    return out["accepted"].withColumn("accepted", F.lit(True)).unionByName(refused.withColumn("accepted", F.lit(False)))
