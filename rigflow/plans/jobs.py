"""Registered job queries: hierarchy walks, change application, data quality, the
transfer workflow and the batch cores of the stream jobs. Same registry as the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hierarchy as H
from ..sources.adapters import with_views_recursive
from .catalog import AS_OF, D, ORACLE, register


def register_sql(name: str, sql: str):
    """Attach an oracle SQL that is already complete (own WITH clause)."""
    def deco(fn):
        register(name)(fn)
        ORACLE[name] = sql
        return fn
    return deco


# ====================================================================== hierarchy
_TREE_CTE = """tree AS (
  SELECT id, asset_id, parent_id, name, 0 AS depth, id AS root_id,
         CAST(id AS VARCHAR) AS path_ids, name AS path_names
  FROM bom_items WHERE parent_id IS NULL
  UNION ALL
  SELECT b.id, b.asset_id, b.parent_id, b.name, t.depth + 1, t.root_id,
         t.path_ids || '/' || CAST(b.id AS VARCHAR), t.path_names || ' / ' || b.name
  FROM bom_items b JOIN tree t ON b.parent_id = t.id AND b.asset_id = t.asset_id)"""


def _tree(d, paths: bool = True) -> DataFrame:
    return H.bom_tree(d.bom_items, paths=paths)


@register_sql("bom_tree", with_views_recursive(_TREE_CTE, "SELECT * FROM tree", ["bom_items"]))
def q_bom_tree(spark, d):
    t = _tree(d)
    return t.orderBy("asset_id", "sort_path").drop("sort_path")


@register_sql("bom_tree_summary", with_views_recursive(_TREE_CTE, """
SELECT b.asset_id, CAST(COUNT(*) AS BIGINT) AS total,
  CAST(COUNT(*) FILTER (WHERE b.item_type = 'Serialized') AS BIGINT) AS serialized,
  CAST(COUNT(*) FILTER (WHERE b.item_type = 'Bulk') AS BIGINT) AS bulk,
  CAST(COUNT(*) FILTER (WHERE b.status = 'On Order') AS BIGINT) AS on_order,
  CAST(COALESCE(SUM(b.quantity * b.unit_cost_usd), 0) AS DECIMAL(38,2)) AS total_cost,
  CAST(COUNT(t.id) AS BIGINT) AS in_tree
FROM bom_items b LEFT JOIN tree t ON t.id = b.id
GROUP BY b.asset_id""", ["bom_items"]))
def q_bom_tree_summary(spark, d):
    return H.bom_tree_summary(d.bom_items, _tree(d, paths=False))


_SUB_CTE = """sub AS (
  SELECT id AS seed_id, id, 0 AS depth FROM bom_items WHERE status = 'Obsolete'
  UNION ALL
  SELECT s.seed_id, b.id, s.depth + 1
  FROM bom_items b JOIN sub s ON b.parent_id = s.id
  WHERE b.id <> s.seed_id)"""


def _subtree(d) -> DataFrame:
    """Delete requests: every Obsolete item, with its whole subtree."""
    return H.subtree(d.bom_items, d.bom_items.where(F.col("status") == "Obsolete"))


@register_sql("bom_subtree", with_views_recursive(_SUB_CTE, "SELECT * FROM sub", ["bom_items"]))
def q_bom_subtree(spark, d):
    return _subtree(d)


@register_sql("bom_subtree_counts", with_views_recursive(_SUB_CTE, """
SELECT seed_id, CAST(COUNT(*) AS BIGINT) AS delete_count, MAX(depth) AS max_depth
FROM sub GROUP BY seed_id""", ["bom_items"]))
def q_bom_subtree_counts(spark, d):
    return H.subtree_sizes(d.bom_items, d.bom_items.where(F.col("status") == "Obsolete"))


@register_sql("bom_subtree_cost", with_views_recursive(_TREE_CTE + """,
clos AS (
  SELECT id AS anc, id AS node, asset_id FROM tree
  UNION ALL
  SELECT c.anc, b.id, b.asset_id FROM clos c JOIN bom_items b ON b.parent_id = c.node AND b.asset_id = c.asset_id)""", """
SELECT t.id, t.asset_id, t.depth,
  CAST(SUM(b.quantity * b.unit_cost_usd) AS DECIMAL(38,2)) AS subtree_cost,
  CAST(COUNT(*) AS BIGINT) AS subtree_size
FROM clos c JOIN bom_items b ON b.id = c.node JOIN tree t ON t.id = c.anc
GROUP BY t.id, t.asset_id, t.depth""", ["bom_items"]))
def q_bom_subtree_cost(spark, d):
    return H.subtree_cost(d.bom_items)


@register_sql("bom_outline", with_views_recursive("""walk AS (
  SELECT id, asset_id, name, 0 AS depth, [{'n': name, 'i': id}] AS trail FROM bom_items WHERE parent_id IS NULL
  UNION ALL
  SELECT b.id, b.asset_id, b.name, w.depth + 1, list_append(w.trail, {'n': b.name, 'i': b.id})
  FROM bom_items b JOIN walk w ON b.parent_id = w.id AND b.asset_id = w.asset_id)""", """
SELECT w.asset_id, w.id, w.name, w.depth, row_number() OVER (PARTITION BY w.asset_id ORDER BY w.trail) - 1 AS place,
  (SELECT count(*) FROM walk x WHERE x.asset_id = w.asset_id AND x.trail[1:len(w.trail)] = w.trail) AS size
FROM walk w""", ["bom_items"]))
def q_bom_outline(spark, d):
    return H.bom_outline(d.bom_items)


# ====================================================================== changes
import datetime as _dt  # noqa: E402

from ..operators import changes as C  # noqa: E402
from ..operators import quality as Q  # noqa: E402
from ..operators import workflow as W  # noqa: E402
from ..sources.adapters import with_views_and  # noqa: E402
from ..sources.schemas import ENUMS, FOREIGN_KEYS  # noqa: E402
from ..streaming import cores as K  # noqa: E402

NOW = _dt.datetime(1998, 6, 1)
TS = "TIMESTAMP '1998-06-01 00:00:00'"
WRITE = "('Admin','Asset Manager','Operations Manager','Editor')"
PATCH_COLS = ["status", "location", "value_usd"]


def _patched(d):
    return C.patch_update(d.assets, d.asset_patches, PATCH_COLS, key_cols=["id", "asset_id"],
                          now=F.lit(NOW))


_PATCH_CTES = f"""ok AS (
  SELECT p.*, a.id AS _id FROM asset_patches p
  JOIN assets a ON CAST(a.id AS STRING) = p.key OR a.asset_id = p.key
  WHERE p.role IN {WRITE}),
f AS (
  SELECT _id,
    arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status,
    arg_max(location, seq) FILTER (WHERE location IS NOT NULL) AS location,
    arg_max(value_usd, seq) FILTER (WHERE value_usd IS NOT NULL) AS value_usd
  FROM ok GROUP BY _id)"""


@register_sql("patch_update", with_views_and(_PATCH_CTES + f"""
SELECT a.id, a.asset_id, a.name, a.category, a.rig_id, a.company_id, a.contract_id,
  COALESCE(f.location, a.location) AS location, COALESCE(f.status, a.status) AS status,
  COALESCE(f.value_usd, a.value_usd) AS value_usd,
  CASE WHEN f._id IS NOT NULL THEN {TS} END AS updated_at
FROM assets a LEFT JOIN f ON f._id = a.id""", ["assets", "asset_patches"]))
def q_patch_update(spark, d):
    return _patched(d)["table"]


@register_sql("patch_rejected", with_views_and(f"""r AS (
  SELECT p.*, CASE WHEN p.role NOT IN {WRITE} THEN 'role'
    WHEN NOT EXISTS (SELECT 1 FROM assets a WHERE CAST(a.id AS STRING) = p.key OR a.asset_id = p.key)
    THEN 'not_found' END AS reason
  FROM asset_patches p)
SELECT * FROM r WHERE reason IS NOT NULL""", ["assets", "asset_patches"]))
def q_patch_rejected(spark, d):
    return _patched(d)["rejected"]


_CHANGED = ("(COALESCE(f.status, a.status) IS DISTINCT FROM a.status "
            "OR COALESCE(f.location, a.location) IS DISTINCT FROM a.location "
            "OR COALESCE(f.value_usd, a.value_usd) IS DISTINCT FROM a.value_usd)")


@register_sql("capture_changes", with_views_and(_PATCH_CTES + f"""
SELECT a.id AS asset_id, 'Updated' AS action, {_CHANGED} AS changed, a.status AS old_status, a.location AS old_location,
  CAST(a.value_usd AS DOUBLE) AS old_value, COALESCE(f.status, a.status) AS new_status,
  COALESCE(f.location, a.location) AS new_location, CAST(COALESCE(f.value_usd, a.value_usd) AS DOUBLE) AS new_value,
  a.name AS new_name
FROM assets a JOIN f ON f._id = a.id""", ["assets", "asset_patches"]))
def q_capture_changes(spark, d):
    r = _patched(d)
    new = r["table"].drop("updated_at")
    ch = C.capture_changes(d.assets, new, "id", touched=r["touched"])
    field = lambda c, n: F.get_json_object(c, f"$.{n}")
    return ch.select("asset_id", "action", (F.coalesce(F.col("old_values") != F.col("new_values"),
                                                       F.lit(True))).alias("changed"),
                     field("old_values", "status").alias("old_status"), field("old_values", "location").alias("old_location"),
                     field("old_values", "value_usd").cast("double").alias("old_value"),
                     field("new_values", "status").alias("new_status"), field("new_values", "location").alias("new_location"),
                     field("new_values", "value_usd").cast("double").alias("new_value"),
                     field("new_values", "name").alias("new_name"))


@register_sql("audit_changes", with_views_and(_PATCH_CTES + f"""
SELECT 'assets' AS table_name, a.id AS record_id, 'UPDATE' AS action, a.asset_id AS old_code, a.status AS old_status,
  COALESCE(f.status, a.status) AS new_status, COALESCE(f.location, a.location) AS new_location
FROM assets a JOIN f ON f._id = a.id WHERE {_CHANGED}""", ["assets", "asset_patches"]))
def q_audit_changes(spark, d):
    new = _patched(d)["table"].drop("updated_at")
    field = lambda c, n: F.get_json_object(c, f"$.{n}")
    return C.audit_changes(d.assets, new, "assets").select(
        "table_name", "record_id", "action", field("old_data", "asset_id").alias("old_code"),
        field("old_data", "status").alias("old_status"), field("new_data", "status").alias("new_status"),
        field("new_data", "location").alias("new_location"))


_ASSET_RULES = (f"p.role IN {WRITE} AND p.asset_id IS NOT NULL AND length(trim(p.asset_id)) > 0 "
                "AND p.name IS NOT NULL AND length(trim(p.name)) > 0 AND p.category IN ("
                + ",".join(f"'{v}'" for v in ENUMS[("assets", "category")]) + ")")


@register_sql("insert_ignore", with_views_and(f"""acc AS (SELECT * FROM asset_creates p WHERE {_ASSET_RULES}),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seq) AS rn FROM acc) x
          WHERE rn = 1),
new AS (SELECT f.id, f.asset_id, f.name, f.category, 'Active' AS status, CAST(0 AS DECIMAL(18,2)) AS value_usd
        FROM first f WHERE NOT EXISTS (SELECT 1 FROM assets a WHERE a.asset_id = f.asset_id))
SELECT id, asset_id, name, category, rig_id, company_id, contract_id, location, status, value_usd FROM assets
UNION ALL
SELECT id, asset_id, name, category, NULL, NULL, NULL, NULL, status, value_usd FROM new""",
                                            ["assets", "asset_creates"]))
def q_insert_ignore(spark, d):
    acc = Q.validate_commands(d.asset_creates, "asset_create")["accepted"].drop("role")
    batch = C.with_defaults(acc, {"status": "Active", "value_usd": F.lit(0).cast("decimal(18,2)")})
    return C.insert_ignore(d.assets, batch, "asset_id")


@register_sql("validate_commands", with_views_and(f"""v AS (
SELECT p.seq, concat_ws(',',
  CASE WHEN NOT COALESCE(p.role IN {WRITE}, false) THEN 'role' END,
  CASE WHEN NOT COALESCE(p.asset_id IS NOT NULL AND length(trim(p.asset_id)) > 0, false) THEN 'asset_id' END,
  CASE WHEN NOT COALESCE(p.name IS NOT NULL AND length(trim(p.name)) > 0, false) THEN 'name' END,
  CASE WHEN NOT COALESCE(p.category IN ({",".join(f"'{v}'" for v in ENUMS[("assets", "category")])}), false)
       THEN 'category' END) AS reasons
FROM asset_creates p)
SELECT seq, reasons, reasons = '' AS accepted FROM v""", ["asset_creates"]))
def q_validate_commands(spark, d):
    t = Q.tag_commands(d.asset_creates, "asset_create")
    return t.select("seq", F.array_join("reasons", ",").alias("reasons"),
                    (F.size("reasons") == 0).alias("accepted"))


@register_sql("unique_violations", with_views_and("""u AS (
SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM assets a WHERE a.asset_id = c.asset_id) THEN 'exists'
  WHEN c.seq <> (SELECT min(c2.seq) FROM asset_creates c2 WHERE c2.asset_id = c.asset_id)
  THEN 'duplicate_in_batch' END AS reason
FROM asset_creates c)
SELECT * FROM u WHERE reason IS NOT NULL""", ["assets", "asset_creates"]))
def q_unique_violations(spark, d):
    return Q.unique_violations(d.assets, d.asset_creates, "asset_id")


_FK_TABLES = {"maintenance_logs": "log_rows", "companies": "companies", "rigs": "rigs", "contracts": "contracts", "assets": "assets",
              "asset_history": "asset_history", "bom_items": "bom_items", "certificates": "certificates",
              "maintenance_schedules": "schedules", "work_orders": "work_orders",
              "transfers": "transfers", "users": "users", "notifications": "notifications"}
# Fixed value: the foreign-key columns each adapter view carries.
_FK_COLS = {"rigs": ["company_id"], "contracts": ["company_id", "rig_id"],
            "assets": ["company_id", "rig_id", "contract_id"], "asset_history": ["asset_id", "changed_by"],
            "bom_items": ["asset_id", "parent_id"], "certificates": ["asset_id", "rig_id"],
            "maintenance_schedules": ["asset_id"], "maintenance_logs": ["schedule_id"], "work_orders": ["asset_id"],
            "transfers": ["asset_id", "dest_rig_id", "dest_company_id", "requested_by", "ops_approved_by", "mgr_approved_by"],
            "notifications": ["user_id"]}


def _orphan_sql() -> str:
    parts = []
    for child, fk, parent, _ in FOREIGN_KEYS:
        if child in _FK_COLS and parent in _FK_TABLES and fk in _FK_COLS[child]:
            parts.append(f"SELECT '{child}' AS child_table, '{fk}' AS fk, '{parent}' AS parent_table, "
                         f"CAST({'c.schedule_id' if child == 'maintenance_logs' else 'c.id'} AS STRING) AS child_id, CAST(c.{fk} AS STRING) AS missing_key "
                         f"FROM {child} c WHERE c.{fk} IS NOT NULL AND NOT EXISTS "
                         f"(SELECT 1 FROM {parent} p WHERE p.id = c.{fk})")
    views = sorted(set(_FK_TABLES))
    from ..sources.adapters import with_views
    return with_views("\nUNION ALL\n".join(parts), views)


ORACLE_ORPHANS = _orphan_sql()


@register_sql("orphans", ORACLE_ORPHANS)
def q_orphans(spark, d):
    tables = {name: getattr(d, attr) for name, attr in _FK_TABLES.items() if name != "maintenance_logs"}
    tables["maintenance_logs"] = d.logs.withColumn("id", F.col("schedule_id"))      # (logs have no key of their own here)
    # (the views leave out some tables and columns; their references are not asked for)
    present = [f for f in FOREIGN_KEYS if f[0] in tables and f[2] in tables and f[1] in tables[f[0]].columns]
    return Q.orphan_report(tables, present)


_CHECKED = """SELECT id, asset_id, CASE id % 9 WHEN 0 THEN 'Bogus' WHEN 1 THEN NULL ELSE 'Power Generation' END AS category,
  CASE WHEN id % 10 = 0 THEN 'Lost' ELSE status END AS status,
  CASE WHEN id % 12 = 0 THEN CAST(-1 AS DECIMAL(18,2)) ELSE value_usd END AS value_usd,
  CASE id % 13 WHEN 0 THEN 1949 WHEN 1 THEN 2101 WHEN 2 THEN NULL ELSE 2000 END AS year_manufactured,
  CASE WHEN id % 17 = 0 THEN -0.5 ELSE 10.0 END AS weight_kg FROM assets"""


def _assets_rule_sql() -> str:
    cat = ",".join(f"'{v}'" for v in ENUMS[("assets", "category")])
    st = ",".join(f"'{v}'" for v in ENUMS[("assets", "status")])
    from ..sources.adapters import with_views
    return with_views(f"""SELECT * FROM (
SELECT a.*, concat_ws(',',
  CASE WHEN NOT COALESCE(a.category IN ({cat}), true) THEN 'category_allowed' END,
  CASE WHEN NOT COALESCE(a.status IN ({st}), true) THEN 'status_allowed' END,
  CASE WHEN NOT COALESCE(a.value_usd >= 0, true) THEN 'value_usd_non_negative' END,
  CASE WHEN a.year_manufactured < 1950 OR a.year_manufactured > 2100 THEN 'year_in_range' END,
  CASE WHEN a.weight_kg < 0 THEN 'weight_non_negative' END) AS violations
FROM ({_CHECKED}) a) x WHERE violations <> ''""", ["assets"])


_CHECKED_COLUMNS = {
    "category": "CASE id % 9 WHEN 0 THEN 'Bogus' WHEN 1 THEN NULL ELSE 'Power Generation' END",
    "status": "CASE WHEN id % 10 = 0 THEN 'Lost' ELSE status END",
    "value_usd": "CASE WHEN id % 12 = 0 THEN CAST(-1 AS DECIMAL(18,2)) ELSE value_usd END",
    "year_manufactured": "CASE id % 13 WHEN 0 THEN 1949 WHEN 1 THEN 2101 WHEN 2 THEN NULL ELSE 2000 END",
    "weight_kg": "CASE WHEN id % 17 = 0 THEN -0.5 ELSE 10.0 END",
}


@register_sql("check_violations", _assets_rule_sql())
def q_check_violations(spark, d):
    v = Q.check_violations(d.assets.select("id", "asset_id", *[F.expr(e).alias(n) for n, e in _CHECKED_COLUMNS.items()]), "assets")
    return v.withColumn("violations", F.array_join("violations", ","))


# ---------------------------------------------------------------- J4
_INACTIVE = "SELECT id FROM assets WHERE status = 'Inactive'"


def _cascade(d, *only: str):
    """Delete the Inactive assets and apply the foreign-key effects to the tables whose
    results are asked for (all of them without ``only``)."""
    tables = {"maintenance_schedules": d.schedules, "maintenance_logs": d.logs, "certificates": d.certificates,
              "asset_history": d.asset_history, "transfers": d.transfers, "work_orders": d.work_orders,
              "bom_items": d.bom_items}
    given = {"assets": d.assets, **{t: f for t, f in tables.items() if not only or t in only}}
    return C.delete_cascade(given, "assets", d.assets.where(F.col("status") == "Inactive"), complete=not only)


@register_sql("delete_cascade", with_views_and(f"""del AS ({_INACTIVE})
SELECT * FROM maintenance_schedules WHERE asset_id NOT IN (SELECT id FROM del)""",
                                                ["assets", "maintenance_schedules"]))
def q_delete_cascade(spark, d):
    return _cascade(d, "maintenance_schedules")["maintenance_schedules"]


@register_sql("delete_cascade_logs", with_views_and(f"""del AS ({_INACTIVE})
SELECT l.* FROM maintenance_logs l JOIN maintenance_schedules s ON s.id = l.schedule_id
WHERE s.asset_id NOT IN (SELECT id FROM del)""", ["assets", "maintenance_schedules", "maintenance_logs"]))
def q_delete_cascade_logs(spark, d):
    return _cascade(d, "maintenance_schedules", "maintenance_logs")["maintenance_logs"]


@register_sql("delete_cascade_certificates", with_views_and(f"""del AS ({_INACTIVE})
SELECT * FROM certificates WHERE asset_id IS NULL OR asset_id NOT IN (SELECT id FROM del)""", ["assets", "certificates"]))
def q_delete_cascade_certificates(spark, d):
    return _cascade(d, "certificates")["certificates"]


@register_sql("delete_cascade_work_orders", with_views_and(f"""del AS ({_INACTIVE})
SELECT * FROM work_orders WHERE asset_id NOT IN (SELECT id FROM del)""", ["assets", "work_orders"]))
def q_delete_cascade_work_orders(spark, d):
    return _cascade(d, "work_orders")["work_orders"]


@register_sql("delete_cascade_bom", with_views_recursive(f"""gone AS (
  SELECT b.id FROM bom_items b WHERE b.asset_id IN ({_INACTIVE})
  UNION
  SELECT c.id FROM bom_items c JOIN gone g ON c.parent_id = g.id)""",
    "SELECT * FROM bom_items WHERE id NOT IN (SELECT id FROM gone)", ["assets", "bom_items"]))
def q_delete_cascade_bom(spark, d):
    return _cascade(d, "bom_items")["bom_items"]


@register_sql("delete_set_null", with_views_and("""del AS (SELECT id FROM contracts WHERE status = 'Terminated')
SELECT a.id, a.asset_id, a.name, a.category, a.rig_id, a.company_id,
  CASE WHEN a.contract_id IN (SELECT id FROM del) THEN NULL ELSE a.contract_id END AS contract_id,
  a.location, a.status, a.value_usd,
  CASE WHEN a.contract_id IN (SELECT id FROM del) THEN TIMESTAMP '1998-06-01 00:00:00' END AS updated_at
FROM assets a""", ["assets", "contracts"]))
def q_delete_set_null(spark, d):
    out = C.delete_cascade({"contracts": d.contracts, "assets": d.assets}, "contracts",
                           d.contracts.where(F.col("status") == "Terminated"), complete=False, now=F.lit(NOW))
    return out["assets"]


# ---------------------------------------------------------------- J6
_COMPLETE_CTES = """c AS (
  SELECT c.*, s.id AS _id, s.frequency_days AS _freq FROM completions c
  LEFT JOIN maintenance_schedules s ON CAST(s.id AS STRING) = c.schedule_key OR s.pm_id = c.schedule_key),
ok AS (
  SELECT *, COALESCE(next_due_date, completion_date + _freq) AS nd FROM c
  WHERE _id IS NOT NULL AND completion_date IS NOT NULL AND completed_by IS NOT NULL
    AND completed_by <> ''),
last AS (SELECT _id, arg_max(completion_date, seq) AS done, arg_max(nd, seq) AS due FROM ok GROUP BY _id)"""


def _completed(d):
    return C.complete_maintenance(d.schedules, d.completions, now=F.lit(NOW))


@register_sql("complete_maintenance_schedules", with_views_and(_COMPLETE_CTES + f"""
SELECT CASE WHEN l._id IS NOT NULL THEN {TS} END AS updated_at, s.id, s.pm_id, s.asset_id, s.task_type, s.priority, s.frequency_days,
  CASE WHEN l._id IS NOT NULL THEN l.due ELSE s.next_due_date END AS next_due_date, s.alert_days,
  CASE WHEN l._id IS NOT NULL THEN 'Scheduled' ELSE s.status END AS status,
  l.done AS last_done_date
FROM maintenance_schedules s LEFT JOIN last l ON l._id = s.id""", ["maintenance_schedules", "completions"]))
def q_complete_schedules(spark, d):
    return _completed(d)["schedules"]


@register_sql("complete_maintenance_logs", with_views_and(_COMPLETE_CTES + """
SELECT seq, _id AS schedule_id, completion_date, completed_by, actual_hours, nd AS next_due_date FROM ok""",
                                                           ["maintenance_schedules", "completions"]))
def q_complete_logs(spark, d):
    return _completed(d)["logs"]


@register_sql("complete_maintenance_rejected", with_views_and(_COMPLETE_CTES + """
SELECT seq, schedule_key AS key, CASE WHEN _id IS NULL THEN 'not_found' ELSE 'missing_fields' END AS reason
FROM c WHERE _id IS NULL OR completion_date IS NULL OR completed_by IS NULL OR completed_by = ''""",
                                                               ["maintenance_schedules", "completions"]))
def q_complete_rejected(spark, d):
    return _completed(d)["rejected"]


# ---------------------------------------------------------------- J13 / J14 / J15
@register_sql("certificate_refresh", with_views_and(f"""x AS (SELECT 1)
SELECT *, CASE WHEN status <> (SELECT c.status FROM certificates c WHERE c.id = n.id) THEN {TS} END AS updated_at FROM (
SELECT id, asset_id, rig_id, expiry_date,
  CASE WHEN expiry_date IS NULL OR status = 'Revoked' THEN status
       WHEN expiry_date < {D} THEN 'Expired'
       WHEN expiry_date <= {D} + 30 THEN 'Expiring' ELSE 'Valid' END AS status
FROM certificates) n""", ["certificates"]))
def q_certificate_refresh(spark, d):
    return C.refresh_certificate_status(d.certificates, AS_OF, now=F.lit(NOW))


@register_sql("mark_read_all", with_views_and("""r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click')
SELECT n.id, n.user_id, n.entity_type, n.entity_id,
  CASE WHEN n.user_id IN (SELECT user_id FROM r) OR (n.user_id IS NULL AND EXISTS (SELECT 1 FROM r))
       THEN true ELSE n.is_read END AS is_read, n.created_at
FROM notifications n""", ["notifications"]))
def q_mark_read_all(spark, d):
    req = d.t.events.where(F.col("event_type") == "click").select("user_id")
    return C.mark_read_all(d.notifications, req)


@register_sql("clear_read", with_views_and("""r AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT n.* FROM notifications n
WHERE NOT COALESCE((n.user_id IN (SELECT user_id FROM r) OR (n.user_id IS NULL AND EXISTS (SELECT 1 FROM r)))
                   AND n.is_read, false)""", ["notifications"]))
def q_clear_read(spark, d):
    req = d.t.events.where(F.col("event_type") == "purchase").select("user_id")
    return C.clear_read(d.notifications, req)


@register_sql("last_login", with_views_and(f"""l AS (SELECT user_id, max(ts) AS ts FROM events
                                           WHERE event_type = 'signup' GROUP BY user_id)
SELECT u.*, l.ts AS last_login, CASE WHEN l.ts IS NOT NULL THEN {TS} END AS updated_at FROM users u LEFT JOIN l ON l.user_id = u.id""", ["users"]))
def q_last_login(spark, d):
    logins = d.t.events.where(F.col("event_type") == "signup").select("user_id", "ts")
    return C.touch_last_login(d.users, logins, now=F.lit(NOW))


# ====================================================================== workflow
_NEW_STATE = """CASE WHEN e.pre IS NOT NULL OR s.state = 'Removed' THEN NULL
  WHEN e.stage = 'ops' AND s.state = 'Pending' THEN
       CASE e.action WHEN 'approve' THEN 'Ops Approved' WHEN 'reject' THEN 'Rejected' ELSE 'On Hold' END
  WHEN e.stage = 'mgr' AND s.state = 'Ops Approved' THEN
       CASE e.action WHEN 'approve' THEN 'Completed' WHEN 'reject' THEN 'Rejected' ELSE 'On Hold' END
  WHEN e.stage = 'cancel' AND s.state IN ('Pending', 'On Hold') THEN 'Removed' END"""

# The oracle replays every transfer's events one by one (a recursive step per event):
# an independent, sequential statement of the state machine.
_SIM_CTES = f"""ev AS (
  SELECT d.* REPLACE (n.id AS transfer_key), d.transfer_key AS named, row_number() OVER (PARTITION BY n.id ORDER BY seq) AS k,
    CASE WHEN NOT COALESCE(CASE stage WHEN 'ops' THEN actor_role IN ('Admin','Operations Manager')
                                      WHEN 'mgr' THEN actor_role IN ('Admin','Asset Manager')
                                      ELSE actor_role IN {WRITE} END, false) THEN 'role'
         WHEN stage <> 'cancel' AND NOT COALESCE(action IN ('approve','reject','hold'), false) THEN 'action'
         WHEN stage <> 'cancel' AND COALESCE(length(trim(comment)), 0) = 0 THEN 'comment' END AS pre
  FROM decisions d JOIN (SELECT id, CAST(id AS VARCHAR) AS name FROM transfers UNION SELECT id, transfer_id FROM transfers) n
    ON n.name = d.transfer_key),
sim AS (
  SELECT t.id AS tid, CAST(0 AS BIGINT) AS k, t.status AS state, CAST(NULL AS BIGINT) AS seq,
         CAST(NULL AS VARCHAR) AS stage, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS actor_role,
         CAST(NULL AS TIMESTAMP) AS ts, false AS accepted, CAST(NULL AS VARCHAR) AS reason,
         CAST(NULL AS VARCHAR) AS state_at, CAST(NULL AS VARCHAR) AS comment, CAST(NULL AS VARCHAR) AS named
  FROM transfers t
  UNION ALL
  SELECT s.tid, e.k, COALESCE({_NEW_STATE}, s.state), e.seq, e.stage, e.action, e.actor_role, e.ts,
         ({_NEW_STATE}) IS NOT NULL,
         CASE WHEN ({_NEW_STATE}) IS NOT NULL THEN NULL WHEN e.pre IS NOT NULL THEN e.pre
              WHEN s.state = 'Removed' THEN 'not_found' ELSE 'status' END,
         CASE WHEN ({_NEW_STATE}) IS NULL THEN s.state END, e.comment, e.named
  FROM sim s JOIN ev e ON e.transfer_key = s.tid AND e.k = s.k + 1)"""


def _fold(d):
    dec = d.decisions
    return W.fold_decisions(d.transfers, dec)


@register_sql("transfer_final_state", with_views_recursive(_SIM_CTES + """,
fin AS (SELECT tid, arg_max(state, k) AS status FROM sim GROUP BY tid),
acc AS (SELECT * FROM sim WHERE accepted)""", """
SELECT t.id AS transfer_key, t.status AS initial_status, f.status,
  o.seq AS ops_seq, o.action AS ops_action, o.actor_role AS ops_role, CAST(o.ts AS DATE) AS ops_date, o.comment AS ops_comment,
  m.seq AS mgr_seq, m.action AS mgr_action, m.actor_role AS mgr_role, CAST(m.ts AS DATE) AS mgr_date, m.comment AS mgr_comment,
  c.seq AS cancel_seq
FROM transfers t JOIN fin f ON f.tid = t.id
LEFT JOIN acc o ON o.tid = t.id AND o.stage = 'ops'
LEFT JOIN acc m ON m.tid = t.id AND m.stage = 'mgr'
LEFT JOIN acc c ON c.tid = t.id AND c.stage = 'cancel'""", ["transfers", "decisions"]))
def q_transfer_final_state(spark, d):
    st = _fold(d)["state"]
    return st.select("transfer_key", "initial_status", "status", "ops_seq", "ops_action", "ops_role", "ops_date",
                     "ops_comment", "mgr_seq", "mgr_action", "mgr_role", "mgr_date", "mgr_comment", "cancel_seq")


@register_sql("transfer_rejected_commands", with_views_recursive(_SIM_CTES, """
SELECT seq, named AS transfer_key, stage, action, reason, state_at FROM sim WHERE k > 0 AND NOT accepted""",
                                                                 ["transfers", "decisions"]))
def q_transfer_rejected(spark, d):
    ev = _fold(d)["events"]
    return ev.where(~F.col("accepted")).select("seq", "transfer_key", "stage", "action", "reason", "state_at")


@register_sql("apply_transfers", with_views_recursive(_SIM_CTES + """,
fin AS (SELECT tid, arg_max(state, k) AS status, max(seq) FILTER (WHERE accepted AND stage = 'mgr') AS mseq
        FROM sim GROUP BY tid),
mv AS (SELECT t.asset_id, arg_max(t.destination, f.mseq) AS dest, arg_max(t.dest_rig_id, f.mseq) AS drig
       FROM transfers t JOIN fin f ON f.tid = t.id WHERE f.status = 'Completed' AND f.mseq IS NOT NULL GROUP BY t.asset_id),
mc AS (SELECT t.asset_id, arg_max(t.dest_company_id, f.mseq) AS dcomp
       FROM transfers t JOIN fin f ON f.tid = t.id WHERE f.status = 'Completed' AND f.mseq IS NOT NULL GROUP BY t.asset_id)""", f"""
SELECT CASE WHEN mv.asset_id IS NOT NULL THEN {TS} END AS updated_at, a.id, a.asset_id, a.name, a.category, COALESCE(mv.drig, a.rig_id) AS rig_id, COALESCE(mc.dcomp, a.company_id) AS company_id,
  a.contract_id, CASE WHEN mv.asset_id IS NOT NULL THEN mv.dest ELSE a.location END AS location,
  a.status, a.value_usd
FROM assets a LEFT JOIN mv ON mv.asset_id = a.id LEFT JOIN mc ON mc.asset_id = a.id""", ["transfers", "decisions", "assets"]))
def q_apply_transfers(spark, d):
    st = _fold(d)["state"]
    return W.apply_transfers(d.assets, d.transfers, st, now=F.lit(NOW))["assets"]


_DONE_CTES = _SIM_CTES + """,
fin AS (SELECT tid, arg_max(state, k) AS status, max(seq) FILTER (WHERE accepted AND stage = 'mgr') AS mseq
        FROM sim GROUP BY tid),
done AS (SELECT t.* FROM transfers t JOIN fin f ON f.tid = t.id WHERE f.status = 'Completed' AND f.mseq IS NOT NULL)"""


@register_sql("transfer_history", with_views_recursive(_DONE_CTES, """
SELECT asset_id, 'Transfer Completed' AS action, 'Transferred to ' || destination || ' via ' || transfer_id AS notes FROM done""",
                                                       ["transfers", "decisions"]))
def q_transfer_history(spark, d):
    return W.apply_transfers(d.assets, d.transfers, _fold(d)["state"])["history"].drop("changed_by")


@register_sql("transfer_notices", with_views_recursive(_DONE_CTES, """
SELECT CAST(NULL AS VARCHAR) AS user_id, 'success' AS type, 'check-double' AS icon, 'Transfer Completed' AS title,
  'Transfer ' || transfer_id || ' fully approved – asset relocated' AS description, 'transfer' AS entity_type, id AS entity_id
FROM done""", ["transfers", "decisions"]))
def q_transfer_notices(spark, d):
    return W.apply_transfers(d.assets, d.transfers, _fold(d)["state"])["notices"]


@register_sql("ops_approval_notices", with_views_recursive(_SIM_CTES, """
SELECT 'info' AS type, 'user-tie' AS icon, 'Transfer Awaiting Final Approval' AS title,
  'Transfer ' || t.transfer_id || ' approved by Ops Manager – needs your final decision' AS description,
  'transfer' AS entity_type, s.tid AS entity_id, u.id AS user_id
FROM sim s JOIN transfers t ON t.id = s.tid JOIN users u ON u.role IN ('Admin', 'Asset Manager')
WHERE s.accepted AND s.stage = 'ops' AND s.action = 'approve'""", ["transfers", "decisions", "users"]))
def q_ops_approval_notices(spark, d):
    st = _fold(d)["state"]
    return W.ops_approval_notices(st, d.transfers, d.users)


@register_sql("cancel_transfers", with_views_and(f"""x AS (SELECT 1)
SELECT * FROM transfers t WHERE NOT (t.status IN ('Pending', 'On Hold') AND EXISTS (
  SELECT 1 FROM decisions d WHERE d.stage = 'cancel' AND d.transfer_key IN (CAST(t.id AS VARCHAR), t.transfer_id)
    AND d.actor_role IN {WRITE}))""",
                                                  ["transfers", "decisions"]))
def q_cancel_transfers(spark, d):
    req = d.decisions.where(F.col("stage") == "cancel").select(
        F.col("transfer_key").alias("key"), "actor_role")
    return W.cancel_transfers(d.transfers, req, ["id", "transfer_id"])["transfers"]


@register_sql("submit_transfers", with_views_and(f"""v AS (
  SELECT * FROM submissions WHERE actor_role IN {WRITE}
    AND transfer_id IS NOT NULL AND length(trim(transfer_id)) > 0
    AND asset_key IS NOT NULL AND length(trim(asset_key)) > 0
    AND destination IS NOT NULL AND length(trim(destination)) > 0
    AND reason IS NOT NULL AND length(trim(reason)) > 0
    AND priority IN ('Critical','High','Normal','Low'))
SELECT v.transfer_id, a.id AS asset_id, a.location AS current_location, v.destination, v.priority,
  'Field to Field' AS transfer_type, v.reason, {D} AS request_date, 'Pending' AS status
FROM v JOIN assets a ON CAST(a.id AS STRING) = v.asset_key OR a.asset_id = v.asset_key""",
                                                  ["submissions", "assets"]))
def q_submit_transfers(spark, d):
    out = W.submit_transfers(d.submissions, d.assets, d.users, AS_OF)["transfers"]
    return out.select("transfer_id", "asset_id", "current_location", "destination", "priority",
                      "transfer_type", "reason", "request_date", "status")


# ====================================================================== stream cores (batch form)
@register_sql("history_dedup", """
SELECT event_id AS change_id, user_id AS asset_id, CASE WHEN event_type = 'signup' THEN 'Created' ELSE 'Updated' END AS action,
  ts AS changed_at FROM events""")
def q_history_dedup(spark, d):
    """Every 40th event is delivered a second time; only those repeats go."""
    again = d.t.events.where(F.col("event_id") % 40 == 0)
    return K.dedup_changes(K.change_rows(d.t.events.unionByName(again)))


_WINDOW_SQL = """
SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start,
  time_bucket(INTERVAL '15 minutes', ts) + INTERVAL '15 minutes' AS window_end,
  client, CAST(COUNT(*) AS BIGINT) AS requests,
  CAST(COUNT(*) FILTER (WHERE path = 'signup') AS BIGINT) AS sign_ins
FROM access_log GROUP BY 1, 2, 3"""


@register_sql("quota_window_counts", with_views_and(f"w AS ({_WINDOW_SQL}) SELECT * FROM w", ["access_log"]))
def q_quota_window_counts(spark, d):
    return K.window_counts(d.access_log)


@register_sql("quota_breaches", with_views_and(f"w AS ({_WINDOW_SQL}) SELECT * FROM w WHERE requests > 200 OR sign_ins > 20",
                                              ["access_log"]))
def q_quota_breaches(spark, d):
    return K.quota_breaches(K.window_counts(d.access_log))


@register_sql("quota_anchored", with_views_recursive("""req AS MATERIALIZED (
  SELECT client, ts, count(*) AS n, count(*) FILTER (WHERE path = 'signup') AS s FROM access_log GROUP BY ALL),
starts AS (
  SELECT client, min(ts) AS start FROM req GROUP BY client
  UNION ALL
  SELECT st.client, min(r.ts) FROM starts st JOIN req r ON r.client = st.client AND r.ts >= st.start + INTERVAL 15 MINUTE GROUP BY st.client)""", """
SELECT st.client, st.start AS window_start, st.start + INTERVAL 15 MINUTE AS window_end, sum(r.n)::BIGINT AS requests, sum(r.s)::BIGINT AS sign_ins
FROM starts st JOIN req r ON r.client = st.client AND r.ts >= st.start AND r.ts < st.start + INTERVAL 15 MINUTE GROUP BY ALL""", ["access_log"]))
def q_quota_anchored(spark, d):
    """K4 as the source counts: a client's windows start at its own requests."""
    return K.anchored_windows(d.access_log)


@register_sql("mark_read", with_views_and("""r AS (SELECT DISTINCT event_id AS id FROM events WHERE event_type = 'view')
SELECT n.id, n.user_id, n.entity_type, n.entity_id,
  CASE WHEN n.id IN (SELECT id FROM r) THEN true ELSE n.is_read END AS is_read, n.created_at
FROM notifications n""", ["notifications"]))
def q_mark_read(spark, d):
    ids = d.t.events.where(F.col("event_type") == "view").select(F.col("event_id").alias("id"))
    return C.mark_read(d.notifications, ids)


_DEL_REQ = """SELECT event_id AS id,
  CASE WHEN event_id % 2 = 0 THEN user_id ELSE user_id + 1 END AS user_id
FROM events WHERE event_type = 'error'"""


@register_sql("delete_notifications", with_views_and(f"""r AS ({_DEL_REQ})
SELECT n.* FROM notifications n
WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = n.id AND (n.user_id IS NULL OR n.user_id = r.user_id))""",
                                                      ["notifications"]))
def q_delete_notifications(spark, d):
    e = d.t.events.where(F.col("event_type") == "error")
    req = e.select(F.col("event_id").alias("id"),
                   F.when(F.col("event_id") % 2 == 0, F.col("user_id"))
                    .otherwise(F.col("user_id") + 1).alias("user_id"))
    return C.delete_notifications(d.notifications, req)


@register_sql("with_defaults", with_views_and(f"""acc AS (SELECT * FROM asset_creates p WHERE {_ASSET_RULES})
SELECT seq, id, asset_id, name, category, 'Active' AS status, CAST(0 AS DECIMAL(18,2)) AS value_usd,
  'Site unknown' AS location FROM acc""", ["asset_creates"]))
def q_with_defaults(spark, d):
    acc = Q.validate_commands(d.asset_creates, "asset_create")["accepted"].drop("role")
    return C.with_defaults(acc, {"status": "Active", "value_usd": F.lit(0).cast("decimal(18,2)"),
                                 "location": "Site unknown"})


@register_sql("submit_transfer_notices", with_views_and(f"""v AS (
  SELECT * FROM submissions WHERE actor_role IN {WRITE}
    AND transfer_id IS NOT NULL AND length(trim(transfer_id)) > 0
    AND asset_key IS NOT NULL AND length(trim(asset_key)) > 0
    AND destination IS NOT NULL AND length(trim(destination)) > 0
    AND reason IS NOT NULL AND length(trim(reason)) > 0
    AND priority IN ('Critical','High','Normal','Low')),
ok AS (SELECT v.* FROM v WHERE EXISTS (SELECT 1 FROM assets a
       WHERE CAST(a.id AS STRING) = v.asset_key OR a.asset_id = v.asset_key))
SELECT 'info' AS type, 'exchange-alt' AS icon, 'New Transfer Request' AS title,
  'Transfer request ' || ok.transfer_id || ' submitted for your review' AS description,
  'transfer' AS entity_type, ok.transfer_id AS entity_id, u.id AS user_id
FROM ok JOIN users u ON u.role = 'Operations Manager'""", ["submissions", "assets", "users"]))
def q_submit_transfer_notices(spark, d):
    return W.submit_transfers(d.submissions, d.assets, d.users, AS_OF)["notices"]


# ====================================================================== output convention
# Oracle result columns of type DATE, cast to TIMESTAMP like the Spark side
# (``dates_as_timestamps``), so both engines return the same column types.
ORACLE_DATE_COLUMNS = {
    "contract_list": ["start_date", "end_date"],
    "contracts_enriched": ["start_date", "end_date"],
    "contracts_expiring_30": ["start_date", "end_date"],
    "contracts_lapsing": ["end_date"],
    "maintenance_list": ["next_due_date"],
    "maintenance_overdue": ["next_due_date"],
    "maintenance_due_soon": ["next_due_date"],
    "maintenance_stored_status": ["next_due_date"],
    "maintenance_by_urgency_page": ["next_due_date"],
    "maintenance_enriched": ["next_due_date", "today"],
    "maintenance_alerts": ["next_due_date"],
    "upcoming_maintenance": ["next_due_date"],
    "assets_enriched": ["contract_end_date"],
    "transfers_enriched": ["request_date"],
    "transfers_page": ["request_date"],
    "certificates_enriched": ["expiry_date"],
    "schedule_logs": ["next_due_date", "log_completion_date"],
    "delete_cascade": ["next_due_date"],
    "complete_maintenance_schedules": ["next_due_date", "last_done_date"],
    "complete_maintenance_logs": ["completion_date", "next_due_date"],
    "certificate_refresh": ["expiry_date"],
    "delete_cascade_certificates": ["expiry_date"],
    "delete_cascade_logs": ["completion_date"],
    "transfer_final_state": ["ops_date", "mgr_date"],
    "cancel_transfers": ["request_date"],
    "submit_transfers": ["request_date"],
}

for _name, _cols in ORACLE_DATE_COLUMNS.items():
    _rep = ", ".join(f"CAST({c} AS TIMESTAMP) AS {c}" for c in _cols)
    ORACLE[_name] = f"SELECT * REPLACE ({_rep}) FROM (\n{ORACLE[_name]}\n) _q"
