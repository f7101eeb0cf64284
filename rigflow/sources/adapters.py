"""Driver tables seen as domain tables (the adapter views of FIXTURES.md §3).

Each builder takes a ``DriverTables`` reader and returns a lazy DataFrame; only the
columns each view needs are read, so the Parquet scans are pruned. Keys are BIGINT.
``ADAPTER_SQL`` keeps the same views as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the reference date of every adapter-view test.
ADAPTER_AS_OF = dt.date(1998, 6, 1)

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class DriverTables:
    """Lazy reader of the driver's Parquet tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return self.table(name)
        raise AttributeError(name)


def _case(col: Column, mapping: list[tuple[object, str]], default) -> Column:
    out = None
    for k, v in mapping:
        out = (F.when(col == k, v) if out is None else out.when(col == k, v))
    return out.otherwise(default)


def _lpad(col: Column, n: int) -> Column:
    return F.lpad(col.cast("string"), n, "0")


def _plus_days(day: str, n: Column) -> Column:
    return F.date_add(F.lit(dt.date.fromisoformat(day)), n.cast("int"))


class Domain:
    """The adapter views, built once per (session, folder)."""

    def __init__(self, spark: SparkSession, root: str):
        self.t = DriverTables(spark, root)
        self.spark = spark

    @cached_property
    def companies(self) -> DataFrame:
        r = self.t.region
        k = F.col("r_regionkey")
        return r.select(
            k.cast("bigint").alias("id"),
            F.concat(F.lit("CMP"), _lpad(k, 3)).alias("company_code"),
            F.col("r_name").alias("name"),
            F.when(k == 4, "Inactive").otherwise("Active").alias("status"),
        )

    @cached_property
    def rigs(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.t.nation.select(
            k.cast("bigint").alias("id"),
            F.concat(F.lit("RIG"), _lpad(k, 2)).alias("rig_id"),
            F.col("n_name").alias("name"),
            F.when(k % 9 == 0, F.lit(None).cast("bigint"))
             .otherwise(F.col("n_regionkey").cast("bigint")).alias("company_id"),
            _case(k % 4, [(0, "Maintenance"), (1, "Standby")], "Active").alias("status"),
        )

    @cached_property
    def contracts(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.t.supplier.select(
            k.alias("id"),
            F.concat(F.lit("CON-"), _lpad(k, 6)).alias("contract_no"),
            (F.col("s_nationkey") % 5).cast("bigint").alias("company_id"),
            F.when(k % 6 == 0, F.lit(None).cast("bigint"))
             .otherwise(F.col("s_nationkey").cast("bigint")).alias("rig_id"),
            _plus_days("1997-05-01", k % 120).alias("start_date"),
            _plus_days("1998-05-01", k % 120).alias("end_date"),
            F.abs(F.col("s_acctbal")).cast("decimal(18,2)").alias("value_usd"),
            _case(k % 5, [(0, "Pending"), (1, "Expired"), (2, "Terminated")], "Active").alias("status"),
        )

    @cached_property
    def assets(self) -> DataFrame:
        k = F.col("c_custkey")
        nk = F.col("c_nationkey")
        return self.t.customer.select(
            k.alias("id"),
            F.concat(F.lit("AST-"), _lpad(k, 6)).alias("asset_id"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("category"),
            F.when((nk < 2) | (k % 11 == 0), F.lit(None).cast("bigint"))
             .otherwise(nk.cast("bigint")).alias("rig_id"),
            (nk % 5).cast("bigint").alias("company_id"),
            F.when(k % 3 == 0, F.lit(None).cast("bigint")).otherwise(k % 10).alias("contract_id"),
            F.concat(F.lit("Site "), nk.cast("string")).alias("location"),
            _case(k % 7, [(0, "Maintenance"), (1, "Inactive"), (2, "Contracted"), (3, "Standby")],
                  "Active").alias("status"),
            F.when(F.col("c_acctbal") < 0, F.lit(0.0)).otherwise(F.col("c_acctbal"))
             .cast("decimal(18,2)").alias("value_usd"),
        )

    @cached_property
    def schedules(self) -> DataFrame:
        k = F.col("o_orderkey")
        pr = F.col("o_orderpriority")
        return self.t.orders.select(
            k.alias("id"),
            F.concat(F.lit("PM-"), _lpad(k, 7)).alias("pm_id"),
            F.col("o_custkey").alias("asset_id"),
            _case(k % 3, [(0, "Inspection"), (1, "Oil Change")], "Calibration").alias("task_type"),
            _case(pr, [("1-URGENT", "Critical"), ("2-HIGH", "High"), ("5-LOW", "Low")],
                  "Normal").alias("priority"),
            (F.lit(30) * (k % 4 + 1)).cast("int").alias("frequency_days"),
            F.col("o_orderdate").cast("date").alias("next_due_date"),
            _case(pr, [("1-URGENT", 30), ("2-HIGH", 14)], 7).alias("alert_days"),
            F.when(F.col("o_orderstatus") == "F", "Completed")
             .when(F.col("o_orderstatus") == "O", "Scheduled")
             .when(k % 7 == 0, "Cancelled").otherwise("In Progress").alias("status"),
        )

    @cached_property
    def logs(self) -> DataFrame:
        return self.t.lineitem.select(
            F.col("l_orderkey").alias("schedule_id"),
            F.col("l_shipdate").cast("date").alias("completion_date"),
            F.col("l_suppkey").cast("string").alias("completed_by"),
            F.col("l_quantity").cast("decimal(6,2)").alias("actual_hours"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("actual_cost"),
        )

    @cached_property
    def bom_items(self) -> DataFrame:
        # 64 consecutive keys are one asset's binary tree: item r of it hangs under item
        # floor(r / 2); every 97th key points at a missing parent (an orphan).
        k = F.col("o_orderkey")
        r = k % 64
        parent = F.when(k % 97 == 0, F.lit(-1).cast("bigint")).when(r > 0, k - r + F.floor(r / 2))
        return self.t.orders.select(
            k.alias("id"),
            F.floor(k / 64).cast("bigint").alias("asset_id"),
            parent.cast("bigint").alias("parent_id"),
            F.concat(F.lit("Item "), k.cast("string")).alias("name"),
            F.when(k % 3 == 0, "Bulk").otherwise("Serialized").alias("item_type"),
            (k % 5 + 1).cast("decimal(12,3)").alias("quantity"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("unit_cost_usd"),
            _case(k % 8, [(0, "On Order"), (1, "Obsolete")], "Active").alias("status"),
        )

    @cached_property
    def certificates(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.t.part.select(
            k.alias("id"),
            F.when(k % 3 == 0, F.lit(None).cast("bigint")).otherwise(k).alias("asset_id"),
            F.when(k % 3 == 0, k % 25).alias("rig_id"),
            F.when(k % 7 == 0, F.lit(None).cast("date"))
             .otherwise(_plus_days("1998-04-02", k % 121)).alias("expiry_date"),
            F.when(k % 9 == 0, "Revoked").otherwise("Valid").alias("status"),
        )

    @cached_property
    def work_orders(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.t.orders.select(
            k.alias("id"),
            F.col("o_custkey").alias("asset_id"),
            _case(k % 5, [(0, "Open"), (1, "In Progress"), (2, "On Hold"), (3, "Completed")],
                  "Cancelled").alias("status"),
        )

    @cached_property
    def users(self) -> DataFrame:
        # every customer is a user; one in 500 has each of the approving roles
        k = F.col("c_custkey")
        return self.t.customer.select(
            k.alias("id"),
            F.col("c_name").alias("full_name"),
            _case(k % 500, [(0, "Admin"), (1, "Asset Manager"), (2, "Operations Manager")],
                  F.when(k % 5 == 3, "Editor").otherwise("Viewer")).alias("role"),
            F.md5("c_name").alias("password_hash"),
            F.when(k % 13 == 0, "Inactive").otherwise("Active").alias("status"),
        )

    @cached_property
    def notifications(self) -> DataFrame:
        e = F.col("event_id")
        return self.t.events.select(
            e.alias("id"),
            F.when(e % 50 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("user_id"),
            _case(F.col("event_type"), [("view", "asset"), ("click", "transfer")],
                  "maintenance").alias("entity_type"),
            F.col("user_id").alias("entity_id"),
            (F.col("value") < 50).alias("is_read"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def asset_history(self) -> DataFrame:
        e = F.col("event_id")
        return self.t.events.select(
            e.alias("id"),
            F.col("user_id").alias("asset_id"),
            F.when(F.col("event_type") == "signup", "Created").otherwise("Updated").alias("action"),
            F.when(e % 6 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("changed_by"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def transfers(self) -> DataFrame:
        u = F.col("user_id")
        return (self.t.events.select("user_id").distinct().select(
            u.alias("id"),
            u.alias("asset_id"),
            F.concat(F.lit("Site "), (u % 25).cast("string")).alias("destination"),
            F.when(u % 4 == 0, F.lit(None).cast("bigint")).otherwise(u % 25).alias("dest_rig_id"),
            _case(u % 10, [(0, "Ops Approved"), (1, "On Hold"), (2, "Completed"), (3, "Rejected")],
                  "Pending").alias("status"),
            F.concat(F.lit("TR-"), _lpad(u, 6)).alias("transfer_id"),
            _plus_days("1998-05-01", u % 45).alias("request_date"),
            F.when(u % 3 == 0, u % 5).alias("dest_company_id"),
            (u + 1).alias("requested_by"),
            F.when((u % 10).isin(0, 2), u + 2).alias("ops_approved_by"),
            F.when(u % 10 == 2, u + 3).alias("mgr_approved_by"),
        ))

    @cached_property
    def decisions(self) -> DataFrame:
        e = F.col("event_id")
        et = F.col("event_type")
        return self.t.events.select(
            e.alias("seq"),
            F.when(e % 2 == 0, F.col("user_id").cast("string"))
             .otherwise(F.concat(F.lit("TR-"), _lpad(F.col("user_id"), 6))).alias("transfer_key"),
            F.col("ts"),
            _case(et, [("click", "ops"), ("view", "mgr"), ("signup", "ops"), ("error", "mgr")],
                  "cancel").alias("stage"),
            F.when(et.isin("click", "view"), "approve").when(e % 2 == 0, "reject")
             .otherwise("hold").alias("action"),
            F.when(e % 10 == 0, " ").otherwise("ok").alias("comment"),
            _case(e % 4, [(0, "Admin"), (1, "Asset Manager"), (2, "Operations Manager")],
                  "Viewer").alias("actor_role"),
        )

    # ---- command batches derived from events (their size grows with the data)
    def _actor(self, e: Column) -> Column:
        return _case(e % 4, [(0, "Admin"), (1, "Asset Manager"), (2, "Editor")], "Viewer")

    def _asset_key(self, e: Column, u: Column) -> Column:
        return F.when(e % 2 == 0, u.cast("string")).otherwise(
            F.concat(F.lit("AST-"), _lpad(u * 11, 6)))

    @cached_property
    def asset_patches(self) -> DataFrame:
        e, u, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
        return self.t.events.select(
            e.alias("seq"), self._asset_key(e, u).alias("key"), self._actor(e).alias("role"),
            _case(et, [("error", "Maintenance"), ("purchase", "Active")], None).alias("status"),
            F.when(et == "view", F.concat(F.lit("Yard "), (u % 7).cast("string"))).alias("location"),
            F.when(et == "signup", (F.col("value") * 100).cast("decimal(18,2)")).alias("value_usd"))

    @cached_property
    def asset_creates(self) -> DataFrame:
        e, u, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
        return self.t.events.select(
            e.alias("seq"), (u * 11 + 1000000).alias("id"),
            F.concat(F.lit("AST-"), _lpad(u * 11, 6)).alias("asset_id"),
            F.when(e % 10 == 0, F.lit(" ")).otherwise(F.concat(F.lit("New asset "), e.cast("string"))).alias("name"),
            _case(et, [("signup", "Other"), ("click", "Transportation")], "Bogus").alias("category"),
            self._actor(e).alias("role"))

    @cached_property
    def completions(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        ev = self.t.events.where(F.col("event_type") == "purchase")
        return ev.select(
            e.alias("seq"),
            F.when(e % 2 == 0, u.cast("string"))
             .otherwise(F.concat(F.lit("PM-"), _lpad(u * 108, 7))).alias("schedule_key"),
            F.col("ts").cast("date").alias("completion_date"),
            F.when(e % 9 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("tech-"), (e % 13).cast("string"))).alias("completed_by"),
            F.col("value").cast("decimal(6,2)").alias("actual_hours"),
            F.when(e % 3 == 0, F.date_add(F.col("ts").cast("date"), 45)).alias("next_due_date"))

    @cached_property
    def submissions(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        ev = self.t.events.where(F.col("event_type") == "view")
        return ev.select(
            e.alias("seq"), F.concat(F.lit("TRQ-"), e.cast("string")).alias("transfer_id"),
            self._asset_key(e, u).alias("asset_key"),
            F.concat(F.lit("Site "), (u % 25).cast("string")).alias("destination"),
            F.when(e % 7 == 0, F.lit("")).otherwise(F.lit("relocation")).alias("reason"),
            _case(e % 5, [(0, "Critical"), (1, "High"), (2, "Normal"), (3, "Low")], "Urgent").alias("priority"),
            self._actor(e).alias("actor_role"))

    @cached_property
    def sessions(self) -> DataFrame:
        """Sign-in sessions: one per signup event, valid for seven days."""
        ev = self.t.events.where(F.col("event_type") == "signup")
        return ev.select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"),
                         (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"))

    @cached_property
    def access_log(self) -> DataFrame:
        # every thousandth event is a storm of 250 requests
        e = F.col("event_id")
        times = F.when(e % 1000 == 0, 250).otherwise(1)
        return self.t.events.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).select(
            "ts", F.col("user_id").alias("client"), F.col("event_type").alias("path"))


# The same views as SQL text (runs in DuckDB and Spark SQL); the oracle puts them in
# front of its queries as CTEs.
ADAPTER_SQL = {
    "companies": """SELECT CAST(r_regionkey AS BIGINT) AS id, concat('CMP', lpad(CAST(r_regionkey AS STRING), 3, '0')) AS company_code, r_name AS name,
       CASE WHEN r_regionkey = 4 THEN 'Inactive' ELSE 'Active' END AS status FROM region""",
    "rigs": """SELECT CAST(n_nationkey AS BIGINT) AS id, concat('RIG', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS rig_id, n_name AS name,
       CASE WHEN n_nationkey % 9 = 0 THEN NULL ELSE CAST(n_regionkey AS BIGINT) END AS company_id,
       CASE n_nationkey % 4 WHEN 0 THEN 'Maintenance' WHEN 1 THEN 'Standby' ELSE 'Active' END AS status FROM nation""",
    "contracts": """SELECT s_suppkey AS id, concat('CON-', lpad(CAST(s_suppkey AS STRING), 6, '0')) AS contract_no, CAST(s_nationkey % 5 AS BIGINT) AS company_id,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_nationkey AS BIGINT) END AS rig_id,
       DATE '1997-05-01' + CAST(s_suppkey % 120 AS INT) AS start_date, DATE '1998-05-01' + CAST(s_suppkey % 120 AS INT) AS end_date,
       CAST(abs(s_acctbal) AS DECIMAL(18,2)) AS value_usd,
       CASE s_suppkey % 5 WHEN 0 THEN 'Pending' WHEN 1 THEN 'Expired' WHEN 2 THEN 'Terminated' ELSE 'Active' END AS status FROM supplier""",
    "assets": """SELECT c_custkey AS id, concat('AST-', lpad(CAST(c_custkey AS STRING), 6, '0')) AS asset_id, c_name AS name, c_mktsegment AS category,
       CASE WHEN c_nationkey < 2 OR c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS rig_id,
       CAST(c_nationkey % 5 AS BIGINT) AS company_id,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 10 END AS contract_id,
       concat('Site ', CAST(c_nationkey AS STRING)) AS location,
       CASE c_custkey % 7 WHEN 0 THEN 'Maintenance' WHEN 1 THEN 'Inactive' WHEN 2 THEN 'Contracted' WHEN 3 THEN 'Standby' ELSE 'Active' END AS status,
       CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS DECIMAL(18,2)) AS value_usd FROM customer""",
    "maintenance_schedules": """SELECT o_orderkey AS id, concat('PM-', lpad(CAST(o_orderkey AS STRING), 7, '0')) AS pm_id, o_custkey AS asset_id,
       CASE o_orderkey % 3 WHEN 0 THEN 'Inspection' WHEN 1 THEN 'Oil Change' ELSE 'Calibration' END AS task_type,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '5-LOW' THEN 'Low' ELSE 'Normal' END AS priority,
       CAST(30 * (o_orderkey % 4 + 1) AS INT) AS frequency_days, CAST(o_orderdate AS DATE) AS next_due_date,
       CASE o_orderpriority WHEN '1-URGENT' THEN 30 WHEN '2-HIGH' THEN 14 ELSE 7 END AS alert_days,
       CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Scheduled'
            ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'Cancelled' ELSE 'In Progress' END END AS status FROM orders""",
    "maintenance_logs": """SELECT l_orderkey AS schedule_id, CAST(l_shipdate AS DATE) AS completion_date, CAST(l_suppkey AS STRING) AS completed_by,
       CAST(l_quantity AS DECIMAL(6,2)) AS actual_hours, CAST(l_extendedprice AS DECIMAL(18,2)) AS actual_cost FROM lineitem""",
    "bom_items": """SELECT o_orderkey AS id, CAST(floor(o_orderkey / 64) AS BIGINT) AS asset_id,
       CASE WHEN o_orderkey % 97 = 0 THEN -1 WHEN o_orderkey % 64 > 0
            THEN CAST(o_orderkey - o_orderkey % 64 + floor((o_orderkey % 64) / 2) AS BIGINT) END AS parent_id,
       concat('Item ', CAST(o_orderkey AS STRING)) AS name,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Bulk' ELSE 'Serialized' END AS item_type,
       CAST(o_orderkey % 5 + 1 AS DECIMAL(12,3)) AS quantity, CAST(o_totalprice AS DECIMAL(18,2)) AS unit_cost_usd,
       CASE o_orderkey % 8 WHEN 0 THEN 'On Order' WHEN 1 THEN 'Obsolete' ELSE 'Active' END AS status FROM orders""",
    "certificates": """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS asset_id,
       CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 25 END AS rig_id,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE DATE '1998-04-02' + CAST(p_partkey % 121 AS INT) END AS expiry_date,
       CASE WHEN p_partkey % 9 = 0 THEN 'Revoked' ELSE 'Valid' END AS status FROM part""",
    "work_orders": """SELECT o_orderkey AS id, o_custkey AS asset_id,
       CASE o_orderkey % 5 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'On Hold' WHEN 3 THEN 'Completed' ELSE 'Cancelled' END AS status
FROM orders""",
    "users": """SELECT c_custkey AS id, c_name AS full_name,
       CASE c_custkey % 500 WHEN 0 THEN 'Admin' WHEN 1 THEN 'Asset Manager' WHEN 2 THEN 'Operations Manager'
            ELSE CASE WHEN c_custkey % 5 = 3 THEN 'Editor' ELSE 'Viewer' END END AS role,
       md5(c_name) AS password_hash,
       CASE WHEN c_custkey % 13 = 0 THEN 'Inactive' ELSE 'Active' END AS status FROM customer""",
    "notifications": """SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE event_type WHEN 'view' THEN 'asset' WHEN 'click' THEN 'transfer' ELSE 'maintenance' END AS entity_type,
       user_id AS entity_id, value < 50 AS is_read, ts AS created_at FROM events""",
    "asset_history": """SELECT event_id AS id, user_id AS asset_id, CASE WHEN event_type = 'signup' THEN 'Created' ELSE 'Updated' END AS action,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS changed_by, ts AS created_at FROM events""",
    "transfers": """SELECT DISTINCT user_id AS id, user_id AS asset_id, concat('Site ', CAST(user_id % 25 AS STRING)) AS destination,
       CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id % 25 END AS dest_rig_id,
       CASE user_id % 10 WHEN 0 THEN 'Ops Approved' WHEN 1 THEN 'On Hold' WHEN 2 THEN 'Completed' WHEN 3 THEN 'Rejected' ELSE 'Pending' END AS status,
       concat('TR-', lpad(CAST(user_id AS STRING), 6, '0')) AS transfer_id,
       DATE '1998-05-01' + CAST(user_id % 45 AS INT) AS request_date,
       CASE WHEN user_id % 3 = 0 THEN user_id % 5 END AS dest_company_id, user_id + 1 AS requested_by,
       CASE WHEN user_id % 10 IN (0, 2) THEN user_id + 2 END AS ops_approved_by,
       CASE WHEN user_id % 10 = 2 THEN user_id + 3 END AS mgr_approved_by FROM events""",
    "decisions": """SELECT event_id AS seq,
       CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING) ELSE concat('TR-', lpad(CAST(user_id AS STRING), 6, '0')) END AS transfer_key, ts,
       CASE event_type WHEN 'click' THEN 'ops' WHEN 'view' THEN 'mgr' WHEN 'signup' THEN 'ops' WHEN 'error' THEN 'mgr' ELSE 'cancel' END AS stage,
       CASE WHEN event_type IN ('click','view') THEN 'approve' WHEN event_id % 2 = 0 THEN 'reject' ELSE 'hold' END AS action,
       CASE WHEN event_id % 10 = 0 THEN ' ' ELSE 'ok' END AS comment,
       CASE event_id % 4 WHEN 0 THEN 'Admin' WHEN 1 THEN 'Asset Manager' WHEN 2 THEN 'Operations Manager' ELSE 'Viewer' END AS actor_role FROM events""",
    "access_log": """SELECT ts, user_id AS client, event_type AS path
FROM events, unnest(range(CASE WHEN event_id % 1000 = 0 THEN 250 ELSE 1 END)) AS storm(n)""",
    "sessions": """SELECT event_id AS id, user_id, ts AS created_at, ts + INTERVAL 7 DAYS AS expires_at
FROM events WHERE event_type = 'signup'""",
}


_ACTOR = "CASE event_id % 4 WHEN 0 THEN 'Admin' WHEN 1 THEN 'Asset Manager' WHEN 2 THEN 'Editor' ELSE 'Viewer' END"
_AKEY = ("CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING) "
         "ELSE concat('AST-', lpad(CAST(user_id * 11 AS STRING), 6, '0')) END")
ADAPTER_SQL.update({
    "asset_patches": f"""SELECT event_id AS seq, {_AKEY} AS key, {_ACTOR} AS role,
       CASE event_type WHEN 'error' THEN 'Maintenance' WHEN 'purchase' THEN 'Active' END AS status,
       CASE WHEN event_type = 'view' THEN concat('Yard ', CAST(user_id % 7 AS STRING)) END AS location,
       CASE WHEN event_type = 'signup' THEN CAST(value * 100 AS DECIMAL(18,2)) END AS value_usd FROM events""",
    "asset_creates": f"""SELECT event_id AS seq, user_id * 11 + 1000000 AS id,
       concat('AST-', lpad(CAST(user_id * 11 AS STRING), 6, '0')) AS asset_id,
       CASE WHEN event_id % 10 = 0 THEN ' ' ELSE concat('New asset ', CAST(event_id AS STRING)) END AS name,
       CASE event_type WHEN 'signup' THEN 'Other' WHEN 'click' THEN 'Transportation' ELSE 'Bogus' END AS category,
       {_ACTOR} AS role FROM events""",
    "completions": """SELECT event_id AS seq,
       CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS STRING)
            ELSE concat('PM-', lpad(CAST(user_id * 108 AS STRING), 7, '0')) END AS schedule_key,
       CAST(ts AS DATE) AS completion_date,
       CASE WHEN event_id % 9 = 0 THEN NULL ELSE concat('tech-', CAST(event_id % 13 AS STRING)) END AS completed_by,
       CAST(value AS DECIMAL(6,2)) AS actual_hours,
       CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) + 45 END AS next_due_date
FROM events WHERE event_type = 'purchase'""",
    "submissions": f"""SELECT event_id AS seq, concat('TRQ-', CAST(event_id AS STRING)) AS transfer_id,
       {_AKEY} AS asset_key, concat('Site ', CAST(user_id % 25 AS STRING)) AS destination,
       CASE WHEN event_id % 7 = 0 THEN '' ELSE 'relocation' END AS reason,
       CASE event_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Normal' WHEN 3 THEN 'Low' ELSE 'Urgent' END AS priority,
       {_ACTOR} AS actor_role FROM events WHERE event_type = 'view'""",
})

def with_views(sql: str, names: list[str]) -> str:
    """Prefix ``sql`` with the named adapter views as CTEs."""
    if not names:
        return sql
    ctes = ",\n".join(f"{n} AS (\n{ADAPTER_SQL[n]}\n)" for n in names)
    return f"WITH {ctes}\n{sql}"


def with_views_recursive(recursive_ctes: str, sql: str, names: list[str]) -> str:
    """``WITH RECURSIVE <adapter views>, <recursive_ctes> <sql>`` for the tree oracles."""
    ctes = ",\n".join(f"{n} AS (\n{ADAPTER_SQL[n]}\n)" for n in names)
    return f"WITH RECURSIVE {ctes},\n{recursive_ctes}\n{sql}"


def with_views_and(body: str, names: list[str]) -> str:
    """``WITH <adapter views>, <body>`` where ``body`` continues the CTE list."""
    ctes = ",\n".join(f"{n} AS (\n{ADAPTER_SQL[n]}\n)" for n in names)
    return f"WITH {ctes},\n{body}"
