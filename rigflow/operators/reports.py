"""Aggregate reports: KPI rows, per-rig / per-company / per-contract counts, BOM value.

Pattern used throughout: aggregate each child table by its foreign key first (partial
aggregation map-side, so a hot key never meets its rows in one task), then LEFT JOIN the
small per-key result to the parent. This gives the same numbers as grouping the
parent ⟕ child fan-out and never multiplies rows. One-row KPI blocks are combined with
scalar subqueries (one scan and one aggregate per table), never with row products.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import status as S
from . import enrich as E

def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _cnt(pred: Column) -> Column:
    return F.count_if(pred).cast("bigint")


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), _zero()).alias(c)


def _money_sum(col: str) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("decimal(38,2)")


def one_row(spark: SparkSession, blocks: dict[str, DataFrame]) -> DataFrame:
    """Combine one-row aggregate frames into one row: each block becomes a scalar
    subquery returning a struct, whose fields are flattened with the block's prefix."""
    cols = []
    for prefix, block in blocks.items():
        s = block.select(F.struct(*block.columns).alias("s")).scalar()
        for f in block.columns:
            name = f"{prefix}_{f}" if prefix else f
            cols.append(s.getField(f).alias(name))
    return spark.range(1).select(*cols)


# ------------------------------------------------------------------ D5 / D6
def asset_kpis(assets: DataFrame, with_standby: bool = False) -> DataFrame:
    st = F.col("status")
    aggs = [F.count("*").alias("total"),
            _cnt(st == "Active").alias("active"),
            _cnt(st == "Maintenance").alias("maintenance"),
            _cnt(st == "Contracted").alias("contracted"),
            _cnt(st == "Inactive").alias("inactive")]
    if with_standby:
        aggs.append(_cnt(st == "Standby").alias("standby"))
    aggs += [_money_sum("value_usd").alias("total_value"),
             F.countDistinct("rig_id").alias("rigs_with_assets")]
    return assets.agg(*aggs)


def asset_summary(assets: DataFrame) -> DataFrame:
    """One row of counts by status, total value, distinct rigs in use."""
    return asset_kpis(assets)


def assets_by_rig(rigs: DataFrame, assets: DataFrame) -> DataFrame:
    """Per rig (empty rigs kept): asset count, Active, Maintenance, total value."""
    st = F.col("status")
    per = (assets.where(F.col("rig_id").isNotNull())
           .groupBy(F.col("rig_id").alias("_k"))
           .agg(F.count("*").alias("asset_count"),
                _cnt(st == "Active").alias("active"),
                _cnt(st == "Maintenance").alias("maintenance"),
                F.sum("value_usd").alias("_v")))
    r = rigs.select("id", "rig_id", F.col("name").alias("rig_name"), F.col("status").alias("rig_status"))
    out = r.join(per, r["id"] == per["_k"], "left")
    return (out.select("rig_id", "rig_name", "rig_status", _z("asset_count"), _z("active"),
                       _z("maintenance"),
                       F.coalesce(F.col("_v"), F.lit(0)).cast("decimal(38,2)").alias("total_value"))
            .orderBy(F.col("rig_id").asc_nulls_last()))


# ------------------------------------------------------------------ rig roll-ups
def schedules_per_asset(schedules: DataFrame, as_of=None) -> DataFrame:
    """Per asset: schedules, overdue, due soon, completed (open = not Completed/Cancelled)."""
    return (schedules.groupBy(F.col("asset_id").alias("_ka"))
            .agg(F.count("*").alias("n_sched"),
                 _cnt(S.is_overdue(as_of=as_of)).alias("n_overdue"),
                 _cnt(S.is_due_soon(as_of=as_of)).alias("n_due_soon"),
                 _cnt(F.col("status") == "Completed").alias("n_completed")))


def schedules_per_rig(assets: DataFrame, schedules: DataFrame, as_of=None) -> DataFrame:
    """Per rig: assets, assets counted once per schedule (the fan-out count), schedules,
    overdue, due soon, completed. Built as schedules→asset aggregate, then asset→rig."""
    pa = schedules_per_asset(schedules, as_of)
    a = assets.select(F.col("id").alias("_id"), F.col("rig_id").alias("_rig")).where(F.col("_rig").isNotNull())
    j = a.join(pa, a["_id"] == pa["_ka"], "left")
    n = F.coalesce(F.col("n_sched"), _zero())
    return (j.groupBy(F.col("_rig").alias("_k"))
            .agg(F.count("*").alias("asset_count_distinct"),
                 F.sum(F.greatest(n, F.lit(1).cast("bigint"))).cast("bigint").alias("asset_count_fanout"),
                 F.sum(n).cast("bigint").alias("total_tasks"),
                 F.sum(F.coalesce("n_overdue", _zero())).cast("bigint").alias("overdue"),
                 F.sum(F.coalesce("n_due_soon", _zero())).cast("bigint").alias("due_soon"),
                 F.sum(F.coalesce("n_completed", _zero())).cast("bigint").alias("completed")))


def _rigs_with(rigs: DataFrame, per_rig: DataFrame, cols: list[str]) -> DataFrame:
    r = rigs.select("id", "rig_id", F.col("name").alias("rig_name"), F.col("status").alias("rig_status"))
    out = r.join(per_rig, r["id"] == per_rig["_k"], "left")
    return out.select("rig_id", "rig_name", "rig_status", *[_z(c) for c in cols])


def maintenance_by_rig(rigs: DataFrame, assets: DataFrame, schedules: DataFrame, as_of=None) -> DataFrame:
    """Per rig (empty rigs kept): total tasks, overdue, due soon, completed."""
    per = schedules_per_rig(assets, schedules, as_of)
    return _rigs_with(rigs, per, ["total_tasks", "overdue", "due_soon", "completed"]).orderBy("rig_id")


def dashboard_by_rig(rigs: DataFrame, assets: DataFrame, schedules: DataFrame, as_of=None) -> DataFrame:
    """Per rig: ``asset_count`` as the source reports it (each asset counted once per
    schedule, once if it has none), ``asset_count_distinct``, overdue and due-soon PMs."""
    per = (schedules_per_rig(assets, schedules, as_of)
           .withColumnRenamed("asset_count_fanout", "asset_count")
           .withColumnRenamed("overdue", "overdue_pm")
           .withColumnRenamed("due_soon", "due_soon_pm"))
    return _rigs_with(rigs, per, ["asset_count", "asset_count_distinct", "overdue_pm",
                                  "due_soon_pm"]).orderBy("rig_id")


def rig_list(rigs: DataFrame, companies: DataFrame, assets: DataFrame, schedules: DataFrame,
             as_of=None) -> DataFrame:
    """Every rig column, company name, distinct assets, distinct schedules, overdue."""
    per = schedules_per_rig(assets, schedules, as_of)
    per = per.select("_k", F.col("asset_count_distinct").alias("asset_count"),
                     F.col("total_tasks").alias("pm_count"), F.col("overdue").alias("overdue_pm"))
    r = E.rig_detail(rigs, companies)
    out = r.join(per, r["id"] == per["_k"], "left").drop("_k")
    for c in ("asset_count", "pm_count", "overdue_pm"):
        out = out.withColumn(c, F.coalesce(F.col(c), _zero()))
    return out.orderBy("rig_id")


# ------------------------------------------------------------------ D11 companies
def company_list(companies: DataFrame, contracts: DataFrame, rigs: DataFrame,
                 assets: DataFrame) -> DataFrame:
    """Every company with its contract, rig and asset counts. Each child table is
    counted per company separately and joined: the source's COUNT(DISTINCT) over the
    three-way fan-out gives the same numbers."""
    def per(df: DataFrame, name: str) -> DataFrame:
        # ids are keys, so once counted per company (no fan-out) COUNT = COUNT(DISTINCT)
        return (df.where(F.col("company_id").isNotNull())
                .groupBy(F.col("company_id").alias(f"_k_{name}"))
                .agg(F.count("id").alias(name)))
    out = companies
    for df, name in ((contracts, "contract_count"), (rigs, "rig_count"), (assets, "asset_count")):
        p = per(df, name)
        out = out.join(p, out["id"] == p[f"_k_{name}"], "left").drop(f"_k_{name}")
        out = out.withColumn(name, F.coalesce(F.col(name), _zero()))
    return out.orderBy("name")


# ------------------------------------------------------------------ D8 / D9 lists
def contract_list(contracts: DataFrame, companies: DataFrame, rigs: DataFrame, assets: DataFrame,
                  as_of=None) -> DataFrame:
    """Contracts with company, rig, days until expiry and linked-asset count."""
    out = E.enrich_contracts(contracts, companies, rigs, assets, as_of, live_status=False,
                             company_map={"name": "company_name"},
                             rig_map={"name": "rig_name", "rig_id": "rig_code"})
    return out.orderBy(F.col("end_date").asc_nulls_last(), "id")


def logs_per_schedule(logs: DataFrame) -> DataFrame:
    return logs.groupBy(F.col("schedule_id").alias("_k_l")).agg(F.count("*").alias("log_count"))


def maintenance_list(schedules: DataFrame, assets: DataFrame, rigs: DataFrame, logs: DataFrame,
                     as_of=None) -> DataFrame:
    """Schedules with labels, days until due, live status (Completed/Cancelled kept,
    In Progress classified by date) and log count, most urgent first."""
    out = E.enrich_maintenance(schedules, assets, rigs, as_of, keep=S.CLOSED)
    lc = logs_per_schedule(logs)
    out = (out.join(lc, out["id"] == lc["_k_l"], "left").drop("_k_l")
           .withColumn("log_count", F.coalesce(F.col("log_count"), _zero())))
    return out.orderBy(S.urgency_rank(as_of=as_of), F.col("next_due_date").asc_nulls_last(), "id")


def maintenance_alerts(schedules: DataFrame, assets: DataFrame, rigs: DataFrame, as_of=None) -> DataFrame:
    """Open schedules due no later than as_of + alert_days, with alert type."""
    s = schedules.where(S.is_alert(as_of=as_of))
    labels = E.asset_labels(assets, rigs, rig_map={"name": "rig_name", "rig_id": "rig_code"},
                            asset_map={"name": "asset_name", "asset_id": "asset_code"})
    out = s.join(labels, s["asset_id"] == F.col("_k_a"), "left").drop("_k_a")
    out = (out.withColumn("days_until_due", S.days_until("next_due_date", as_of))
              .withColumn("alert_type", S.alert_type(as_of=as_of)))
    return out.orderBy(F.col("next_due_date").asc_nulls_last(), "id")


def upcoming_maintenance(schedules: DataFrame, assets: DataFrame, rigs: DataFrame, as_of=None,
                         k: int = 10) -> DataFrame:
    """the k most urgent alerts (top-k: partial TakeOrdered per partition, then merge).
    Ties on the due date are broken by pm_id so the cut is deterministic."""
    # the cut is made on the schedules alone; k rows meet the labels
    order = [F.col("next_due_date").asc_nulls_last(), F.col("pm_id").asc_nulls_last()]
    first = schedules.where(S.is_alert(as_of=as_of)).orderBy(*order).limit(k)
    alerts = maintenance_alerts(first, assets, rigs, as_of)
    cols = [c for c in ("pm_id", "task_name", "priority", "next_due_date", "days_until_due",
                        "asset_name", "asset_code", "rig_name", "alert_type") if c in alerts.columns]
    return alerts.orderBy(*order).select(*cols)


def contracts_expiring(contracts: DataFrame, companies: DataFrame, rigs: DataFrame, as_of=None,
                       days: int = 30) -> DataFrame:
    """Active contracts ending in [as_of, as_of + days]."""
    c = contracts.where((F.col("status") == "Active") & S.in_window("end_date", as_of, days))
    out = E.enrich_contracts(c, companies, rigs, None, as_of, live_status=False,
                             company_map={"name": "company_name"}, rig_map={"name": "rig_name"})
    return out.orderBy(F.col("end_date").asc_nulls_last(), F.col("id").asc_nulls_last())


def contracts_lapsing(contracts: DataFrame, companies: DataFrame, rigs: DataFrame, as_of=None,
                      days: int = 30) -> DataFrame:
    """Dashboard list: Active contracts ending by as_of + days, with no lower bound
    (contracts already past their end but still Active appear)."""
    c = contracts.where((F.col("status") == "Active")
                        & (F.col("end_date") <= F.date_add(S.as_of_col(as_of), days)))
    out = E.enrich_contracts(c, companies, rigs, None, as_of, live_status=False,
                             company_map={"name": "company_name"}, rig_map={"name": "rig_name"})
    return out.select("contract_no", "end_date", "days_until_expiry", "company_name",
                      "rig_name").orderBy(F.col("end_date").asc_nulls_last(), F.col("contract_no").asc_nulls_last())


# ------------------------------------------------------------------ D12 / D13 BOM
def bom_summary(items: DataFrame) -> DataFrame:
    """One row: items, serialized, bulk, on order, total value Σ quantity × unit cost."""
    return items.agg(
        F.count("*").alias("total_items"),
        _cnt(F.col("item_type") == "Serialized").alias("serialized"),
        _cnt(F.col("item_type") == "Bulk").alias("bulk"),
        _cnt(F.col("status") == "On Order").alias("on_order"),
        F.coalesce(F.sum(F.col("quantity") * F.col("unit_cost_usd")), F.lit(0))
         .cast("decimal(38,2)").alias("total_value"))


def bom_per_asset(items: DataFrame) -> DataFrame:
    return (items.groupBy(F.col("asset_id").alias("_k_b"))
            .agg(F.count("*").alias("total_items"),
                 _cnt(F.col("item_type") == "Serialized").alias("serialized_count"),
                 _cnt(F.col("item_type") == "Bulk").alias("bulk_count"),
                 _cnt(F.col("status") == "On Order").alias("on_order_count"),
                 _cnt(F.col("status") == "Obsolete").alias("obsolete_count"),
                 F.sum(F.col("quantity") * F.col("unit_cost_usd")).alias("_val")))


def bom_summary_by_asset(assets: DataFrame, items: DataFrame, rigs: DataFrame) -> DataFrame:
    """Every asset (none dropped) with item counts by type/status and BOM value."""
    a = assets.select(F.col("id").alias("asset_uuid"), F.col("asset_id").alias("asset_code"),
                      F.col("name").alias("asset_name"), "rig_id")
    a = E.left_join_dim(a, "rig_id", E.dim(rigs, "id", {"name": "rig_name"}, "r"), "r").drop("rig_id")
    b = bom_per_asset(items)
    out = a.join(b, a["asset_uuid"] == b["_k_b"], "left")
    return out.select("asset_uuid", "asset_code", "asset_name", "rig_name",
                      *[_z(c) for c in ("total_items", "serialized_count", "bulk_count",
                                        "on_order_count", "obsolete_count")],
                      F.coalesce(F.col("_val"), F.lit(0)).cast("decimal(38,2)").alias("total_bom_value"))


# ------------------------------------------------------------------ D14 / D16 dashboard rows
def rig_kpis(rigs: DataFrame) -> DataFrame:
    st = F.col("status")
    return rigs.agg(F.count("*").alias("total"), _cnt(st == "Active").alias("active"),
                    _cnt(st == "Maintenance").alias("maintenance"), _cnt(st == "Standby").alias("standby"))


def contract_kpis(contracts: DataFrame, as_of=None) -> DataFrame:
    st = F.col("status")
    act = st == "Active"
    return contracts.agg(
        F.count("*").alias("total"), _cnt(act).alias("active"), _cnt(st == "Pending").alias("pending"),
        _cnt(st == "Expired").alias("expired"),
        F.coalesce(F.sum(F.when(act, F.col("value_usd"))), F.lit(0)).cast("decimal(38,2)").alias("active_value"),
        _cnt(act & S.in_window("end_date", as_of, 30)).alias("expiring_soon"))


def maintenance_kpis(schedules: DataFrame, as_of=None) -> DataFrame:
    a = S.as_of_col(as_of)
    return schedules.agg(
        F.count("*").alias("total"),
        _cnt(S.is_overdue(as_of=as_of)).alias("overdue"),
        _cnt(S.is_due_soon(as_of=as_of)).alias("due_soon"),
        _cnt(F.col("status") == "Completed").alias("completed"),
        _cnt((F.col("status") == "Scheduled")
             & (F.col("next_due_date") > F.date_add(a, F.col("alert_days")))).alias("scheduled"))


def transfer_kpis(transfers: DataFrame) -> DataFrame:
    st = F.col("status")
    return transfers.agg(F.count("*").alias("total"), _cnt(st == "Pending").alias("pending"),
                         _cnt(st == "Ops Approved").alias("ops_approved"),
                         _cnt(st == "Completed").alias("completed"), _cnt(st == "Rejected").alias("rejected"))


def notification_kpis(notifs: DataFrame) -> DataFrame:
    """Broadcast (user_id NULL) notices: total and unread. Per-user numbers add these."""
    b = notifs.where(F.col("user_id").isNull())
    return b.agg(F.count("*").alias("broadcast_total"), _cnt(~F.col("is_read")).alias("broadcast_unread"))


def dashboard_kpis(spark: SparkSession, assets, rigs, contracts, schedules, transfers, notifs,
                   as_of=None) -> DataFrame:
    """The six KPI blocks in one row (one aggregate per table)."""
    return one_row(spark, {
        "assets": asset_kpis(assets, with_standby=True),
        "rigs": rig_kpis(rigs),
        "contracts": contract_kpis(contracts, as_of),
        "maintenance": maintenance_kpis(schedules, as_of),
        "transfers": transfer_kpis(transfers),
        "notifications": notification_kpis(notifs),
    })


def dashboard_summary(spark: SparkSession, assets, rigs, contracts, schedules, transfers, certs,
                      work_orders, as_of=None) -> DataFrame:
    """The summary view's eighteen numbers, one filtered aggregate per table."""
    st = F.col("status")
    a = S.as_of_col(as_of)
    exp = F.col("expiry_date")
    blocks = {
        "": assets.agg(F.count("*").alias("total_assets"), _cnt(st == "Active").alias("active_assets"),
                       _cnt(st == "Maintenance").alias("maintenance_assets"),
                       _cnt(st == "Contracted").alias("contracted_assets"),
                       _money_sum("value_usd").alias("total_asset_value")),
    }
    rows = [
        rigs.agg(F.count("*").alias("total_rigs"), _cnt(st == "Active").alias("active_rigs"),
                 _cnt(st == "Maintenance").alias("maintenance_rigs")),
        contracts.agg(_cnt(st == "Active").alias("active_contracts"),
                      _cnt((st == "Active") & S.in_window("end_date", as_of, 30)).alias("expiring_contracts")),
        schedules.agg(_cnt(S.is_overdue(as_of=as_of)).alias("overdue_pm"),
                      _cnt(S.is_due_soon(as_of=as_of)).alias("due_soon_pm")),
        transfers.agg(_cnt(st == "Pending").alias("pending_transfers"),
                      _cnt(st == "Ops Approved").alias("ops_approved_transfers")),
        certs.agg(_cnt((exp < a) & (st != "Revoked")).alias("expired_certs"),
                  _cnt(S.in_window("expiry_date", as_of, 30) & (st != "Revoked")).alias("expiring_certs")),
        work_orders.agg(_cnt(st == "Open").alias("open_work_orders"),
                        _cnt(st == "In Progress").alias("active_work_orders")),
    ]
    cols = []
    for block in [blocks[""], *rows]:
        s = block.select(F.struct(*block.columns).alias("s")).scalar()
        cols += [s.getField(f).alias(f) for f in block.columns]
    return spark.range(1).select(*cols)


# ------------------------------------------------------------------ notifications per user
def notification_counts(notifs: DataFrame, users: DataFrame) -> DataFrame:
    """Per user: visible notices (own + broadcast) and unread among them.

    Own notices are aggregated per user; broadcast notices (user_id NULL) are counted once
    and added as a scalar, so broadcast rows are never copied to every user."""
    own = (notifs.where(F.col("user_id").isNotNull())
           .groupBy(F.col("user_id").alias("_k_u"))
           .agg(F.count("*").alias("_own"), _cnt(~F.col("is_read")).alias("_own_unread")))
    bc = notification_kpis(notifs)
    s = bc.select(F.struct(*bc.columns).alias("s")).scalar()
    u = users.select(F.col("id").alias("user_id"))
    out = u.join(own, u["user_id"] == own["_k_u"], "left")
    return out.select(
        "user_id",
        (F.coalesce("_own", _zero()) + s.getField("broadcast_total")).alias("visible"),
        (F.coalesce("_own_unread", _zero()) + s.getField("broadcast_unread")).alias("unread"))


# ------------------------------------------------------------------ A5 dashboard document
def dashboard_document(spark: SparkSession, assets, rigs, contracts, schedules, transfers, notifs,
                       companies, as_of=None, k: int = 10) -> DataFrame:
    """A5 re-aimed: the dashboard's nested reply as rows of one frame, one row per item:
    ``section`` (kpis / byRig / upcomingMaintenance / expiringContracts), ``item_key``,
    ``ord`` (text that sorts as the section is ordered, together with the key) and ``payload`` (the item as JSON). Sections are never
    gathered into one row, so a section of any size stays distributed; ``write.json``
    writes it from the tasks."""
    kpis = dashboard_kpis(spark, assets, rigs, contracts, schedules, transfers, notifs, as_of)
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("generated_at")
    kp = kpis.select(F.lit("kpis").alias("section"), F.lit("all").alias("item_key"),
                     F.lit("").alias("ord"),
                     F.to_json(F.struct(*kpis.columns, stamp)).alias("payload"))
    br = dashboard_by_rig(rigs, assets, schedules, as_of)
    by = br.select(F.lit("byRig").alias("section"), F.col("rig_id").alias("item_key"),
                   F.lit("").alias("ord"), F.to_json(F.struct(*br.columns)).alias("payload"))
    up = upcoming_maintenance(schedules, assets, rigs, as_of, k)
    u = up.select(F.lit("upcomingMaintenance").alias("section"), F.col("pm_id").alias("item_key"),
                  F.col("next_due_date").cast("string").alias("ord"), F.to_json(F.struct(*up.columns)).alias("payload"))
    ec = contracts_lapsing(contracts, companies, rigs, as_of)
    c = ec.select(F.lit("expiringContracts").alias("section"), F.col("contract_no").alias("item_key"),
                  F.col("end_date").cast("string").alias("ord"), F.to_json(F.struct(*ec.columns)).alias("payload"))
    return kp.unionByName(by).unionByName(u).unionByName(c)
