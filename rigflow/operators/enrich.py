"""Enrichment joins (all LEFT OUTER equi-joins on surrogate keys).

Each dimension is projected to its key plus the renamed attributes before the join, so
no name is ambiguous and the scans read only those columns. Small dimensions are
broadcast by Spark's own size check (``autoBroadcastJoinThreshold``, re-checked at run
time by AQE); large ones go through a sort-merge join. No unconditional broadcast hints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import status as S


def dim(df: DataFrame, key: str, mapping: dict[str, str], tag: str) -> DataFrame:
    """Project ``df`` to ``_k_<tag>`` (the key) plus ``{source: alias}`` for columns present."""
    cols = [F.col(key).alias(f"_k_{tag}")]
    cols += [F.col(src).alias(dst) for src, dst in mapping.items() if src in df.columns]
    return df.select(*cols)


def left_join_dim(fact: DataFrame, fk: str, d: DataFrame, tag: str) -> DataFrame:
    """``fact ⟕ d`` on ``fact.fk = d._k_<tag>``; the dimension key is dropped after."""
    k = f"_k_{tag}"
    return fact.join(d, fact[fk] == d[k], "left").drop(k)


def _drop_existing(df: DataFrame, names) -> DataFrame:
    return df.drop(*[n for n in names if n in df.columns])


# ---------------------------------------------------------------- C1 assets
# Columns taken from each joined table, and their names in the result.
ASSET_RIG_LIST = {"name": "rig_name", "rig_id": "rig_code"}
ASSET_RIG_VIEW = {"name": "rig_name", "rig_id": "rig_code", "rig_number": "rig_number",
                  "location": "rig_location", "status": "rig_status"}
ASSET_COMPANY_LIST = {"name": "company_name", "company_code": "company_code"}
ASSET_CONTRACT_LIST = {"contract_no": "contract_no"}
ASSET_CONTRACT_VIEW = {"contract_no": "contract_no", "status": "contract_status",
                       "end_date": "contract_end_date"}
ASSET_CONTRACT_DETAIL = {"contract_no": "contract_no", "start_date": "start_date",
                         "end_date": "end_date", "value_usd": "contract_value"}


def enrich_assets(assets: DataFrame, rigs: DataFrame, companies: DataFrame,
                  contracts: DataFrame, form: str = "view") -> DataFrame:
    """assets ⟕ rigs ⟕ companies ⟕ contracts. ``form``: 'view' (all asset columns plus
    rig/company/contract labels), 'list' (list columns) or 'detail' (contract dates/value)."""
    rig_map = ASSET_RIG_VIEW if form == "view" else ASSET_RIG_LIST
    con_map = {"view": ASSET_CONTRACT_VIEW, "list": ASSET_CONTRACT_LIST,
               "detail": ASSET_CONTRACT_DETAIL}[form]
    comp_map = ASSET_COMPANY_LIST if form != "detail" else {"name": "company_name"}
    out = left_join_dim(assets, "rig_id", dim(rigs, "id", rig_map, "r"), "r")
    out = left_join_dim(out, "company_id", dim(companies, "id", comp_map, "c"), "c")
    out = left_join_dim(out, "contract_id", dim(contracts, "id", con_map, "ct"), "ct")
    return out


# ---------------------------------------------------------------- C2 maintenance
def asset_labels(assets: DataFrame, rigs: DataFrame, rig_map: dict | None = None,
                 asset_map: dict | None = None) -> DataFrame:
    """One row per asset with its labels and its rig's labels (assets ⟕ rigs), keyed
    ``_k_a``. Joining this to a fact is the same as fact ⟕ assets ⟕ rigs."""
    asset_map = asset_map or {"name": "asset_name", "asset_id": "asset_code",
                              "location": "asset_location"}
    rig_map = rig_map or {"name": "rig_name", "rig_id": "rig_code", "rig_number": "rig_number"}
    a = assets.select(F.col("id").alias("_k_a"), F.col("rig_id").alias("_a_rig"),
                      *[F.col(s).alias(d) for s, d in asset_map.items() if s in assets.columns])
    a = left_join_dim(a, "_a_rig", dim(rigs, "id", rig_map, "ar"), "ar")
    return a.drop("_a_rig")


def enrich_maintenance(schedules: DataFrame, assets: DataFrame, rigs: DataFrame, as_of=None,
                       keep=S.VIEW_KEEP, with_today: bool = False) -> DataFrame:
    """schedules ⟕ assets ⟕ rigs with ``days_until_due`` and ``live_status``.
    ``keep`` = statuses reported as stored (the view keeps In Progress; the list does not)."""
    out = schedules.join(asset_labels(assets, rigs),
                         schedules["asset_id"] == F.col("_k_a"), "left").drop("_k_a")
    out = out.withColumn("days_until_due", S.days_until("next_due_date", as_of))
    out = out.withColumn("live_status", S.due_status(as_of=as_of, keep=keep))
    if with_today:
        out = out.withColumn("today", S.as_of_col(as_of))
    return out


# ---------------------------------------------------------------- C3 transfers
def enrich_transfers(transfers: DataFrame, assets: DataFrame, rigs: DataFrame,
                     companies: DataFrame, users: DataFrame) -> DataFrame:
    """transfers ⟕ assets ⟕ rigs (source) ⟕ rigs (destination) ⟕ companies ⟕ users ×3.
    Role-playing dimensions are separate projections."""
    labels = asset_labels(assets, rigs, rig_map={"name": "rig_name"},
                          asset_map={"name": "asset_name", "asset_id": "asset_code",
                                     "location": "asset_current_location"})
    out = transfers.join(labels, transfers["asset_id"] == F.col("_k_a"), "left").drop("_k_a")
    roles = [("dest_rig_id", rigs, {"name": "dest_rig_name"}, "dr"),
             ("dest_company_id", companies, {"name": "dest_company_name"}, "dc"),
             ("requested_by", users, {"full_name": "requested_by_name"}, "u"),
             ("ops_approved_by", users, {"full_name": "ops_approver_name"}, "ou"),
             ("mgr_approved_by", users, {"full_name": "mgr_approver_name"}, "mu")]
    for fk, d, m, tag in roles:
        out = left_join_dim(out, fk, dim(d, "id", m, tag), tag)
    return out


# ---------------------------------------------------------------- C4 contracts
def assets_per_contract(assets: DataFrame) -> DataFrame:
    """Pre-aggregate: linked-asset count per contract (partial aggregation map-side)."""
    return (assets.where(F.col("contract_id").isNotNull())
            .groupBy(F.col("contract_id").alias("_k_n"))
            .agg(F.count("*").alias("asset_count")))


def enrich_contracts(contracts: DataFrame, companies: DataFrame, rigs: DataFrame,
                     assets: DataFrame | None = None, as_of=None, live_status: bool = True,
                     company_map: dict | None = None, rig_map: dict | None = None) -> DataFrame:
    """contracts ⟕ companies ⟕ rigs (+ asset count, days until expiry, live status).
    The asset count is aggregated per contract first and then joined: the same numbers
    as grouping the fan-out, without multiplying contract rows."""
    company_map = company_map or {"name": "company_name", "contact_email": "company_email"}
    rig_map = rig_map or {"name": "rig_name", "rig_id": "rig_code", "rig_number": "rig_number"}
    out = left_join_dim(contracts, "company_id", dim(companies, "id", company_map, "c"), "c")
    out = left_join_dim(out, "rig_id", dim(rigs, "id", rig_map, "r"), "r")
    out = out.withColumn("days_until_expiry", S.days_until("end_date", as_of))
    if live_status:
        out = out.withColumn("live_status", S.contract_status(as_of=as_of))
    if assets is not None:
        n = assets_per_contract(assets)
        out = (out.join(n, out["id"] == n["_k_n"], "left").drop("_k_n")
               .withColumn("asset_count", F.coalesce("asset_count", F.lit(0).cast("bigint"))))
    return out


# ---------------------------------------------------------------- C5 BOM parent
def bom_with_parent(items: DataFrame) -> DataFrame:
    """Each item with its parent's name (self join on parent_id)."""
    p = items.select(F.col("id").alias("_k_p"), F.col("name").alias("parent_name"))
    return items.join(p, items["parent_id"] == p["_k_p"], "left").drop("_k_p")


def line_cost(items: DataFrame) -> DataFrame:
    return items.withColumn("total_cost", F.col("quantity") * F.col("unit_cost_usd"))


# ---------------------------------------------------------------- C6 certificates
def enrich_certificates(certs: DataFrame, assets: DataFrame, rigs: DataFrame, as_of=None) -> DataFrame:
    """certificates ⟕ assets ⟕ rigs (the certificate's own rig) with live status."""
    out = certs.withColumn("days_until_expiry", S.days_until("expiry_date", as_of))
    out = out.withColumn("live_status", S.certificate_status(as_of=as_of))
    out = left_join_dim(out, "asset_id",
                        dim(assets, "id", {"name": "asset_name", "asset_id": "asset_code"}, "a"), "a")
    out = left_join_dim(out, "rig_id", dim(rigs, "id", {"name": "rig_name"}, "rg"), "rg")
    return out


# ---------------------------------------------------------------- C7 / C8 / C14
def history_with_author(history: DataFrame, users: DataFrame) -> DataFrame:
    return left_join_dim(history, "changed_by",
                         dim(users, "id", {"full_name": "changed_by_name"}, "u"), "u")


def notifications_with_entity(notifs: DataFrame, assets: DataFrame) -> DataFrame:
    """notifications ⟕ assets ON entity_id = asset AND entity_type = 'asset' (rows of other
    entity types are kept with a NULL code)."""
    a = assets.select(F.col("id").alias("_k_ea"), F.col("asset_id").alias("entity_code"))
    cond = (notifs["entity_id"] == a["_k_ea"]) & (notifs["entity_type"] == F.lit("asset"))
    return notifs.join(a, cond, "left").drop("_k_ea")


def rig_detail(rigs: DataFrame, companies: DataFrame) -> DataFrame:
    return left_join_dim(rigs, "company_id", dim(companies, "id", {"name": "company_name"}, "c"), "c")


def bom_labels(items: DataFrame, assets: DataFrame, rigs: DataFrame) -> DataFrame:
    """BOM items with asset name/code and the asset's rig name."""
    labels = asset_labels(assets, rigs, rig_map={"name": "rig_name"},
                          asset_map={"name": "asset_name", "asset_id": "asset_code"})
    return items.join(labels, items["asset_id"] == F.col("_k_a"), "left").drop("_k_a")


# ---------------------------------------------------------------- C12 schedule + logs
def schedule_logs(schedules: DataFrame, logs: DataFrame, assets: DataFrame, rigs: DataFrame,
                  as_of=None) -> DataFrame:
    """Each schedule (with labels) and its log rows, newest completion first.

    Flat rows ordered by (schedule, completion_date DESC) instead of one array per schedule,
    so no schedule's logs are ever gathered into one row; the ordering is a range-partitioned
    sort that splits a hot schedule across tasks.
    """
    sched = schedules.join(asset_labels(assets, rigs, rig_map={"name": "rig_name"},
                                        asset_map={"name": "asset_name", "asset_id": "asset_code"}),
                           schedules["asset_id"] == F.col("_k_a"), "left").drop("_k_a")
    sched = sched.withColumn("days_until_due", S.days_until("next_due_date", as_of))
    lg = logs.select(*[F.col(c).alias(f"log_{c}") if c != "schedule_id" else F.col(c).alias("_k_s")
                       for c in logs.columns])
    out = sched.join(lg, sched["id"] == lg["_k_s"], "left").drop("_k_s")
    return out
