"""Data quality: field validation of command batches, permissions, unique keys, orphan
references and value rules. Every check is a column expression or a join; a batch is
split into accepted rows and rejected rows with an array of reasons, in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.status import null_if_empty
from ..functions.validators import (EMAIL_PATTERN, is_date, is_email, is_float, is_in,  # noqa: F401
                                    is_int, min_length, required)
from ..session import materialize, small_tasks
from ..sources.schemas import ENUMS, FOREIGN_KEYS, ROW_RULES
from . import changes as C

# The role × action permission matrix of the source system.
PERMISSIONS = {
    "read": ("Admin", "Asset Manager", "Operations Manager", "Editor", "Viewer"),
    "create": ("Admin", "Asset Manager", "Operations Manager", "Editor"),
    "update": ("Admin", "Asset Manager", "Operations Manager", "Editor"),
    "delete": ("Admin", "Asset Manager"),
    "approve_ops": ("Admin", "Operations Manager"),
    "approve_mgr": ("Admin", "Asset Manager"),
    "cancel_transfer": ("Admin", "Asset Manager", "Operations Manager", "Editor"),
    "manage_users": ("Admin",),
    "list_users": ("Admin", "Asset Manager"),
}

# Request-body rules per command kind (fixed values of the source's validators).
COMMAND_RULES = {
    "asset_create": {"asset_id": lambda: required("asset_id"), "name": lambda: required("name"),
                     "category": lambda: is_in("category", ENUMS[("assets", "category")])},
    "schedule_create": {"pm_id": lambda: required("pm_id"), "asset_key": lambda: required("asset_key"),
                        "task_name": lambda: required("task_name"), "task_type": lambda: required("task_type"),
                        "next_due_date": lambda: is_date("next_due_date"),
                        "frequency_days": lambda: is_int("frequency_days", 1)},
    "transfer_create": {"transfer_id": lambda: required("transfer_id"), "asset_key": lambda: required("asset_key"),
                        "destination": lambda: required("destination"), "reason": lambda: required("reason"),
                        "priority": lambda: is_in("priority", ("Critical", "High", "Normal", "Low"))},
    "bom_create": {"bom_id": lambda: required("bom_id"), "asset_key": lambda: required("asset_key"),
                   "name": lambda: required("name"), "item_type": lambda: is_in("item_type", ("Serialized", "Bulk")),
                   "quantity": lambda: is_float("quantity", 0)},
    "contract_create": {"contract_no": lambda: required("contract_no"), "start_date": lambda: is_date("start_date"),
                        "end_date": lambda: is_date("end_date")},
    "company_create": {"company_code": lambda: required("company_code"), "name": lambda: required("name"),
                       "type": lambda: is_in("type", ENUMS[("companies", "type")])},
    "user_create": {"full_name": lambda: required("full_name"), "email": lambda: is_email("email"),
                    "password": lambda: min_length("password", 8),
                    "role": lambda: is_in("role", ENUMS[("users", "role")])},
}


def _reasons(named: list[tuple[str, Column]]) -> Column:
    """Array of the names whose check is false (NULL counts as false)."""
    return F.filter(F.array(*[F.when(~F.coalesce(chk, F.lit(False)), F.lit(n)) for n, chk in named]),
                    lambda x: x.isNotNull())


def tag_commands(batch: DataFrame, kind: str, action: str = "create", role_col: str = "role") -> DataFrame:
    """Add ``reasons``: the failed checks of each command, role first (the source's
    middleware runs before the body checks), then the body rules in order."""
    no = F.lit(False)       # a field or role that the batch does not carry is a failed rule
    checks = [("role", F.col(role_col).isin(*PERMISSIONS[action]) if role_col in batch.columns else no)]
    checks += [(name, fn() if name in batch.columns else no) for name, fn in COMMAND_RULES[kind].items()]
    return batch.withColumn("reasons", _reasons(checks))


def validate_commands(batch: DataFrame, kind: str, action: str = "create",
                      role_col: str = "role") -> dict[str, DataFrame]:
    """Split a command batch into accepted and rejected (with ``reasons``)."""
    tagged = tag_commands(batch, kind, action, role_col)
    return {"accepted": tagged.where(F.size("reasons") == 0).drop("reasons"),
            "rejected": tagged.where(F.size("reasons") > 0)}


def validate_user_updates(batch: DataFrame, actor: str = "actor_id", role: str = "actor_role", target: str = "user_id",
                          protected: tuple[str, ...] = ("role", "status")) -> dict[str, DataFrame]:
    """J9, own-row rule: an account is changed by an Admin or by its owner (``me`` names the
    asking user); anyone else is refused. Only an Admin's change keeps the protected columns:
    for others they are emptied, which a patch takes as "keep". Returns ``{"accepted",
    "rejected"}``, the rejected rows with ``reasons``."""
    asked = F.col(target).cast("string")
    named = batch.withColumn(target, F.when(asked == "me", F.col(actor).cast("string")).otherwise(asked))
    admin = F.coalesce(F.col(role) == "Admin", F.lit(False))
    own = F.coalesce(F.col(target) == F.col(actor).cast("string"), F.lit(False))
    kept = {c: F.when(admin, F.col(c)) for c in protected if c in batch.columns}
    return {"accepted": named.where(admin | own).withColumns(kept),
            "rejected": named.where(~(admin | own)).withColumn("reasons", F.array(F.lit("access_denied")))}


def unique_violations(base: DataFrame, batch: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Batch rows whose key repeats inside the batch (all but the first by ``order``)
    or already exists in ``base``. Columns: batch columns + ``reason``."""
    first = batch.groupBy(F.col(key).alias("_k")).agg(F.min(order).alias("_first"))
    b = batch.join(first, batch[key] == first["_k"], "left")
    dup = F.col(order) != F.col("_first")
    existing = base.select(F.col(key).alias("_e")).dropDuplicates()
    b = b.join(existing, b[key] == existing["_e"], "left")
    reason = F.when(F.col("_e").isNotNull(), "exists").when(dup, "duplicate_in_batch")
    return b.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_k", "_first", "_e")


def create_rigs(rigs: DataFrame, batch: DataFrame, role_col: str = "role") -> dict[str, DataFrame]:
    """A6 for rigs: a writing role; empty optional fields become NULL and an empty status
    ``Active``; code and name given; the table's value rules; code and name not yet taken, in
    ``seq`` order. ``{"accepted", "rejected"}``, the rejected rows with the first ``reason``."""
    optional = [c for c in ("company_id", "location", "horsepower", "notes") if c in batch.columns]
    b = batch.withColumns({c: null_if_empty(c) for c in optional})
    b = C.with_defaults(b.withColumn("status", null_if_empty("status")), {"status": "Active"})
    absent = {c: F.lit(None).cast("int") for c in ("depth_capacity_ft", "horsepower", "mast_height_ft", "max_hook_load_ton") if c not in b.columns}
    broken = [F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in table_rules("rigs", [*b.columns, *absent])]
    role_ok = F.coalesce(F.col(role_col).isin(*PERMISSIONS["create"]), F.lit(False))
    reason = F.coalesce(F.when(~role_ok, "role"), F.when(F.col("rig_id").isNull() | F.col("name").isNull(), "missing_fields"), *broken)
    judged = b.withColumns(absent).withColumn("reason", reason).drop(*absent)
    new = C.insert_unique(rigs, judged.where("reason IS NULL").drop("reason"), ["rig_id", "name"])
    return {"accepted": new["accepted"], "rejected": judged.where("reason IS NOT NULL").unionByName(new["rejected"])}


def orphans(child: DataFrame, fk: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose non-NULL ``fk`` matches no parent row (anti join)."""
    p = parent.select(F.col(parent_key).alias("_pk"))
    return child.where(F.col(fk).isNotNull()).join(p, F.col(fk) == p["_pk"], "left_anti")


def orphan_report(tables: dict[str, DataFrame], fks=FOREIGN_KEYS) -> DataFrame:
    """Every dangling reference across the given tables: (child_table, fk, parent_table,
    child_id, missing_key). References are grouped by parent table: the union of all
    references to one parent meets that parent's keys in a single anti join. A reference of a
    given table whose column or parent table is not there raises."""
    by_parent: dict[str, list[DataFrame]] = {}
    names = []
    for child, fk, parent, _ in fks:
        if child in tables:
            if parent not in tables or fk not in tables[child].columns:
                raise ValueError(f"{child}.{fk} -> {parent}: no such column or table given")
            # (a number stands for the three names until the join is done: narrow rows)
            refs = tables[child].where(F.col(fk).isNotNull()).select(
                F.lit(len(names)).alias("_n"), F.col("id").cast("string").alias("child_id"), F.col(fk).alias("_ref"))
            names.append((child, fk, parent))
            by_parent.setdefault(parent, []).append(refs)
    named = [F.element_at(F.array(*[F.lit(x[i]) for x in names]), F.col("_n") + 1).alias(c) for i, c in enumerate(("child_table", "fk", "parent_table"))]
    parts = []
    for parent, refs in by_parent.items():
        r = reduce(lambda a, b: a.unionByName(b), refs)
        keys = tables[parent].select(F.col("id").alias("_pk"))
        dangling = r.join(keys, r["_ref"] == keys["_pk"], "left_anti")
        with small_tasks(r.sparkSession, r.count()):
            dangling, _ = materialize(dangling, "orphans")
        parts.append(dangling.select(*named, "child_id", F.col("_ref").cast("string").alias("missing_key")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def table_rules(table: str, columns: list[str]) -> list[tuple[str, Column]]:
    """The value rules of ``table``: enumerations and row rules; a rule whose column is
    missing raises. A rule fails only when it is false (NULL passes, as a CHECK constraint
    does)."""
    rules = []
    for (t, c), values in ENUMS.items():
        if t == table:
            if c not in columns:
                raise ValueError(f"{table} has no column {c}, which the rule {c}_allowed reads")
            rules.append((f"{c}_allowed", F.col(c).isin(*values)))
    for name, expr in ROW_RULES.get(table, {}).items():
        refs = [w for w in expr.replace("(", " ").replace(")", " ").split() if w.isidentifier()]
        needed = [w for w in refs if w.islower() and w not in ("and", "or", "not", "is", "null", "between")]
        missing = [w for w in needed if w not in columns]
        if missing:
            raise ValueError(f"{table} has no column {missing[0]}, which the rule {name} reads")
        rules.append((name, F.expr(expr)))
    return rules


def check_violations(df: DataFrame, table: str) -> DataFrame:
    """Rows breaking any value rule of ``table``, with the names of the broken rules."""
    rules = table_rules(table, df.columns)
    failed = F.filter(F.array(*[F.when(~F.coalesce(r, F.lit(True)), F.lit(n)) for n, r in rules]),
                      lambda x: x.isNotNull())
    return df.withColumn("violations", failed).where(F.size("violations") > 0)
