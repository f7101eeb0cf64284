"""Change application: single-row writes re-aimed as batch jobs (base + commands → new base).

A total order of commands (``seq``) is always an explicit input. Multiple commands on one
key are folded with grouped aggregates (``max(struct(seq, value))``), which aggregate
partially map-side, so a hot key never gathers its commands in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import status as S
from ..session import materialize
from ..sources.schemas import FOREIGN_KEYS
from . import digests as D
from . import filters as B

# Roles allowed to write (any create/update), and to delete.
WRITE_ROLES = ("Admin", "Asset Manager", "Operations Manager", "Editor")
DELETE_ROLES = ("Admin", "Asset Manager")


# ------------------------------------------------------------------ A2 / A3 / A4
def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill column defaults on insert: missing columns are added, NULLs replaced."""
    out = df
    for c, v in defaults.items():
        val = v if isinstance(v, Column) else F.lit(v)
        out = out.withColumn(c, F.coalesce(F.col(c), val) if c in out.columns else val)
    return out


def insert_ignore(base: DataFrame, batch: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """INSERT … ON CONFLICT (key) DO NOTHING: the first row per key in the batch (by
    ``order``) is inserted unless the key already exists. Idempotent on rerun, but for rows with
    a NULL key: a unique key lets them all in, each time.

    First-per-key is ``min(struct(order, row))`` per key: a grouped aggregate, no window."""
    cols = [c for c in batch.columns if c not in (key, order)]
    unkeyed = batch.where(F.col(key).isNull()).select(key, *cols)
    first = (batch.where(F.col(key).isNotNull()).groupBy(key)
             .agg(F.min(F.struct(F.col(order), *[F.col(c) for c in cols])).alias("_f"))
             .select(key, *[F.col(f"_f.{c}").alias(c) for c in cols]))
    new = first.join(base.select(F.col(key).alias("_bk")), F.col(key) == F.col("_bk"), "left_anti")
    return base.unionByName(new.unionByName(unkeyed), allowMissingColumns=True)


def insert_unique(base: DataFrame, batch: DataFrame, keys: list[str], order: str = "seq") -> dict[str, DataFrame]:
    """INSERT under several unique keys, command by command in ``order`` (unique): a command is
    refused when one of its keys is in ``base`` (``exists``) or on a command accepted before it
    (``duplicate``). A refused command takes no key, so a later one may still use them. NULL
    keys never meet. Returns ``{"accepted", "rejected"}``, the rejected rows with ``reason``.

    Each round accepts every command that is the first of all its keys, and refuses those that
    share a key with one; rounds end when none is left (most batches take two: a further round
    needs a command freed by the refusal of another)."""
    stored = batch
    for i, k in enumerate(keys):
        taken = base.where(F.col(k).isNotNull()).select(F.col(k).alias(f"_b{i}")).distinct()
        stored = stored.join(taken, F.col(k) == F.col(f"_b{i}"), "left")
    exists = reduce(lambda a, b: a | b, [F.col(f"_b{i}").isNotNull() for i in range(len(keys))])
    stored = stored.withColumn("reason", F.when(exists, "exists")).select(*batch.columns, "reason")
    stored, _ = materialize(stored, "commands")
    done, left = [stored.where("reason IS NOT NULL")], stored.where("reason IS NULL")
    while True:
        left, n = materialize(left, "commands")
        if n == 0:
            break
        named, first = left, F.lit(True)
        for i, k in enumerate(keys):
            least = left.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(f"_k{i}")).agg(F.min(order).alias(f"_m{i}"))
            named = named.join(least, F.col(k) == F.col(f"_k{i}"), "left")
            first = first & F.coalesce(F.col(order) == F.col(f"_m{i}"), F.lit(True))
        named, _ = materialize(named.select(*left.columns, first.alias("_ok")), "commands")
        taken, rest = named.where("_ok").drop("_ok"), named.where("NOT _ok").drop("_ok")
        for i, k in enumerate(keys):
            used = taken.where(F.col(k).isNotNull()).select(F.col(k).alias(f"_u{i}"))      # (each key once: its first command)
            rest = rest.join(used, F.col(k) == F.col(f"_u{i}"), "left")
        hit = reduce(lambda a, b: a | b, [F.col(f"_u{i}").isNotNull() for i in range(len(keys))])
        rest = rest.withColumn("reason", F.when(hit, "duplicate")).select(*left.columns)
        done += [taken, rest.where("reason IS NOT NULL")]
        left = rest.where("reason IS NULL")
    out = reduce(lambda a, b: a.unionByName(b), done)
    return {"accepted": out.where("reason IS NULL").drop("reason"), "rejected": out.where("reason IS NOT NULL")}


def append_rows(base: DataFrame, batch: DataFrame) -> DataFrame:
    """INSERT without a conflict key: every row is appended (again on a rerun)."""
    return base.unionByName(batch, allowMissingColumns=True)


# ------------------------------------------------------------------ J1 / J2 / J3
def touched_at(df: DataFrame, hit: Column, now: Column | None) -> Column:
    """The ``updated_at`` column of a job's result: ``now`` on the rows it updated, else what it was."""
    before = F.col("updated_at") if "updated_at" in df.columns else F.lit(None)
    return F.when(hit, now).otherwise(before).alias("updated_at")


def resolve_keys(commands: DataFrame, base: DataFrame, key_cols: list[str], key: str = "key") -> DataFrame:
    """Attach ``_id`` (the base row id) to each command whose ``key`` matches any of
    ``key_cols``; unmatched commands get NULL."""
    lk = B.lookup(base.select(*key_cols), commands.select(key), key_cols, key=key)
    lk = lk.select(F.col(key).alias("_rk"), F.col(key_cols[0]).alias("_id"))
    return commands.join(lk, commands[key] == lk["_rk"], "left").drop("_rk")


def fold_patches(patches: DataFrame, id_col: str, cols: list[str], order: str = "seq") -> DataFrame:
    """Per target id, the latest non-NULL value of each column (NULL means keep)."""
    aggs = [F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("v"))))
             .getField("v").alias(c) for c in cols]
    return patches.groupBy(id_col).agg(*aggs, F.count("*").alias("_n"))


def patch_update(base: DataFrame, patches: DataFrame, cols: list[str], key_cols: list[str] | None = None,
                 role_col: str | None = "role", now: Column | None = None) -> dict[str, DataFrame]:
    """COALESCE partial update of ``base`` by a batch of ``patches``.

    ``patches``: seq, key (matches any of ``key_cols``), the role column (a NULL role may
    not write; pass ``role_col=None`` where no role applies), and nullable columns ``cols``. Returns ``{"table": new base, "rejected": commands with reason,
    "touched": ids updated}``. Every matched id gets ``updated_at = now`` even when no value
    changes (as the source's trigger does). A NULL in a patch keeps the old value.
    """
    key_cols = key_cols or ["id"]
    p = resolve_keys(patches, base, key_cols)
    role_ok = F.coalesce(F.col(role_col).isin(*WRITE_ROLES), F.lit(False)) if role_col else F.lit(True)
    p = p.withColumn("reason", F.when(~role_ok, "role").when(F.col("_id").isNull(), "not_found"))
    ok = p.where(F.col("reason").isNull())
    folded = fold_patches(ok, "_id", cols)
    upd = folded.select(F.col("_id").alias("_pid"), *[F.col(c).alias(f"_p_{c}") for c in cols])
    j = base.join(upd, base["id"] == upd["_pid"], "left")
    matched = F.col("_pid").isNotNull()
    out_cols = []
    for c in base.columns:
        if c in cols:
            out_cols.append(F.coalesce(F.col(f"_p_{c}"), F.col(c)).alias(c))
        elif c == "updated_at":
            out_cols.append(F.when(matched, now if now is not None else F.current_timestamp())
                            .otherwise(F.col(c)).alias(c))
        else:
            out_cols.append(F.col(c))
    table = j.select(*out_cols)
    if "updated_at" not in base.columns and now is not None:
        table = j.select(*out_cols, F.when(matched, now).alias("updated_at"))
    rejected = p.where(F.col("reason").isNotNull()).drop("_id")
    touched = folded.select(F.col("_id").alias("id"), F.col("_n").alias("patch_count"))
    return {"table": table, "rejected": rejected, "touched": touched}


# ------------------------------------------------------------------ J4
def check_delete_role(requests: DataFrame, role_col: str = "role") -> dict[str, DataFrame]:
    """Delete requests split by the role that asks: only DELETE_ROLES may (NULL may not)."""
    ok = F.coalesce(F.col(role_col).isin(*DELETE_ROLES), F.lit(False))
    return {"accepted": requests.where(ok), "rejected": requests.where(~ok).withColumn("reason", F.lit("role"))}


def delete_keys(base: DataFrame, keys: DataFrame, col: str = "id", key: str = "id") -> DataFrame:
    return B.member_of(base, keys, col, key, keep=False)


def delete_cascade(tables: dict[str, DataFrame], table: str, keys: DataFrame, key: str = "id",
                   fks=FOREIGN_KEYS, complete: bool = True, now: Column | None = None) -> dict[str, DataFrame]:
    """Delete ``keys`` from ``table`` and apply the foreign-key effects to the other
    tables: CASCADE removes child rows (and, recursively, their children), SET NULL
    clears the reference. Walks the FK graph (tables, not rows) breadth first; a
    self-reference (BOM parent) removes whole subtrees.

    Every table that refers to a deleted row must be given; ``complete=False`` says that
    those not given have no such rows. Children without an id of their own (they have no
    children) are deleted by their foreign key. With ``now``, rows whose reference is cleared
    move their ``updated_at``.

    Returns the new frames of every table touched; deleted-key frames are semi-joins, so
    nothing is collected.
    """
    from . import hierarchy as H
    out = dict(tables)
    deleted: dict[str, DataFrame] = {table: keys.select(F.col(key).alias("id")).dropDuplicates()}
    queue = [table]
    while queue:
        parent = queue.pop(0)
        dk = deleted[parent]
        for child, fk, ptable, action in fks:
            if ptable != parent:
                continue
            if child not in out:
                if complete:
                    raise ValueError(f"{child} refers to {parent} and is not given")
                continue
            if fk not in out[child].columns:      # a frame without the column holds no such reference
                continue
            cdf = out[child]
            if action == "CASCADE":
                if "id" not in cdf.columns:
                    out[child] = delete_keys(cdf, dk, fk)
                    continue
                if child == parent:  # self reference: everything below the deleted rows
                    gone = H.reachable(cdf, dk)
                else:
                    gone = B.member_of(cdf, dk, fk, "id").select("id")
                prev = deleted.get(child)
                deleted[child] = gone if prev is None else prev.unionByName(gone).dropDuplicates()
                if child != parent:
                    queue.append(child)
            else:
                k = dk.select(F.col("id").alias("_dk"))
                j = cdf.join(k, cdf[fk] == k["_dk"], "left")
                hit = F.col("_dk").isNotNull()
                if now is not None:
                    j = j.withColumn("updated_at", touched_at(cdf, hit, now))
                out[child] = j.withColumn(fk, F.when(hit, F.lit(None)).otherwise(F.col(fk))).drop("_dk")
    for t, dk in deleted.items():
        if t in out:
            out[t] = delete_keys(out[t], dk)
    return out


# ------------------------------------------------------------------ J5
def capture_changes(old: DataFrame, new: DataFrame, key: str = "id", touched: DataFrame | None = None,
                    only_changed: bool = False, changed_by: Column | None = None,
                    now: Column | None = None) -> DataFrame:
    """History rows between two versions of a table: Created (only new), Deleted (only
    old) and Updated (in both; only where a value differs with ``only_changed``). With
    ``touched`` (the keys that commands named) only those keys are looked at. Old and new
    rows are written as JSON text."""
    if touched is not None:
        # only the touched rows of either version are turned into JSON and meet
        t = touched.select(F.col(key).alias("_t")).dropDuplicates()
        old = old.join(t, old[key] == t["_t"], "left_semi")
        new = new.join(t, new[key] == t["_t"], "left_semi")
    o = old.select(F.col(key).alias("_k"), F.to_json(F.struct(*old.columns)).alias("old_values"))
    n = new.select(F.col(key).alias("_k2"), F.to_json(F.struct(*new.columns)).alias("new_values"))
    j = o.join(n, o["_k"] == n["_k2"], "full_outer")
    k = F.coalesce("_k", "_k2")
    action = (F.when(F.col("_k").isNull(), "Created").when(F.col("_k2").isNull(), "Deleted")
               .otherwise("Updated"))
    rows = j.select(k.alias("asset_id"), action.alias("action"), "old_values", "new_values")
    if only_changed:
        rows = rows.where((F.col("action") != "Updated") | (F.col("old_values") != F.col("new_values")))
    rows = rows.withColumn("changed_by", changed_by if changed_by is not None else F.lit(None))
    return rows.withColumn("created_at", now if now is not None else F.current_timestamp())


def audit_changes(old: DataFrame, new: DataFrame, table_name: str, key: str = "id") -> DataFrame:
    """Audit-log shape of ``capture_changes``: INSERT / UPDATE / DELETE with old/new data,
    only where something differs. Digests tell which buckets of rows differ; only their rows
    are written as JSON and meet."""
    ch = capture_changes(*D.differing_rows(old, new, key), key, only_changed=True)
    return ch.select(F.lit(table_name).alias("table_name"), F.col("asset_id").alias("record_id"),
                     F.when(F.col("action") == "Created", "INSERT")
                      .when(F.col("action") == "Deleted", "DELETE").otherwise("UPDATE").alias("action"),
                     F.col("old_values").alias("old_data"), F.col("new_values").alias("new_data"))


# ------------------------------------------------------------------ J6
def complete_maintenance(schedules: DataFrame, completions: DataFrame,
                         key_cols: list[str] | None = None, role_col: str | None = None,
                         now: Column | None = None) -> dict[str, DataFrame]:
    """Apply maintenance completions.

    With ``role_col``, a completion needs a writing role (NULL is none) and is rejected first.

    Each valid completion (schedule found, completion_date and completed_by given) adds a
    log row whose next_due_date is the given one or completion_date + frequency_days. The
    schedule takes the last completion by ``seq``: last_done_date, next_due_date, and status
    back to Scheduled. Returns ``{"schedules", "logs", "rejected"}``.
    """
    key_cols = key_cols or ["id", "pm_id"]
    c = resolve_keys(completions.withColumnRenamed("schedule_key", "key"), schedules, key_cols)
    c = c.withColumn("reason", F.when(F.col("_id").isNull(), "not_found")
                     .when(F.col("completion_date").isNull() | F.col("completed_by").isNull()
                           | (F.col("completed_by") == ""), "missing_fields"))
    if role_col:
        c = c.withColumn("reason", F.when(~F.coalesce(F.col(role_col).isin(*WRITE_ROLES), F.lit(False)), "role")
                         .otherwise(F.col("reason")))
    ok = c.where(F.col("reason").isNull())
    freq = schedules.select(F.col("id").alias("_sid"), F.col("frequency_days").alias("_freq"))
    ok = ok.join(freq, ok["_id"] == freq["_sid"], "inner").drop("_sid")
    ok = ok.withColumn("next_due_date",
                       F.coalesce(F.col("next_due_date"), F.date_add("completion_date", F.col("_freq"))))
    log_cols = [x for x in ("completion_date", "completed_by", "actual_hours", "actual_cost",
                            "parts_used", "work_notes", "next_due_date") if x in ok.columns]
    logs = ok.select("seq", F.col("_id").alias("schedule_id"), *log_cols)
    last = (ok.groupBy("_id")
            .agg(F.max(F.struct("seq", "completion_date", "next_due_date")).alias("_l"))
            .select(F.col("_id").alias("_lid"), F.col("_l.completion_date").alias("_done"),
                    F.col("_l.next_due_date").alias("_due")))
    j = schedules.join(last, schedules["id"] == last["_lid"], "left")
    hit = F.col("_lid").isNotNull()
    cols = []
    for col in schedules.columns:
        if col == "next_due_date":
            cols.append(F.when(hit, F.col("_due")).otherwise(F.col(col)).alias(col))
        elif col == "status":
            cols.append(F.when(hit, F.lit("Scheduled")).otherwise(F.col(col)).alias(col))
        elif col == "last_done_date":
            cols.append(F.when(hit, F.col("_done")).otherwise(F.col(col)).alias(col))
        else:
            cols.append(F.col(col))
    if "last_done_date" not in schedules.columns:
        cols.append(F.when(hit, F.col("_done")).alias("last_done_date"))
    new_sched = j.select(*cols) if now is None else j.select(
        *[c for c, n in zip(cols, [*schedules.columns, "last_done_date"]) if n != "updated_at"], touched_at(schedules, hit, now))
    rejected = c.where(F.col("reason").isNotNull()).select("seq", "key", "reason")
    return {"schedules": new_sched, "logs": logs, "rejected": rejected}


# ------------------------------------------------------------------ J13
def refresh_certificate_status(certs: DataFrame, as_of=None, now: Column | None = None) -> DataFrame:
    """Trigger form: status from expiry (Expired / Expiring within 30 days / Valid),
    untouched when expiry is NULL or the certificate is Revoked."""
    new = S.certificate_refresh_status(as_of=as_of)
    if now is not None:
        certs = certs.withColumn("updated_at", touched_at(certs, ~new.eqNullSafe(F.col("status")), now))
    return certs.withColumn("status", new)


# ------------------------------------------------------------------ J14
def mark_read_all(notifs: DataFrame, requesters: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Read-all for a batch of users: their own notices and every broadcast notice (a
    broadcast row is shared, so one user's read-all marks it read for everyone)."""
    r = requesters.select(F.col(user_col).alias("_u")).dropDuplicates()
    any_req = r.exists()
    j = notifs.join(r, notifs["user_id"] == r["_u"], "left")
    hit = F.col("_u").isNotNull() | (F.col("user_id").isNull() & any_req)
    return j.withColumn("is_read", F.when(hit, F.lit(True)).otherwise(F.col("is_read"))).drop("_u")


def mark_read(notifs: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Mark given notices read (by notice id, no owner check, as the source does)."""
    k = ids.select(F.col(id_col).alias("_n")).dropDuplicates()
    j = notifs.join(k, notifs["id"] == k["_n"], "left")
    return j.withColumn("is_read", F.when(F.col("_n").isNotNull(), F.lit(True))
                        .otherwise(F.col("is_read"))).drop("_n")


def clear_read(notifs: DataFrame, requesters: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Delete read notices of the requesting users, broadcast ones included."""
    r = requesters.select(F.col(user_col).alias("_u")).dropDuplicates()
    own_read = notifs.join(r, notifs["user_id"] == r["_u"], "left_semi").where(F.col("is_read"))
    gone = own_read.select("id").unionByName(
        notifs.where(F.col("user_id").isNull() & F.col("is_read") & r.exists()).select("id"))
    return notifs.join(gone.select(F.col("id").alias("_g")), notifs["id"] == F.col("_g"), "left_anti")


def delete_notifications(notifs: DataFrame, requests: DataFrame) -> DataFrame:
    """Delete notice ``id`` for user ``user_id`` when it is theirs or a broadcast."""
    r = requests.select(F.col("id").alias("_n"), F.col("user_id").alias("_u"))
    j = notifs.join(r, notifs["id"] == r["_n"], "inner")
    gone = j.where(F.col("user_id").isNull() | (F.col("user_id") == F.col("_u"))).select("id").dropDuplicates()
    return notifs.join(gone.select(F.col("id").alias("_g")), notifs["id"] == F.col("_g"), "left_anti")


# ------------------------------------------------------------------ J15
def touch_last_login(users: DataFrame, logins: DataFrame, user_col: str = "user_id",
                     ts_col: str = "ts", now: Column | None = None) -> DataFrame:
    """last_login := latest login per user (kept when newer than the stored one)."""
    last = logins.groupBy(F.col(user_col).alias("_u")).agg(F.max(ts_col).alias("_ts"))
    j = users.join(last, users["id"] == last["_u"], "left")
    cur = F.col("last_login") if "last_login" in users.columns else F.lit(None).cast("timestamp_ntz")
    new = F.greatest(cur, F.col("_ts"))
    out = j.withColumn("last_login", new) if "last_login" in users.columns else j.withColumn("last_login", F.col("_ts"))
    if now is not None:
        out = out.withColumn("updated_at", touched_at(users, F.col("_ts").isNotNull(), now))
    return out.drop("_u", "_ts")
