"""Filters and lookups (optional equality filters, search, key-or-code lookup, visibility).

All are plain ``where`` / equi-join plans, so Catalyst pushes the predicates into the
Parquet scan where the column comes straight from a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import status as S


def filter_by(df: DataFrame, **kv) -> DataFrame:
    """AND of ``col == value`` for every non-empty value (an empty value means no filter)."""
    conds = [F.col(k) == v for k, v in kv.items() if v not in (None, "")]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def search(df: DataFrame, term: str | None, cols: list[str]) -> DataFrame:
    """Case-insensitive substring match ORed over ``cols`` (LIKE without escaping: ``%``
    and ``_`` in the term are wildcards, as in the source). A missing column raises."""
    if not term:
        return df
    pattern = f"%{term.lower()}%"
    conds = [F.lower(df[c]).like(pattern) for c in cols]
    return df.where(reduce(lambda a, b: a | b, conds))


def lookup(df: DataFrame, keys: DataFrame, key_cols: list[str], key: str = "key") -> DataFrame:
    """Rows of ``df`` whose any of ``key_cols`` equals a requested key.

    One equi-join per key column (an OR join would be a nested loop), then the matches are
    unioned and de-duplicated on (key, row id). ``keys`` has a string column ``key``.
    Output: every column of ``df`` plus ``key``.
    """
    k = keys.select(F.col(key).cast("string").alias("_lk")).dropDuplicates()
    parts = []
    for c in key_cols:
        parts.append(df.join(k, df[c].cast("string") == k["_lk"], "inner"))
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.dropDuplicates(["_lk", key_cols[0]]).withColumnRenamed("_lk", key)


def lookup_missing(df: DataFrame, keys: DataFrame, key_cols: list[str], key: str = "key") -> DataFrame:
    """Requested keys that match no row (the 404 set), as a left-anti join per key column."""
    k = keys.select(F.col(key).cast("string").alias(key)).dropDuplicates()
    for c in key_cols:
        probe = df.select(F.col(c).cast("string").alias("_v")).where(F.col("_v").isNotNull())
        k = k.join(probe, k[key] == probe["_v"], "left_anti")
    return k


def filter_live_status(df: DataFrame, status: str | None, as_of=None, due="next_due_date",
                       alert_days="alert_days", status_col="status") -> DataFrame:
    """Maintenance list status filter: live logic for 'Overdue' and 'Due Soon', the stored
    status for anything else (so status='Scheduled' also returns overdue rows)."""
    if not status:
        return df
    if status == "Overdue":
        return df.where(S.is_overdue(due, status_col, as_of))
    if status == "Due Soon":
        return df.where(S.is_due_soon(due, alert_days, status_col, as_of))
    return df.where(F.col(status_col) == status)


def unexpired(df: DataFrame, col: str = "expires_at", now=None) -> DataFrame:
    """Rows still valid at ``now`` (``col > now``)."""
    n = F.current_timestamp() if now is None else (now if isinstance(now, Column) else F.lit(now))
    return df.where(F.col(col) > n)


def member_of(df: DataFrame, keys: DataFrame, col: str, key: str = "id", keep: bool = True) -> DataFrame:
    """``col = ANY(keys)`` as a semi join (``keep=False``: anti join)."""
    k = keys.select(F.col(key).alias("_m")).dropDuplicates()
    return df.join(k, df[col] == k["_m"], "left_semi" if keep else "left_anti")


# Fixed value: columns the users list exposes (secrets never leave).
SAFE_USER_COLS = ["id", "full_name", "email", "role", "department", "status", "alert_maint",
                  "alert_certs", "alert_contracts", "alert_assets", "last_login", "created_at"]


def safe_users(users: DataFrame) -> DataFrame:
    return users.select(*[c for c in SAFE_USER_COLS if c in users.columns])
