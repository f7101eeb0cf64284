"""Live statuses and date arithmetic as Column builders.

Every builder takes ``as_of`` (a date, ISO string or Column; default ``current_date()``)
so reports are repeatable. Boundaries follow the source system: overdue is ``due < as_of``;
due soon is ``as_of <= due <= as_of + alert_days`` with both ends included.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status lists of the source system.
CLOSED = ("Completed", "Cancelled")                      # list filter, alerts, KPIs
VIEW_KEEP = ("Completed", "Cancelled", "In Progress")    # the maintenance view keeps these
CONTRACT_FINAL = ("Expired", "Terminated")


def as_of_col(as_of=None) -> Column:
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, str):
        as_of = dt.date.fromisoformat(as_of)
    return F.lit(as_of)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def days_until(day, as_of=None) -> Column:
    """``day - as_of`` in whole days (INT)."""
    return F.datediff(_c(day), as_of_col(as_of))


def is_open(status="status", closed=CLOSED) -> Column:
    return ~_c(status).isin(*closed)


def is_overdue(due="next_due_date", status="status", as_of=None, closed=CLOSED) -> Column:
    return is_open(status, closed) & (_c(due) < as_of_col(as_of))


def is_due_soon(due="next_due_date", alert_days="alert_days", status="status", as_of=None,
                closed=CLOSED) -> Column:
    a = as_of_col(as_of)
    return is_open(status, closed) & (_c(due) >= a) & (_c(due) <= F.date_add(a, _c(alert_days)))


def is_alert(due="next_due_date", alert_days="alert_days", status="status", as_of=None) -> Column:
    """Open and due no later than as_of + alert_days (overdue or due soon)."""
    return is_open(status) & (_c(due) <= F.date_add(as_of_col(as_of), _c(alert_days)))


def due_status(due="next_due_date", alert_days="alert_days", status="status", as_of=None,
               keep=CLOSED) -> Column:
    """Overdue / Due Soon / Scheduled, or the stored status when it is in ``keep``."""
    a = as_of_col(as_of)
    s = _c(status)
    return (F.when(s.isin(*keep), s)
             .when(_c(due) < a, F.lit("Overdue"))
             .when(_c(due) <= F.date_add(a, _c(alert_days)), F.lit("Due Soon"))
             .otherwise(F.lit("Scheduled")))


def urgency_rank(due="next_due_date", alert_days="alert_days", status="status", as_of=None) -> Column:
    """1 overdue, 2 due soon, 3 otherwise (sort key of the maintenance list)."""
    a = as_of_col(as_of)
    open_ = is_open(status)
    return (F.when(open_ & (_c(due) < a), F.lit(1))
             .when(open_ & (_c(due) <= F.date_add(a, _c(alert_days))), F.lit(2))
             .otherwise(F.lit(3)))


def alert_type(due="next_due_date", as_of=None) -> Column:
    return F.when(_c(due) < as_of_col(as_of), F.lit("Overdue")).otherwise(F.lit("Due Soon"))


def contract_status(end="end_date", status="status", as_of=None, window_days: int = 30) -> Column:
    a = as_of_col(as_of)
    s = _c(status)
    return (F.when(s.isin(*CONTRACT_FINAL), s)
             .when(_c(end) < a, F.lit("Expired"))
             .when(_c(end) <= F.date_add(a, window_days), F.lit("Expiring Soon"))
             .otherwise(s))


def certificate_status(expiry="expiry_date", status="status", as_of=None, window_days: int = 30) -> Column:
    """View form: Revoked stays, NULL expiry is Valid."""
    a = as_of_col(as_of)
    e = _c(expiry)
    return (F.when(_c(status) == "Revoked", F.lit("Revoked"))
             .when(e.isNull(), F.lit("Valid"))
             .when(e < a, F.lit("Expired"))
             .when(e <= F.date_add(a, window_days), F.lit("Expiring"))
             .otherwise(F.lit("Valid")))


def certificate_refresh_status(expiry="expiry_date", status="status", as_of=None,
                               window_days: int = 30) -> Column:
    """Trigger form: the stored status is left alone when expiry is NULL or Revoked."""
    a = as_of_col(as_of)
    e = _c(expiry)
    s = _c(status)
    return (F.when(e.isNull() | (s == "Revoked"), s)
             .when(e < a, F.lit("Expired"))
             .when(e <= F.date_add(a, window_days), F.lit("Expiring"))
             .otherwise(F.lit("Valid")))


def in_window(day, as_of=None, days: int = 30) -> Column:
    """``as_of <= day <= as_of + days``."""
    a = as_of_col(as_of)
    return _c(day).between(a, F.date_add(a, days))


def initials(full_name="full_name") -> Column:
    """First letter of the trimmed name plus first letter of its second space-separated
    part (split before trimming, as the source's generated column does)."""
    n = _c(full_name)
    second = F.split_part(n, F.lit(" "), F.lit(2))
    return F.concat(F.left(F.upper(F.trim(n)), F.lit(1)),
                    F.coalesce(F.left(F.upper(F.trim(second)), F.lit(1)), F.lit("")))


def null_if_empty(c) -> Column:
    """``x || null``: an empty text, a numeric zero or NaN, and false become NULL; the text "0" stays."""
    col = _c(c)
    kind = F.typeof(col)
    number = kind.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    value = col.try_cast("double")
    return F.when((number & ((value == 0) | F.isnan(value))) | (kind.isin("string") & (col.cast("string") == ""))
                  | (kind.isin("boolean") & (col.cast("string") == "false")), F.lit(None)).otherwise(col)
