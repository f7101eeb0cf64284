"""Field rules of command bodies (trimmed non-empty, allowed values, dates, integers and
numbers with a minimum, e-mail shape, minimum length) as Column predicates. A NULL field
fails every rule (the request validators reject a missing field)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a plain e-mail shape (local@domain.tld).
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def required(c: str) -> Column:
    """Present and not blank after trimming."""
    return F.col(c).isNotNull() & (F.length(F.trim(F.col(c).cast("string"))) > 0)


def is_in(c: str, values) -> Column:
    return F.col(c).isNotNull() & F.col(c).isin(*values)


def is_date(c: str) -> Column:
    text = F.col(c).cast("string")
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyy/MM/dd")).isNotNull()


def is_int(c: str, min_value: int | None = None) -> Column:
    v = F.col(c).cast("string")
    ok = v.rlike(r"^\s*[+-]?\d+\s*$")
    if min_value is not None:
        ok = ok & (F.trim(v).try_cast("long") >= min_value)
    return ok & F.col(c).isNotNull()


def is_float(c: str, min_value: float | None = None) -> Column:
    v = F.trim(F.col(c).cast("string")).try_cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    if min_value is not None:
        ok = ok & (v >= min_value)
    return ok


def is_email(c: str) -> Column:
    return F.col(c).isNotNull() & F.col(c).rlike(EMAIL_PATTERN)


def min_length(c: str, n: int) -> Column:
    return F.col(c).isNotNull() & (F.length(F.col(c)) >= n)


