"""Boundary behaviour of the live-status column builders."""

import datetime as dt

from pyspark.sql import functions as F

from rigflow.functions import status as S

AS_OF = dt.date(2025, 1, 20)


def _one(spark, expr, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(
        f"{n} {'date' if isinstance(v, dt.date) or v is None and n.endswith('date') else 'int' if isinstance(v, int) else 'string'}"
        for n, v in cols.items()))
    return df.select(expr.alias("x")).first().x


def test_due_boundaries(spark):
    rows = [(AS_OF - dt.timedelta(days=1), 7, "Scheduled", "Overdue"),
            (AS_OF, 7, "Scheduled", "Due Soon"),
            (AS_OF + dt.timedelta(days=7), 7, "Scheduled", "Due Soon"),
            (AS_OF + dt.timedelta(days=8), 7, "Scheduled", "Scheduled"),
            (AS_OF - dt.timedelta(days=1), 7, "In Progress", "Overdue"),
            (AS_OF - dt.timedelta(days=1), 7, "Completed", "Completed")]
    df = spark.createDataFrame([r[:3] for r in rows], "next_due_date date, alert_days int, status string")
    got = [r.x for r in df.select(S.due_status(as_of=AS_OF).alias("x")).collect()]
    assert got == [r[3] for r in rows]
    view = [r.x for r in df.select(S.due_status(as_of=AS_OF, keep=S.VIEW_KEEP).alias("x")).collect()]
    assert view[4] == "In Progress"
    ov = [r.x for r in df.select(S.is_overdue(as_of=AS_OF).alias("x")).collect()]
    assert ov == [True, False, False, False, True, False]
    ds = [r.x for r in df.select(S.is_due_soon(as_of=AS_OF).alias("x")).collect()]
    assert ds == [False, True, True, False, False, False]


def test_contract_and_certificate_status(spark):
    df = spark.createDataFrame(
        [(AS_OF - dt.timedelta(days=6), "Active"), (AS_OF + dt.timedelta(days=30), "Pending"),
         (AS_OF + dt.timedelta(days=31), "Active"), (AS_OF - dt.timedelta(days=6), "Terminated")],
        "end_date date, status string")
    got = [r.x for r in df.select(S.contract_status(as_of=AS_OF).alias("x")).collect()]
    assert got == ["Expired", "Expiring Soon", "Active", "Terminated"]
    c = spark.createDataFrame(
        [(None, "Expired"), (AS_OF - dt.timedelta(days=1), "Revoked"), (AS_OF - dt.timedelta(days=1), "Valid"),
         (AS_OF + dt.timedelta(days=30), "Valid"), (AS_OF + dt.timedelta(days=31), "Expiring")],
        "expiry_date date, status string")
    view = [r.x for r in c.select(S.certificate_status(as_of=AS_OF).alias("x")).collect()]
    assert view == ["Valid", "Revoked", "Expired", "Expiring", "Valid"]
    trig = [r.x for r in c.select(S.certificate_refresh_status(as_of=AS_OF).alias("x")).collect()]
    assert trig == ["Expired", "Revoked", "Expired", "Expiring", "Valid"]


def test_initials(spark):
    df = spark.createDataFrame([("Sara Al-Rashid",), ("Bob",), (" Amy Lee",), ("small ring",)], "full_name string")
    assert [r.x for r in df.select(S.initials().alias("x")).collect()] == ["SA", "B", "AA", "SR"]


def test_days_until_and_window(spark):
    df = spark.createDataFrame([(AS_OF + dt.timedelta(days=30),), (AS_OF + dt.timedelta(days=31),)], "d date")
    assert [r.x for r in df.select(S.days_until("d", AS_OF).alias("x")).collect()] == [30, 31]
    assert [r.x for r in df.select(S.in_window("d", AS_OF, 30).alias("x")).collect()] == [True, False]


def test_null_if_empty(spark):
    df = spark.createDataFrame([("",), ("0",), ("R1",), (None,)], "x string")
    assert [r.y for r in df.select(S.null_if_empty("x").alias("y")).collect()] == [None, "0", "R1", None]
    n = spark.sql("SELECT * FROM VALUES (0, 0.00BD, 0.0D, false), (1, 0.10BD, double('NaN'), true) AS t(i, c, d, b)")
    out = n.select(*[S.null_if_empty(c).alias(c) for c in n.columns]).collect()
    assert tuple(out[0]) == (None,) * 4 and out[1].i == 1 and out[1].d is None and out[1].b and float(out[1].c) == 0.1
