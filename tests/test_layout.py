"""Keyed tables: no shuffle by key, months pruned, appended files compacted, hot keys spread."""

import datetime as dt
import os

from pyspark.sql import functions as F

from rigflow.operators import paging as P
from rigflow.sources import layout as L

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "id long, asset_id long, changed_by long, created_at timestamp_ntz"


def _history(spark, n, start=0):
    return spark.createDataFrame([(i, i % 7 if i % 11 else None, i % 3, None if i % 13 == 0 else T0 + dt.timedelta(days=i % 90, seconds=i))
                                  for i in range(start, start + n)], SCHEMA)


def _table(spark, scratch, buckets=4):
    return L.KeyedTable(spark, os.path.join(scratch, "t"), "asset_id", "created_at", buckets)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_appends_compact_and_read_back(spark, scratch):
    t = _table(spark, scratch)
    whole = _history(spark, 600)
    for lo in (0, 200, 400):
        t.append(whole.where((F.col("id") >= lo) & (F.col("id") < lo + 200)))
    assert max(t.files().values()) > t.buckets
    assert t.compact() and max(t.files().values()) <= t.buckets
    assert sorted(map(str, t.read().collect())) == sorted(map(str, whole.collect()))
    assert t.compact() == []
    t.forget()


def test_latest_per_key_needs_no_shuffle_of_history(spark, scratch):
    t = _table(spark, scratch)
    whole = _history(spark, 400)
    t.append(whole)
    users = spark.createDataFrame([(i, f"U{i}") for i in range(3)], "id long, full_name string")
    top = P.top_k_per_group(t.read(), ["asset_id"], [F.col("created_at").desc(), F.col("id").desc()], 5)
    assert "Exchange" not in _plan(top)
    got, want = (P.history_latest(h, users, 5).collect() for h in (t.read(), whole))
    assert sorted(map(str, got)) == sorted(map(str, want))
    t.forget()


def test_only_the_months_of_a_span_are_opened(spark, scratch):
    t = _table(spark, scratch)
    whole = _history(spark, 400)
    t.append(whole)
    since, until = T0 + dt.timedelta(days=40), T0 + dt.timedelta(days=45)
    part = t.read(since, until)
    assert sorted(r.id for r in part.collect()) == sorted(r.id for r in whole.collect() if r.created_at and since <= r.created_at < until)
    opened = {r.f for r in part.select(F.input_file_name().alias("f")).distinct().collect()}
    assert opened and all("_month=2025-02" in f for f in opened)
    assert "PartitionFilters: [isnotnull(_month" in _plan(part)
    t.forget()


def test_a_hot_key_is_read_without_buckets(spark, scratch, monkeypatch):
    monkeypatch.setattr(L, "LEAST", 100)
    t = _table(spark, scratch, 8)
    t.append(_history(spark, 200).withColumn("asset_id", F.when(F.col("id") % 10 != 0, F.lit(1)).otherwise(F.col("id"))))
    assert t.skewed() and "Bucketed: true" not in _plan(t.read())
    t.forget()


def test_empty_table(spark, scratch):
    t = _table(spark, scratch)
    t.append(_history(spark, 0))
    t.append(_history(spark, 3))
    assert t.read().count() == 3
    t.forget()
