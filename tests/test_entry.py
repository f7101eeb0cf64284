"""Driver contract: entry() runs, every oracle names a query, and at sf0.001 every query
with an oracle matches it (the same compare as tools/oracle_check.py)."""

import os
import re

import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, digest, frame_rows

SMOKE = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 25 and set(df.columns) >= {"rig_id", "total_tasks", "overdue", "due_soon"}


def test_oracle_keys_subset():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


@pytest.mark.skipif(not os.path.exists(SMOKE), reason="driver data missing")
def test_all_queries_match_oracle_at_smoke_scale(spark):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SMOKE}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    from tools.type_check import spark_type
    bad, bad_types = [], []
    sqls = E.oracle_sql()
    for name, fn in E.queries().items():
        if name not in sqls or re.match(r"op\d+_", name):      # (the text operators have tests of their own)
            continue
        df = fn(spark, SMOKE)
        s_cols, s_rows = frame_rows(df.toPandas())
        o_cols, o_rows = frame_rows(con.execute(sqls[name]).fetchdf())
        if s_cols != o_cols or digest(s_rows) != digest(o_rows):
            bad.append(name)
        rel = con.sql(sqls[name])
        s_types = {f.name: spark_type(f.dataType.simpleString()) for f in df.schema.fields}
        o_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        if s_types != o_types:
            bad_types.append(name)
    assert bad == [] and bad_types == []
