"""Digests, tables as of other times, sketches, unique inserts: against plain replays."""

import datetime as dt
import random

from pyspark.sql import functions as F

from rigflow.operators import changes as C
from rigflow.operators import digests as D
from rigflow.operators import history as V
from rigflow.operators import paging as P
from rigflow.operators import quality as Q
from rigflow.operators import sketches as K

T0 = dt.datetime(2025, 1, 1)


# ------------------------------------------------------------------ digests
SCHEMA = "id long, name string, value double, tags array<string>, day date"


def _rows(n):
    return [(i, f"n{i}", i / 2, [str(i), None], dt.date(2025, 1, 1)) for i in range(n)]


def test_only_rows_of_differing_buckets_are_read_on(spark):
    old, new = _rows(5000), _rows(5000)
    new[17] = (17, None, 8.5, ["17", None], None)
    new[18] = (18, "n18", 9.0, [None, "18"], dt.date(2025, 1, 1))
    del new[4000]
    new.append((9999, "x", None, None, None))
    o, n = spark.createDataFrame(old, SCHEMA), spark.createDataFrame(new, SCHEMA)
    a, b = D.differing_rows(o, n)
    touched = {17, 18, 4000, 9999}
    assert a.count() + b.count() < 40                       # of 10,000 rows
    assert touched <= {r.id for r in a.union(b).collect()}
    got = C.audit_changes(o, n, "t").collect()
    assert {(r.record_id, r.action) for r in got} == {(17, "UPDATE"), (18, "UPDATE"), (4000, "DELETE"), (9999, "INSERT")}
    want = C.capture_changes(o, n, only_changed=True)
    assert ({(r.record_id, r.old_data, r.new_data) for r in got}
            == {(r.asset_id, r.old_values, r.new_values) for r in want.collect()})


def test_digests_of_edges(spark):
    def differ(a, b, schema="id long, x string, y string"):
        return D.differing_rows(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))[0].count()
    assert differ([(1, None, "a")], [(1, "a", None)]) == 1
    assert differ([(1, "", None)], [(1, None, "")]) == 1
    assert differ([(1, "a", "b"), (1, "a", "b")], [(1, "a", "b")]) == 2            # repeated rows count
    assert differ([(None, "a", "b")], [(None, "a", "b")]) == 0
    assert differ([], []) == 0
    assert differ([(1, 0.0)], [(1, -0.0)], "id long, x double") == 1
    assert differ([(1, float("nan"))], [(1, float("nan"))], "id long, x double") == 0


def test_levels_of_the_tree_add_up(spark):
    df = spark.createDataFrame(_rows(300), SCHEMA)
    fine = D.bucket_digests(df, "id", 256)
    coarse = D.bucket_digests(df, "id", 16)
    assert sorted(map(tuple, D.coarser(fine, 16).collect())) == sorted(map(tuple, coarse.collect()))
    assert D.coarser(fine, 1).first()["rows"] == 300


# ------------------------------------------------------------------ tables as of other times
def _versions(rnd, n=300):
    return [(seq, rnd.choice(["a", "a", "a", "b", "c", None]),
             rnd.choice([None] + [T0 + dt.timedelta(hours=rnd.randrange(24 * 6)) for _ in range(12)]),
             rnd.choice([None, f"v{seq}"])) for seq in range(n)]


def test_as_of_join_equals_replay(spark):
    rnd = random.Random(1)
    versions = _versions(rnd)
    asks = [(i, k, t, i) for i, (_, k, t, _) in enumerate(_versions(rnd, 200) + [(0, "z", T0, None)])] + [(500, "a", T0 + dt.timedelta(days=400), 0)] * 2
    q = spark.createDataFrame(asks, "q long, key string, at timestamp_ntz, seq long")
    v = spark.createDataFrame(versions, "seq long, key string, ts timestamp_ntz, value string")
    got = V.as_of_join(q, v.withColumn("version", F.col("seq")), "key", "at", "key", "ts", "seq", ["value", "version"]).collect()

    def valid(key, at):
        seen = [r for r in versions if key is not None and at is not None and r[1] == key and r[2] is not None and r[2] <= at]
        best = max(seen, key=lambda r: (r[2], r[0]), default=None)
        return (None, None) if best is None else (best[3], best[0])
    assert sorted((r.q, r.seq, r.value or "", r.version or -1) for r in got) == sorted(
        (i, s, valid(k, t)[0] or "", valid(k, t)[1] or -1) for i, k, t, s in asks)
    assert V.as_of_join(q.limit(0), v, "key", "at", "key", "ts", "seq", ["value"]).count() == 0
    assert V.as_of_join(q, v.limit(0), "key", "at", "key", "ts", "seq", ["value"]).where("value IS NULL").count() == len(asks)


def test_validity_intervals_meet(spark):
    versions = [r for r in _versions(random.Random(2)) if r[1] is not None]
    v = spark.createDataFrame(versions, "seq long, key string, ts timestamp_ntz, value string")
    got = {r.seq: (r.valid_from, r.valid_to) for r in V.validity_intervals(v, "key", "ts", "seq").collect()}
    assert len(got) == len(versions)
    for key in "abc":
        line = sorted((r for r in versions if r[1] == key and r[2] is not None), key=lambda r: (r[2], r[0]))
        for r, after in zip(line, line[1:] + [None]):
            assert got[r[0]] == (r[2], after[2] if after else None)
    assert all(got[r[0]] == (None, None) for r in versions if r[2] is None)


def test_table_at_equals_replay_of_patches(spark):
    rnd = random.Random(3)
    base = [(k, f"base-{k}", None) for k in "abcd"]
    patches = [(seq, rnd.choice(["a", "a", "b", "c", "x", None]), rnd.choice([None] + [T0 + dt.timedelta(hours=rnd.randrange(72)) for _ in range(9)]),
                rnd.choice([None, f"s{seq}"]), rnd.choice([None, seq])) for seq in range(200)]
    instants = [T0 + dt.timedelta(hours=h) for h in (-1, 24, 24.5, 100)]
    b = spark.createDataFrame(base, "id string, status string, n int")
    p = spark.createDataFrame(patches, "seq long, id string, ts timestamp_ntz, status string, n int")
    got = {(r.as_of, r.id): (r.status, r.n) for r in V.table_at(b, p, instants, ["status", "n"]).collect()}
    want = {}
    for at in instants:
        for key, *values in base:
            for seq, k, ts, *new in sorted((r for r in patches if r[1] == key and r[2] is not None and r[2] <= at), key=lambda r: (r[2], r[0])):
                values = [x if x is not None else y for x, y in zip(new, values)]
            want[(at, key)] = tuple(values)
    assert got == want


# ------------------------------------------------------------------ sketches
def test_merged_sketches_equal_the_sketch_of_the_whole(spark):
    df = spark.range(200_000).select((F.col("id") % 5).alias("part"), (F.hash("id") % 60_000).alias("v"))
    df = df.unionByName(spark.createDataFrame([(0, None)], "part long, v int"))
    whole = K.distinct_sketches(df, [F.lit(1).alias("one")], "v")
    merged = K.merge_sketches(K.distinct_sketches(df, ["part"], "v").withColumn("one", F.lit(1)), ["one"])
    a, b = (x.select(K.estimate().alias("n")).first()["n"] for x in (whole, merged))
    exact = df.select("v").distinct().where("v IS NOT NULL").count()
    assert abs(a - exact) <= exact * K.bound() and abs(a - b) <= exact * 0.01


# ------------------------------------------------------------------ unique inserts, rig creates, unread
def test_insert_unique_equals_command_by_command(spark):
    rnd = random.Random(4)
    for _ in range(3):
        rows = [(seq, rnd.choice([None] + list("abcdefgh")), rnd.choice([None] + list("qrstuvwx"))) for seq in range(60)]
        taken = [{"a"}, {"q"}]
        want = {}
        for seq, *keys in rows:
            stored = any(k in t for k, t in zip(keys, ({"a"}, {"q"})))
            clash = any(k is not None and k in t for k, t in zip(keys, taken))
            want[seq] = "exists" if stored else "duplicate" if clash else None
            if not clash:
                for k, t in zip(keys, taken):
                    t.add(k)
        out = C.insert_unique(spark.createDataFrame([("a", None), (None, "q")], "code string, name string"),
                              spark.createDataFrame(rows, "seq long, code string, name string"), ["code", "name"])
        got = {r.seq: None for r in out["accepted"].collect()} | {r.seq: r.reason for r in out["rejected"].collect()}
        assert got == want


def test_create_rigs_empty_fields_become_null(spark):
    rigs = spark.createDataFrame([("R1", "One")], "rig_id string, name string")
    rows = [(1, "R2", "Two", "SCR", "", "", 0, "", "Editor"), (2, "R1", "Three", "SCR", "C", "x", 5, "Active", "Editor"),
            (3, "R3", "Two", "SCR", "C", "x", 5, "Active", "Admin"), (4, "R4", None, "SCR", None, None, None, None, "Admin"),
            (5, "R5", "Five", "Steam", "", "", 0, "", "Admin"), (6, "R6", "Six", None, "", "", -1, "", "Admin"), (7, "R7", "Seven", "SCR", "", "", 0, "", None)]
    out = Q.create_rigs(rigs, spark.createDataFrame(rows, "seq long, rig_id string, name string, type string, company_id string, location string, horsepower int, status string, role string"))
    a = out["accepted"].collect()
    assert [(r.seq, r.company_id, r.location, r.horsepower, r.status) for r in a] == [(1, None, None, None, "Active")]
    assert {r.seq: r.reason for r in out["rejected"].collect()} == {
        2: "exists", 3: "duplicate", 4: "missing_fields", 5: "type_allowed", 6: "horsepower_positive", 7: "role"}


def test_unread_counts_the_page_only(spark):
    n = spark.createDataFrame([(i, None if i % 4 == 0 else 1, "asset", 0, i % 2 == 0, T0 + dt.timedelta(hours=i)) for i in range(12)],
                              "id long, user_id long, entity_type string, entity_id long, is_read boolean, created_at timestamp_ntz")
    users = spark.createDataFrame([(1,), (2,)], "id long")
    assets = spark.createDataFrame([], "id long, asset_id string")
    got = {r.user_id: (r.returned, r.unread) for r in P.unread_in_page(P.notification_feed(n, users, assets, k=5), users).collect()}
    assert got == {1: (5, 3), 2: (3, 0)}
    none = P.unread_in_page(P.notification_feed(n.limit(0), users, assets, k=5), users)
    assert {tuple(r) for r in none.collect()} == {(1, 0, 0), (2, 0, 0)}
