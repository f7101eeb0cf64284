"""Ordered streams: shuffled, late and split input gives the batch result."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from rigflow.operators import changes as C
from rigflow.operators import workflow as W
from rigflow.streaming import cores as K
from rigflow.streaming import ordered as O

T0 = dt.datetime(2025, 1, 20)


def _stream(spark, scratch, files, schema):
    """A stream that takes one of the given lists of rows per micro-batch."""
    src = os.path.join(scratch, "in")
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(os.path.join(src, f"p{i}"))
    return (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", 1).parquet(src))


def _collect(spark, scratch, out):
    path = os.path.join(scratch, "out")
    q = (out.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(path)


def _shuffled(rows, n, rnd):
    rows = list(rows)
    rnd.shuffle(rows)
    return [rows[i::n] for i in range(n)]


def test_transfer_events_in_order_across_batches(spark, scratch):
    rnd = random.Random(5)
    transfers = spark.createDataFrame([(f"T{i}", rnd.choice(["Pending", "Pending", "Ops Approved", "On Hold"]))
                                       for i in range(20)], "id string, status string")
    rows = [(T0 + dt.timedelta(seconds=seq), seq, f"T{rnd.randrange(22)}", rnd.choice(["ops", "mgr", "cancel", None]),
             rnd.choice(["approve", "reject", "hold", None]), rnd.choice(["ok", " ", "", None]),
             rnd.choice(["Admin", "Asset Manager", "Operations Manager", "Viewer", None])) for seq in range(300)]
    schema = ("ts timestamp_ntz, seq long, transfer_key string, stage string, action string, comment string, "
              "actor_role string")
    end = [[(T0 + dt.timedelta(days=d), 1000 + d, "end", "ops", "approve", "x", "Admin")] for d in (1, 2)]
    stream = _stream(spark, scratch, _shuffled(rows, 3, rnd) + end, schema)
    got = _collect(spark, scratch, O.ordered_transfer_stream(stream, transfers))
    got = {r.seq: (r.accepted, r.reason, r.state_at) for r in got.where("transfer_key <> 'end'").collect()}
    want = W.fold_decisions(transfers, spark.createDataFrame(rows, schema).drop("ts"))["events"]
    assert {s: v[:2] for s, v in got.items()} == {r.seq: (r.accepted, r.reason) for r in want.collect()}
    assert sum(a for a, _, _ in got.values()) > 10


def test_completions_in_order_across_batches(spark, scratch):
    rnd = random.Random(6)
    day = dt.date(2025, 1, 1)
    sched = spark.createDataFrame([(str(i), f"PM-{i}", f"A{i}", 10 + i, day, 7, "Scheduled") for i in range(6)],
                                  "id string, pm_id string, asset_id string, frequency_days int, next_due_date date, "
                                  "alert_days int, status string")
    schema = "ts timestamp_ntz, seq long, schedule_key string, completion_date date, completed_by string, next_due_date date"
    rows = [(T0 + dt.timedelta(seconds=s), s, rnd.choice(["PM-", ""]) + str(rnd.randrange(7)),
             rnd.choice([day + dt.timedelta(days=rnd.randrange(60)), None]), rnd.choice(["tech", "", None, "x"]),
             rnd.choice([None, None, day + dt.timedelta(days=90)])) for s in range(80)]
    end = [[(T0 + dt.timedelta(days=d), 1000 + d, "end", None, None, None)] for d in (1, 2)]
    stream = _stream(spark, scratch, _shuffled(rows, 3, rnd) + end, schema)
    got = _collect(spark, scratch, O.ordered_completion_stream(stream, sched)).where("schedule_key <> 'end'")
    want = C.complete_maintenance(sched, spark.createDataFrame(rows, schema).drop("ts"))
    logs = {(r.seq, r.schedule_id, r.next_due_date) for r in want["logs"].collect()}
    assert {(r.seq, r.schedule_id, r.next_due_date) for r in got.where("accepted").collect()} == logs and logs
    assert ({(r.seq, r.reason) for r in got.where("NOT accepted").collect()}
            == {(r.seq, r.reason) for r in want["rejected"].collect()})


def _replay(rows, width):
    """Windows of each client, request by request."""
    out = {}
    for ts, client, path in sorted(rows, key=lambda r: r[0]):
        wins = out.setdefault(client, [])
        if not wins or ts >= wins[-1][0] + width:
            wins.append([ts, 0, 0])
        wins[-1][1] += 1
        wins[-1][2] += path == "signup"
    return {(c, *w) for c, wins in out.items() for w in wins}


def _requests(rnd, n=400):
    times = [T0 + dt.timedelta(seconds=rnd.choice([rnd.randrange(7200), 900 * rnd.randrange(9)])) for _ in range(n)]
    return [(t, rnd.choice(["a", "a", "a", "b", "c"]), rnd.choice(["signup", "view", None])) for t in times]


def test_anchored_windows_batch_equals_replay(spark):
    schema = "ts timestamp_ntz, client string, path string"
    rows = _requests(random.Random(7))
    rows += [(T0 + dt.timedelta(days=3), "b", "signup"), (T0 + dt.timedelta(days=3, microseconds=1), "b", "signup")]
    got = K.anchored_windows(spark.createDataFrame(rows, schema))
    width = dt.timedelta(minutes=15)
    assert {(r.client, r.window_start, r.requests, r.sign_ins) for r in got.collect()} == _replay(rows, width)
    assert K.anchored_windows(spark.createDataFrame([], schema)).count() == 0
    nulls = [(None, "a", "view"), (T0, None, "view"), (T0, None, "signup")]
    assert [(r.client, r.requests, r.sign_ins) for r in K.anchored_windows(spark.createDataFrame(nulls, schema)).collect()] == [(None, 2, 1)]


def test_anchored_windows_stream_equals_replay(spark, scratch):
    rnd = random.Random(8)
    schema = "ts timestamp_ntz, client string, path string"
    rows = _requests(rnd, 300)
    end = [[(T0 + dt.timedelta(days=d), "end", None)] for d in (1, 2)]
    stream = _stream(spark, scratch, _shuffled(rows, 3, rnd) + end, schema)
    got = _collect(spark, scratch, O.anchored_quota_stream(stream, lateness="3 hours")).where("client <> 'end'")
    rows_got = got.select("client", F.col("window_start").cast("timestamp_ntz").alias("s"), "requests", "sign_ins").collect()
    assert {tuple(r) for r in rows_got} == _replay(rows, dt.timedelta(minutes=15))


def test_alert_view_follows_completions_and_dates(spark, scratch):
    """After every trigger the view equals the report over all schedules as of the watermark's day."""
    rnd = random.Random(9)
    start = dt.date(2025, 1, 20)
    sched = spark.createDataFrame(
        [(str(i), f"PM-{i}", str(i % 5), 20, start + dt.timedelta(days=rnd.randrange(-5, 25)), rnd.choice([0, 3, 7]),
          rnd.choice(["Scheduled", "Scheduled", "In Progress", "Completed", "Cancelled"])) for i in range(40)],
        "id string, pm_id string, asset_id string, frequency_days int, next_due_date date, alert_days int, status string")
    assets = spark.createDataFrame([(str(i), None if i == 4 else i % 2) for i in range(5)], "id string, rig_id long")
    schema = "ts timestamp_ntz, seq long, schedule_key string, completion_date date, completed_by string, next_due_date date"
    days = [1, 4, 9, 20, 30]
    files = [[(T0 + dt.timedelta(days=d, hours=12, minutes=i), 100 * d + i, f"PM-{rnd.randrange(40)}",
               start + dt.timedelta(days=d), "tech", None) for i in range(6)] for d in days]
    stream = _stream(spark, scratch, files, schema)
    root, seen = os.path.join(scratch, "view"), []
    write = O.alert_view_writer(spark, O.initial_alerts(assets, sched, start), root)

    def handle(batch, batch_id):
        write(batch, batch_id)
        seen.append(batch_id)

    changes = O.alert_change_stream(stream, sched, assets, start, lateness="0 seconds")
    q = (changes.writeStream.foreachBatch(handle).option("checkpointLocation", os.path.join(scratch, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert len(seen) >= len(days)
    marks = {p["batchId"]: p["eventTime"].get("watermark") for p in (x if isinstance(x, dict) else __import__("json").loads(x.json)
                                                                       for x in q.recentProgress)}
    moved = 0
    for b in seen:
        mark = max(dt.datetime.fromisoformat(marks[b].rstrip("Z")), T0)
        passed = [r for f in files for r in f if r[0] < mark]
        state = C.complete_maintenance(sched, spark.createDataFrame(passed, schema).drop("ts"))["schedules"] if passed else sched
        want = O.initial_alerts(assets, state, mark.date())
        got = spark.read.parquet(os.path.join(root, f"v={b + 1}"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (b, mark)
        moved += bool(passed)
    assert moved >= 3
