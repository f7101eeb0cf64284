"""Stream forms equal their batch forms: files land in a folder, the query runs with
trigger(availableNow=True), and the sink is compared with the batch operator."""

import datetime as dt
import os

from pyspark.sql import functions as F

from rigflow.operators import changes as C
from rigflow.operators import workflow as W
from rigflow.streaming import cores as K
from rigflow.streaming import jobs as J

SMOKE = "/root/testdata/sf0.001"


def _split_events(spark, scratch):
    ev = spark.read.parquet(f"{SMOKE}/events.parquet")
    src = os.path.join(scratch, "events")
    # two arrivals, the second repeating some rows (exact duplicates)
    ev.where(F.col("event_id") < 500).write.parquet(os.path.join(src, "part1"))
    ev.where(F.col("event_id") >= 450).write.parquet(os.path.join(src, "part2"))
    return ev, src


def test_history_stream_equals_batch(spark, scratch):
    ev, src = _split_events(spark, scratch)
    stream = spark.readStream.schema(ev.schema).option("recursiveFileLookup", "true").parquet(src)
    out = os.path.join(scratch, "hist")
    q = (J.history_stream(stream).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(scratch, "ck1")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out)
    want = K.dedup_changes(K.change_rows(ev)).withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_quota_stream_equals_batch(spark, scratch):
    ev = spark.read.parquet(f"{SMOKE}/events.parquet")
    acc = ev.select("ts", F.col("user_id").alias("client"), F.col("event_type").alias("path"))
    src = os.path.join(scratch, "access")
    acc.write.parquet(src)
    stream = spark.readStream.schema(acc.schema).parquet(src)
    q = (J.quota_stream(stream).writeStream.outputMode("update").format("memory").queryName("quota_t")
         .option("checkpointLocation", os.path.join(scratch, "ck2")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("quota_t").select("client", "requests", "sign_ins",
                                        F.col("window_start").cast("timestamp_ntz").alias("window_start"))
    want = K.window_counts(acc).select("client", "requests", "sign_ins", "window_start")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_workflow_stream_two_batches_equals_batch_fold(spark, scratch):
    transfers = spark.createDataFrame([(f"T{i}", "Pending") for i in range(6)], "id string, status string")
    rows = [(1, "T0", "ops", "approve", "ok", "Admin"), (2, "T1", "ops", "hold", "ok", "Admin"),
            (3, "T2", "cancel", None, None, "Editor"), (4, "T3", "mgr", "approve", "ok", "Admin"),
            (5, "T0", "mgr", "approve", "ok", "Asset Manager"), (6, "T1", "cancel", None, None, "Viewer"),
            (7, "T1", "cancel", None, None, "Editor"), (8, "T4", "ops", "reject", " ", "Admin"),
            (9, "T4", "ops", "reject", "no", "Operations Manager"), (10, "T5", "ops", "approve", "ok", "Admin")]
    schema = "seq long, transfer_key string, stage string, action string, comment string, actor_role string"
    src = os.path.join(scratch, "decisions")
    spark.createDataFrame(rows[:4], schema).coalesce(1).write.parquet(os.path.join(src, "a"))
    spark.createDataFrame(rows[4:], schema).coalesce(1).write.parquet(os.path.join(src, "b"))
    stream = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    state_root, out_root = os.path.join(scratch, "state"), os.path.join(scratch, "out")
    q = J.transfer_workflow_stream(spark, stream, transfers, state_root, out_root,
                                   os.path.join(scratch, "ck3")).trigger(availableNow=True).start()
    q.awaitTermination()
    final = spark.read.parquet(os.path.join(state_root, "v=2"))
    batch = W.fold_decisions(transfers, spark.createDataFrame(rows, schema))
    want = W.apply_state(transfers, batch["state"])
    assert {r.id: r.status for r in final.collect()} == {r.id: r.status for r in want.collect()}
    assert {r.id: r.status for r in final.collect()} == {
        "T0": "Completed", "T3": "Pending", "T4": "Rejected", "T5": "Ops Approved"}


def test_completion_stream_writes_alerts(spark, scratch):
    sched = spark.createDataFrame([("S1", "PM-1", "A1", 30, dt.date(2025, 1, 1), 7, "Scheduled")],
                                  "id string, pm_id string, asset_id string, frequency_days int, "
                                  "next_due_date date, alert_days int, status string")
    assets = spark.createDataFrame([("A1", "R1")], "id string, rig_id string")
    rigs = spark.createDataFrame([("R1", "RIG01", "Rig 1", "Active")], "id string, rig_id string, name string, status string")
    schema = "seq long, schedule_key string, completion_date date, completed_by string, next_due_date date"
    src = os.path.join(scratch, "completions")
    spark.createDataFrame([(1, "PM-1", dt.date(2025, 1, 18), "tech", None)], schema).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = J.completion_stream(spark, stream, sched, assets, rigs, os.path.join(scratch, "st"),
                            os.path.join(scratch, "o"), os.path.join(scratch, "ck4"),
                            as_of=dt.date(2025, 1, 20)).trigger(availableNow=True).start()
    q.awaitTermination()
    s = spark.read.parquet(os.path.join(scratch, "st", "v=1")).first()
    assert s.next_due_date == dt.date(2025, 2, 17)
    a = spark.read.parquet(os.path.join(scratch, "o", "alerts")).first()
    assert (a.total_tasks, a.due_soon, a.overdue) == (1, 0, 0)


def test_stateful_workflow_stream_equals_batch_fold(spark, scratch):
    import random
    rnd = random.Random(3)
    transfers = spark.createDataFrame([(f"T{i}", rnd.choice(["Pending", "Pending", "Ops Approved", "On Hold"]))
                                       for i in range(40)], "id string, status string")
    rows, seq = [], 0
    for _ in range(400):
        seq += 1
        rows.append((seq, f"T{rnd.randrange(42)}", rnd.choice(["ops", "mgr", "cancel"]),
                     rnd.choice(["approve", "reject", "hold"]), rnd.choice(["ok", " "]),
                     rnd.choice(["Admin", "Asset Manager", "Operations Manager", "Editor", "Viewer"])))
    schema = "seq long, transfer_key string, stage string, action string, comment string, actor_role string"
    src = os.path.join(scratch, "dec")
    for part in range(4):
        spark.createDataFrame(rows[part * 100:(part + 1) * 100], schema).coalesce(1).write.parquet(
            os.path.join(src, f"p{part}"))
    stream = (spark.readStream.schema(schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    out = os.path.join(scratch, "tws")
    q = (J.transfer_state_stream(stream, transfers).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(scratch, "ck5")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r.seq: (r.accepted, r.reason) for r in spark.read.parquet(out).collect()}
    batch = W.fold_decisions(transfers, spark.createDataFrame(rows, schema))["events"]
    want = {r.seq: (r.accepted, r.reason) for r in batch.collect()}
    assert got == want


def test_stateful_completion_stream_equals_batch(spark, scratch):
    d = __import__("rigflow.plans.catalog", fromlist=["domain"]).domain(spark, SMOKE)
    schedules = d.schedules
    comps = d.completions
    src = os.path.join(scratch, "comp")
    comps.where(F.col("seq") < 500).write.parquet(os.path.join(src, "a"))
    comps.where(F.col("seq") >= 500).write.parquet(os.path.join(src, "b"))
    stream = (spark.readStream.schema(comps.schema).option("recursiveFileLookup", "true")
              .option("maxFilesPerTrigger", 1).parquet(src))
    out = os.path.join(scratch, "cs")
    q = (J.completion_state_stream(stream, schedules).writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", os.path.join(scratch, "ck6")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out)
    batch = C.complete_maintenance(schedules, comps)
    logs = {(r.seq, str(r.schedule_id), r.next_due_date) for r in batch["logs"].collect()}
    assert {(r.seq, r.schedule_id, r.next_due_date) for r in got.where("accepted").collect()} == logs
    rej = {(r.seq, r.reason) for r in batch["rejected"].collect()}
    assert {(r.seq, r.reason) for r in got.where("NOT accepted").collect()} == rej
