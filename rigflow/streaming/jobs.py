"""Structured Streaming jobs. Each shares its core with a batch operator, so the batch
form is the oracle of the stream form (tests/test_streaming.py).

- K1 ``history_stream``: change events → history rows, exact duplicates dropped within a
  watermark (``dropDuplicatesWithinWatermark``), append-only.
- K2 ``transfer_state_stream`` (stateful form): decision events grouped by transfer into
  ``transformWithStateInPandas``; each transfer's status lives in the state store (RocksDB)
  and only transfers with events in a micro-batch are touched.
- K2 ``transfer_workflow_stream`` (table form): decision events → ``foreachBatch`` running
  the set-based approval fold against the stored transfer table; every micro-batch writes a
  new table version and its rejected commands under ``batch_id=N`` (overwrite, so a retried
  batch is idempotent). Simple, but each batch rewrites the table: for large tables use the
  stateful form.
- K3 + K5 ``completion_stream``: maintenance completions → ``foreachBatch`` applying them
  to the stored schedules, appending logs, and writing the open-alert counts per rig of
  the new state.
- K4 ``quota_stream``: access log → requests per client per 15-minute window with a
  watermark; breaches are windows over the quota.

Paths (state tables, checkpoints) must be on shared storage on a cluster; tests pass
fresh scratch folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import reports as R
from ..operators import workflow as W
from ..session import scratch
from . import cores as K


def _event_time(df: DataFrame, col: str) -> DataFrame:
    """Watermarks need TIMESTAMP (local time zone); driver data is TIMESTAMP_NTZ."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


# ------------------------------------------------------------------ K1
def history_stream(events: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """History rows from a (streaming) events frame, duplicates within ``lateness``
    dropped. Output mode: append."""
    rows = _event_time(K.change_rows(events), "changed_at")
    return rows.withWatermark("changed_at", lateness).dropDuplicatesWithinWatermark(
        ["change_id", "changed_at"])


# ------------------------------------------------------------------ K4
def quota_stream(access: DataFrame, lateness: str = "15 minutes", window: str = K.QUOTA_WINDOW) -> DataFrame:
    """Requests per client per window from a (streaming) access log; use update or
    append output mode. Breaches: ``cores.quota_breaches`` on the result."""
    a = _event_time(access, "ts").withWatermark("ts", lateness)
    return K.window_counts(a, window)


# ------------------------------------------------------------------ versioned state tables
def _join(root: str, *parts: str) -> str:
    return "/".join([root.rstrip("/"), *parts])


def state_before(spark: SparkSession, state_root: str, batch_id: int, initial: DataFrame) -> DataFrame:
    """The table as of the start of micro-batch ``batch_id``: batch N writes version N+1,
    so batch N reads version N (the initial table for batch 0). Deterministic paths, no
    listing, so a retried batch reads the same input and overwrites the same output."""
    return initial if batch_id == 0 else spark.read.parquet(_join(state_root, f"v={batch_id}"))


def write_version(df: DataFrame, state_root: str, version: int) -> str:
    path = _join(state_root, f"v={version}")
    df.write.mode("overwrite").parquet(path)
    return path


# ------------------------------------------------------------------ K2
def transfer_batch_handler(spark: SparkSession, state_root: str, out_root: str,
                           initial: DataFrame):
    """``foreachBatch`` function: fold the micro-batch's decisions into the stored
    transfers (version = batch id + 1), append rejected commands per batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):          # the fold's tables go when the batch is written
            transfers = state_before(spark, state_root, batch_id, initial)
            res = W.fold_decisions(transfers, batch)
            new = W.apply_state(transfers, res["state"])
            write_version(new, state_root, batch_id + 1)
            rej = res["events"].where(~F.col("accepted"))
            rej.write.mode("overwrite").parquet(_join(out_root, f"rejected/batch_id={batch_id}"))
    return handle


def transfer_workflow_stream(spark: SparkSession, decisions: DataFrame, initial: DataFrame,
                             state_root: str, out_root: str, checkpoint: str):
    """Start the K2 query (caller chooses the trigger via the returned writer)."""
    return (decisions.writeStream
            .foreachBatch(transfer_batch_handler(spark, state_root, out_root, initial))
            .option("checkpointLocation", checkpoint))


# ------------------------------------------------------------------ K3 + K5
def completion_batch_handler(spark: SparkSession, state_root: str, out_root: str,
                             initial: DataFrame, assets: DataFrame, rigs: DataFrame, as_of=None):
    def handle(batch: DataFrame, batch_id: int) -> None:
        schedules = state_before(spark, state_root, batch_id, initial)
        res = C.complete_maintenance(schedules, batch)
        write_version(res["schedules"], state_root, batch_id + 1)
        res["logs"].write.mode("overwrite").parquet(_join(out_root, f"logs/batch_id={batch_id}"))
        res["rejected"].write.mode("overwrite").parquet(
            _join(out_root, f"rejected/batch_id={batch_id}"))
        new = spark.read.parquet(_join(state_root, f"v={batch_id + 1}"))
        alerts = R.maintenance_by_rig(rigs, assets, new, as_of).withColumn("batch_id", F.lit(batch_id))
        alerts.write.mode("overwrite").parquet(_join(out_root, f"alerts/batch_id={batch_id}"))
    return handle


def completion_stream(spark: SparkSession, completions: DataFrame, initial: DataFrame, assets: DataFrame,
                      rigs: DataFrame, state_root: str, out_root: str, checkpoint: str, as_of=None):
    return (completions.writeStream
            .foreachBatch(completion_batch_handler(spark, state_root, out_root, initial, assets, rigs, as_of))
            .option("checkpointLocation", checkpoint))


# ------------------------------------------------------------------ K2, stateful form
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

TRANSFER_EVENT_OUT = ("seq long, transfer_key string, stage string, action string, accepted boolean, "
                      "reason string, state_at string, status_after string")


def _step(state, stage, action, comment, role):
    """One event against the current state: (new state or None, rejection reason)."""
    if role not in W.STAGE_ROLES.get(stage, ()):
        return None, "role"
    if stage != "cancel" and action not in W.ACTIONS:
        return None, "action"
    if stage != "cancel" and not (comment or "").strip():
        return None, "comment"
    if state is None or state == W.REMOVED:
        return None, "not_found"
    if stage == "ops" and state == "Pending":
        return W.OPS_RESULT[action], None
    if stage == "mgr" and state == "Ops Approved":
        return W.MGR_RESULT[action], None
    if stage == "cancel" and state in ("Pending", "On Hold"):
        return W.REMOVED, None
    return None, "status"


def transfer_state_processor():
    """A ``StatefulProcessor`` keeping each transfer's status in the state store.

    Within a micro-batch a key's events are taken in ``seq`` order (their number is
    bounded by the trigger's batch size); only keys with events are touched, so the work
    per batch follows the batch, not the size of the transfer table."""
    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class TransferState(StatefulProcessor):
        def init(self, handle):
            self.status = handle.getValueState("status", "status string")

        def handleInitialState(self, key, initialState, timerValues):
            if len(initialState):
                self.status.update((str(initialState["status"].iloc[0]),))

        def handleInputRows(self, key, rows, timerValues):
            ev = pd.concat(list(rows), ignore_index=True).sort_values("seq")
            state = self.status.get()[0] if self.status.exists() else None
            out = []
            for r in ev.itertuples(index=False):
                new, reason = _step(state, r.stage, r.action, r.comment, r.actor_role)
                before = state
                if new is not None:
                    state = new
                out.append((int(r.seq), str(key[0]), r.stage, r.action, new is not None, reason,
                            None if new is not None else before, state))
            if state is not None:
                self.status.update((state,))
            yield pd.DataFrame(out, columns=["seq", "transfer_key", "stage", "action", "accepted",
                                             "reason", "state_at", "status_after"])

        def close(self):
            pass

    return TransferState()


def transfer_state_stream(decisions: DataFrame, transfers: DataFrame, key: str = "id") -> DataFrame:
    """K2 low-latency form: every decision event with its outcome and the transfer's status
    after it (append mode). Needs the RocksDB state store provider."""
    spark = decisions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    ev = decisions.select(F.col("seq").cast("long"), F.col("transfer_key").cast("string"), "stage",
                          "action", "comment", "actor_role")
    init = transfers.select(F.col(key).cast("string").alias("transfer_key"), "status").groupBy("transfer_key")
    return ev.groupBy("transfer_key").transformWithStateInPandas(
        statefulProcessor=transfer_state_processor(), outputStructType=TRANSFER_EVENT_OUT,
        outputMode="Append", timeMode="None", initialState=init)


# ------------------------------------------------------------------ K3, stateful form
COMPLETION_OUT = ("seq long, schedule_key string, schedule_id string, accepted boolean, reason string, "
                  "completion_date date, completed_by string, next_due_date date, status_after string")


def completion_state_processor():
    """Per schedule: frequency, next due, last done and status in the state store. Each
    completion (in ``seq`` order within a micro-batch) becomes a log row and moves the
    schedule forward; unknown schedules and incomplete completions are rejected."""
    import datetime as dt

    import pandas as pd
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class ScheduleState(StatefulProcessor):
        def init(self, handle):
            self.sched = handle.getValueState(
                "schedule", "frequency_days int, next_due_date date, last_done_date date, status string")

        def handleInitialState(self, key, initialState, timerValues):
            r = initialState.iloc[0]
            self.sched.update((int(r["frequency_days"]), r["next_due_date"], r["last_done_date"], r["status"]))

        def handleInputRows(self, key, rows, timerValues):
            ev = pd.concat(list(rows), ignore_index=True).sort_values("seq")
            cur = self.sched.get() if self.sched.exists() else None
            out = []
            for r in ev.itertuples(index=False):
                done, by = r.completion_date, r.completed_by
                if cur is None:
                    out.append((int(r.seq), r.schedule_key, None, False, "not_found", done, by, None, None))
                    continue
                if done is None or pd.isna(done) or by is None or not str(by).strip():
                    out.append((int(r.seq), r.schedule_key, key[0], False, "missing_fields", done, by, None, cur[3]))
                    continue
                if isinstance(done, pd.Timestamp):
                    done = done.date()
                given = r.next_due_date
                nxt = (given.date() if isinstance(given, pd.Timestamp) else given) \
                    if given is not None and not pd.isna(given) else done + dt.timedelta(days=int(cur[0]))
                cur = (cur[0], nxt, done, "Scheduled")
                out.append((int(r.seq), r.schedule_key, key[0], True, None, done, by, nxt, "Scheduled"))
            if cur is not None:
                self.sched.update(cur)
            yield pd.DataFrame(out, columns=["seq", "schedule_key", "schedule_id", "accepted", "reason",
                                             "completion_date", "completed_by", "next_due_date",
                                             "status_after"])

        def close(self):
            pass

    return ScheduleState()


def completion_state_stream(completions: DataFrame, schedules: DataFrame) -> DataFrame:
    """K3 low-latency form. The key-or-code reference is resolved by a stream–static left
    join with a key map (two rows per schedule: its id and its code); unresolved keys are
    grouped under their own key, find no state and are rejected. Needs RocksDB state."""
    spark = completions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    keymap = (schedules.select(F.col("id").cast("string").alias("_key"), F.col("id").cast("string").alias("_sid"))
              .unionByName(schedules.select(F.col("pm_id").alias("_key"), F.col("id").cast("string").alias("_sid"))))
    c = completions.join(keymap, completions["schedule_key"] == keymap["_key"], "left")
    c = c.withColumn("_gk", F.coalesce(F.col("_sid"), F.concat(F.lit("?"), F.col("schedule_key"))))
    ev = c.select("_gk", F.col("seq").cast("long"), "schedule_key", "completion_date", "completed_by",
                  "next_due_date")
    init = schedules.select(F.col("id").cast("string").alias("_gk"), "frequency_days", "next_due_date",
                            (F.col("last_done_date") if "last_done_date" in schedules.columns
                             else F.lit(None).cast("date")).alias("last_done_date"), "status").groupBy("_gk")
    return ev.groupBy("_gk").transformWithStateInPandas(
        statefulProcessor=completion_state_processor(), outputStructType=COMPLETION_OUT,
        outputMode="Append", timeMode="None", initialState=init)
