"""Streams whose commands take effect in order, across micro-batches, and views that follow them.

``OrderedEvents`` is the shared mechanism: events of a key wait in a list in the state store
until the watermark has passed their time, then they are handed on in ``seq`` order, as one
frame of columns. An event that comes in a later micro-batch than its successors, but within
the lateness, still takes effect before them. Timers wake a key when its next waiting event is
due, or when it asked to be woken (a date passes, a window ends) with no event at all.

- ``ordered_transfer_stream`` (K2): approval events; ``ordered_completion_stream`` (K3):
  maintenance completions. Both give the batch fold for shuffled and late input.
- ``anchored_quota_stream`` (K4): quota windows that start at a client's first request.
- ``alert_change_stream`` (K5): signed changes of the per-rig alert counts; ``alert_view_writer``
  adds them to the stored view, so the work of a trigger follows its events and the dates that
  pass, not the size of the schedule table.

The state of a key holds its events within the lateness; older events than the watermark are
dropped by Spark, so choose ``lateness`` by the delay of the source. Events of a NULL key share
one group. Rows without an event time take effect never (they have no place in the order) and
are set aside before the stream by ``with_event_time``. All times are UTC.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import status as S
from ..operators import reports as R
from ..operators import workflow as W
from .jobs import COMPLETION_OUT, ROCKSDB_PROVIDER, TRANSFER_EVENT_OUT, state_before, write_version

DAY = 86_400_000_000          # microseconds


def with_event_time(events: DataFrame, ts: str, lateness: str) -> DataFrame:
    """``events`` with a watermarked ``_ts`` and its microseconds ``us``; rows without a time go."""
    at = F.col(ts).cast("timestamp")
    return (events.where(F.col(ts).isNotNull()).withColumns({"_ts": at, "us": F.unix_micros(at)})
            .withWatermark("_ts", lateness))


class OrderedEvents(StatefulProcessor):
    """Keeps a key's events until the watermark passes them; subclasses give ``EVENT`` (state
    schema of an event, with ``us`` and ``seq``), ``STATE`` and ``fold``."""

    EVENT = ""
    STATE = ""

    def init(self, handle):
        self.handle = handle
        self.columns = [part.split()[0] for part in self.EVENT.split(", ")]
        self.pending = handle.getListState("pending", self.EVENT)
        self.state = handle.getValueState("state", self.STATE)

    def fold(self, key, state, events, edge):
        """New state, rows to emit (or None) and the time to be woken at (or None), from the
        ``events`` due before ``edge``, in order; ``events`` may be empty."""
        raise NotImplementedError

    def wake(self, us: int) -> None:
        self.handle.registerTimer(int(us) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            frame = frame[self.columns].astype(object).where(frame[self.columns].notna(), None)
            self.pending.appendList(list(frame.itertuples(index=False, name=None)))
            self.wake(frame["us"].min())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        edge = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = pd.DataFrame(list(self.pending.get()) if self.pending.exists() else [], columns=self.columns)
        passed = waiting["us"].astype("int64") < edge
        due, rest = waiting[passed].sort_values(["seq", "us"], ignore_index=True), waiting[~passed]
        if len(rest):
            self.pending.put(list(rest.itertuples(index=False, name=None)))
            self.wake(rest["us"].min())
        elif len(waiting):
            self.pending.clear()
        state, out, again = self.fold(key, self.state.get() if self.state.exists() else None, due, edge)
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        if again is not None:
            self.wake(again)
        if out is not None and len(out):
            yield out

    def close(self):
        pass


def _run(events: DataFrame, key: str, processor: OrderedEvents, output: str, initial=None) -> DataFrame:
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    return events.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=output, outputMode="Append", timeMode="EventTime",
        initialState=initial)


# ------------------------------------------------------------------ K2
class TransferOrder(OrderedEvents):
    """A transfer's status; at most three events of a transfer are accepted, so a fold jumps
    from one accepted event to the next over masks of the event columns."""

    EVENT = "us long, seq long, stage string, action string, comment string, actor_role string"
    STATE = "status string"

    def handleInitialState(self, key, initialState, timerValues):
        self.state.update((initialState["status"].iloc[0],))

    def fold(self, key, state, ev, edge):
        status = None if state is None else state[0]
        n = len(ev)
        stage, cancel = ev["stage"], (ev["stage"] == "cancel").to_numpy()
        roles = {f"{s}|{r}" for s, allowed in W.STAGE_ROLES.items() for r in allowed}
        known = stage.where(stage.isin(W.STAGE_ROLES), "cancel")
        role_ok = (known + "|" + ev["actor_role"].fillna("")).isin(roles).to_numpy()
        action_ok = cancel | ev["action"].isin(W.ACTIONS).to_numpy()
        comment_ok = cancel | (ev["comment"].fillna("").astype(str).str.strip(" ") != "").to_numpy()
        sound = role_ok & action_ok & comment_ok
        at = {"Pending": (stage == "ops").to_numpy() | cancel, "Ops Approved": (stage == "mgr").to_numpy(), "On Hold": cancel}
        before, after, accepted, i = [None] * n, [None] * n, np.zeros(n, bool), 0
        while i < n:
            fits = np.flatnonzero(sound[i:] & at.get(status, np.zeros(n, bool))[i:])
            j = i + int(fits[0]) if len(fits) else n
            before[i:j + 1] = [status] * (min(j + 1, n) - i)
            after[i:j] = [status] * (j - i)
            if j < n:
                results = W.OPS_RESULT if stage[j] == "ops" else W.MGR_RESULT
                status = W.REMOVED if cancel[j] else results[ev["action"][j]]
                after[j], accepted[j] = status, True
            i = j + 1
        absent = np.array([b is None or b == W.REMOVED for b in before], bool)
        reason = np.select([accepted, ~role_ok, ~action_ok, ~comment_ok, absent],
                           [None, "role", "action", "comment", "not_found"], "status") if n else []
        out = pd.DataFrame({"seq": ev["seq"].astype("int64"), "transfer_key": key[0], "stage": stage, "action": ev["action"],
                            "accepted": accepted, "reason": reason,
                            "state_at": [None if a else b for a, b in zip(accepted, before)], "status_after": after})
        return (None if status is None else (status,)), out, None


def ordered_transfer_stream(decisions: DataFrame, transfers: DataFrame, ts: str = "ts", lateness: str = "1 hour",
                            key: str = "id") -> DataFrame:
    """K2: every decision event with its outcome, in ``seq`` order per transfer whatever
    micro-batch it came in (append mode)."""
    ev = with_event_time(decisions, ts, lateness).select(
        F.col("transfer_key").cast("string"), "_ts", "us", F.col("seq").cast("long"), "stage", "action", "comment", "actor_role")
    init = transfers.select(F.col(key).cast("string").alias("transfer_key"), "status").groupBy("transfer_key")
    return _run(ev, "transfer_key", TransferOrder(), TRANSFER_EVENT_OUT, init)


# ------------------------------------------------------------------ K3
def _complete(ev: pd.DataFrame, frequency: int | None) -> tuple[np.ndarray, pd.Series]:
    """Which completions count, and their next due dates."""
    done = ev["completion_date"].notna() & ev["completed_by"].fillna("").astype(str).ne("")
    step = (pd.to_datetime(ev["completion_date"]) + pd.to_timedelta(frequency or 0, unit="D")).dt.date
    if frequency is None:
        step = pd.Series([None] * len(ev), dtype=object)
    due = ev["next_due_date"].where(ev["next_due_date"].notna(), step)
    return done.to_numpy(), due


class CompletionOrder(OrderedEvents):
    """A schedule's frequency and dates; every completion becomes a log row, the last one by
    ``seq`` moves the schedule."""

    EVENT = "us long, seq long, schedule_key string, completion_date date, completed_by string, next_due_date date"
    STATE = "frequency_days int, next_due_date date, last_done_date date, status string"

    def handleInitialState(self, key, initialState, timerValues):
        r = initialState.astype(object).where(initialState.notna(), None).iloc[0]
        self.state.update((None if r["frequency_days"] is None else int(r["frequency_days"]),
                           r["next_due_date"], r["last_done_date"], r["status"]))

    def fold(self, key, state, ev, edge):
        out = pd.DataFrame({"seq": ev["seq"].astype("int64"), "schedule_key": ev["schedule_key"], "schedule_id": None,
                            "accepted": False, "reason": "not_found", "completion_date": ev["completion_date"],
                            "completed_by": ev["completed_by"], "next_due_date": None, "status_after": None})
        if state is None or not len(ev):
            return state, out, None
        done, due = _complete(ev, state[0])
        out["schedule_id"], out["accepted"] = key[0], done
        out["reason"] = np.where(done, None, "missing_fields")
        out["next_due_date"] = due.where(done, None)
        out["status_after"] = np.where(np.maximum.accumulate(done), "Scheduled", state[3])
        if done.any():
            last = int(np.flatnonzero(done)[-1])
            state = (state[0], due[last], ev["completion_date"][last], "Scheduled")
        return state, out, None


def _keyed_completions(completions: DataFrame, schedules: DataFrame, ts: str, lateness: str) -> DataFrame:
    """Completions with the group key ``_gk``: the schedule's id, or the unknown reference."""
    ids = schedules.select(F.col("id").cast("string").alias("_sid"), "pm_id")
    keymap = ids.select(F.col("_sid").alias("_key"), "_sid").unionByName(ids.select(F.col("pm_id").alias("_key"), "_sid"))
    c = with_event_time(completions, ts, lateness)
    c = c.join(keymap, c["schedule_key"] == keymap["_key"], "left")
    return c.select(F.coalesce("_sid", F.concat(F.lit("?"), "schedule_key")).alias("_gk"), "_ts", "us",
                    F.col("seq").cast("long"), "schedule_key", "completion_date", "completed_by", "next_due_date")


def ordered_completion_stream(completions: DataFrame, schedules: DataFrame, ts: str = "ts",
                              lateness: str = "1 hour") -> DataFrame:
    """K3: every completion with its outcome, in ``seq`` order per schedule (append mode)."""
    last = F.col("last_done_date") if "last_done_date" in schedules.columns else F.lit(None).cast("date").alias("last_done_date")
    init = schedules.select(F.col("id").cast("string").alias("_gk"), "frequency_days", "next_due_date", last, "status").groupBy("_gk")
    return _run(_keyed_completions(completions, schedules, ts, lateness), "_gk", CompletionOrder(), COMPLETION_OUT, init)


# ------------------------------------------------------------------ K4
QUOTA_OUT = "client string, window_start timestamp, window_end timestamp, requests long, sign_ins long"


class AnchoredWindows(OrderedEvents):
    """The open window of a client: its start and counts. A request at or after the end of the
    window starts the next one; a window is emitted once the watermark is past its end."""

    EVENT = "us long, seq long, sign_in boolean"
    STATE = "start long, requests long, sign_ins long"

    def __init__(self, width_us: int):
        self.width = width_us

    def fold(self, key, state, ev, edge):
        times = ev["us"].to_numpy("int64")
        sign_in = np.concatenate([[0], np.cumsum(ev["sign_in"].to_numpy(bool))])
        rows, i = [], 0
        while True:
            if state is not None:
                j = int(np.searchsorted(times, state[0] + self.width))
                state = (state[0], state[1] + max(j - i, 0), state[2] + int(sign_in[max(i, j)] - sign_in[i]))
                i = max(i, j)
                if edge < state[0] + self.width:
                    break
                rows.append(state)
                state = None
            if i == len(times):
                break
            state = (int(times[i]), 0, 0)
        out = pd.DataFrame(rows, columns=["start", "requests", "sign_ins"], dtype="int64")
        out = pd.DataFrame({"client": key[0], "window_start": pd.to_datetime(out["start"], unit="us"),
                            "window_end": pd.to_datetime(out["start"] + self.width, unit="us"),
                            "requests": out["requests"], "sign_ins": out["sign_ins"]})
        return state, out, None if state is None else state[0] + self.width


def anchored_quota_stream(access: DataFrame, minutes: int = 15, lateness: str = "15 minutes", ts: str = "ts") -> DataFrame:
    """K4: requests per client in windows that start at the client's first request (append
    mode); batch form: ``cores.anchored_windows``."""
    a = with_event_time(access, ts, lateness).select(
        F.col("client").cast("string"), "_ts", "us", F.col("us").alias("seq"),
        F.coalesce(F.col("path") == "signup", F.lit(False)).alias("sign_in"))
    return _run(a, "client", AnchoredWindows(minutes * 60_000_000), QUOTA_OUT)


# ------------------------------------------------------------------ K5
ALERT_CHANGE_OUT = "rig long, total_tasks long, overdue long, due_soon long, completed long"
ALERTS = ("total_tasks", "overdue", "due_soon", "completed")


class AlertClass(OrderedEvents):
    """A schedule with the class it is counted under. A completion, or a date that passes,
    moves it to another class: two signed rows of its rig, old class out and new class in."""

    EVENT = CompletionOrder.EVENT
    STATE = "rig long, frequency_days int, next_due_date date, alert_days int, status string, counted string"

    def __init__(self, start: dt.date):
        self.start = start

    def _class(self, due, alert_days, status, today):
        if status == "Completed":
            return "completed"
        if status is None or status in S.CLOSED or due is None:
            return None
        if due < today:
            return "overdue"
        return "due_soon" if alert_days is not None and due <= today + dt.timedelta(days=alert_days) else None

    def _next(self, due, alert_days, status, today):
        """The next day on which the class changes by itself, in microseconds."""
        if status is None or status in S.CLOSED or due is None or due < today:
            return None
        soon = due - dt.timedelta(days=alert_days) if alert_days is not None else None
        day = soon if soon is not None and today < soon <= due else due + dt.timedelta(days=1)
        return (day - dt.date(1970, 1, 1)).days * DAY - 1

    def handleInitialState(self, key, initialState, timerValues):
        r = initialState.astype(object).where(initialState.notna(), None).iloc[0]
        rig, freq, alert = (None if r[c] is None else int(r[c]) for c in ("rig", "frequency_days", "alert_days"))
        due, status = r["next_due_date"], r["status"]
        self.state.update((rig, freq, due, alert, status, self._class(due, alert, status, self.start)))
        again = self._next(due, alert, status, self.start)
        if again is not None:
            self.wake(again)

    def fold(self, key, state, ev, edge):
        if state is None:
            return None, None, None
        rig, freq, due, alert, status, counted = state
        if len(ev):
            done, dues = _complete(ev, freq)
            if done.any():
                due, status = dues[int(np.flatnonzero(done)[-1])], "Scheduled"
        today = max(self.start, dt.date(1970, 1, 1) + dt.timedelta(days=edge // DAY))
        new = self._class(due, alert, status, today)
        out = None
        if new != counted and rig is not None:
            out = pd.DataFrame([{c: (c == new) - (c == counted) for c in ALERTS}]).assign(rig=rig)
        return (rig, freq, due, alert, status, new), out, self._next(due, alert, status, today)


def alert_change_stream(completions: DataFrame, schedules: DataFrame, assets: DataFrame, start: dt.date,
                        ts: str = "ts", lateness: str = "1 hour") -> DataFrame:
    """K5: signed changes of the per-rig counts since ``start``, the day of the initial view.
    A change takes effect when the watermark passes it: after a trigger the view stands as of
    the watermark's day."""
    a = assets.select(F.col("id").alias("_a"), F.col("rig_id").cast("long").alias("rig"))
    s = schedules.join(a, schedules["asset_id"] == a["_a"], "left")
    init = s.select(F.col("id").cast("string").alias("_gk"), "rig", F.col("frequency_days").cast("int"), "next_due_date",
                    F.col("alert_days").cast("int"), "status").groupBy("_gk")
    return _run(_keyed_completions(completions, schedules, ts, lateness), "_gk", AlertClass(start), ALERT_CHANGE_OUT, init)


def alert_view_writer(spark: SparkSession, initial: DataFrame, root: str):
    """``foreachBatch`` function: the trigger's changes, summed per rig, added to the view of
    the trigger before (``initial``: ``rig`` and the counts). One row per rig is read and written."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        view = state_before(spark, root, batch_id, initial.select("rig", *ALERTS))
        both = view.unionByName(batch.select("rig", *ALERTS))
        write_version(both.groupBy("rig").agg(*[F.sum(c).cast("bigint").alias(c) for c in ALERTS]), root, batch_id + 1)
    return handle


def initial_alerts(assets: DataFrame, schedules: DataFrame, start: dt.date) -> DataFrame:
    """The per-rig counts as of ``start`` (D7's figures), from which the view goes on."""
    return R.schedules_per_rig(assets, schedules, start).select(F.col("_k").cast("long").alias("rig"), *ALERTS)
