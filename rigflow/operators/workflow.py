"""Two-stage transfer approval as a set-based fold over ordered decision events.

State machine (start: the stored status, Pending for new transfers):

    Pending       --ops approve/reject/hold-->  Ops Approved / Rejected / On Hold
    Pending       --cancel-->                   removed
    Ops Approved  --mgr approve/reject/hold-->  Completed / Rejected / On Hold
    On Hold       --cancel-->                   removed
    Completed, Rejected, removed: final

An event is checked in the source's order: role, action, comment, transfer found, status.
A transfer can accept at most three events, so the fold is three rounds of "first valid
event after the last accepted one" — a grouped ``min(struct(seq, …))`` per transfer each
round (partial aggregation map-side: a transfer with a huge event stream never gathers its
events in one task). Every other event is rejected with the reason and the state at its
moment. No per-row Python, no loop over data.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .changes import touched_at

# Who may decide at each stage, and the action → status maps.
STAGE_ROLES = {
    "ops": ("Admin", "Operations Manager"),
    "mgr": ("Admin", "Asset Manager"),
    "cancel": ("Admin", "Asset Manager", "Operations Manager", "Editor"),
}
ACTIONS = ("approve", "reject", "hold")
OPS_RESULT = {"approve": "Ops Approved", "reject": "Rejected", "hold": "On Hold"}
MGR_RESULT = {"approve": "Completed", "reject": "Rejected", "hold": "On Hold"}
REMOVED = "Removed"
HEAVY = 4_096            # at most so many transfers hold 1/HEAVY of the events each
RECIPIENTS = 100_000     # users of a role that one task pairs with the messages


def _case(col: Column, mapping: dict) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


def precheck(decisions: DataFrame) -> DataFrame:
    """Add ``pre_reason``: role / action / comment, the checks that need no state."""
    st = F.col("stage")
    role_ok = (F.when(st == "ops", F.col("actor_role").isin(*STAGE_ROLES["ops"]))
                .when(st == "mgr", F.col("actor_role").isin(*STAGE_ROLES["mgr"]))
                .otherwise(F.col("actor_role").isin(*STAGE_ROLES["cancel"])))
    action_ok = (st == "cancel") | F.col("action").isin(*ACTIONS)
    comment_ok = (st == "cancel") | (F.coalesce(F.length(F.trim("comment")), F.lit(0)) > 0)
    return decisions.withColumn(
        "pre_reason", F.when(~F.coalesce(role_ok, F.lit(False)), "role")
                       .when(~F.coalesce(action_ok, F.lit(False)), "action")
                       .when(~F.coalesce(comment_ok, F.lit(False)), "comment"))


def _allowed(state: Column) -> Column:
    """Stage accepted in ``state`` (as a predicate on the event's ``stage``)."""
    st = F.col("stage")
    return (((state == "Pending") & st.isin("ops", "cancel"))
            | ((state == "Ops Approved") & (st == "mgr"))
            | ((state == "On Hold") & (st == "cancel")))


def _transition(state: Column, stage: Column, action: Column) -> Column:
    return (F.when(stage == "cancel", F.lit(REMOVED))
             .when(stage == "ops", _case(action, OPS_RESULT))
             .otherwise(_case(action, MGR_RESULT)))


def fold_decisions(transfers: DataFrame, decisions: DataFrame, key: str = "id",
                   status_col: str = "status", code_col: str = "transfer_id") -> dict[str, DataFrame]:
    """Run the approval workflow for a batch of decision events.

    ``transfers``: key + stored status (+ code). ``decisions``: seq, transfer_key (id or
    code), stage, action, comment, actor_role (optional actor_id, ts). Returns:
      ``state``    one row per transfer: final status (``Removed`` when cancelled), the
                   accepted ops / mgr / cancel events (seq, action, comment, role, ts);
      ``events``   every decision with ``accepted`` and, if rejected, ``reason`` and the
                   ``state_at`` its moment.
    """
    ev = precheck(decisions)
    if "actor_id" not in ev.columns:
        ev = ev.withColumn("actor_id", F.lit(None).cast("string"))
    if "ts" not in ev.columns:
        ev = ev.withColumn("ts", F.lit(None).cast("timestamp"))
    known = transfers.select(F.col(key).alias("_tk"), F.col(status_col).alias("s0"))
    # a decision names a transfer by its id or by its code
    names = known.select(F.col("_tk").cast("string").alias("_name"), "_tk")
    if code_col in transfers.columns:
        # (a name that is one transfer's id and another's code means the id)
        codes = transfers.select(F.col(code_col).alias("_name"), F.col(key).alias("_tk"))
        names = names.unionByName(codes.join(names.select("_name"), "_name", "left_anti"))
    ev = ev.join(names, ev["transfer_key"].cast("string") == names["_name"], "left").drop("_name")
    found = F.col("_tk").isNotNull()
    valid = ev.where(found & F.col("pre_reason").isNull()).select(
        F.col("_tk").alias("_t"), "seq", "stage", "action", "comment", "actor_role", "actor_id", "ts")
    # read by all three rounds: kept once (recomputed from lineage if an executor is lost)
    valid = valid.persist(StorageLevel.MEMORY_AND_DISK)
    # Transfers with at least 1/HEAVY of the events number HEAVY at most, so their states are
    # broadcast and their events meet only in partial minima; all others join by key.
    counts, _ = materialize(valid.groupBy("_t").agg(F.count("*").alias("n")), "event-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = F.broadcast(counts.where(F.col("n") >= max(1000, -(-total // HEAVY))).select("_t"))
    light_events = valid.join(heavy, "_t", "left_anti")

    state = known.select(F.col("_tk").alias("_t"), F.col("s0").alias("state"),
                         F.lit(None).cast("bigint").alias("last_seq"))
    ecols = ["seq", "stage", "action", "comment", "actor_role", "actor_id", "ts"]
    accepted = []
    for rnd in (1, 2, 3):
        # only transfers still able to accept an event meet the event stream
        live = state.where(F.col("state").isin("Pending", "Ops Approved", "On Hold"))
        live = live.select("_t", "state", "last_seq")
        few = F.broadcast(live.join(heavy, "_t", "left_semi"))
        cand = valid.join(few, "_t").unionByName(light_events.join(live, "_t")).where(
            _allowed(F.col("state")) & (F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))))
        first = cand.groupBy("_t").agg(F.min(F.struct(*ecols)).alias("e"))
        st = state.select("_t", "state", "last_seq").join(first, "_t", "left")
        hit = F.col("e").isNotNull()
        # one small table per round: every transfer's state after it, plus the event the
        # round accepted (written once, so the next round and the final joins read files)
        state, _ = materialize(st.select(
            "_t",
            F.when(hit, _transition(F.col("state"), F.col("e.stage"), F.col("e.action")))
             .otherwise(F.col("state")).alias("state"),
            F.coalesce(F.col("e.seq"), F.col("last_seq")).alias("last_seq"),
            *[F.col(f"e.{c}").alias(f"e_{c}") for c in ecols]), f"round{rnd}")
        accepted.append(state.where(F.col("e_seq").isNotNull()).select(
            "_t", *[F.col(f"e_{c}").alias(c) for c in ecols], F.lit(rnd).alias("round")))
    valid.unpersist()

    acc = accepted[0].unionByName(accepted[1]).unionByName(accepted[2])
    # state after each accepted event, to place rejected events in time
    chain = acc.select("_t", "seq", "round", "stage", "action")
    per = (chain.groupBy("_t")
           .agg(*[F.max(F.when(F.col("round") == r, F.struct("seq", "stage", "action"))).alias(f"a{r}")
                  for r in (1, 2, 3)]))
    s = known.join(per, known["_tk"] == per["_t"], "left").drop("_t")
    s1 = F.when(F.col("a1").isNotNull(), _transition(F.col("s0"), F.col("a1.stage"), F.col("a1.action")))
    s = s.withColumn("s1", s1)
    s = s.withColumn("s2", F.when(F.col("a2").isNotNull(),
                                  _transition(F.col("s1"), F.col("a2.stage"), F.col("a2.action"))))
    s = s.withColumn("s3", F.when(F.col("a3").isNotNull(),
                                  _transition(F.col("s2"), F.col("a3.stage"), F.col("a3.action"))))
    s = s.withColumn("final_status", F.coalesce("s3", "s2", "s1", "s0"))

    # ---- per-event classification
    marks = s.select(F.col("_tk").alias("_m"), "s0", "s1", "s2", "s3",
                     F.col("a1.seq").alias("q1"), F.col("a2.seq").alias("q2"), F.col("a3.seq").alias("q3"))
    e = ev.join(marks, ev["_tk"] == marks["_m"], "left").drop("_m")
    q = F.col("seq")
    state_at = (F.when(F.col("q1").isNull() | (q < F.col("q1")), F.col("s0"))
                 .when(F.col("q2").isNull() | (q < F.col("q2")), F.col("s1"))
                 .when(F.col("q3").isNull() | (q < F.col("q3")), F.col("s2"))
                 .otherwise(F.col("s3")))
    is_acc = found & ((q == F.col("q1")) | (q == F.col("q2")) | (q == F.col("q3")))
    is_acc = F.coalesce(is_acc, F.lit(False))
    e = e.withColumn("state_at", F.when(found, state_at))
    reason = (F.when(is_acc, F.lit(None))
               .when(F.col("pre_reason").isNotNull(), F.col("pre_reason"))
               .when(~found | (F.col("state_at") == REMOVED), F.lit("not_found"))
               .otherwise(F.lit("status")))
    events = e.select("seq", "transfer_key", "stage", "action", "actor_role", "ts",
                      is_acc.alias("accepted"), reason.alias("reason"),
                      F.when(~is_acc, F.col("state_at")).alias("state_at"))

    # ---- final per-transfer record: who decided what, when
    def stage_cols(stage: str, prefix: str):
        a = acc.where(F.col("stage") == stage).groupBy("_t").agg(
            F.max(F.struct("seq", "action", "comment", "actor_role", "actor_id", "ts")).alias("x"))
        return a.select(F.col("_t").alias(f"_t_{prefix}"),
                        F.col("x.seq").alias(f"{prefix}_seq"), F.col("x.action").alias(f"{prefix}_action"),
                        F.col("x.comment").alias(f"{prefix}_comment"),
                        F.col("x.actor_role").alias(f"{prefix}_role"),
                        F.col("x.actor_id").alias(f"{prefix}_approved_by"),
                        F.col("x.ts").cast("date").alias(f"{prefix}_date"))
    out = s.select(F.col("_tk").alias("transfer_key"), F.col("s0").alias("initial_status"),
                   F.col("final_status").alias("status"))
    for stage, prefix in (("ops", "ops"), ("mgr", "mgr"), ("cancel", "cancel")):
        sc = stage_cols(stage, prefix)
        out = out.join(sc, out["transfer_key"] == sc[f"_t_{prefix}"], "left").drop(f"_t_{prefix}")
    return {"state": out, "events": events}


def apply_state(transfers: DataFrame, state: DataFrame, key: str = "id", now: Column | None = None) -> DataFrame:
    """New transfers table: cancelled (Removed) rows dropped, status and decision columns
    updated from the fold."""
    s = state.select(F.col("transfer_key").alias("_k"), F.col("status").alias("_status"),
                     "ops_action", "ops_comment", "ops_date", "ops_approved_by",
                     "mgr_action", "mgr_comment", "mgr_date", "mgr_approved_by")
    base = transfers.drop(*[c for c in s.columns if c in transfers.columns and c != "_k"])
    j = base.join(s, base[key] == s["_k"], "left").where(F.coalesce(F.col("_status"), F.lit("")) != REMOVED)
    cols = [F.coalesce(F.col("_status"), F.col("status")).alias("status") if c == "status" else F.col(c)
            for c in base.columns]
    dec = ["ops_action", "ops_comment", "ops_date", "ops_approved_by", "mgr_action", "mgr_comment",
           "mgr_date", "mgr_approved_by"]
    if now is not None:
        decided = F.coalesce(F.col("ops_action"), F.col("mgr_action")).isNotNull()
        cols = [c for c, n in zip(cols, base.columns) if n != "updated_at"] + [touched_at(base, decided, now)]
    return j.select(*cols, *dec)


def apply_transfers(assets: DataFrame, transfers: DataFrame, state: DataFrame,
                    key: str = "id", now: Column | None = None) -> dict[str, DataFrame]:
    """For transfers completed by the fold, relocate the asset (location := destination,
    rig / company := destination's when given), write a history row and a broadcast notice.
    Several completed transfers of one asset apply in the order of their final approvals: the
    last location wins, and for rig and company the last that was given."""
    # (a transfer that was stored as Completed has been applied before)
    done = state.where((F.col("status") == "Completed") & F.col("mgr_seq").isNotNull()).select(
        F.col("transfer_key").alias("_k"), F.col("mgr_seq").alias("_seq"), "mgr_approved_by")
    t = transfers.drop("mgr_approved_by").join(done, transfers[key] == done["_k"], "inner")
    tcols = [c for c in ("dest_rig_id", "dest_company_id") if c in t.columns]
    order = ("_seq", F.col(key).alias("_tid"))
    given = [F.max(F.when(F.col(c).isNotNull(), F.struct(*order, F.col(c).alias("v")))).alias(c) for c in tcols]
    last = t.groupBy(F.col("asset_id").alias("_a")).agg(F.max(F.struct(*order, F.col("destination").alias("v"))).alias("x"), *given)
    moves = last.select("_a", F.col("x.v").alias("_dest"), *[F.col(f"{c}.v").alias(f"_{c}") for c in tcols])
    j = assets.join(moves, assets["id"] == moves["_a"], "left")
    hit = F.col("_a").isNotNull()
    cols = []
    for c in assets.columns:
        if c == "location":
            cols.append(F.when(hit, F.col("_dest")).otherwise(F.col(c)).alias(c))
        elif c == "rig_id" and "dest_rig_id" in tcols:
            cols.append(F.coalesce(F.col("_dest_rig_id"), F.col(c)).alias(c))
        elif c == "company_id" and "dest_company_id" in tcols:
            cols.append(F.coalesce(F.col("_dest_company_id"), F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    if now is not None:
        cols = [c for c, n in zip(cols, assets.columns) if n != "updated_at"] + [touched_at(assets, hit, now)]
    new_assets = j.select(*cols)
    code = F.col("transfer_id") if "transfer_id" in t.columns else F.col(key).cast("string")
    history = t.select(F.col("asset_id"), F.lit("Transfer Completed").alias("action"),
                       F.col("mgr_approved_by").alias("changed_by"),
                       F.format_string("Transferred to %s via %s", F.col("destination"), code).alias("notes"))
    notices = t.select(F.lit(None).cast("string").alias("user_id"), F.lit("success").alias("type"),
                       F.lit("check-double").alias("icon"), F.lit("Transfer Completed").alias("title"),
                       F.format_string("Transfer %s fully approved – asset relocated", code).alias("description"),
                       F.lit("transfer").alias("entity_type"), F.col(key).alias("entity_id"))
    return {"assets": new_assets, "history": history, "notices": notices}


def cancel_transfers(transfers: DataFrame, requests: DataFrame, key_cols: list[str] | None = None,
                     role_col: str = "actor_role") -> dict[str, DataFrame]:
    """Delete requested transfers that are Pending or On Hold; the rest are refused
    (role, or 'not_found_or_not_cancellable' as the source answers)."""
    from .changes import resolve_keys
    key_cols = key_cols or ["id"]
    r = resolve_keys(requests, transfers, key_cols)
    st = transfers.select(F.col("id").alias("_sid"), F.col("status").alias("_st"))
    r = r.join(st, r["_id"] == st["_sid"], "left")
    reason = (F.when(~F.coalesce(F.col(role_col).isin(*STAGE_ROLES["cancel"]), F.lit(False)), "role")
               .when(F.col("_id").isNull() | ~F.coalesce(F.col("_st").isin("Pending", "On Hold"), F.lit(False)),
                     "not_found_or_not_cancellable"))
    r = r.withColumn("reason", reason)
    gone = r.where(F.col("reason").isNull()).select(F.col("_id").alias("_g")).dropDuplicates()
    table = transfers.join(gone, transfers["id"] == gone["_g"], "left_anti")
    return {"transfers": table, "rejected": r.where(F.col("reason").isNotNull()).drop("_sid", "_st")}


def notify_role(messages: DataFrame, users: DataFrame, roles: tuple[str, ...],
                salts: int | None = None) -> DataFrame:
    """One notice per (message, user whose role is in ``roles``), users active or not.

    An equi-join on (role, salt): a role has few distinct values, so joining on it alone
    would send every recipient of a role to one task once the users side is too big to
    broadcast. Users are spread over ``salts`` buckets by a hash of their id and every
    message is copied once per bucket; each (message, user) pair still meets exactly once.
    The number of buckets follows the measured number of recipients (one for every
    ``RECIPIENTS`` of them), so few recipients mean no copies.
    """
    n = salts or max(1, -(-users.where(F.col("role").isin(*roles)).count() // RECIPIENTS))
    m = (messages.withColumn("_role", F.explode(F.array(*[F.lit(r) for r in roles])))
         .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))))
    u = (users.where(F.col("role").isin(*roles))
         .select(F.col("id").alias("user_id"), F.col("role").alias("_urole"),
                 F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("_usalt")))
    cond = (m["_role"] == u["_urole"]) & (m["_salt"] == u["_usalt"])
    return m.join(u, cond, "inner").drop("_role", "_urole", "_salt", "_usalt")


def ops_approval_notices(state: DataFrame, transfers: DataFrame, users: DataFrame, key: str = "id") -> DataFrame:
    """J8d: after an accepted ops approval, notify every Admin and Asset Manager."""
    appr = state.where(F.col("ops_action") == "approve").select(F.col("transfer_key").alias("entity_id"))
    code = (transfers.select(F.col(key).alias("_k"),
                             (F.col("transfer_id") if "transfer_id" in transfers.columns
                              else F.col(key).cast("string")).alias("_code")))
    m = appr.join(code, appr["entity_id"] == code["_k"], "left").select(
        F.lit("info").alias("type"), F.lit("user-tie").alias("icon"),
        F.lit("Transfer Awaiting Final Approval").alias("title"),
        F.format_string("Transfer %s approved by Ops Manager – needs your final decision",
                        F.col("_code")).alias("description"),
        F.lit("transfer").alias("entity_type"), "entity_id")
    return notify_role(m, users, ("Admin", "Asset Manager"))


def submit_transfers(submissions: DataFrame, assets: DataFrame, users: DataFrame,
                     as_of=None) -> dict[str, DataFrame]:
    """New transfer requests. The asset key may be its id or code; the current
    location is copied from the asset; defaults fill type and request date; each
    Operations Manager gets a notice. Returns ``{"transfers", "rejected", "notices"}``."""
    from ..functions.status import as_of_col
    from .changes import resolve_keys
    from .quality import validate_commands
    from ..functions.status import null_if_empty
    # optional fields: an empty value means "not given" (stored as NULL)
    for c in ("dest_rig_id", "dest_company_id", "instructions", "required_date"):
        if c in submissions.columns:
            submissions = submissions.withColumn(c, null_if_empty(c))
    v = validate_commands(submissions, "transfer_create", action="create", role_col="actor_role")
    acc = resolve_keys(v["accepted"].withColumnRenamed("asset_key", "key"), assets, ["id", "asset_id"])
    loc = assets.select(F.col("id").alias("_aid"), F.col("location").alias("current_location"))
    acc = acc.join(loc, acc["_id"] == loc["_aid"], "left").drop("_aid")
    missing = acc.where(F.col("_id").isNull()).withColumn("reasons", F.array(F.lit("asset_not_found")))
    ok = acc.where(F.col("_id").isNotNull())
    new = ok.select("transfer_id", F.col("_id").alias("asset_id"), "current_location", "destination",
                    *[c for c in ("dest_rig_id", "dest_company_id", "priority") if c in ok.columns],
                    F.coalesce(F.col("transfer_type") if "transfer_type" in ok.columns else F.lit(None),
                               F.lit("Field to Field")).alias("transfer_type"),
                    "reason", F.col("actor_id").alias("requested_by") if "actor_id" in ok.columns
                    else F.lit(None).alias("requested_by"),
                    F.coalesce(F.col("request_date") if "request_date" in ok.columns else F.lit(None),
                               as_of_col(as_of)).alias("request_date"),
                    F.lit("Pending").alias("status"))
    msgs = new.select(F.lit("info").alias("type"), F.lit("exchange-alt").alias("icon"),
                      F.lit("New Transfer Request").alias("title"),
                      F.format_string("Transfer request %s submitted for your review",
                                      F.col("transfer_id")).alias("description"),
                      F.lit("transfer").alias("entity_type"), F.col("transfer_id").alias("entity_id"))
    notices = notify_role(msgs, users, ("Operations Manager",))
    rejected = v["rejected"].unionByName(missing.drop("_id", "current_location").withColumnRenamed("key", "asset_key"),
                                         allowMissingColumns=True)
    return {"transfers": new, "rejected": rejected, "notices": notices}
