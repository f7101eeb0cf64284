"""Transfer approval fold against a step-by-step simulation on random event lists."""

import random

from pyspark.sql import functions as F

from rigflow.operators import workflow as W

ROLES = ["Admin", "Asset Manager", "Operations Manager", "Editor", "Viewer"]
STAGES = ["ops", "mgr", "cancel"]
ACTIONS = ["approve", "reject", "hold", "bogus"]


def simulate(start, events):
    """Plain sequential state machine: returns final state and (seq -> reason or None)."""
    state, out = start, {}
    for seq, stage, action, comment, role in events:
        if role not in W.STAGE_ROLES[stage]:
            out[seq] = "role"; continue
        if stage != "cancel" and action not in W.ACTIONS:
            out[seq] = "action"; continue
        if stage != "cancel" and not (comment or "").strip():
            out[seq] = "comment"; continue
        if state == W.REMOVED:
            out[seq] = "not_found"; continue
        if stage == "ops" and state == "Pending":
            state = W.OPS_RESULT[action]
        elif stage == "mgr" and state == "Ops Approved":
            state = W.MGR_RESULT[action]
        elif stage == "cancel" and state in ("Pending", "On Hold"):
            state = W.REMOVED
        else:
            out[seq] = "status"; continue
        out[seq] = None
    return state, out


def test_fold_equals_simulation(spark):
    rnd = random.Random(7)
    transfers, decisions, expect = [], [], {}
    seq = 0
    for t in range(400):
        start = rnd.choice(["Pending", "Pending", "Ops Approved", "On Hold", "Completed"])
        transfers.append((f"T{t}", start))
        evs = []
        for _ in range(rnd.randint(0, 8)):
            seq += rnd.randint(1, 3)
            evs.append((seq, rnd.choice(STAGES), rnd.choice(ACTIONS), rnd.choice(["ok", " ", None]),
                        rnd.choice(ROLES)))
        expect[f"T{t}"] = simulate(start, evs)
        decisions += [(s, f"T{t}", st, a, c, r) for s, st, a, c, r in evs]
    decisions.append((seq + 1, "T-missing", "ops", "approve", "ok", "Admin"))
    tdf = spark.createDataFrame(transfers, "id string, status string")
    ddf = spark.createDataFrame(decisions, "seq long, transfer_key string, stage string, action string, "
                                           "comment string, actor_role string")
    res = W.fold_decisions(tdf, ddf)
    final = {r.transfer_key: r.status for r in res["state"].collect()}
    assert final == {k: v[0] for k, v in expect.items()}
    got = {r.seq: r.reason for r in res["events"].collect()}
    want = {s: r for v in expect.values() for s, r in v[1].items()}
    want[seq + 1] = "not_found"
    assert got == want


def test_apply_state_and_notices(spark):
    tdf = spark.createDataFrame([("T1", "TR-1", "A1", "Yard", "R9", "Pending"),
                                 ("T2", "TR-2", "A2", "Dock", None, "Pending"),
                                 ("T3", "TR-3", "A3", "Pier", None, "Pending")],
                                "id string, transfer_id string, asset_id string, destination string, "
                                "dest_rig_id string, status string")
    ddf = spark.createDataFrame([(1, "T1", "ops", "approve", "ok", "Operations Manager"),
                                 (2, "T1", "mgr", "approve", "ok", "Asset Manager"),
                                 (3, "T2", "ops", "hold", "ok", "Admin"),
                                 (4, "T2", "cancel", None, None, "Editor"),
                                 (5, "T3", "mgr", "approve", "ok", "Admin")],
                                "seq long, transfer_key string, stage string, action string, comment string, "
                                "actor_role string")
    res = W.fold_decisions(tdf, ddf)
    new = {r.id: r.status for r in W.apply_state(tdf, res["state"]).collect()}
    assert new == {"T1": "Completed", "T3": "Pending"}
    assets = spark.createDataFrame([("A1", "Old", "R1", "C1"), ("A2", "Old2", "R2", "C2")],
                                   "id string, location string, rig_id string, company_id string")
    moved = W.apply_transfers(assets, tdf, res["state"])
    a = {r.id: (r.location, r.rig_id) for r in moved["assets"].collect()}
    assert a == {"A1": ("Yard", "R9"), "A2": ("Old2", "R2")}
    assert moved["history"].count() == 1 and moved["notices"].first().user_id is None
    users = spark.createDataFrame([("U1", "Admin"), ("U2", "Asset Manager"), ("U3", "Viewer")],
                                  "id string, role string")
    n = W.ops_approval_notices(res["state"], tdf, users)
    assert sorted(r.user_id for r in n.collect()) == ["U1", "U2"]


def test_salted_role_fan_out_pairs_each_recipient_once(spark):
    users = spark.createDataFrame([(f"U{i}", "Admin" if i % 10 else "Viewer") for i in range(500)],
                                  "id string, role string")
    msgs = spark.createDataFrame([(f"M{j}",) for j in range(7)], "entity_id string")
    out = W.notify_role(msgs, users, ("Admin", "Asset Manager"), salts=5)
    pairs = [(r.entity_id, r.user_id) for r in out.collect()]
    assert len(pairs) == len(set(pairs)) == 7 * 450


def test_hot_transfer_fold(spark):
    """One transfer carries most events: the grouped fold still picks the first valid ones."""
    rows = [(i, "HOT", "mgr", "approve", "ok", "Admin") for i in range(1, 3000)]
    rows[1500] = (1501, "HOT", "ops", "approve", "ok", "Admin")
    rows += [(5000, "COLD", "cancel", None, None, "Editor")]
    tdf = spark.createDataFrame([("HOT", "Pending"), ("COLD", "Pending")], "id string, status string")
    ddf = spark.createDataFrame(rows, "seq long, transfer_key string, stage string, action string, "
                                      "comment string, actor_role string")
    st = {r.transfer_key: (r.status, r.ops_seq, r.mgr_seq) for r in W.fold_decisions(tdf, ddf)["state"].collect()}
    assert st["HOT"] == ("Completed", 1501, 1502) and st["COLD"][0] == W.REMOVED


def test_hot_transfer_gives_the_same_states(spark):
    """One transfer with most of the events takes the broadcast path, by id and by code."""
    transfers = spark.createDataFrame([(i, f"TR-{i}", "Pending") for i in range(30)], "id long, transfer_id string, status string")
    rnd = random.Random(3)
    rows = []
    for seq in range(4000):
        t = 7 if rnd.random() < 0.8 else rnd.randrange(30)
        rows.append((seq, str(t) if seq % 2 else f"TR-{t}", rnd.choice(STAGES), rnd.choice(ACTIONS), "ok", rnd.choice(ROLES[2:])))
    got = {r.transfer_key: r.status for r in W.fold_decisions(transfers, spark.createDataFrame(
        rows, "seq long, transfer_key string, stage string, action string, comment string, actor_role string"))["state"].collect()}
    for t in range(30):
        own = [(q, s, a, c, r) for q, k, s, a, c, r in rows if k in (str(t), f"TR-{t}")]
        assert got[t] == simulate("Pending", own)[0]


def test_several_transfers_of_one_asset_apply_in_order(spark):
    assets = spark.createDataFrame([(1, "yard", 1, 10), (2, "yard", 2, 20)], "id long, location string, rig_id long, company_id long")
    transfers = spark.createDataFrame(
        [(101, "T1", 1, "site 7", 7, None, "Ops Approved"), (102, "T2", 1, "dock", None, 30, "Ops Approved"), (103, "T3", 2, "shop", None, None, "Ops Approved")],
        "id long, transfer_id string, asset_id long, destination string, dest_rig_id long, dest_company_id long, status string")
    decisions = spark.createDataFrame([(5, "T2", "mgr", "approve", "ok", "Admin"), (3, "101", "mgr", "approve", "ok", "Admin"), (9, "T3", "mgr", "approve", "ok", "Admin")],
                                      "seq long, transfer_key string, stage string, action string, comment string, actor_role string")
    out = W.apply_transfers(assets, transfers, W.fold_decisions(transfers, decisions)["state"])
    assert {tuple(r) for r in out["assets"].collect()} == {(1, "dock", 7, 30), (2, "shop", 2, 20)}
    assert out["history"].count() == 3


def test_a_name_that_is_an_id_and_a_code_means_the_id(spark):
    transfers = spark.createDataFrame([("A", "B", "Pending"), ("B", "C", "Pending")], "id string, transfer_id string, status string")
    decisions = spark.createDataFrame([(1, "B", "ops", "approve", "ok", "Admin")], "seq long, transfer_key string, stage string, action string, comment string, actor_role string")
    res = W.fold_decisions(transfers, decisions)
    assert res["events"].count() == 1
    assert {(r.transfer_key, r.status) for r in res["state"].collect()} == {("A", "Pending"), ("B", "Ops Approved")}
