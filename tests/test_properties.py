"""Properties over the driver data (sf0.001): totals add up, accepted + rejected =
commands, reruns are idempotent, trees account for every item."""

import pytest
from pyspark.sql import functions as F

from rigflow.operators import changes as C
from rigflow.operators import hierarchy as H
from rigflow.operators import quality as Q
from rigflow.operators import reports as R
from rigflow.operators import workflow as W
from rigflow.plans.catalog import AS_OF, domain

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def d(spark):
    return domain(spark, SMOKE)


def test_rig_totals_plus_unassigned_equal_all(d):
    per_rig = R.maintenance_by_rig(d.rigs, d.assets, d.schedules, AS_OF).agg(F.sum("total_tasks")).first()[0]
    no_rig = d.schedules.join(d.assets.where(F.col("rig_id").isNull()).select(F.col("id").alias("a")),
                              F.col("asset_id") == F.col("a"), "left_semi").count()
    orphan = d.schedules.join(d.assets.select(F.col("id").alias("a")), F.col("asset_id") == F.col("a"),
                              "left_anti").count()
    assert per_rig + no_rig + orphan == d.schedules.count()


def test_commands_are_accepted_or_rejected(d):
    v = Q.validate_commands(d.asset_creates, "asset_create")
    assert v["accepted"].count() + v["rejected"].count() == d.asset_creates.count()
    res = W.fold_decisions(d.transfers, d.decisions)
    ev = res["events"]
    assert ev.count() == d.decisions.count()
    assert ev.where(F.col("accepted")).count() + ev.where(F.col("reason").isNotNull()).count() == ev.count()


def test_insert_ignore_and_delete_are_idempotent(d):
    batch = Q.validate_commands(d.asset_creates, "asset_create")["accepted"].drop("role")
    once = C.insert_ignore(d.assets, batch, "asset_id")
    twice = C.insert_ignore(once, batch, "asset_id")
    assert once.count() == twice.count()
    keys = d.assets.where(F.col("status") == "Inactive").select("id")
    t = {"assets": d.assets, "maintenance_schedules": d.schedules}
    one = C.delete_cascade(t, "assets", keys, complete=False)
    two = C.delete_cascade(one, "assets", keys, complete=False)
    assert one["maintenance_schedules"].count() == two["maintenance_schedules"].count()


def test_tree_accounts_for_every_item(d):
    items = d.bom_items
    tree = H.bom_tree(items)
    reached = tree.count()
    assert tree.select("id").distinct().count() == reached
    unreached = items.join(tree.select(F.col("id").alias("t")), F.col("id") == F.col("t"), "left_anti")
    # every unreached item hangs (directly or not) below a missing parent
    orphans = items.where(F.col("parent_id") == -1)
    below = H.subtree(items, orphans).select("id").distinct()
    assert unreached.join(below, "id", "left_anti").count() == 0
    assert reached + unreached.count() == items.count()
