"""BOM tree / subtree against brute force on invented items: a 3-level tree, an orphan,
a two-node cycle, siblings whose names sort against id order, a cross-asset child."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rigflow.operators import hierarchy as H

ITEMS = [  # id, asset, parent, name, qty, cost, type, status
    ("r1", "A", None, "Root", 1, 100, "Serialized", "Active"),
    ("c2", "A", "r1", "Zeta", 2, 10, "Bulk", "Active"),
    ("c1", "A", "r1", "Alpha", 1, 5, "Serialized", "On Order"),
    ("g1", "A", "c1", "Gear", 3, 1, "Bulk", "Obsolete"),
    ("o1", "A", "missing", "Orphan", 1, 7, "Serialized", "Active"),
    ("o2", "A", "o1", "Orphan child", 1, 7, "Serialized", "Active"),
    ("y1", "A", "y2", "Cycle one", 1, 1, "Serialized", "Active"),
    ("y2", "A", "y1", "Cycle two", 1, 1, "Serialized", "Active"),
    ("r2", "B", None, "Other root", 1, 50, "Serialized", "Active"),
    ("x1", "B", "r1", "Cross-asset child", 1, 3, "Bulk", "Active"),
]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(i, a, p, n, Decimal(q), Decimal(c), t, s) for i, a, p, n, q, c, t, s in ITEMS],
        "id string, asset_id string, parent_id string, name string, quantity decimal(12,3), "
        "unit_cost_usd decimal(18,2), item_type string, status string")


def brute_tree():
    out = {}
    def walk(node, depth, path):
        out[node[0]] = (depth, path)
        for ch in sorted((i for i in ITEMS if i[2] == node[0] and i[1] == node[1]), key=lambda i: i[3]):
            walk(ch, depth + 1, path + [ch[0]])
    for root in (i for i in ITEMS if i[2] is None):
        walk(root, 0, [root[0]])
    return out


def test_tree_matches_brute_force(items):
    got = {r.id: (r.depth, r.path_ids.split("/")) for r in H.bom_tree(items).collect()}
    assert got == brute_tree()
    assert "o1" not in got and "y1" not in got and "x1" not in got


def test_outline_order_siblings_by_name(items):
    order = [r.id for r in H.bom_outline(items).where(F.col("asset_id") == "A").orderBy("place").collect()]
    assert order == ["r1", "c1", "g1", "c2"]


def test_subtree_stops_on_cycle_and_crosses_assets(spark, items):
    seeds = spark.createDataFrame([("r1",), ("y1",), ("nope",)], "id string")
    got = {}
    for r in H.subtree(items, seeds).collect():
        got.setdefault(r.seed_id, set()).add(r.id)
    assert got["r1"] == {"r1", "c1", "c2", "g1", "x1"}
    assert got["y1"] == {"y1", "y2"}
    assert "nope" not in got
    counts = {r.seed_id: r.delete_count for r in H.subtree_counts(H.subtree(items, seeds)).collect()}
    assert counts == {"r1": 5, "y1": 2}


def test_subtree_cost_and_summary(items):
    cost = {r.id: r.subtree_cost for r in H.subtree_cost(items).collect()}
    assert cost["r1"] == Decimal("100") + 20 + 5 + 3
    assert cost["c1"] == Decimal("8") and cost["g1"] == Decimal("3")
    s = {r.asset_id: r for r in H.bom_tree_summary(items).collect()}
    assert s["A"].total == 8 and s["A"].in_tree == 4 and s["A"].on_order == 1
    assert s["B"].total == 2 and s["B"].in_tree == 1


def test_long_chain_and_ids_with_slashes(spark):
    rows = [(f"x/{i}", "A", f"x/{i - 1}" if i else None, "n", "Bulk", Decimal("2"), Decimal("1.50"), "Active") for i in range(100)]
    chain = spark.createDataFrame(rows, "id string, asset_id string, parent_id string, name string, item_type string, "
                                        "quantity decimal(12,3), unit_cost_usd decimal(18,2), status string")
    assert H.bom_tree(chain, paths=False).agg({"depth": "max"}).first()[0] == 99
    cost = {r.id: (r.subtree_cost, r.subtree_size) for r in H.subtree_cost(chain).collect()}
    assert cost["x/0"] == (Decimal("300.00"), 100) and cost["x/99"] == (Decimal("3.00"), 1)
    assert H.reachable(chain, chain.where("id IN ('x/90', 'x/95')").select("id")).count() == 10


def test_reachable_on_a_cycle(spark):
    items = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", None)], "id string, parent_id string")
    assert {r.id for r in H.reachable(items, items.where("id = 'b'").select("id")).collect()} == {"a", "b", "c", "d"}


def test_doubling_takes_log_rounds_and_ends_on_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(100)], "id long, up long")
    state, left, rounds = H._double(chain)
    assert left == 0 and rounds <= 8 and state.agg({"depth": "max"}).first()[0] == 99
    ring = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, 3), (5, None), (6, 5)], "id long, up long")
    state, left, rounds = H._double(ring)
    assert left == 4 and rounds <= 3 and {r.id for r in state.where("up IS NULL").collect()} == {5, 6}


def test_random_forests_against_brute_force(spark, monkeypatch):
    """Orphans, cycles, links across assets, nested seeds; intervals over many small blocks."""
    monkeypatch.setattr(H, "BLOCK", 4)
    r = random.Random(6)
    rows = []
    for i in range(160):
        parent = None if r.random() < 0.1 else r.choice([r.randrange(max(i, 1)), r.randrange(160), 999 if r.random() < 0.2 else r.randrange(max(i, 1))])
        rows.append((i, r.randrange(2), parent, r.choice("abc"), Decimal(r.randrange(5)), Decimal(r.randrange(9)), "Bulk", "Active"))
    items = spark.createDataFrame(rows, "id long, asset_id int, parent_id long, name string, quantity decimal(12,3), unit_cost_usd decimal(18,2), item_type string, status string")
    by = {x[0]: x for x in rows}

    def walk(seed):
        out, level, depth = {seed: 0}, [seed], 0
        while level:
            depth += 1
            level = [x[0] for x in rows if x[2] in level and x[0] not in out]
            out.update(dict.fromkeys(level, depth))
        return out

    seeds = r.sample(range(160), 40)
    want = {(s, i, d) for s in seeds for i, d in walk(s).items()}
    frame = spark.createDataFrame([(s,) for s in seeds + [12345]], "id long")
    assert {tuple(x) for x in H.subtree(items, frame).select("seed_id", "id", "depth").collect()} == want
    assert {tuple(x) for x in H.subtree_sizes(items, frame).collect()} == {(s, len(walk(s)), max(walk(s).values())) for s in seeds}

    places, costs = {}, {}

    def visit(i, depth):
        asset = by[i][1]
        places[i] = (asset, sum(1 for j in places if by[j][1] == asset), depth)
        size, cost = 1, by[i][4] * by[i][5]
        for c in sorted((x for x in rows if x[2] == i and x[1] == asset), key=lambda x: (x[3], x[0])):
            s, m = visit(c[0], depth + 1)
            size, cost = size + s, cost + m
        costs[i] = (size, cost)
        return size, cost

    for root in sorted((x for x in rows if x[2] is None), key=lambda x: (x[3], x[0])):
        visit(root[0], 0)
    got = H.bom_places(items).collect()
    assert {x.id: (x.asset_id, x.place, x.depth) for x in got} == places
    assert {x.id: (x.size, x.cost) for x in got} == costs
    assert {x.id: (x.subtree_size, x.subtree_cost) for x in H.subtree_cost(items).collect()} == costs


def test_rounds_run_in_small_tasks_and_the_outline_carries_no_costs(spark, monkeypatch):
    seen, write = [], H.materialize
    monkeypatch.setattr(H, "materialize", lambda df, name: seen.append((name, spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"), df.columns)) or write(df, name))
    items = spark.createDataFrame([(i, 1, i // 2 if i > 1 else None, f"n{i}", 1, 2) for i in range(1, 8)], "id long, asset_id long, parent_id long, name string, quantity int, unit_cost_usd int")
    assert [(r.id, r.size) for r in H.bom_outline(items).orderBy("place").collect()] == [(1, 7), (2, 3), (4, 1), (5, 1), (3, 3), (6, 1), (7, 1)]
    assert {r.seed_id: (r.delete_count, r.max_depth) for r in H.subtree_sizes(items, items.where("id < 3")).collect()} == {1: (7, 2), 2: (3, 1)}
    assert H.subtree(items, items.where("id < 3")).count() == 10
    assert {size for name, size, _ in seen if name in ("doubling", "sized", "places", "sizes", "below")} == {"4m"}
    assert not any("cost" in c for name, _, c in seen if name == "sized")
