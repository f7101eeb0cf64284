import random

from pyspark.sql import functions as F

from rigflow.llm.mixing import SCHEDULES, demand_time, mix, plan_mix

from .conftest import EDGE


def filled(sizes):
    """Targets by sharing again and again."""
    keys = sorted((k for k in sizes if k is not None)) + [None] * (None in sizes)
    weight = {k: 1 + i % 3 for i, k in enumerate(keys)}
    target, left, open_ = dict.fromkeys(keys, 0.0), float(sum(sizes.values())), set(keys)
    while left > 1e-9 and open_:
        total = sum(weight[k] for k in open_)
        share, left = left, 0.0
        for k in sorted(open_, key=str):
            target[k] += share * weight[k] / total
            if target[k] >= 3 * sizes[k]:
                left += target[k] - 3 * sizes[k]
                target[k] = 3.0 * sizes[k]
                open_.discard(k)
    return target


def test_targets_and_taken(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 200])), r.choice(["a", "b", "c", "tiny", None])) for i in range(600)]
    rows = [x for x in rows if x[2] != "tiny" or r.random() < 0.05]
    got = plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want, source = filled(sizes), {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for x in got:
        s = source[x.doc_id]
        assert x.source_size == sizes[s] and abs(x.target - want[s]) < 1e-6
        assert 0 <= x.taken <= 3 * x.size and x.times == sorted(x.times) and all(0 <= t <= 1 for t in x.times)
        taken[s] += x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 100        # half of the largest document


def test_a_document_longer_than_the_gap(spark):
    r = random.Random(3)
    sizes = [r.randrange(50, 401) for _ in range(500)]
    total = sum(sizes)
    for first, long in ((0, 60_000), (2000, 200_000)):
        rows = [(first + i, "w " * n, "a") for i, n in enumerate(sizes)] + [(first + 999, "w " * long, "a")]
        rows += [(9_000 + i, "w " * 300, "b") for i in range(2 * (total + long) // 300)]      # a's target is half its size
        got = [x for x in plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 5)).collect() if x.doc_id < 9_000]
        taken = sum(x.taken for x in got)
        assert abs(taken - got[0].target) <= 400, (long, taken, got[0].target)
        assert all(x.times == sorted(x.times) and len(x.times) <= 3 and all(0 <= t <= 1 for t in x.times) for x in got)


def test_demand_is_the_inverse_of_the_schedule(spark):
    parts = [k / 50 for k in range(51)]
    for knots in SCHEDULES + ((2.0, 2.0), (0.0, 1.0)):
        times = [r[0] for r in spark.createDataFrame([(p,) for p in parts], "q double").select(demand_time(F.col("q"), knots)).collect()]
        n = len(knots) - 1
        fine = 2000

        def integral(t):
            w = lambda x: knots[min(int(x * n), n - 1)] + (knots[min(int(x * n), n - 1) + 1] - knots[min(int(x * n), n - 1)]) * (x * n - min(int(x * n), n - 1))  # noqa: E731, B023
            return sum(w(t * (k + 0.5) / fine) for k in range(fine)) * t / fine

        whole = integral(1.0)
        for p, t in zip(parts, times):
            assert abs(integral(t) / whole - p) < 1e-4


def test_stream_order_and_edge_cases(edge, empty):
    plan = plan_mix(edge).collect()
    assert len(plan) == len(EDGE) and all(x.taken == 0 for x in plan if x.size == 0)
    rows = mix(edge)
    assert rows.columns == edge.columns
    ids = [r.doc_id for r in rows.select("doc_id").collect()]
    assert 3 not in ids and 6 in ids
    assert ids == [r.doc_id for r in mix(edge).select("doc_id").collect()]
    assert plan_mix(empty).count() == 0 and mix(empty).count() == 0


def test_rows_without_ids_and_repeated_ids_are_documents_of_their_own(spark):
    for ids in ([None] * 100, [7] * 100, [7] * 50 + [None] * 50):
        rows = [(d, f"text {i} " + "w " * (i % 9), "a") for i, d in enumerate(ids)]
        assert mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).count() == 100
    same = spark.createDataFrame([(7, "one two three", "a")] * 100, "doc_id long, text string, source string")
    assert mix(same).count() == 100 and sum(r.taken for r in plan_mix(same).collect()) == 300


def test_partitionings_agree(spark):
    r = random.Random(9)
    rows = [(r.choice([None, 1, 2, i]), "w " * r.randrange(1, 30), r.choice("abc"), i % 4) for i in range(400)]
    found = set()
    for n in (1, 3, 7):
        r.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int").repartition(n)
        plan = sorted(map(str, plan_mix(docs).select("doc_id", "size", "target", "times").collect()))
        found.add((str(plan), str([tuple(x) for x in mix(docs).collect()])))
    assert len(found) == 1
