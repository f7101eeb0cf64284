import math

import numpy as np

from rigflow.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int, links string"


def brute(rows, cosine=0.9):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ids = sorted(good)
    near = {i: [j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] / math.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= cosine] for i in ids}
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in near[i]:
                if label[j] < label[i]:
                    label[i], changed = label[j], True
    return {i: (len(near.get(i, [])), label[i]) for i, _ in rows}


def data(seed=1, n=500, dim=24):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(30, dim))
    x = np.concatenate([r.normal(size=(n, dim)), centres[r.integers(0, 30, n)] + r.normal(size=(n, dim)) * r.choice([0.05, 0.2, 0.35, 0.45], (n, 1)), np.repeat(centres[:2], 40, axis=0)])
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]


def test_against_brute_force(spark, monkeypatch):
    rows = data()
    for tile in (E.TILE, 64):                                   # one tile, then many
        monkeypatch.setattr(E, "TILE", tile)
        got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame([(*r, 0, "x") for r in rows], SCHEMA).repartition(5)).collect()}
        assert got == brute(rows)


def test_edge_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]),
            (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.01]), (12, [0.0, -0.0]), (13, [1.0]), (14, [3e38, 0.0])]
    frame = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(frame).collect()}
    assert got == brute(rows) and got[14] == (3, 1)
    more = frame.unionByName(spark.createDataFrame([(None, [1.0, 0.0], 1, "x"), (1, [1.0, 0.0], 1, "x")], SCHEMA))
    rows2 = E.near_vectors(more).collect()
    assert len(rows2) == len(rows) + 2
    assert [(r.n_links, r.component_id, r.kept) for r in rows2 if r.vec_id is None] == [(0, None, True)]
    assert {r.n_links for r in rows2 if r.vec_id == 1} == {4}
    assert E.near_vectors(frame.limit(0)).count() == 0
