import hashlib
import itertools
import random
import re

import pytest

from rigflow.llm import near_dedup
from rigflow.llm.exact_dedup import DigestIndex, exact_dedup, keep_one
from rigflow.llm.near_dedup import keep_one_of_each, near_duplicates

from .conftest import EDGE


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_edge_cases(edge, empty):
    got = exact_dedup(edge).collect()
    assert len(got) == len(EDGE)
    by_text = {}
    for row in EDGE:
        by_text.setdefault(plain(row[1]), []).append(row[0])
    for r in got:
        same = next(v for t, v in by_text.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(same)
        assert r.keep_id == min((i for i in same if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in got) == len(by_text)            # of rows that repeat an id only one stays
    assert exact_dedup(empty).count() == 0
    kept = keep_one(edge)
    assert kept.columns == edge.columns and kept.count() == len(by_text)
    assert keep_one(empty).count() == 0


def test_index_goes_on_over_batches(spark):
    index = DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(5, "a b"), (3, "a  b"), (9, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a b"), (2, "d"), (4, "d")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(first, index).collect()} == {(5, 3, False), (3, 3, True), (9, 9, True)}
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(second, index).collect()} == {(1, 3, False), (2, 2, True), (4, 2, False)}
    assert index.rows().count() == 3
    again = DigestIndex(spark, index.path, buckets=4)          # opened anew from its folder
    assert again.rows().count() == 3
    plan = first.select("doc_id").join(again.rows().hint("merge"), first["doc_id"] == again.rows()["keep_id"])
    assert plan.count() == 2


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def components_of(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_edge_cases(edge, empty):
    got = near_duplicates(edge).collect()
    want = components_of([r[:2] for r in EDGE])
    assert len(got) == len(EDGE)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, True)
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert near_duplicates(empty).count() == 0
    kept = keep_one_of_each(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, 6, 7, 8, 9, 10, None}


def _family(r, n, words, edits):
    base = [f"w{r.randrange(4000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randrange(edits + 1)):
            copy[r.randrange(words)] = f"x{r.randrange(10 ** 6)}"
        yield " ".join(copy)


def test_near_against_brute_force(spark, monkeypatch):
    r = random.Random(7)
    texts = [t for k in range(12) for t in _family(r, 14, r.choice([8, 30, 60, 150]), r.choice([1, 2, 4, 8]))]
    chain = [f"c{i}" for i in range(400)]                       # a chain of links: neighbours are similar, ends are not
    texts += [" ".join(chain[i:i + 100]) for i in range(0, 300, 12)]
    r.shuffle(texts)
    rows = list(enumerate(texts, 100))
    for tile in (near_dedup.TILE, 3):
        monkeypatch.setattr(near_dedup, "TILE", tile)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
        assert got == components_of(rows)


def test_parity_bound_never_rules_out_a_link():
    import numpy as np
    r = np.random.default_rng(4)
    sets = []
    for n in (1, 2, 5, 40, 300, 3000, 20_000):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        for change in (0.0, 0.05, 0.12, 0.14, 0.25):
            k = int(len(a) * change)
            sets += [a, np.unique(np.concatenate([a[k:], r.integers(0, 1 << 63, k, dtype=np.uint64)]))]
    u, v = np.arange(0, len(sets), 2), np.arange(1, len(sets), 2)
    sketches = near_dedup.odd_sketches(near_dedup.minhashes(sets))
    keep = near_dedup.plausible(u, v, np.array([len(s) for s in sets]), sketches, [near_dedup.parity(s) for s in sets])
    true = np.array([100 * len(np.intersect1d(sets[a], sets[b])) >= 75 * len(np.union1d(sets[a], sets[b])) for a, b in zip(u, v)])
    assert (keep | ~true).all() and not keep[4::5][2:].any()


def test_odd_sketch_estimates():
    import numpy as np
    r = np.random.default_rng(3)
    a = np.unique(r.integers(0, 1 << 63, 3000, dtype=np.uint64))
    for share in (0.5, 0.75, 0.9):
        n = int(len(a) * 2 * share / (1 + share))
        b = np.unique(np.concatenate([a[:n], r.integers(0, 1 << 63, len(a) - n, dtype=np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        k = near_dedup.odd_sketches(near_dedup.minhashes([np.sort(a), b]))
        bits = sum(int(x).bit_count() for x in k[0] ^ k[1])
        estimate = 1 + near_dedup.BITS / (4 * near_dedup.BANDS * near_dedup.ROWS) * np.log(max(1 - 2 * bits / near_dedup.BITS, 1 / near_dedup.BITS))
        assert abs(estimate - true) < 0.15


def test_a_reopened_index_keeps_its_buckets(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    path = str(tmp_path / "index")
    exact_dedup(docs, DigestIndex(spark, path, buckets=4)).count()
    again = DigestIndex(spark, path)
    assert again.buckets == 4
    assert exact_dedup(docs, again).where("kept").count() == 0
    again.close()
    with pytest.raises(ValueError):
        DigestIndex(spark, path, buckets=5)
