import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rigflow.llm import recurrent_lm as R
from rigflow.llm.common import arrow_words, byte_words

from .conftest import EDGE


def plain_score(w, symbols, end):
    """One text, one symbol at a time, all probabilities of each step spelled out."""
    h, x, total = np.zeros(R.HIDDEN), end, 0.0
    s = lambda a: 1 / (1 + np.exp(-a))
    for y in symbols:
        g, u = w.embed[x] @ w.read + w.bias, h @ w.turn
        n = R.HIDDEN
        z, r = s(g[:n] + u[:n]), s(g[n:2 * n] + u[n:2 * n])
        c = np.tanh(g[2 * n:] + r * u[2 * n:])
        h = (1 - z) * c + z * h
        p = np.exp(h @ w.classes + w.class_bias)
        p /= p.sum()
        k = int(R.class_of(np.array([y]))[0])
        total += math.log10(p[k])
        if k < R.CLASSES:
            q = np.exp(w.words[k] @ h + w.word_bias[k])
            total += math.log10(q[y - k * R.CLASS] / q.sum())
        x = y
    return total


def _weights():
    r = np.random.default_rng(1)
    w = R.Weights.fresh(r.integers(1, 100, R.SYMBOLS).astype(float))
    w.words[:] = r.normal(0, 0.5, w.words.shape)
    return w


def test_lockstep_is_the_plain_recurrence():
    r, w = np.random.default_rng(2), _weights()
    texts = [np.append(r.integers(1, R.SYMBOLS, n), 0).astype(np.int16) for n in (0, 1, 40, 3, 200, 40)]
    got = R.score_symbols(w, texts, 0, window=32)
    assert np.allclose(got, [plain_score(w, t.astype(int), 0) for t in texts], rtol=1e-4)


def test_gradient_steps_lower_the_loss():
    w = _weights()
    text = np.append(np.tile([5, 9, 700, 1030], 12), 0)
    symbols = np.tile(text, 200)
    before = R.score_symbols(w, [text.astype(np.int16)], 0)[0]
    after = R.score_symbols(R.learn(w, symbols, 0, 3), [text.astype(np.int16)], 0)[0]
    assert after > before / 2


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {x.doc_id: x for x in R.op5_lm_score(spark, sf).collect()}
    tokens = {x.doc_id: (x.text or "").encode().lower().split() + [b""] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    c = Counter()
    for i, t in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(t)
    n, v = sum(c.values()), len(c)
    assert got.keys() == tokens.keys()
    for i, t in tokens.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(x.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    held = [x for x in got.values() if x.held_out]
    assert sum(x.score for x in held) / sum(x.base_score for x in held) < 0.97       # better on texts not learned
    assert np.mean([x.score > x.base_score for x in held]) > 0.9


def test_every_training_row_is_learned_from(spark, monkeypatch):
    monkeypatch.setattr(R, "WARM_TOKENS", 1)                 # as on a table far larger than the start
    docs = spark.createDataFrame([(i if i % 3 else None, f"own{i} " * 20) for i in range(300)], "doc_id long, text string")
    _, counts = R.count_words(docs)
    start = R.Weights.fresh(np.ones(R.SYMBOLS)).embed        # the same at every start
    moved = (R.train(docs, counts).embed != start).any(axis=1)
    own = counts.symbols()
    assert np.mean([moved[own[f"own{i}".encode()]] for i in range(300)]) >= 0.99     # (a worker's streams end in padding, which is not learned)


def test_probabilities_of_words_add_up(spark):
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d{i}") for i in range(50)], "doc_id long, text string")
    words, counts = R.count_words(docs)
    assert counts.total == 250 and counts.distinct == 60 and counts.ends == 50
    tails = np.zeros(R.TAILS)
    own = counts.symbols()
    for r in words.collect():
        if r.word not in own:
            tails[R.tail_of(r.word)] += r.c + 1
    assert np.allclose(tails + 1, counts.tail_words)


def test_small_vocabulary_gives_the_same_base(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c{i % 7} d{i} " + "e " * i) for i in range(40)] + [(99, "never seen c3")], "doc_id long, text string")
    out = []
    for most in (1 << 17, 5):
        monkeypatch.setattr(R, "VOCABULARY", most)
        words, counts = R.count_words(docs.where("doc_id < 99"))
        weights = R.Weights.fresh(np.ones(R.SYMBOLS))
        out.append({r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 9)) for r in R.score(docs, words, counts, weights).collect()})
    assert out[0] == out[1] and out[0][99][:2] == (4, 2)


def test_edge_cases(edge, empty):
    words, counts = R.count_words(edge)
    weights = R.train(edge, counts)
    rows = R.score(edge, words, counts, weights).collect()
    assert len(rows) == len(EDGE) and all(np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert {(r.n_tokens, r.n_known) for r in rows if r.doc_id in (3, 4, 5)} == {(1, 1)}
    assert R.score(empty, words, counts, weights).count() == 0
    none, zero = R.count_words(empty)
    assert (zero.total, zero.distinct) == (0, 0)
    again = R.score(edge, none, zero, R.train(empty, zero)).collect()
    assert all(r.n_known == 0 and np.isfinite(r.base_score) for r in again)


def test_the_vocabulary_is_the_most_used_words_whatever_their_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{k:02}" for k in range(60))) for i in range(3)] + [(9, "w59 " * 100_000)], "doc_id long, text string")
    monkeypatch.setattr(R, "VOCABULARY", 50)
    _, counts = R.count_words(docs)
    assert counts.words == [b"w59"] + [f"w{k:02}".encode() for k in range(50 - (counts.ends > 3))][:len(counts.words) - 1] and len(counts.words) in (49, 50)
    assert counts.total == 3 * 61 + 100_001 and counts.ends == 4


def test_no_token_of_a_run_is_left_out():
    """Symbols only in the last tokens of a run are learned from, with streams of any width."""
    for widest in (32, 256):
        n = 64 * R.WINDOW * 40 + 17
        symbols = np.tile(np.append(np.arange(2, 9), 0), n // 8 + 1)[:n].copy()
        symbols[-20:-1] = np.arange(900, 919)
        start = R.Weights.fresh(np.ones(R.SYMBOLS))
        got = R.learn(start, symbols, 0, widest=widest)
        assert (got.embed[900:918] != start.embed[900:918]).any(axis=1).all()


def test_arrow_words_and_tails_are_those_of_single_words():
    texts = [None, "", " \t\n", "  One two\x0bTHREE\x0c", "É\x1cÀ x\u00a0Y z\x85 日本語 ab a", "last"]
    column = pa.array(["dropped", *texts]).slice(1)
    words, lengths = arrow_words(column)
    want = [byte_words(t) for t in texts]
    assert words.to_pylist() == [x for own in want for x in own] and lengths.tolist() == [len(x) for x in want]
    assert R.tails_of(words[2:]).tolist() == [R.tail_of(x) for x in words.to_pylist()[2:]] and not len(R.tails_of(words[:0]))
    listed = [b"two", "é\x1cÀ".encode(), b"ab"]
    symbols, ends = R._symbols_of(column, pa.array(listed))
    own = {R.END: 0, **{x: i + 1 for i, x in enumerate(listed)}}
    assert symbols.tolist() == [own.get(x, R.CLASSES * R.CLASS + R.tail_of(x)) for t in want for x in [*t, R.END]]
    assert ends.tolist() == (np.cumsum([len(x) + 1 for x in want]) - 1).tolist()


def test_large_outputs_take_the_safe_softmax():
    """Weights beyond what exp takes as it is give the plain recurrence, too, and finite steps."""
    r, w = np.random.default_rng(6), _weights()
    w.classes *= 200
    w.words *= 200
    texts = [np.append(r.integers(1, R.SYMBOLS, n), 0).astype(np.int16) for n in (5, 30)]
    assert R._most(w.classes) > R.SAFE
    assert np.allclose(R.score_symbols(w, texts, 0), [plain_score(R.Weights(*[x.astype(float) for x in w.arrays()]), t.astype(int), 0) for t in texts], rtol=1e-3)
    assert all(np.isfinite(x).all() for x in R.learn(w, np.concatenate(texts), 0).arrays())


def test_counts_of_a_task_are_summed(monkeypatch):
    monkeypatch.setattr(R, "arrow_slices", lambda column, limit: [column.slice(i, 1) for i in range(len(column))])
    texts = ["a b a", None, "B c", "a"]
    got = Counter()
    parts = list(R._count([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    for x in parts:
        got.update(dict(zip(x.column("word").to_pylist(), x.column("n").to_pylist())))
    assert got == {b"a": 3, b"b": 2, b"c": 1, b"": 4} and sum(x.num_rows for x in parts) == 4


def test_first_step_goes_against_the_numeric_gradient():
    """The first step of Adam moves each weight by the rate against the sign of its gradient."""
    r, w = np.random.default_rng(4), _weights()
    w.words[:] *= 2
    run = r.integers(1, R.SYMBOLS, R.WINDOW)
    run[[6, 13, 23]] = 0                                     # three texts in one window
    texts = [x.astype(np.int16) for x in np.split(run, [7, 14])]
    moved = [b - a for a, b in zip(w.arrays(), R.learn(w, run, 0).arrays())]
    exact = R.Weights(*[x.astype(np.float64) for x in w.arrays()])
    loss = lambda: -R.score_symbols(exact, texts, 0).sum() * R.LN10 / len(run)
    tried = 0
    for x, step in zip(exact.arrays(), moved):
        flat, at = x.reshape(-1), np.flatnonzero(np.abs(step.reshape(-1)) > R.RATE / 2)
        for i in r.choice(at, min(len(at), 40), replace=False):
            kept, sides = flat[i], []
            for eps in (1e-5, -1e-5):
                flat[i] = kept + eps
                sides.append(loss())
            flat[i] = kept
            slope = (sides[0] - sides[1]) / 2e-5
            if abs(slope) > 1e-4:
                tried += 1
                assert np.sign(step.reshape(-1)[i]) == -np.sign(slope)
    assert tried > 150
