import numpy as np
from pyspark.sql import functions as F

from rigflow.llm import toxicity as T
from rigflow.llm.language_id import train as train_language

from .conftest import EDGE


def test_pooling_is_the_plain_convolution():
    net = T.Network.fresh(3)
    net.table *= 20
    texts = [["a"], ["a", "b"], [], ["c", "d", "a", "b", "c"], ["b"] * 7]
    got = net.pooled(texts)
    for t, row in zip(texts, got):
        e = np.array([net.table[list(r)].sum(axis=0) for r in T._buckets(t)]).reshape(-1, T.DIM)
        want = np.zeros(len(row), np.float32)
        for k, width in enumerate(T.WIDTHS):
            z = np.full((max(len(t), 1), T.FILTERS), 0 if not t else -np.inf, np.float32)
            for i in range(len(t)):
                z[i] = sum(e[i + o] @ net.taps[:, cols] for w, o, cols in T.TAPS if w == width and i + o < len(t))
            want[k * T.FILTERS:(k + 1) * T.FILTERS] = np.maximum(z.max(axis=0), 0)
        assert np.allclose(row, want, atol=1e-4)


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = T.op8_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").toPandas()
    assert docs.count() > 9000 and set(out["predicted"]) == {0, 1}
    rank, toxic = out["score"].rank(), out["toxic"] == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.95
    assert ((out["predicted"] == 1) == toxic).mean() > 0.95
    assert ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()


def test_edge_cases(spark, edge, empty):
    language = train_language(edge)
    labels = spark.createDataFrame([(1, 1), (1, 0), (8, 0), (10, None), (None, 1), (7, 0), (77, 1)], "doc_id long, toxic int")
    net = T.train(edge, labels, language)
    rows = T.score(edge, net, language).select("doc_id", "score", "predicted").collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert T.score(empty, net, language).count() == 0
    assert T.train(edge, labels.where(F.lit(False)), language) is None
    assert {(r.score, r.predicted) for r in T.score(edge, None, language).collect()} == {(0.0, 0)}


def test_thresholds_do_not_drift_with_the_number_of_labels():
    """Overlapping scores, a tenth toxic: samples of few and of very many labels give about the same threshold."""
    from rigflow.llm import toxicity as X
    from rigflow.llm.common import sample_rate

    r = np.random.default_rng(3)
    for labels in (4_000, 50_000, 500_000):
        n = {1: labels // 10, 0: labels - labels // 10}
        rates = {1: sample_rate(n[1], X.POSITIVES), 0: sample_rate(n[0], X.NEGATIVES)}
        kept = {t: int(n[t] * rates[t]) for t in n}
        logits = np.concatenate([r.normal(1.5, 1, kept[1]), r.normal(-0.5, 1, kept[0])])
        toxic = np.concatenate([np.ones(kept[1]), np.zeros(kept[0])])
        cut = X._threshold(logits, toxic, np.where(toxic == 1, 1.0, X.negative_weight(rates)))
        assert 0.5 < cut < 1.6, (labels, cut)


def test_every_labelled_row_is_learned_and_counted(spark, monkeypatch):
    """A word that only rows outside the starting slice hold changes the network, and every labelled row has a say in the thresholds."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    monkeypatch.setattr(T, "POSITIVES", 40)
    monkeypatch.setattr(T, "NEGATIVES", 40)
    seen = []
    cut = T._thresholds
    monkeypatch.setattr(T, "_thresholds", lambda counts: seen.append(int(counts["n"].sum())) or cut(counts))
    alone = ["".join(chr(97 + i * k % 26) for k in (1, 3, 5)) + "".join(chr(97 + int(c)) for c in str(i)) for i in range(1200)]
    rows = [(i, f"{alone[i]} plain words") for i in range(1200)]
    docs = spark.createDataFrame(rows, StructType([StructField("doc_id", LongType()), StructField("text", StringType())])).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int")
    language = train_language(docs.withColumn("lang", F.lit("en")))
    net = T.train(docs, labels, language)
    assert seen == [1200]
    fresh = T.Network.fresh().table
    assert (net.table[T._buckets(alone)[:, 0]] != fresh[T._buckets(alone)[:, 0]]).any(axis=1).mean() > 0.9


def test_labels_are_never_broadcast(spark):
    """Few labels take the way of many: one shuffle of the texts, no broadcast that ends at some size."""
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, None), (None, "d")], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (9, 1)], "doc_id long, toxic int")
    out = T.with_labels(docs, known)
    assert sorted(out.collect(), key=str) == sorted([("a", 1), ("b", 0), ("c", 0), (None, 1)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_long_texts_are_pooled_in_runs(monkeypatch):
    r = np.random.default_rng(2)
    net = T.Network.fresh(4)
    net.table *= 20
    texts = [[f"w{i}" for i in r.integers(0, 60, n)] for n in (1, 2, 3, 4, 5, 8, 9, 50, 0)]
    want = net.pooled(texts)
    for run in (1, 2, 4, 5):
        monkeypatch.setattr(T, "RUN", run)
        assert np.allclose(net.pooled(texts), want, atol=1e-5)


def test_words_that_come_up_again_after_the_cache_was_cleared(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the cat sat here", "en"), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string")
    model = train_language(docs)
    texts = [["the", "cat"], [], ["der", "hund"], ["katze", "und", "the"]]
    want = T.main_language(model, texts)
    assert want[:3] == ["en", "und", "de"]
    net = T.Network.fresh(4)
    for size in (0, 3, 100):
        monkeypatch.setattr(T, "CACHE", size)
        known = T.Vocabulary(model)
        for _ in range(3):
            at = known.places(texts)
            assert known.languages(at) == want and np.allclose(net.pooled_rows(known.buckets, at), net.pooled(texts))
    nothing = train_language(docs.where(F.lit(False)))
    assert T.main_language(nothing, texts) == ["und"] * 4


def test_equal_logits_are_cut_together():
    import pandas as pd

    counts = pd.DataFrame({"lang": "en", "toxic": [1, 0, 1, 0], "at": [512, 512, 1024, 0], "n": [5, 50, 30, 100]})
    assert 2 < T._thresholds(counts)[""] < 4
