import itertools

import numpy as np
from pyspark.sql import functions as F

from rigflow.llm import language_id as L

from .conftest import EDGE


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    scores = r.normal(size=(7, 3)) * 4
    more = np.concatenate([scores, r.normal(size=(5, 3)) * 4, scores[:1]])
    got = L.viterbi(more, np.array([7, 0, 5, 1]), 2.0)
    at = 0
    for n in (7, 5, 1):
        s = more[at:at + n]
        best = max(itertools.product(range(3), repeat=n), key=lambda p: sum(s[i, a] for i, a in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got[at:at + n]) == best
        at += n


def test_held_out_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = L.train_fold(docs)
    held = docs.where(L.fold(F.col("doc_id"), 5, 0)).select("doc_id", "text", "lang")
    right, n = L.identify(held, model).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 1500 and right > 0.98
    text = "the and of that with from which this are. der die das und nicht eine wird von zu den"
    spans, langs, scores = L.label_texts(model, [text])
    assert [x[2] for x in spans[0]] == ["en", "de"] and spans[0][0][0] == 0 and spans[0][-1][1] == len(text)
    assert spans[0][1][0] == text.index("der") and 0.4 < scores[0] < 0.7


def test_edge_cases(spark, edge, empty):
    model = L.train(edge)
    assert model.languages == ["de", "en", "ru"]               # null labels are not learned
    rows = L.identify(edge, model).select("doc_id", "text", "lang_pred", F.col("score").alias("s"), "spans").collect()
    assert len(rows) == len(EDGE)
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.s, r.spans) == ("und", 0.0, [])
        else:
            assert r.lang_pred in model.languages and 0 < r.s <= 1
    assert L.identify(empty, model).count() == 0
    nothing = L.train(empty)
    assert {r.lang_pred for r in L.identify(edge, nothing).select("lang_pred").collect()} == {"und"}


def test_scripts_narrow_the_candidates(edge):
    model = L.train(edge)
    assert L.label_texts(model, ["мирпривет"])[1] == ["ru"]
    assert L.script_of("é") == 0 and L.script_of("日") == list(L.SCRIPTS).index("han")


def test_a_rare_language_and_few_labels_are_learned(spark):
    rows = [(i, "the cat and the dog", "en") for i in range(3000)] + [(5000 + i, "der Hund und die Katze", "de") for i in range(3)]
    rows += [(10_000 + i, "unlabelled words", None) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.train(docs, sample=100)
    assert model.languages == ["de", "en"]
    assert L.label_texts(model, ["der Hund und die Katze"])[1] == ["de"]


def test_letters_are_unicode_letters_with_their_marks():
    assert L.LETTERS.findall("½ ② ٣ _") == []
    assert L.LETTERS.findall("हिन्दी में") == ["हिन्दी", "में"]
    assert L.LETTERS.findall("e\u0301t\u00e9 \u0301x") == ["e\u0301t\u00e9", "x"]
