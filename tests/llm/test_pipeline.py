import corpus_pipeline
from rigflow.llm import registry
from rigflow.llm.language_id import train_fold, label_texts
from rigflow.llm.sentencepiece_codec import Encoder, default_vocabulary

from .conftest import EDGE, SF
from .test_dedup import components_of, plain


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = train_fold(docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]
    out, kept = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF).persist()
        assert out.columns == docs.columns
        kept.append([r.doc_id for r in out.collect()])
    _, langs, _ = label_texts(model, [r.text for r in rows.values()])
    want = [i for i, l in zip(rows, langs) if l != "und"]
    assert sorted(kept[0]) == sorted(want)
    first = {}
    for i in sorted(want):
        first.setdefault(plain(rows[i].text), i)
    assert sorted(kept[1]) == sorted(first.values())
    assert sorted(kept[2]) == sorted(i for i, (_, c) in components_of([(i, rows[i].text) for i in kept[1]]).items() if i == c)
    assert set(kept[3]) <= set(kept[2])
    size = {i: len(rows[i].text.encode().split()) for i in kept[2]}
    total, taken = sum(size.values()), sum(size[i] for i in kept[3])
    assert abs(taken - total) < 0.1 * total
    vocabulary = default_vocabulary()
    encoded = corpus_pipeline.STAGES[-1][1](spark, out, SF).collect()
    assert [r.doc_id for r in encoded] == kept[3]
    for r in encoded:
        assert r.lossless and Encoder(vocabulary).decode(r.pieces) == rows[r.doc_id].text


def test_even_mixes_of_languages_stay(spark):
    parts = {"en": "the cat and the dog ran over the hill", "de": "der Hund und die Katze laufen schnell", "fr": "le chien et le chat sont dans la rue", "es": "el perro y los gatos corren por aquella calle"}
    rows = [(10 * i + k, text, lang) for k, (lang, text) in enumerate(parts.items()) for i in range(50)]
    rows += [(1000, " ".join([parts["en"], parts["de"], parts["fr"]]), None), (1001, " ".join(parts.values()), None), (1002, "12 34", None)]
    kept = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), SF).collect()
    assert {1000, 1001} <= {r.doc_id for r in kept} and 1002 not in {r.doc_id for r in kept}


def test_run_and_edge_tables(spark, edge, empty):
    assert corpus_pipeline.run(spark, SF).count() > 100
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, edge, SF).count() <= 4 * len(EDGE), name
        assert stage(spark, empty, SF).count() == 0, name


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in registry.QUERIES
    assert set(registry.ORACLE) <= set(registry.QUERIES)
