import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rigflow.llm import sentencepiece_codec as S

from .conftest import EDGE

public_tokenizers = pytest.importorskip("public_tokenizers")
V = S.default_vocabulary()
TEXTS = ["  a   b ", "\n\n x", " ", "   ", "日本語テキスト \x00 \t", "x" * 700 + " " + "ab" * 400, "é́", "\U0001f642 ok", "    indented\n        more", "The quick brown fox, again and again."]


def test_without_dropout_it_is_the_library():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert [x.tolist() for x in S.Encoder(V, 0.0).encode([""] * len(TEXTS), TEXTS)] == sp.encode(TEXTS)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\nabcde"), st.characters(exclude_categories=["Cs"])), max_size=60), st.sampled_from([0.0, 0.1, 0.5, 0.9]), st.integers(0, 5))
def test_round_trip(text, dropout, seed):
    e = S.Encoder(V, dropout, seed)
    assert e.decode(e.encode(["d"], [text])[0].tolist()) == text


def test_heap_and_side_by_side_agree():
    r = random.Random(2)
    units = ["".join(r.choice(" aeinorst日") for _ in range(r.randrange(1, 40))) for _ in range(400)]
    ids, lengths = V.symbols(units)
    for dropout in (0.0, 0.1, 0.5):
        keys = np.arange(len(units), dtype=np.uint64) * np.uint64(987654321987654321)
        flat, counts = S.agendas(V, ids, lengths, keys, dropout)
        at, out = 0, []
        for n in counts:
            out.append(flat[at:at + n].tolist())
            at += n
        ends = np.cumsum(lengths)
        assert out == [S.agenda(V, ids[b - n:b].tolist(), int(k), dropout) for b, n, k in zip(ends, lengths, keys)]


def test_dropout_varies_by_seed_epoch_and_document_but_not_by_run():
    text = ["internationalization of representations " * 5]
    one = lambda name="a", **k: tuple(S.Encoder(V, **{"dropout": 0.3, **k}).encode([name], text)[0])
    assert one() == one()
    assert one() != one(seed=1) and one() != one(epoch=1)
    assert len({one(name=str(i)) for i in range(20)}) > 3
    assert len(one(dropout=0.5)) > len(one(dropout=0.0))


def test_every_occurrence_of_a_word_is_cut_in_its_own_way(spark):
    word = "internationalization"
    e = S.Encoder(V, 0.5)
    cut = {tuple(x) for x in e.encode([str(i) for i in range(2_000)], [word] * 2_000)}
    assert len(cut) > 100
    once = [e.encode(["a"], [word + (" " + word) * n])[0].tolist() for n in (0, 1)]
    assert once[1][:len(once[0])] == once[0] and once[1] != once[0] * 2
    copies = S.encode_documents(spark.createDataFrame([(1, word)] * 50, "doc_id long, text string").coalesce(1), V, 0.5, epoch=F.monotonically_increasing_id())
    assert len({tuple(r.pieces) for r in copies.collect()}) > 10


def test_runs_of_units_do_not_change_the_pieces(monkeypatch):
    texts = TEXTS * 3
    names = [str(i) for i in range(len(texts))]
    want = [x.tolist() for x in S.Encoder(V, 0.3).encode(names, texts)]
    monkeypatch.setattr(S, "RUN", 7)
    assert [x.tolist() for x in S.Encoder(V, 0.3).encode(names, texts)] == want
    assert [S.Encoder(V, 0.3).encode([n], [t])[0].tolist() for n, t in zip(names, texts)] == want


def test_documents(edge, empty):
    rows = S.encode_documents(edge, V).collect()
    assert len(rows) == len(EDGE) and all(r.lossless for r in rows)
    assert all(r.pieces is None and r.n_pieces is None for r in rows if r.doc_id == 3)
    assert all(r.pieces == [] for r in rows if r.doc_id == 4)
    back = {r.doc_id: r.text for r in S.decode_documents(S.encode_documents(edge, V), V).collect()}
    assert all(back[x[0]] == x[1] for x in EDGE)
    assert S.encode_documents(empty, V).count() == 0
