import hashlib
import random

import numpy as np
import pytest
import tiktoken

from rigflow.llm import bpe_replay as B
from tests.llm.conftest import EDGE, SF


@pytest.fixture(scope="module")
def ranks():
    return B.default_ranks()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=ranks.pattern, mergeable_ranks=ranks.tokens, special_tokens={})


def slow(tokens: dict, word: bytes) -> list[int]:
    """One word: the lowest rank, the leftmost of equal ones, again and again."""
    if word in tokens:
        return [tokens[word]]
    parts = [bytes([b]) for b in word]
    while True:
        pairs = [(tokens[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in tokens]
        if not pairs:
            return [tokens[p] for p in parts]
        _, i = min(pairs)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def texts_of(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    alphabet = "aaabcdeehillnoorstu ABC  \t\n\r.,;'-_=0123456789éßñüΩд日本語🙂  \x85\x1c"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 80))) for _ in range(n)]


def test_equals_the_library(ranks, library):
    texts = texts_of(3_000, 1) + ["", "it's we'll I'd", " " * 500 + "x", "a" * 5_000, "ab" * 3_000, "é" * 999, "<|endoftext|>", "\x00\x01", "\n" * 64]
    encoder = B.Encoder(ranks)
    for lo in range(0, len(texts), 500):
        part = texts[lo:lo + 500]
        for text, ids in zip(part, encoder.encode(part)):
            assert ids.tolist() == library.encode_ordinary(text)
            assert encoder.decode(ids) == text.encode()


def test_every_character_is_cut_as_in_the_library(ranks, library):
    encoder = B.Encoder(ranks)
    chars = [chr(c) for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c}{c}1" for c in chars]
    assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_ranks_that_do_not_ascend_along_the_merges():
    """Vocabularies whose merges give pairs of lower rank: the order within a word still holds."""
    r = random.Random(4)
    for _ in range(300):
        made = {bytes([r.choice(b"abc") for _ in range(r.randrange(2, 6))]) for _ in range(12)}
        rest = list(made)
        r.shuffle(rest)
        tokens = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(rest)}
        ranks = B.Ranks(tokens, r".+")
        words = [bytes([r.choice(b"abc") for _ in range(r.randrange(1, 14))]) for _ in range(40)]
        words = [w for w in words if w not in tokens]
        assert [np.frombuffer(x, np.int32).tolist() for x in B.replay(ranks, words)] == [slow(tokens, w) for w in words]


def test_cache_is_bounded_and_changes_nothing(ranks, monkeypatch):
    texts = texts_of(400, 2)
    want = [ids.tolist() for ids in B.Encoder(ranks).encode(texts)]
    monkeypatch.setattr(B, "CACHE", 10)
    encoder = B.Encoder(ranks)
    assert [ids.tolist() for t in texts for ids in encoder.encode([t])] == want
    assert len(encoder._known) < 100


def test_a_vocabulary_without_every_byte_is_refused():
    with pytest.raises(ValueError):
        B.Ranks({b"a": 0}, r".")


def test_edge_rows(spark, edge, empty, ranks, library):
    got = sorted(((r.doc_id, tuple(r.ids)) for r in B.encode_documents(edge, ranks).collect()), key=str)
    assert got == sorted(((r[0], tuple(library.encode_ordinary(r[1] or ""))) for r in EDGE), key=str)
    back = B.decode_documents(B.encode_documents(edge, ranks).withColumnRenamed("doc_id", "n"), ranks)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r[1] or "").encode() for r in EDGE)
    assert B.encode_documents(empty, ranks).count() == 0


def test_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = B.op12_byte_bpe(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
