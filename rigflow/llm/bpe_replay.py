"""Byte-level BPE encoding and decoding by replay of the merges over a corpus of words.

A text is cut into words by the vocabulary's pattern.  The distinct words of a run of texts are
a corpus: their bytes lie one after another, and an inverted index maps every rank to the
positions of the pairs that merge to it.  The ranks are replayed in order, lowest first; each
merge is applied at all its positions, and only the pairs to its left and right are looked up
again and entered into the index.  Every word is merged once however often it occurs, and a
task keeps the words it has seen (``CACHE``), so most words of later texts are there already.

Some merges can give a pair of a lower rank than their own (the same bytes can be cut in several
ways; the vocabulary tells which).  These are applied at the leftmost of their positions in each
word, and the rest waits in the index: a lower rank comes first.  So within each word the order
is the lowest rank first, the leftmost of equal ones, as in the tiktoken library.  A word that is
itself a token is that token, also where no merges lead to it.

Texts are dealt as they lie in the table: no word is shuffled, and a hot word costs its look-ups.
A run is about ``SLICE`` bytes of text, so a task's memory does not grow with the table; a text
beyond that, or a word of any length, is a run of its own.

Defined results: a null text is encoded like an empty one, to no tokens; rows that repeat an id
are encoded one by one, and rows without an id too.  Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigflow.llm.common import column_slices

SLICE = 8_000_000        # bytes of text whose words are merged together
CACHE = 300_000          # words that a task keeps
BYTES = 256


class Ranks:
    """A byte-level vocabulary: the tokens' bytes by rank, and the rank that each pair merges to."""

    def __init__(self, tokens: dict[bytes, int], pattern: str):
        """tokens: rank of each token's bytes; every single byte must be among them."""
        self.pattern, self.tokens = pattern, tokens
        self.shift = max(tokens.values(), default=0).bit_length()
        missing = [b for b in range(BYTES) if bytes([b]) not in tokens]
        if missing:
            raise ValueError(f"no token for the bytes {missing}")
        self.raw: list[bytes] = [b""] * (max(tokens.values()) + 1)
        for token, rank in tokens.items():
            self.raw[rank] = token
        self.of_byte = np.array([tokens[bytes([b])] for b in range(BYTES)], np.int64)
        pairs: dict[int, int] = {}
        self.lowers: set[int] = set()                                     # ranks with a pair of a lower rank
        for token, rank in tokens.items():
            for cut in range(1, len(token)):
                a, b = tokens.get(token[:cut]), tokens.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << self.shift | b] = rank
                    self.lowers.update(x for x in (a, b) if x > rank)
        self._keys = np.array(sorted(pairs) or [-1], np.int64)
        self._merged = np.array([pairs.get(k, -1) for k in self._keys.tolist()], np.int64)
        self.names = list(map(str, range(len(self.raw))))
        self.byte_pairs = np.full((BYTES, BYTES), -1, np.int64)           # rank by the bytes themselves
        for token, rank in tokens.items():
            if len(token) == 2:
                self.byte_pairs[token[0], token[1]] = rank

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that each pair of tokens merges to, else -1."""
        key = a << self.shift | b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, self._merged[at], -1)

    @staticmethod
    def load(path: str, pattern: str) -> Ranks:
        """A file of lines "token in base64, rank"."""
        with open(path, "rb") as lines:
            return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)


def _alternate(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places whose pairs overlap (a run of one token), the first, third, fifth ..."""
    joined = np.concatenate([[False], after[places[:-1]] == places[1:]])
    if not joined.any():
        return places
    number = np.arange(len(places))
    start = np.maximum.accumulate(np.where(joined, 0, number))
    return places[(number - start) % 2 == 0]


def replay(ranks: Ranks, words: list[bytes]) -> list[bytes]:
    """The tokens of each word (one byte at least) as packed 32-bit numbers, all merges applied in rank order to all words."""
    text = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n, ends = len(text), np.cumsum(lengths)
    if not n:
        return [b"" for _ in words]
    ids, word = ranks.of_byte[text], np.repeat(np.arange(len(words)), lengths)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[ends[:-1]] = -1
    pair = np.full(n, -1, np.int64)                            # rank of the pair that begins at each position
    pair[:-1] = ranks.byte_pairs[text[:-1], text[1:]]
    pair[ends - 1] = -1
    order = np.argsort(pair, kind="stable")
    order = order[np.searchsorted(pair[order], 0):]
    first = np.flatnonzero(np.concatenate([[True], pair[order][1:] != pair[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    queue = pair[order[first]].tolist()                        # (ascending, so a heap)
    index = {r: part.tolist() for r, part in zip(queue, np.split(order, first[1:]))}

    def enter(positions: np.ndarray, new: np.ndarray) -> None:
        for p, r in zip(positions.tolist(), new.tolist()):
            listed = index.get(r)
            if listed is None:
                index[r] = [p]
                heappush(queue, r)
            else:
                listed.append(p)

    while queue:
        rank = heappop(queue)
        places = np.array(index.pop(rank))
        places = np.sort(places[pair[places] == rank])          # others have been merged away since
        if len(places) > 1:
            places = places[np.concatenate([[True], places[1:] != places[:-1]])]
        if not len(places):
            continue
        if rank not in ranks.lowers:
            places = _alternate(places, after)
        elif len(places) > 1:                                   # one a word, the leftmost; the rest waits
            leading = np.concatenate([[True], word[places[1:]] != word[places[:-1]]])
            enter(places[~leading], np.full(len(places), rank)[~leading])
            places = places[leading]
        gone = after[places]
        right = after[gone]
        ids[places], ids[gone], pair[gone], after[places] = rank, -1, -1, right
        inner = right >= 0
        before[right[inner]] = places[inner]
        pair[places[~inner]] = -1
        left = before[places]
        touched = np.concatenate([places[inner], left[left >= 0]])
        new = ranks.merge(ids[touched], ids[after[touched]])
        pair[touched] = new
        found = new >= 0
        enter(touched[found], new[found])
    left = ids >= 0
    tokens, stops = ids[left].astype("<i4").tobytes(), (np.cumsum(left)[ends - 1] * 4).tolist()
    return [tokens[a:b] for a, b in zip([0, *stops], stops)]


class Encoder:
    """Encodes texts; keeps the tokens of the words it has met."""

    def __init__(self, ranks: Ranks):
        self.ranks = ranks
        self.cut = regex.compile(ranks.pattern).findall
        self._known: dict[str, bytes] = {}

    def learn(self, words: Iterable[str]) -> None:
        """Replay the merges over the words that are not known yet."""
        whole, new, spelled = self.ranks.tokens.get, [], []
        for word in words:
            if word not in self._known:
                raw = word.encode()
                token = whole(raw)
                if token is not None:
                    self._known[word] = token.to_bytes(4, "little")
                else:
                    new.append(word)
                    spelled.append(raw)
        self._known.update(zip(new, replay(self.ranks, spelled)))

    def encode(self, texts: list) -> Iterator[np.ndarray]:
        """The tokens of each text, one text at a time."""
        if len(self._known) > CACHE:
            self._known.clear()
        cut = [self.cut(t) if t else [] for t in texts]
        self.learn({word for words in cut for word in words})
        known = self._known.__getitem__
        for words in cut:
            yield np.frombuffer(b"".join(map(known, words)), "<i4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.ranks.raw.__getitem__, ids))


def _over(docs: DataFrame, ranks: Ranks, key: str, fields: list[tuple[str, pa.DataType]], schema: str, rows):
    """mapInArrow over (key, text): for each run of texts ``rows(encoder, texts)`` gives the other columns."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)           # the vocabulary: a fixed size

    def run(batches):
        encoder = Encoder(shared.value)
        for b in batches:
            ids = b.column(key)
            for lo, hi, texts in column_slices(b.column("text"), SLICE):
                columns = rows(encoder, texts)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), *[pa.array(c, t) for c, (_, t) in zip(columns, fields)]], [key, *[n for n, _ in fields]])

    return docs.select(F.col(key).cast("long").alias(key), "text").mapInArrow(run, f"{key} long, {schema}")


def encode_documents(docs: DataFrame, ranks: Ranks, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` (key, text): key, ids.  Row by row, without a shuffle."""
    return _over(docs, ranks, key, [("ids", pa.list_(pa.int32()))], "ids array<int>", lambda encoder, texts: [list(encoder.encode(texts))])


def decode_documents(encoded: DataFrame, ranks: Ranks) -> DataFrame:
    """``encoded`` (ids, and anything else) with the bytes they stand for; null for null."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks.raw)

    @F.pandas_udf("binary")
    def raw(ids):
        return ids.map(lambda own: None if own is None else b"".join(map(shared.value.__getitem__, own)))

    return encoded.withColumn("bytes", raw("ids"))


def digests(encoder: Encoder, texts: list) -> list[list]:
    """Tokens, hash of the ids as text, and hash of the bytes they decode to, of each text."""
    sizes, of_ids, of_bytes = [], [], []
    for packed in encoder.encode(texts):
        ids = packed.tolist()
        sizes.append(len(ids))
        of_ids.append(hashlib.sha256(" ".join(map(encoder.ranks.names.__getitem__, ids)).encode()).hexdigest())
        of_bytes.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
    return [sizes, of_ids, of_bytes]


def default_ranks() -> Ranks:
    """The public vocabulary of 50,256 ranks of the installed files; give another path to use another."""
    import public_tokenizers

    return Ranks.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_byte_bpe(spark, sf_dir):
    """The ids stay in the task: what leaves it is their number and two hashes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _over(docs, default_ranks(), "doc_id", fields, "n_tokens long, ids_sha256 string, decoded_sha256 string", digests)
