"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

A text becomes units: a run of spaces with the word after it (no piece of a merge-type
vocabulary goes on past a word into the next space; ``Vocabulary`` checks that).  In each unit
the agenda holds every adjacent pair whose join is a piece; the best pair (by score, then
leftmost) is joined, its neighbours enter the agenda, until it is empty.  With dropout p, a
candidate is skipped if a keyed hash of (seed, epoch, document, the unit's place in it, the
candidate's place in the unit, its two halves) falls under p.  So each occurrence of a word is
cut in its own way, a document's segmentation varies with seed and epoch, is the same at every
run and on every machine, and always decodes to the text.  Dropout 0 gives the library's own
segmentation.

Short units run through the agenda side by side in numpy (one step joins the best pair of every
unit of about ``RUN`` symbols of text), long ones through a heap, each n log n; both give the
same pieces.  No unit is looked up in what was encoded before.

Characters without a piece become byte pieces, as does the space mark itself where a text
holds it, so decoding is lossless for every text.

Defined results: null has null pieces, counts as lossless and has no length; an empty text has
no pieces; a lone surrogate cannot occur in a Spark string.  Other columns are not looked at.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rigflow.llm.common import column_slices

MARK = "▁"
DROPOUT = 0.1
SEED = 20240601
LONG = 256                  # symbols from which on a unit goes through the heap
RUN = 500_000               # symbols that go through the agenda together
SLICE = 2_000_000           # bytes of text that a task holds as strings
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = (1 << 64) - 1


class Vocabulary:
    """Pieces, scores and the table of joins of a SentencePiece merge-type model."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str], dummy_prefix: bool = True):
        """kinds: "normal", "byte" or "control" for each piece."""
        self.pieces, self.dummy_prefix = pieces, dummy_prefix
        normal = {p: i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == "normal"}
        for p in normal:
            if MARK in p.lstrip(MARK) or "\n" in p:
                raise ValueError(f"piece {p!r} spans words: units would not be independent")
        self.chars = {p: i for p, i in normal.items() if len(p) == 1}
        self._char_table = np.full(0x110000, -1, np.int32)         # by code point; the space mark itself has no piece
        for c, i in self.chars.items():
            self._char_table[ord(" " if c == MARK else c)] = i
        self.bytes = [0] * 256
        self.raw: list[bytes] = []
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == "byte":
                self.bytes[int(p[1:-1], 16)] = i
            self.raw.append(bytes([int(p[1:-1], 16)]) if k == "byte" else b"" if k == "control" else p.replace(MARK, " ").encode())
        self.joins: dict[tuple[int, int], int] = {}
        for p, i in normal.items():
            for c in range(1, len(p)):
                a, b = normal.get(p[:c]), normal.get(p[c:])
                if a is not None and b is not None:
                    self.joins[a, b] = i
        # rank: the order in which the agenda takes pairs; equal scores go left to right
        values = np.array(scores)
        self.rank = np.zeros(len(pieces), np.int64)
        self.rank[:] = np.unique(-values, return_inverse=True)[1]
        keys = np.array([a << 32 | b for a, b in self.joins], np.uint64)
        self._shift = np.uint64(64 - max(4, int(np.ceil(np.log2(4 * max(len(keys), 1))))))
        size = 1 << int(64 - int(self._shift))
        self._keys, self._joined = np.full(size, _MASK, np.uint64), np.full(size, -1, np.int64)
        at, left = ((keys * _K1) >> self._shift).astype(np.int64), np.arange(len(keys))
        joined = np.fromiter(self.joins.values(), np.int64, len(keys))
        self._probes = 0
        while len(left):                                   # linear probing, all keys at once
            free = self._keys[at[left]] == np.uint64(_MASK)
            take, first = np.unique(at[left][free], return_index=True)
            put = left[free][first]
            self._keys[take], self._joined[take] = keys[put], joined[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) % size
            self._probes += 1

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal" for i in range(n)]
        return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair joins to, else -1."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = ((key * _K1) >> self._shift).astype(np.int64)
        out = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        for _ in range(self._probes):
            held = self._keys[at[open_]]
            hit = held == key[open_]
            out[open_[hit]] = self._joined[at[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(_MASK))]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % len(self._keys)
        return out

    def symbols(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of all units one after another, and each unit's number of them: a piece
        for each character that has one, else its bytes in UTF-8."""
        out, sizes = self.spell(_points("".join(units)))
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lengths)])]
        return out, np.diff(ends)

    def spell(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First symbols of code points, and each one's number of them."""
        piece = self._char_table[points]
        missing = piece < 0
        sizes = np.where(missing, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 1)
        out = np.empty(int(sizes.sum()), np.int64)
        in_bytes = np.repeat(missing, sizes)
        out[~in_bytes] = piece[~missing]
        spelled = points[missing].tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        out[in_bytes] = np.array(self.bytes)[np.frombuffer(spelled, np.uint8)]
        return out, sizes


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def unit_starts(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """True where a unit begins: at a text's start, a line break, after one, and at the first of a run of spaces."""
    first, space, line = np.zeros(len(points), bool), points == 0x20, points == 0x0A
    first[starts] = True
    first |= line
    first[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    return first


def _skip(key: int, place: int, a: int, b: int, below: int) -> bool:
    h = (key + place * int(_K1) + a * int(_K2) + b * int(_K3)) & _MASK
    h = ((h ^ (h >> 31)) * int(_K2)) & _MASK
    return (h ^ (h >> 29)) >> 32 < below


def agenda(v: Vocabulary, symbols: list[int], key: int, dropout: float) -> list[int]:
    """One unit through a heap of candidates."""
    below = int(dropout * (1 << 32))
    ids, before, after = list(symbols), [i - 1 for i in range(len(symbols))], [i + 1 for i in range(len(symbols))]
    heap: list[tuple[int, int, int, int]] = []

    def enter(i: int, j: int) -> None:
        joined = v.joins.get((ids[i], ids[j]))
        if joined is not None and not (below and _skip(key, i, ids[i], ids[j], below)):
            heapq.heappush(heap, (int(v.rank[joined]), i, ids[i], ids[j]))

    for i in range(len(ids) - 1):
        enter(i, i + 1)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if ids[i] == a else len(ids)
        if j >= len(ids) or ids[j] != b:
            continue                                        # one of the halves has gone
        ids[i], ids[j] = v.joins[a, b], -1
        after[i] = after[j]
        if after[i] < len(ids):
            before[after[i]] = i
            enter(i, after[i])
        if before[i] >= 0:
            enter(before[i], i)
    return [x for x in ids if x >= 0]


def agendas(v: Vocabulary, ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray]:
    """Many units side by side, their symbols one after another, each with its own key: their
    pieces, and each unit's number of pieces."""
    ids = ids.copy()
    unit = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    below, none = np.uint64(int(dropout * (1 << 32))), np.int64(1 << 40)

    def candidates(a, b, at, of):
        """Rank of each pair in the high bits, place below: the least is the agenda's next."""
        joined = v.join(a, b)
        rank = np.where(joined >= 0, (v.rank[joined] << 20) + at, none)
        if below:
            h = keys[of] + at.astype(np.uint64) * _K1 + a.astype(np.uint64) * _K2 + b.astype(np.uint64) * _K3
            h = (h ^ (h >> np.uint64(31))) * _K2
            rank[((h ^ (h >> np.uint64(29))) >> np.uint64(32)) < below] = none
        return rank, joined

    rank, joined = np.full(len(ids), none, np.int64), np.full(len(ids), -1, np.int64)
    if len(ids) > 1:
        rank[:-1], joined[:-1] = candidates(ids[:-1], ids[1:], place[:-1], unit[:-1])
        rank[:-1][unit[:-1] != unit[1:]] = none
    done_ids, done_unit = [], []
    while len(ids):
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        best = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.concatenate([starts, [len(ids)]]))
        live = np.repeat(best < none, sizes)
        if not live.all():                                  # units with an empty agenda are done
            done_ids.append(ids[~live])
            done_unit.append(unit[~live])
            best, sizes = best[best < none], sizes[best < none]
            ids, unit, place, rank, joined = ids[live], unit[live], place[live], rank[live], joined[live]
            if not len(ids):
                break
        at = np.flatnonzero(rank == np.repeat(best, sizes))     # places differ, so one in each unit
        ids[at] = joined[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        new = at - np.arange(len(at))                       # where the joined symbols are afterwards
        ids, unit, place, rank, joined = ids[keep], unit[keep], place[keep], rank[keep], joined[keep]
        n = len(ids)
        rank[new] = none
        for left in (new[(new + 1 < n)], new[new > 0] - 1):
            left = left[unit[left] == unit[np.minimum(left + 1, n - 1)]]
            left = left[left + 1 < n]
            rank[left], joined[left] = candidates(ids[left], ids[left + 1], place[left], unit[left])
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
    ids, unit = np.concatenate(done_ids), np.concatenate(done_unit)
    order = np.argsort(unit, kind="stable")
    return ids[order], np.bincount(unit, minlength=len(lengths))


class Encoder:
    """Encodes texts, each under its own key."""

    def __init__(self, v: Vocabulary, dropout: float = DROPOUT, seed: int = SEED, epoch: int = 0):
        self.v, self.dropout, self.seed, self.epoch = v, dropout, seed, epoch

    def key(self, name: str, epoch: int) -> int:
        """The hash key of a document."""
        return xxhash.xxh3_64_intdigest(f"{epoch}:{name}".encode(), seed=self.seed)

    def encode(self, names: list[str], texts: list, epochs: list[int] | None = None) -> list[np.ndarray]:
        """The pieces of each text (empty for null)."""
        v, prefix = self.v, " " if self.v.dummy_prefix else ""
        keys = np.array([self.key(n, e) for n, e in zip(names, epochs or [self.epoch] * len(names))], np.uint64)
        points = _points("".join([prefix + t for t in texts if t]))
        lengths = np.fromiter((len(t) + len(prefix) if t else 0 for t in texts), np.int64, len(texts))
        first = unit_starts(points, (np.cumsum(lengths) - lengths)[lengths > 0])
        symbols, sizes = v.spell(points)
        of_text = np.repeat(np.arange(len(texts)), lengths)[first]                # of each unit
        sizes = np.add.reduceat(sizes, np.flatnonzero(first)) if len(points) else np.zeros(0, np.int64)
        units = np.bincount(of_text, minlength=len(texts))
        place = np.arange(len(of_text)) - np.repeat(np.cumsum(units) - units, units)
        h = keys[of_text] ^ (place.astype(np.uint64) * _K2)
        unit_keys = (h ^ (h >> np.uint64(32))) * _K3
        pieces, counts = self._pieces(symbols, sizes, unit_keys)
        ends = np.cumsum(np.bincount(of_text, weights=counts, minlength=len(texts)).astype(np.int64))
        return np.split(pieces, ends[:-1]) if len(texts) else []

    def _pieces(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of units of ``sizes`` symbols, and each unit's number of them."""
        ends, out, counts = np.cumsum(sizes), [], np.zeros(len(sizes), np.int64)
        lo = 0
        while lo < len(sizes):
            before = int(ends[lo] - sizes[lo])
            if sizes[lo] >= LONG:
                own = agenda(self.v, symbols[before:ends[lo]].tolist(), int(keys[lo]), self.dropout)
                out.append(np.array(own, np.int32))
                counts[lo] = len(own)
                lo += 1
                continue
            hi = max(lo + 1, int(np.searchsorted(ends, before + RUN, side="right")))
            long = np.flatnonzero(sizes[lo:hi] >= LONG)
            hi = lo + int(long[0]) if len(long) else hi
            flat, counts[lo:hi] = agendas(self.v, symbols[before:ends[hi - 1]], sizes[lo:hi], keys[lo:hi], self.dropout)
            out.append(flat.astype(np.int32))
            lo = hi
        return np.concatenate(out) if out else np.zeros(0, np.int32), counts

    def decode(self, ids) -> str:
        text = b"".join(map(self.v.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")
        return text[1:] if self.v.dummy_prefix and text[:1] == " " else text


_ENCODED = "doc_id long, n_pieces int, pieces array<int>, lossless boolean"


def encode_documents(docs: DataFrame, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED, epoch: int | Column = 0) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_pieces, pieces, and whether decoding
    the pieces gave the text again.  Row by row, without a shuffle.  ``epoch``: a number, or a
    column where rows that repeat a doc_id are to be cut in different ways."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)      # the vocabulary's pieces and joins

    def run(batches):
        encoder = Encoder(shared.value, dropout, seed)
        for b in batches:
            ids, epochs = b.column("doc_id"), b.column("epoch").to_pylist()
            names = [str(i) for i in ids.to_pylist()]
            for lo, hi, part in column_slices(b.column("text"), SLICE):
                out = encoder.encode(names[lo:hi], part, epochs[lo:hi])
                null = np.array([t is None for t in part])
                sizes = np.fromiter(map(len, out), np.int32, len(out))
                same = [t is None or encoder.decode(p.tolist()) == t for p, t in zip(out, part)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.concatenate([null, [False]]))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes, mask=null), lists, pa.array(same)], ["doc_id", "n_pieces", "pieces", "lossless"])

    number = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", number.cast("long").alias("epoch")).mapInArrow(run, _ENCODED)


def decode_documents(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``encoded`` (pieces, and anything else) with the text it stands for; null for null."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("string")
    def text(pieces: pd.Series) -> pd.Series:
        return pieces.map(lambda p: None if p is None else Encoder(shared.value).decode(p))

    return encoded.withColumn("text", text("pieces"))


def default_vocabulary() -> Vocabulary:
    """The public 32,000-piece model of the installed vocabulary files; give another path to use another."""
    import public_tokenizers

    return Vocabulary.load(public_tokenizers.path("piece_bpe_32k.model"))


def op10_sentencepiece(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, default_vocabulary())
