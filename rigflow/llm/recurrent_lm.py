"""LM scoring: a gated recurrent language model with a class-factored output softmax.

Words are counted over all training documents.  The ``FREQUENT`` most used words (and the end
of a text) are symbols of their own, in classes of ``CLASS``; every other word belongs to one of
``TAILS`` classes by its last three bytes.  The network reads symbols and gives a softmax over
classes, then one over the words of a class; within a tail class a word has its smoothed share
of the class's counts, so every word, unseen ones too, has a probability.

Training is truncated backpropagation in numpy, data-parallel: a start from a bounded sample of
about ``WARM_TOKENS`` (documented), then the whole corpus, dealt to a fixed number of workers;
each goes on from there over all its rows, ``SHARD_TOKENS`` at a time, and their weights are averaged.  Scoring covers every row: the documents of a
batch go forward together, state carried across windows, whole texts.

The counts of the ``VOCABULARY`` most used words (ties by the word) go to the tasks; the few tokens beyond them are joined with the full counts.  Such words are
rare by construction, so no key of that join is hot.

Defined results: null is an empty text, which has one token, its end; rows without a doc_id are
not held out; without any training token N and V are 0 and both scores are those of the formula;
rows that repeat a doc_id are scored one by one.  Other columns are not looked at.
"""

from __future__ import annotations

import math
import pickle
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigflow.llm.common import arrow_slices, arrow_words, fold, hash_sample
from rigflow.session import materialize

END = b""                                  # no word is empty
FREQUENT, CLASS, TAILS = 1_023, 32, 64     # (with the end: 32 classes of 32)
CLASSES = (FREQUENT + 1) // CLASS
SYMBOLS = CLASSES * CLASS + TAILS
VOCABULARY = 131_072
HIDDEN, EMBEDDED = 16, 16
STREAMS, WINDOW, RATE = 32, 24, 0.004
WIDE = 256                                 # streams of the parallel round: an eighth of the steps, each over eight times the tokens
WARM_TOKENS, WARM_EPOCHS = 400_000, 2
SHARD_TOKENS = 500_000                     # tokens that a worker learns from at a time
WORKERS = 64                               # of the parallel round at most, or two for each core of a larger cluster
BLOCK = 1_024                              # tokens whose class outputs are held at a time: they stay in a core's cache
LN10 = float(np.log(10))


def tail_of(word: bytes) -> int:
    """Tail class of a word (also in SQL: ``_tail_column``)."""
    return zlib.crc32(word[-3:]) % TAILS


def _byte_parts() -> tuple[np.ndarray, np.ndarray]:
    """crc32 is linear: that of up to three bytes is that of as many zeros, xor a part of each byte
    by its place from the end. Those parts (with one of nothing for bytes not there), and zeros' crc32."""
    zeros = np.array([zlib.crc32(bytes(k)) for k in range(4)], np.uint32)
    parts = np.zeros((3, 257), np.uint32)
    for place in range(3):
        parts[place, :256] = [zlib.crc32(bytes([b]) + bytes(place)) for b in range(256)] ^ zeros[place + 1]
    return parts, zeros


_PARTS, _ZEROS = _byte_parts()


def tails_of(words: pa.Array) -> np.ndarray:
    """``tail_of`` of each of an Arrow array of words (none empty)."""
    if not len(words):
        return np.zeros(0, np.int64)
    words = words.cast(pa.large_binary())
    edges = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data, ends = np.frombuffer(words.buffers()[2], np.uint8), edges[1:]
    lengths = np.minimum(ends - edges[:-1], 3)
    crc = _ZEROS[lengths] ^ _PARTS[0][data[ends - 1]]
    for place in (1, 2):
        crc ^= _PARTS[place][np.where(lengths > place, data[ends - 1 - place], np.uint16(256))]
    return (crc % TAILS).astype(np.int64)


def _tail_column(word):
    return (F.crc32(F.when(F.length(word) > 3, F.substring(word, F.length(word) - 2, F.lit(3))).otherwise(word)) % TAILS).cast("int")


@dataclass
class Weights:
    embed: np.ndarray          # SYMBOLS x EMBEDDED
    read: np.ndarray           # EMBEDDED x 3 HIDDEN (update, reset, candidate)
    bias: np.ndarray
    turn: np.ndarray           # HIDDEN x 3 HIDDEN
    classes: np.ndarray        # HIDDEN x (CLASSES + TAILS)
    class_bias: np.ndarray
    words: np.ndarray          # CLASSES x CLASS x HIDDEN
    word_bias: np.ndarray      # CLASSES x CLASS

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.read, self.bias, self.turn, self.classes, self.class_bias, self.words, self.word_bias]

    @staticmethod
    def fresh(symbol_counts: np.ndarray, seed: int = 5) -> Weights:
        """Random, but for the biases: they start at the corpus's own shares."""
        r = np.random.default_rng(seed)
        n = lambda *shape: r.normal(0, 0.3 / np.sqrt(shape[-2] if len(shape) > 1 else 1), shape).astype(np.float32)
        own = symbol_counts[:CLASSES * CLASS].reshape(CLASSES, CLASS) + 0.5
        by_class = np.concatenate([own.sum(axis=1), symbol_counts[CLASSES * CLASS:] + 0.5])
        return Weights(r.normal(0, 0.3, (SYMBOLS, EMBEDDED)).astype(np.float32), n(EMBEDDED, 3 * HIDDEN), np.zeros(3 * HIDDEN, np.float32), n(HIDDEN, 3 * HIDDEN),
                       n(HIDDEN, CLASSES + TAILS), np.log(by_class / by_class.sum()).astype(np.float32),
                       np.zeros((CLASSES, CLASS, HIDDEN), np.float32), np.log(own / own.sum(axis=1, keepdims=True)).astype(np.float32))


SAFE = 40.0                                # exp of values within +-SAFE neither overflows nor vanishes in a sum


def _with_bias(w: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with their bias as one more input, which is always 1."""
    return np.concatenate([w, bias[..., None, :]], axis=-2)


def _most(w: np.ndarray) -> float:
    """What no output of these weights exceeds: states are within +-1."""
    return float(np.abs(w).sum(axis=-2).max())


def _exp(x: np.ndarray, most: float) -> np.ndarray:
    """exp along the rows, in place; less their maximum where they may be large."""
    if not most < SAFE:
        x -= x.max(axis=1, keepdims=True)
    return np.exp(x, out=x)


def class_of(symbols: np.ndarray) -> np.ndarray:
    return np.where(symbols < CLASSES * CLASS, symbols // CLASS, symbols - CLASSES * CLASS + CLASSES)


CLASS_OF = class_of(np.arange(SYMBOLS)).astype(np.uint8)      # (keys of one byte sort by counting)


def _by_class(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Places of the targets that are own symbols, in the order of their classes; each class's run."""
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(CLASSES + 1, dtype=np.uint8)).tolist()
    return order[:edges[-1]], [(k, slice(a, b)) for k, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def log_probability(w: Weights, hidden: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log of the symbols' probabilities after the states ``hidden`` (one a row)."""
    to_class, to_word = _with_bias(w.classes, w.class_bias), _with_bias(w.words.transpose(0, 2, 1), w.word_bias)
    most, most_word = _most(to_class), _most(to_word)
    of, rows = CLASS_OF[targets], np.ones((len(hidden), HIDDEN + 1), hidden.dtype)
    rows[:, :HIDDEN] = hidden
    out, buffer = np.empty(len(of)), np.empty((BLOCK, CLASSES + TAILS), to_class.dtype)
    for lo in range(0, len(of), BLOCK):
        part = of[lo:lo + BLOCK]
        x = np.matmul(rows[lo:lo + BLOCK], to_class, out=buffer[:len(part)])
        if not most < SAFE:
            x -= x.max(axis=1, keepdims=True)
        out[lo:lo + BLOCK] = x[np.arange(len(part)), part]
        out[lo:lo + BLOCK] -= np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))
    own, runs = _by_class(of)
    states, place = rows[own], targets[own] % CLASS
    y = np.empty((len(own), CLASS), to_word.dtype)
    for k, at in runs:
        np.matmul(states[at], to_word[k], out=y[at])
    if not most_word < SAFE:
        y -= y.max(axis=1, keepdims=True)
    chosen = y[np.arange(len(own)), place].astype(np.float64)
    out[own] += chosen - np.log(np.exp(y, out=y) @ np.ones(CLASS, y.dtype))
    return out


def learn(w: Weights, symbols: np.ndarray, end: int, epochs: int = 1, widest: int = STREAMS) -> Weights:
    """Truncated backpropagation (Adam) over a run of symbols in which every text ends with ``end``.

    The run is cut into streams of equal length that go forward together, up to ``widest`` where
    it is long enough for 64 steps; what the last ones lack is filled up with ends that teach nothing.
    Arrays are gates x time x streams x units, so that each step's values lie together.
    """
    w = Weights(*[x.copy() for x in w.arrays()])
    streams = max(1, min(max(STREAMS, min(widest, len(symbols) // (64 * WINDOW))), len(symbols) // (2 * WINDOW)))
    length = -(-len(symbols) // streams)
    if not length:
        return w
    full = np.full(streams * length, end, np.int16)
    full[:len(symbols)] = symbols
    data = np.ascontiguousarray(full.reshape(streams, length).T)           # time x streams
    real = (np.arange(streams * length) < len(symbols)).reshape(streams, length).T.astype(np.float32)
    m, v = [np.zeros_like(x) for x in w.arrays()], [np.zeros_like(x) for x in w.arrays()]
    buffer, ones = np.empty((BLOCK, CLASSES + TAILS), np.float32), np.ones(CLASSES + TAILS, np.float32)
    step, n = 0, HIDDEN
    for _ in range(epochs):
        h = np.zeros((streams, n), np.float32)
        before = np.full(streams, end, np.int16)
        for lo in range(0, length, WINDOW):
            targets = data[lo:lo + WINDOW]
            inputs = np.concatenate([before[None], targets[:-1]])
            before, steps = targets[-1], len(targets)
            flat, read = targets.ravel(), inputs.ravel()
            # a symbol's part of the gates; update and reset halved, as s(x) = (1 + tanh(x / 2)) / 2
            turn = np.ascontiguousarray(w.turn.reshape(n, 3, n).transpose(1, 0, 2))
            back_turn = np.ascontiguousarray(turn.transpose(0, 2, 1))
            table = np.ascontiguousarray((w.embed @ w.read + w.bias).reshape(SYMBOLS, 3, n).transpose(1, 0, 2))
            table[:2] *= 0.5
            turn[:2] *= 0.5
            gates, goes_on = np.empty((3, steps, streams, n), np.float32), (inputs != end).astype(np.float32)[:, :, None]
            for k in range(3):
                np.take(table[k], inputs, axis=0, out=gates[k], mode="clip")
            starts, turns = np.empty((steps, streams, n), np.float32), np.empty((3, steps, streams, n), np.float32)
            hidden = np.empty((steps, streams, n), np.float32)
            for t in range(steps):
                h0 = np.multiply(h, goes_on[t], out=starts[t])             # a text starts from nothing
                u = np.matmul(h0, turn, out=turns[:, t])
                zr, c = gates[:2, t], gates[2, t]
                zr += u[:2]
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                c += zr[1] * u[2]
                np.tanh(c, out=c)
                h = np.subtract(h0, c, out=hidden[t])
                h *= zr[0]
                h += c
            h = h.copy()
            z, r, c = gates
            of, rows = CLASS_OF[flat], np.ones((len(flat), n + 1), np.float32)
            rows[:, :n] = hidden.reshape(-1, n)
            counted = real[lo:lo + WINDOW].ravel()
            scale = counted / max(counted.sum(), 1)
            to_class, to_word = _with_bias(w.classes, w.class_bias), _with_bias(w.words.transpose(0, 2, 1), w.word_bias)
            most, back_class = _most(to_class), np.ascontiguousarray(w.classes.T)
            g_class, d_hidden = np.zeros_like(to_class), np.empty((len(flat), n), np.float32)
            for a in range(0, len(flat), BLOCK):
                part, weight = slice(a, a + BLOCK), scale[a:a + BLOCK]
                d = _exp(np.matmul(rows[part], to_class, out=buffer[:len(weight)]), most)
                d *= (weight / (d @ ones))[:, None]
                d[np.arange(len(weight)), of[part]] -= weight
                g_class += rows[part].T @ d
                np.matmul(d, back_class, out=d_hidden[part])
            own, runs = _by_class(of)
            states, weight, g_word = rows[own], scale[own], np.zeros_like(to_word)
            e, back_own = np.empty((len(own), CLASS), np.float32), np.empty((len(own), n), np.float32)
            for k, at in runs:
                np.matmul(states[at], to_word[k], out=e[at])
            e = _exp(e, _most(to_word))
            e *= (weight / (e @ ones[:CLASS]))[:, None]
            e[np.arange(len(own)), flat[own] % CLASS] -= weight
            for k, at in runs:
                g_word[k] = states[at].T @ e[at]
                np.matmul(e[at], w.words[k], out=back_own[at])
            d_hidden[own] += back_own
            d_hidden = d_hidden.reshape(steps, streams, n)
            # what each step's gates pass on, for all steps at once: only ``back`` goes step by step
            keep = 1 - z
            to_c = c * c
            np.subtract(1, to_c, out=to_c)
            to_c *= keep
            to_z = np.subtract(starts, c)
            to_z *= z
            to_z *= keep
            to_r = np.subtract(1, r, out=keep)
            to_r *= r
            to_r *= turns[2]
            d_gates, d_turns = turns, np.empty_like(turns)                 # (``turns`` is done with)
            back = np.zeros((streams, n), np.float32)
            for t in range(steps - 1, -1, -1):
                dh = np.add(d_hidden[t], back, out=d_hidden[t])
                dc = np.multiply(dh, to_c[t], out=d_gates[2, t])
                np.multiply(dh, to_z[t], out=d_turns[0, t])
                np.multiply(dc, to_r[t], out=d_turns[1, t])
                np.multiply(dc, r[t], out=d_turns[2, t])
                back = np.matmul(d_turns[:, t], back_turn).sum(axis=0)
                dh *= z[t]
                back += dh
                back *= goes_on[t]
            d_gates[:2] = d_turns[:2]
            d_gates, d_turns = d_gates.reshape(3, -1, n), d_turns.reshape(3, -1, n)
            g_turn = (starts.reshape(-1, n).T @ d_turns).transpose(1, 0, 2).reshape(n, 3 * n)
            into = np.matmul(d_gates, np.ascontiguousarray(w.read.reshape(EMBEDDED, 3, n).transpose(1, 2, 0)))
            into[0] += into[1]
            into[0] += into[2]
            into = np.ascontiguousarray(into[0].T)
            g_embed = np.stack([np.bincount(read, weights=x, minlength=SYMBOLS) for x in into], axis=1).astype(np.float32)
            g_read = (w.embed[read].T @ d_gates).transpose(1, 0, 2).reshape(EMBEDDED, 3 * n)
            g_bias = (np.ones(len(flat), np.float32) @ d_gates).ravel()
            g_classes, g_class_bias = g_class[:n], g_class[n]
            g_words, g_word_bias = g_word[:, :n].transpose(0, 2, 1), g_word[:, n]
            step += 1
            for x, g, a, b in zip(w.arrays(), (g_embed, g_read, g_bias, g_turn, g_classes, g_class_bias, g_words, g_word_bias), m, v):
                np.clip(g, -1, 1, out=g)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                x -= RATE * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-6)
    return w


def score_symbols(w: Weights, texts: list[np.ndarray], end: int, window: int = 16_384) -> np.ndarray:
    """log10 probability of each text's symbols (each ends with ``end``)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(int(lengths.max())), side="left")     # texts with more than t symbols
    offsets = np.concatenate([[0], np.cumsum(alive)])
    # time-major: the symbols of step t of all texts alive, longest text first
    steps = np.empty(int(lengths.sum()), np.int16)
    for j, i in enumerate(order):
        steps[offsets[:lengths[i]] + j] = texts[i]
    n = HIDDEN
    table = np.ascontiguousarray((w.embed @ w.read + w.bias).reshape(SYMBOLS, 3, n).transpose(1, 0, 2))
    turn = np.ascontiguousarray(w.turn.reshape(n, 3, n).transpose(1, 0, 2))
    table[:2] *= 0.5                                          # s(x) = (1 + tanh(x / 2)) / 2
    turn[:2] *= 0.5
    total, h, states, first = np.zeros(len(texts)), np.zeros((len(texts), n), table.dtype), [], 0
    last = np.full(len(texts), end, np.int16)
    for t in range(len(alive)):
        k = alive[t]
        h = h[:k]
        g, u = np.take(table, last[:k], axis=1), np.matmul(h, turn)
        zr, c = g[:2], g[2]
        zr += u[:2]
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        u[2] *= zr[1]
        c += u[2]
        np.tanh(c, out=c)
        h = h - c
        h *= zr[0]
        h += c
        states.append(h)
        last = steps[offsets[t]:offsets[t + 1]]
        if offsets[t + 1] - offsets[first] >= window or t + 1 == len(alive):
            got = log_probability(w, np.concatenate(states), steps[offsets[first]:offsets[t + 1]])
            place = np.concatenate([np.arange(x) for x in alive[first:t + 1]])
            total += np.bincount(place, weights=got, minlength=len(texts))
            states, first = [], t + 1
    out = np.empty(len(texts))
    out[order] = total / LN10
    return out


@dataclass
class Counts:
    """What the corpus gives: the counts of common words, and totals."""
    words: list[bytes]            # at most VOCABULARY, most frequent first, without the end
    counts: np.ndarray
    ends: int                     # training documents
    total: int                    # N
    distinct: int                 # V
    tail_words: np.ndarray        # by tail class: sum of (count + 1) over its words, plus 1

    def symbols(self) -> dict[bytes, int]:
        """Own symbols: the end first, then the most frequent words."""
        return {END: 0, **{x: i + 1 for i, x in enumerate(self.words[:FREQUENT])}}


def _summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])


def _count(batches):
    held, size, names = [], 0, ["word", "n"]
    for b in batches:
        for texts in arrow_slices(b.column("text"), 24_000_000):
            words, _ = arrow_words(texts)
            seen = words.value_counts()
            held += [pa.table([seen.field(0), seen.field(1)], names), pa.table([pa.array([END], pa.binary()), pa.array([len(texts)], pa.int64())], names)]
            size += len(seen) + 1
            if size > 1_000_000:
                held = [_summed(held)]
                size = held[0].num_rows
                if size > 500_000:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from _summed(held).to_batches()


def count_words(train: DataFrame) -> tuple[DataFrame, Counts]:
    """Counts of all words (word, c) and what the tasks get of them."""
    summed = train.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts, distinct = materialize(summed, "word-counts")
    # counts in steps that grow with them: a bounded list, in the order of the counts
    step = F.when(F.col("c") < (1 << 16), F.col("c")).otherwise((1 << 16) + F.floor((F.log2("c") - 16) * 4096)).cast("long")
    held, floor, rest = 0, -1, 0
    by_step = counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("tokens")).orderBy(F.desc("step")).collect()
    for r in by_step:
        if held + r["n"] > VOCABULARY + 1:                   # (the end is among them)
            floor, rest = r["step"], VOCABULARY + 1 - held
            break
        held += r["n"]
    common = counts.where(step > floor)
    if rest:
        common = common.unionByName(counts.where(step == floor).orderBy(F.desc("c"), "word").limit(rest))
    common = common.toArrow()
    words, n = common.column("word").to_pylist(), common.column("c").to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i]))
    ends = sum(int(n[i]) for i in order if words[i] == END)
    order = [i for i in order if words[i] != END]
    if not ends:                                             # (no word is as common as the end of few texts)
        ends = (counts.where(F.length("word") == 0).agg(F.sum("c")).first()[0] or 0)
    words, n = [words[i] for i in order], np.array([n[i] for i in order], np.int64)
    tails = np.ones(TAILS)
    for r in counts.where(F.length("word") > 0).groupBy(_tail_column(F.col("word")).alias("k")).agg(F.sum(F.col("c") + 1).alias("n")).collect():
        tails[r["k"]] += r["n"]
    for x, k in zip(words[:FREQUENT], n[:FREQUENT]):
        tails[tail_of(x)] -= k + 1
    return counts, Counts(words, n, ends, int(sum(r["tokens"] for r in by_step)), distinct, tails)


def places_of(words: pa.Array, listed: pa.Array) -> np.ndarray:
    """Place of each word in ``listed``, -1 where it is not there."""
    return pc.fill_null(pc.index_in(words, value_set=listed), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of texts of so many words lie once each text has its end, and where the ends do."""
    words = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)
    return words, np.cumsum(lengths + 1) - 1


def _symbols_of(texts: pa.Array, own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a column of texts, one after another, each with its end; where each text's end lies."""
    words, lengths = arrow_words(texts)
    symbols = places_of(words, own) + 1
    tail = np.flatnonzero(symbols == 0)
    symbols[tail] = CLASSES * CLASS + tails_of(words.take(pa.array(tail)))
    at, ends = _ends(lengths)
    out = np.zeros(len(symbols) + len(lengths), np.int16)     # (the end is symbol 0)
    out[at] = symbols
    return out, ends


def _train_shard(shared, epochs: int, widest: int):
    def run(batches):
        weights, own = shared.value
        own = pa.array(own, pa.binary())
        total, held, size = 0, [], 0
        for b in batches:
            for texts in arrow_slices(b.column("text")):
                symbols, ends = _symbols_of(texts, own)
                start = 0
                while start < len(symbols):
                    # up to the end of the text that fills the shard
                    k = np.searchsorted(ends, start + SHARD_TOKENS - size - 1)
                    stop = int(ends[min(k, len(ends) - 1)]) + 1
                    held.append(symbols[start:stop])
                    size, start = size + stop - start, stop
                    if size >= SHARD_TOKENS:
                        weights = learn(weights, np.concatenate(held), 0, epochs, widest)
                        total, held, size = total + size, [], 0
        if size:
            weights = learn(weights, np.concatenate(held), 0, epochs, widest)
        if total + size:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total + size], pa.int64()),
                                              pa.array([pickle.dumps(weights.arrays())], pa.binary())], ["shard", "tokens", "weights"])

    return run


def _mean(group: pd.DataFrame) -> pd.DataFrame:
    total, out = 0, None
    for tokens, packed in zip(group["tokens"], group["weights"]):
        own = [x.astype(np.float64) * tokens for x in pickle.loads(packed)]
        out = own if out is None else [a + b for a, b in zip(out, own)]
        total += tokens
    return pd.DataFrame({"tokens": [total], "weights": [pickle.dumps([x / total for x in out])]})


_SHARD = "shard int, tokens long, weights binary"


def train(docs: DataFrame, counts: Counts) -> Weights:
    """Train on ``docs`` (doc_id, text), the training rows."""
    sc, own = docs.sparkSession.sparkContext, counts.words[:FREQUENT]
    shares = np.concatenate([[counts.ends], counts.counts[:FREQUENT], np.zeros(max(0, FREQUENT - len(counts.words))), np.maximum(counts.tail_words - 1, 0)])
    weights = Weights.fresh(shares)
    rate = min(1.0, WARM_TOKENS / max(counts.total, 1))
    warm = hash_sample(docs, F.col("doc_id"), rate, 51).select("text").repartition(1)
    found = warm.mapInArrow(_train_shard(sc.broadcast((weights, own)), WARM_EPOCHS, STREAMS), _SHARD).collect()
    if found:
        weights = Weights(*pickle.loads(found[0]["weights"]))
    shards = max(1, min(round(counts.total / SHARD_TOKENS), max(WORKERS, 2 * sc.defaultParallelism)))
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("deal")).repartition(shards, "deal").select("text")
    trained = rows.mapInArrow(_train_shard(sc.broadcast((weights, own)), 1, WIDE), _SHARD)
    for step in (F.pmod("shard", F.lit(math.isqrt(shards))), F.lit(0)):      # averaged in two steps, a few at a time
        trained = trained.groupBy(step.alias("part")).applyInPandas(_mean, "tokens long, weights binary")
        trained = trained.withColumn("shard", F.lit(0))
    found = trained.collect()
    return Weights(*[x.astype(np.float32) for x in pickle.loads(found[0]["weights"])]) if found else weights


_SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, words array<binary>, times array<int>"


def _score(shared):
    def run(batches):
        weights, counts = shared.value
        listed, most = pa.array(counts.words, pa.binary()), len(counts.words)
        symbol = np.append(np.arange(1, most + 1), 0)                        # of each listed word, then the end
        symbol[FREQUENT:most] = CLASSES * CLASS + tails_of(listed[FREQUENT:])
        log_count = np.log10(np.concatenate([counts.counts, [counts.ends]]) + 1.0)
        log_tail = np.log10(counts.tail_words)
        all_tokens = np.log10(counts.total + counts.distinct + 1.0)
        end_known = counts.ends > 0
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            first = 0
            for texts in arrow_slices(b.column("text"), 24_000_000):
                n, (words, lengths) = len(texts), arrow_words(texts)
                found = places_of(words, listed)
                in_words, ends = _ends(lengths)
                at = np.full(len(found) + n, most, np.int64)
                at[in_words] = found
                s, logs = symbol[at], log_count[at]
                # words that are not listed: each text's, with how often it has them
                missing = np.flatnonzero(found < 0)
                rare = words.take(pa.array(missing))
                s[in_words[missing]] = CLASSES * CLASS + tails_of(rare)
                logs[in_words[missing]] = 0
                rare, owner = rare.dictionary_encode(), np.repeat(np.arange(n), lengths)[missing]
                kinds = max(len(rare.dictionary), 1)
                pairs, times = np.unique(owner * kinds + rare.indices.to_numpy(zero_copy_only=False), return_counts=True)
                edges = pa.array(np.searchsorted(pairs, np.arange(n + 1) * kinds), pa.int32())
                starts, n_tokens = ends - lengths, lengths + 1
                tail = np.flatnonzero(s >= CLASSES * CLASS)
                of_tail = np.zeros(len(s))
                of_tail[tail] = logs[tail] - log_tail[s[tail] - CLASSES * CLASS]
                base = np.add.reduceat(logs, starts) - n_tokens * all_tokens
                score = score_symbols(weights, np.split(s.astype(np.int16), ends[:-1] + 1), 0) + np.add.reduceat(of_tail, starts)
                n_known = n_tokens - np.bincount(owner, minlength=n) - (not end_known)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), b.column("doc_id").slice(first, n), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
                                                  pa.array(base, pa.float64()), pa.array(score), pa.ListArray.from_arrays(edges, rare.dictionary.take(pa.array(pairs % kinds))),
                                                  pa.ListArray.from_arrays(edges, pa.array(times, pa.int32()))],
                                                 ["row", "doc_id", "n_tokens", "n_known", "base", "score", "words", "times"])
                row, first = row + n, first + n

    return run


def score(docs: DataFrame, word_counts: DataFrame, counts: Counts, weights: Weights) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast((weights, counts))     # at most VOCABULARY words
    scored, _ = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(shared), _SCORED), "scored")
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(word_counts, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("times").alias("known"))
    out = scored.drop("words", "times").join(found, "row", "left")
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
                      (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op5_lm_score(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7, 2)
    training = docs.where(~held_out)
    word_counts, counts = count_words(training)
    return score(docs, word_counts, counts, train(training, counts)).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
