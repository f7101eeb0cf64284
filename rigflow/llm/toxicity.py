"""Toxicity: a convolutional text classifier with thresholds by language.

A word is the sum of two hashed embeddings (the word, its first four letters).  Filters of
several widths run over the words, the maximum over the whole text is taken of each, and a
linear layer gives the logit.  Only the place of each maximum gets a gradient, so a training step costs
little more than the forward pass.

Training learns from every labelled document.  A starting network is learned in one task from
a slice of them (``POSITIVES`` and ``NEGATIVES``, so that all workers begin near the same place);
every other labelled document is then learned by the task that reads it, each task going on from
the starting network, and Spark averages what the tasks have learned: a row of the embeddings
over the tasks that changed it, all else over all tasks, by the rows they read.  Every
labelled document is scored by a network that has not learned it yet (those of the starting
slice by a network of the slice's other half); counts of these logits by language, label and
step of 1 / ``STEPS`` give, for each predicted language, the logit that separates best; scores
are shifted so that this threshold is 0.5.  Languages are learned from every row, too.  How
Spark deals the rows to tasks moves the averages a little.

A task finds hashed rows and language scores of a word once, for learning, scoring and language
alike, as long as it keeps the word (``CACHE``).  Scoring projects a text's words through all
filters ``RUN`` words at a time and adds up the projections along the text.

Defined results: null or empty text, or one without letters, is scored by the bias alone, at the
overall threshold; documents with several labels count as toxic if any says so; null labels are
not learned from; without labels of both kinds every score is 0 and nothing is predicted toxic.
Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigflow.llm import language_id
from rigflow.llm.common import fold, free_name, sample_rate, text_slices
from rigflow.session import materialize

POSITIVES, NEGATIVES = 1_500, 2_500
WORDS, PREFIXES = 1 << 15, 1 << 13     # hashed embeddings
DIM, WIDTHS, FILTERS = 12, (1, 2, 3), 16
EPOCHS, BATCH, RATE = 5, 32, 0.2
CACHE = 200_000                        # words that a task keeps from one slice to the next
RUN = 8_192
STEPS, WIDEST = 256, 30                # logits are counted in steps of 1 / STEPS, up to WIDEST on either side


def _buckets(words: list[str]) -> np.ndarray:
    """Words x 2: the rows of the embedding table of each word."""
    crc = lambda texts: np.fromiter([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in texts], np.int64, len(texts))
    firsts: dict[str, int] = {}
    first = np.fromiter([firsts.setdefault(w[:4], len(firsts)) for w in words], np.int64, len(words))
    return np.stack([crc(words) % WORDS, WORDS + crc(list(firsts))[first] % PREFIXES], axis=1).astype(np.int32)


def _spans() -> list[tuple[int, int, slice]]:
    """(width, offset, columns of the projection) of every filter tap."""
    at, out = 0, []
    for w in WIDTHS:
        for o in range(w):
            out.append((w, o, slice(at, at + FILTERS)))
            at += FILTERS
    return out


TAPS = _spans()


@dataclass
class Network:
    table: np.ndarray                       # (WORDS + PREFIXES) x DIM
    taps: np.ndarray                        # DIM x (FILTERS for every tap)
    bias: np.ndarray                        # FILTERS for every width
    out: np.ndarray
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 8) -> Network:
        r = np.random.default_rng(seed)
        # words start near nothing, so one that is never a maximum stays without effect
        return Network(r.normal(0, 0.02, (WORDS + PREFIXES, DIM)).astype(np.float32), r.normal(0, 0.3, (DIM, len(TAPS) * FILTERS)).astype(np.float32),
                       np.zeros(len(WIDTHS) * FILTERS, np.float32), r.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32))

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """One logit for each list of words."""
        return self.pooled(texts) @ self.out + self.shift

    def pooled(self, texts: list[list[str]]) -> np.ndarray:
        place: dict[str, int] = {}
        at = [np.array([place.setdefault(w, len(place)) for w in t], np.int64) for t in texts]
        return self.pooled_rows(_buckets(list(place)), at)

    def pooled_rows(self, buckets: np.ndarray, texts: list[np.ndarray]) -> np.ndarray:
        """The maxima of texts given by the places of their words in ``buckets``."""
        pooled, taps, pad = np.zeros((len(texts), len(WIDTHS) * FILTERS), np.float32), np.ascontiguousarray(self.taps.T), max(WIDTHS) - 1
        table = self.table[buckets[:, 0]] + self.table[buckets[:, 1]]
        for out, at in zip(pooled, texts):
            for lo in range(0, len(at), RUN):
                n = min(RUN, len(at) - lo)                   # places where a filter starts; the words after them count, too
                projected = taps @ np.take(table, at[lo:lo + n + pad], axis=0, mode="clip").T
                for k, width in enumerate(WIDTHS):
                    z = None
                    for w, o, cols in TAPS:
                        if w == width:
                            part = projected[cols, o:n + o]
                            if z is None:
                                z = part
                            else:
                                z[:, :part.shape[1]] += part  # (past the text's end words are missing)
                    most, own = z.max(axis=1), out[k * FILTERS:(k + 1) * FILTERS]
                    own[:] = np.maximum(own, most) if lo else most
        return np.maximum(pooled + self.bias * np.fromiter(map(len, texts), np.int64, len(texts)).astype(bool)[:, None], 0)


@dataclass
class Learner:
    """A network that is being learned, with Adagrad's sums of squares and the embeddings changed."""

    net: Network
    sums: list[np.ndarray]
    touched: np.ndarray

    @staticmethod
    def of(net: Network) -> Learner:
        return Learner(net, [np.full_like(x, 1e-2) for x in (net.table, net.taps, net.bias, net.out)], np.zeros(len(net.table), bool))

    def step(self, buckets: list[np.ndarray], toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Learn from a minibatch; its logits before that. Gradients flow through the place of each maximum."""
        net, sums, logits = self.net, self.sums, np.zeros(len(buckets))
        g_taps, g_bias, g_out, g_shift = np.zeros_like(net.taps), np.zeros_like(net.bias), np.zeros_like(net.out), 0.0
        touched, grads, taps = [], [], np.ascontiguousarray(net.taps.T)
        for d, rows in enumerate(buckets):
            n = len(rows)
            pooled, best, vectors = np.zeros(len(net.bias), np.float32), [None] * len(WIDTHS), None
            if n:
                vectors = np.take(net.table, rows[:, 0], axis=0)
                vectors += np.take(net.table, rows[:, 1], axis=0)
                projected = taps @ vectors.T                 # filter taps x words: the maxima lie along rows
                for w, o, cols in TAPS:
                    k = WIDTHS.index(w)
                    if o == 0:
                        z = projected[cols]
                    elif o < n:
                        z[:, :n - o] += projected[cols, o:]
                    if o == w - 1:
                        best[k] = z.argmax(axis=1)
                        pooled[k * FILTERS:(k + 1) * FILTERS] = z[np.arange(FILTERS), best[k]]
                pooled = np.maximum(pooled + net.bias, 0)
            logits[d] = pooled @ net.out + net.shift
            p = 1 / (1 + np.exp(-np.clip(logits[d], -30, 30)))
            e = np.float32((p - toxic[d]) * weight[d] / len(buckets))
            g_out += e * pooled
            g_shift += e
            if not n:
                continue
            g = e * net.out * (pooled > 0)
            g_bias += g
            for w, o, cols in TAPS:
                k = WIDTHS.index(w)
                own = g[k * FILTERS:(k + 1) * FILTERS]
                at = best[k] + o
                here = np.flatnonzero((at < n) & (own != 0))
                if len(here):
                    g_taps[:, cols.start + here] += vectors[at[here]].T * own[here]
                    v = (net.taps[:, cols.start + here] * own[here]).T
                    touched += [rows[at[here], 0], rows[at[here], 1]]
                    grads += [v, v]
        for x, g, s in ((net.taps, g_taps, sums[1]), (net.bias, g_bias, sums[2]), (net.out, g_out, sums[3])):
            s += g * g
            x -= RATE * g / np.sqrt(s)
        net.shift -= RATE * float(g_shift)
        if touched:
            rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            g = np.zeros((len(rows), DIM), np.float32)
            np.add.at(g, inverse, np.concatenate(grads))
            sums[0][rows] += g * g
            net.table[rows] -= RATE * g / np.sqrt(sums[0][rows])
            self.touched[rows] = True
        return logits


def fit(texts: list[list[str]], toxic: np.ndarray, weight: np.ndarray, seed: int = 8) -> Learner:
    """Adagrad over minibatches of all texts, ``EPOCHS`` times."""
    learner, r = Learner.of(Network.fresh(seed)), np.random.default_rng(seed)
    buckets = [_buckets(t) for t in texts]
    for _ in range(EPOCHS):
        order = r.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            batch = order[lo:lo + BATCH]
            learner.step([buckets[d] for d in batch], toxic[batch], weight[batch])
    return learner


def _threshold(logits: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> float:
    """The logit, half way between two, from which calling texts toxic has the best F1."""
    order = np.argsort(-logits, kind="stable")
    hit, all_ = np.cumsum((toxic * weight)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (toxic * weight).sum())
    k = int(f1.argmax())
    above = logits[order[k]]
    below = logits[order[k + 1]] if k + 1 < len(order) else above - 1
    return float((above + below) / 2)


def negative_weight(rates: dict[int, float]) -> float:
    """What a sampled negative weighs against a sampled positive, so that both count as they occur."""
    return rates[1] / rates[0]


def words_of(text: str | None) -> list[str]:
    return language_id.lower_words(text) if text else []


class Vocabulary:
    """Rows of the embedding table and language scores of the words that a task has met."""

    def __init__(self, language: language_id.Model):
        self.language = language
        self._clear()

    def _clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.buckets, self.scores = np.zeros((0, 2), np.int32), np.zeros((0, len(self.language.languages)), np.float32)

    def places(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Where the words of each text are; holds until the next call."""
        if len(self.ids) > CACHE:
            self._clear()
        words = [w for t in texts for w in t]
        new = list(set(words).difference(self.ids))
        self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))
        self.buckets = np.concatenate([self.buckets, _buckets(new)])
        if self.language.languages:
            self.scores = np.concatenate([self.scores, self.language.word_scores(new)])
        at = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        return np.split(at, np.cumsum([len(t) for t in texts])[:-1])

    def languages(self, texts: list[np.ndarray]) -> list[str]:
        """The language in which the words of each text are likeliest; "und" without words."""
        names, out = self.language.languages, np.full(len(texts), "und", object)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        some = np.flatnonzero(lengths)
        if len(some) and names:
            sums = np.add.reduceat(np.take(self.scores, np.concatenate(texts), axis=0), np.cumsum(lengths[some]) - lengths[some])
            out[some] = np.array(names, object)[sums.argmax(axis=1)]
        return out.tolist()


def main_language(model: language_id.Model, texts: list[list[str]]) -> list[str]:
    """The language of each list of words (``Vocabulary.languages``)."""
    words = Vocabulary(model)
    return words.languages(words.places(texts))


PARTS = [f"x{i}" for i in range(DIM)]
LEARNED = "lang string, toxic int, at int, n long, " + ", ".join(f"{x} double" for x in PARTS)


def _dense(net: Network) -> np.ndarray:
    """All weights but the embeddings, as rows of DIM."""
    flat = np.concatenate([net.taps.ravel(), net.bias, net.out, [net.shift]])
    return np.pad(flat, (0, -len(flat) % DIM)).reshape(-1, DIM)


def _with_weights(net: Network, at: np.ndarray, rows: np.ndarray) -> Network:
    """``net`` with the embeddings and the dense rows ``at`` replaced."""
    table, dense = net.table.copy(), _dense(net)
    low = at < len(table)
    table[at[low]] = rows[low]
    dense[at[~low] - len(table)] = rows[~low]
    sizes = [net.taps.size, net.bias.size, net.out.size, 1]
    taps, bias, out, shift = np.split(dense.ravel()[:sum(sizes)], np.cumsum(sizes)[:-1])
    return Network(table, taps.reshape(net.taps.shape).astype(np.float32), bias.astype(np.float32), out.astype(np.float32), float(shift[0]))


def _steps(langs: list[str], toxic: np.ndarray, logits: np.ndarray) -> pd.DataFrame:
    """Counts of logits by language, label and step."""
    at = np.rint(np.clip(logits, -WIDEST, WIDEST) * STEPS).astype(np.int32)
    return pd.DataFrame({"lang": langs, "toxic": toxic.astype(np.int32), "at": at}).groupby(["lang", "toxic", "at"]).size().rename("n").reset_index()


def _start_task(language: language_id.Model):
    """A task that learns the starting network from all of its rows (a bounded slice); returns it
    as bytes, and the counts of the rows' logits under a network of the other half."""
    import pickle

    def run(batches):
        frame = pd.concat(list(batches), ignore_index=True)
        if not len(frame):
            return
        frame = frame.sort_values(["doc_id"], kind="stable").reset_index(drop=True)
        toxic = frame["toxic"].to_numpy(np.float32)
        texts = [words_of(t) for t in frame["text"]]
        weight = np.where(toxic == 1, np.float32(min((toxic == 0).sum() / max(toxic.sum(), 1), 5)), np.float32(1))
        half = np.array([zlib.crc32(f"c{i}".encode()) % 2 for i in frame["doc_id"]])
        logits = np.zeros(len(frame))
        for h in (0, 1):
            own, other = np.flatnonzero(half == h), np.flatnonzero(half != h)
            # (a half that lacks one of the labels gives no network to compare with)
            learn = other if len(np.unique(toxic[other])) == 2 else np.arange(len(frame))
            logits[own] = fit([texts[i] for i in learn], toxic[learn], weight[learn]).net.logits([texts[i] for i in own])
        learner = fit(texts, toxic, weight)
        counts = _steps(main_language(language, texts), toxic, logits)
        yield counts.assign(learner=None)
        yield pd.DataFrame({"lang": [None], "toxic": [0], "at": [0], "n": [len(frame)], "learner": [pickle.dumps(learner)]})

    return run


def _learn_task(shared, positive_weight: float):
    """A task that goes on from the starting network over all of its rows, a batch at a time; returns the
    weights it has changed, with the number of its rows, and the counts of the rows' logits."""

    def run(batches):
        learner, language = shared.value
        net = learner.net
        learner = Learner(Network(net.table.copy(), net.taps.copy(), net.bias.copy(), net.out.copy(), net.shift), [s.copy() for s in learner.sums], np.zeros(len(net.table), bool))
        rows, counts, known = 0, [], Vocabulary(language)
        for frame in batches:
            texts, labels = frame["text"].tolist(), frame["toxic"].to_numpy(np.float32)
            for lo, hi in text_slices(texts, 2_000_000):
                words, toxic = [words_of(t) for t in texts[lo:hi]], labels[lo:hi]
                at = known.places(words)
                buckets = [known.buckets[x] for x in at]
                weight, logits = np.where(toxic == 1, np.float32(positive_weight), np.float32(1)), np.zeros(len(words))
                for a in range(0, len(words), BATCH):
                    logits[a:a + BATCH] = learner.step(buckets[a:a + BATCH], toxic[a:a + BATCH], weight[a:a + BATCH])
                counts.append(_steps(known.languages(at), toxic, logits))
                counts = [pd.concat(counts).groupby(["lang", "toxic", "at"])["n"].sum().reset_index()] if len(counts) > 20 else counts
                rows += len(words)
        if not rows:
            return
        yield pd.concat(counts).assign(**{x: 0.0 for x in PARTS})
        at = np.flatnonzero(learner.touched)
        dense = _dense(learner.net)
        weights = np.concatenate([learner.net.table[at], dense]).astype(float)
        at = np.concatenate([at, len(net.table) + np.arange(len(dense))]).astype(np.int32)
        yield pd.DataFrame({"lang": None, "toxic": 0, "at": at, "n": rows, **{x: weights[:, i] for i, x in enumerate(PARTS)}})

    return run


def _thresholds(counts: pd.DataFrame) -> dict[str, float]:
    """The best logit of all and of each language, from counts of (lang, toxic, at)."""
    def cut(own: pd.DataFrame) -> float:
        # of equal logits those without the label come first, so no cut falls between them
        own = own.groupby(["toxic", "at"])["n"].sum().reset_index().sort_values("toxic", kind="stable")
        return _threshold(own["at"].to_numpy() / STEPS, own["toxic"].to_numpy(), own["n"].to_numpy())

    out = {"": cut(counts)}
    for lang, own in counts.groupby("lang"):
        n = own.groupby("toxic")["n"].sum()
        if n.get(1, 0) >= 20 and n.get(0, 0) >= 20:
            out[lang] = cut(own)
    return out


def with_labels(docs: DataFrame, known: DataFrame) -> DataFrame:
    """text and toxic of the rows of ``docs`` that ``known`` (a row for each doc_id) has a label for.

    The labels grow with the corpus, so they are never broadcast: texts meet them by one shuffle
    at any size (a join that Spark would begin to shuffle from some size on)."""
    return docs.join(known.hint("merge"), "doc_id").select("text", "toxic")


def train(docs: DataFrame, labels: DataFrame, language: language_id.Model) -> Network | None:
    """Learn from every row of ``docs`` (doc_id, text) that ``labels`` (doc_id, toxic) has a label for."""
    import pickle

    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known, _ = materialize(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    rates = {1: sample_rate(counts[1], POSITIVES), 0: sample_rate(counts[0], NEGATIVES)}
    positive_weight = min(counts[0] / counts[1], 5)
    place = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30))
    starts = place < F.when(F.col("toxic") == 1, int(rates[1] * (1 << 30))).otherwise(int(rates[0] * (1 << 30)))
    rows = docs.select("doc_id", "text")
    begin, _ = materialize(known.where(starts), "label-start")          # (written, so Spark sees that it is small and moves no text)
    first = rows.join(begin, "doc_id").repartition(1).mapInPandas(_start_task(language), "lang string, toxic int, at int, n long, learner binary").toPandas()
    if not len(first):
        return None
    learner, seen = pickle.loads(first["learner"].dropna().iloc[0]), first[first["lang"].notna()]
    net = learner.net
    if min(rates.values()) < 1:
        shared = docs.sparkSession.sparkContext.broadcast((learner, language))          # fixed sizes
        learned = with_labels(rows, known.where(~starts)).mapInPandas(_learn_task(shared, positive_weight), LEARNED)
        total = learned.groupBy("lang", "toxic", "at").agg(F.sum("n").alias("n"), *[(F.sum(F.col(x) * F.col("n")) / F.sum("n")).alias(x) for x in PARTS]).toPandas()
        weights = total[total["lang"].isna()]
        net = _with_weights(net, weights["at"].to_numpy(), weights[PARTS].to_numpy())
        seen = pd.concat([seen, total[total["lang"].notna()]])
    net.thresholds = _thresholds(seen[["lang", "toxic", "at", "n"]])
    return net


def score(docs: DataFrame, network: Network | None, language: language_id.Model) -> DataFrame:
    """``docs`` with score and predicted (in place of columns so named); row by row, no shuffle."""
    if network is None:
        return docs.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shared = docs.sparkSession.sparkContext.broadcast((network, language))     # fixed sizes

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net, model = shared.value
        known = Vocabulary(model)
        for batch in batches:
            texts, out = batch.tolist(), []
            for lo, hi in text_slices(texts, 2_000_000):
                at = known.places([words_of(t) for t in texts[lo:hi]])
                cut = [net.thresholds.get(x, net.thresholds[""]) for x in known.languages(at)]
                logits = net.pooled_rows(known.buckets, at) @ net.out + net.shift
                out.append(1 / (1 + np.exp(-np.clip(logits - np.array(cut), -50, 50))))
            yield pd.Series(np.concatenate(out).astype(float) if out else np.zeros(0))

    name = free_name(docs, "toxic_score")
    scored = docs.withColumn(name, toxic("text"))
    return scored.withColumns({"score": F.col(name), "predicted": (F.col(name) >= 0.5).cast("int")}).drop(name)


def op8_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    language = language_id.train_fold(docs, sample=None)
    learned = ~fold(F.col("doc_id"), 5, 0)
    network = train(docs.where(learned), labels.where(learned), language)
    return score(docs.select("doc_id", "text"), network, language).select("doc_id", fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
