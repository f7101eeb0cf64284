"""Language identification with spans.

Words are runs of letters (Unicode category L, and M after it).  The script of a word (Unicode ranges) narrows the languages to
those that were learned with that script; each candidate gets the word's log-likelihood from
character n-grams (1 to 4, and the whole word), relative to the best candidate.  Viterbi over
the words, with a penalty for every change of language, labels spans; the document's language
is the one with most letters, and its score their share.

Training: n-gram counts of a hash sample of about ``SAMPLE`` labelled documents (a documented
bound; every other step covers all rows), and of ``LEAST_OF_EACH`` of each language at least or
all it has; summed by Spark into ``BUCKETS`` hashed counts for
each language, so the model's size does not depend on the corpus.

Defined results: null text, or text without a letter, is "und" with score 0 and no spans; a
script that no language was learned with leaves all languages as candidates, without evidence;
ties go to the language that sorts first; rows with a null label are not learned from; with no
labelled row at all every text is "und".  Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigflow.llm.common import column_slices, fold, free_name, sample_rate, text_slices

SAMPLE = 20_000        # labelled documents learned from
LEAST_OF_EACH = 200    # of a language, so that a rare one is learned on a table of any size
BUCKETS = 1 << 14      # hashed n-grams
SWITCH = 9.0           # penalty of a change of language, in nats
FLOOR = -12.0          # a word counts against a language by no more than this
CACHE = 50_000         # words whose scores a task keeps from one slice to the next
SLICE = 2_000_000      # bytes of text that a task labels at a time

#: First and last code point of the ranges that tell scripts apart.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")       # with the marks that belong to a letter; no numerals
_ASCII = re.compile(r"[a-z]+")                       # the same in lower-case ASCII
_NAMES = [*SCRIPTS, "other"]


def lower_words(text: str) -> list[str]:
    """The words of the lower-case text."""
    low = text.lower()
    return (_ASCII if low.isascii() else LETTERS).findall(low)


def script_of(word: str) -> int:
    """Index into SCRIPTS (or "other") by the word's first letter."""
    return _script_at(word[0])


@lru_cache(maxsize=1 << 16)
def _script_at(letter: str) -> int:
    c = ord(letter)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            if a <= c <= b:
                return k
    return len(SCRIPTS)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of lower-case words with their ends marked: bucket, and the word it is of.

    Rolling hashes over the code points of all words at once; every word gives at least one.
    """
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.cumsum(lengths)[owner] - np.arange(len(points))      # code points to the word's end
    prime, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - int(np.log2(BUCKETS)))
    mixed = lambda h: (((h ^ (h >> np.uint64(29))) * prime) >> shift).astype(np.int32)
    buckets, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in (1, 2, 3, 4):
        h = h[:len(points) - n + 1] * prime + points[n - 1:] + np.uint64(n)
        whole = left[:len(h)] >= n
        buckets.append(mixed(h[whole]))
        owners.append(owner[:len(h)][whole])
    starts = np.cumsum(lengths) - lengths
    place = (np.arange(len(points)) - starts[owner] + 1).astype(np.uint64)
    if len(words):
        buckets.append(mixed(np.add.reduceat(points * prime * (place * place + np.uint64(1)), starts)))
        owners.append(np.arange(len(words)))
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray                  # languages x BUCKETS, float32
    by_script: list[np.ndarray]        # for each script, the candidate languages
    prior: int = 0                     # the language with most training words
    _scores: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_scores": {}}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each language relative to the best candidate, FLOOR at least."""
        out = np.full((len(words), len(self.languages)), FLOOR, np.float32)
        scripts = np.fromiter(map(script_of, words), np.int64, len(words))
        for script in np.unique(scripts):
            candidates, at = self.by_script[script], np.flatnonzero(scripts == script)
            if len(candidates) == 1:
                out[at, candidates[0]] = 0.0
                continue
            buckets, owners = grams([words[i].lower() for i in at])
            s = np.empty((len(at), len(candidates)), np.float32)
            for k, c in enumerate(candidates):
                s[:, k] = np.bincount(owners, weights=self.log_p[c][buckets], minlength=len(at))
            out[np.ix_(at, candidates)] = np.maximum(s - s.max(axis=1, keepdims=True), FLOOR)
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Words x languages, by a table of word scores that grows as words come up."""
        known = self._scores.setdefault("ids", {})
        if len(known) > CACHE:
            known.clear()
        new = list(set(words).difference(known))
        table = self.word_scores(new)
        if known:
            table = np.concatenate([self._scores["table"], table])
        self._scores["table"] = table
        known.update(zip(new, range(len(known), len(known) + len(new))))
        return table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of every row of ``scores``; documents of ``lengths`` rows lie one after another.

    All documents go forward together, longest first, so one step is a few numpy operations on
    those that still have a word.
    """
    total, k = scores.shape
    labels = np.zeros(total, np.int8 if k < 128 else np.int32)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return labels
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
    lens = lengths[order]
    back = np.zeros((total, k), bool)              # true: came from the best label before, else stayed
    best_before = np.zeros(total, labels.dtype)
    alive = np.searchsorted(-lens, -np.arange(int(lens[0])), side="left")   # documents with more than t words
    v = scores[starts].copy()
    for t in range(1, int(lens[0])):
        n = alive[t]
        at = starts[:n] + t
        before = v[:n]
        top = before.argmax(axis=1)
        most = before[np.arange(n), top] - penalty
        jump = before < most[:, None]
        back[at] = jump
        best_before[at] = top
        now = np.maximum(before, most[:, None])
        now += scores[at]
        v[:n] = now
    last = v.argmax(axis=1)
    current = last.astype(np.int64)
    for t in range(int(lens[0]) - 1, -1, -1):
        n = alive[t]
        at = starts[:n] + t
        labels[at] = current[:n]
        if t:
            came = back[at, current[:n]]
            current[:n] = np.where(came, best_before[at], current[:n])
    return labels


def _sum_rows(batches):
    """Partial counts of a task's rows: (lang, what, key, n)."""
    seen: dict[str, Counter] = {}
    for b in batches:
        for text, lang in zip(b["text"], b["lang"]):
            words = lower_words(text) if text.isascii() else [w.lower() for w in LETTERS.findall(text)]
            seen.setdefault(lang, Counter()).update(words)
    for lang, words in seen.items():
        names, times = list(words), np.fromiter(words.values(), np.float64, len(words))
        hashed, owners = grams(names)
        buckets = np.bincount(hashed, weights=times[owners], minlength=BUCKETS).astype(np.int64)
        scripts = np.bincount(np.fromiter(map(script_of, names), np.int64, len(names)), weights=times, minlength=len(_NAMES)).astype(np.int64)
        for what, counts in (("gram", buckets), ("script", scripts)):
            at = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "what": what, "key": at.astype(np.int32), "n": counts[at]})


def train(docs: DataFrame, sample: int | None = SAMPLE) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that have a text and a label; from all, where no ``sample`` is given."""
    rows = docs.select("doc_id", "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    if sample is None:
        return _model(rows.select("text", "lang"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))                # a row for each language
    rate = sample_rate(sizes.agg(F.sum("n")).first()[0] or 0, sample)
    rates = sizes.select("lang", F.when(F.col("n") <= LEAST_OF_EACH, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(rate), 2.0 * LEAST_OF_EACH / F.col("n")))).alias("rate"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) < F.col("rate") * (1 << 30)
    picked = rows.join(F.broadcast(rates), "lang").where(drawn).select("text", "lang")
    return _model(picked.repartition(12))


def _model(picked: DataFrame) -> Model:
    """The model of all rows of ``picked`` (text, lang)."""
    counts = picked.mapInPandas(_sum_rows, "lang string, what string, key int, n long")
    found = counts.groupBy("lang", "what", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    grams_of, scripts_of = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), len(_NAMES)))
    at = found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
    for what, into in (("gram", grams_of), ("script", scripts_of)):
        m = (found["what"] == what).to_numpy()
        into[at[m], found["key"].to_numpy()[m]] = found["n"].to_numpy()[m]
    log_p = np.log((grams_of + 0.5) / (grams_of.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)).astype(np.float32)
    share = scripts_of / np.maximum(scripts_of.sum(axis=1, keepdims=True), 1)
    everyone = np.arange(len(languages))
    by_script = [c if len(c := np.flatnonzero(share[:, s] >= 0.01)) else everyone for s in range(len(_NAMES))]
    return Model(languages, log_p, by_script, int(scripts_of.sum(axis=1).argmax()) if languages else 0)


def label_texts(model: Model, texts: list, with_spans: bool = True) -> tuple[list[list[tuple]], list[str], list[float]]:
    """For each text: its spans (start, end, language) in code points (if asked for), its language and score."""
    spans, langs, scores = [], [], []
    for a, b in text_slices(texts):
        part = [t or "" for t in texts[a:b]]
        words = [LETTERS.findall(t) for t in part] if model.languages else [[] for _ in part]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = [w for ws in words for w in ws]
        labels = viterbi(model.scores(flat), lengths) if flat else np.zeros(0, np.int8)
        letters = np.fromiter(map(len, flat), np.int64, len(flat))
        ends = np.cumsum(lengths)
        for text, lo, hi in zip(part, ends - lengths, ends):
            own = labels[lo:hi]
            if not len(own):
                spans.append([])
                langs.append("und")
                scores.append(0.0)
                continue
            share = np.bincount(own, weights=letters[lo:hi], minlength=len(model.languages))
            k = int(share.argmax())
            langs.append(model.languages[k])
            scores.append(float(share[k] / share.sum()))
            if not with_spans:
                continue
            cuts = np.flatnonzero(np.diff(own)) + 1
            if not len(cuts):
                spans.append([(0, len(text), langs[-1])])
                continue
            # a span goes from its first word to the next span's first word
            places = [m.start() for m in LETTERS.finditer(text)]
            edges = [0, *(places[c] for c in cuts), len(text)]
            first = [0, *cuts]
            spans.append([(edges[i], edges[i + 1], model.languages[own[c]]) for i, c in enumerate(first)])
    return spans, langs, scores


def _found(spans: list, langs: list, scores: list) -> pa.StructArray:
    flat = [x for own in spans for x in own]
    parts = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["start", "end", "lang"])
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, spans), np.int64, len(spans)))]).astype(np.int32)
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), parts)], ["lang", "score", "spans"])


def label_column(spark, model: Model, text):
    """A column struct(lang, score, spans) for a column of texts; one slice of a batch at a time."""
    shared = spark.sparkContext.broadcast(model)      # languages x BUCKETS floats

    @F.arrow_udf("lang string, score double, spans array<struct<start:int,end:int,lang:string>>")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.concat_arrays([_found(*label_texts(shared.value, part)) for _, _, part in column_slices(texts, SLICE)] or [_found([], [], [])])

    return label(text)


def language_column(spark, model: Model, text):
    """A column with the language of a column of texts, without spans."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([lang for _, _, part in column_slices(texts, SLICE) for lang in label_texts(shared.value, part, with_spans=False)[1]], pa.string())

    return label(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and spans (in place of columns so named); row by row, without a shuffle."""
    found = label_column(docs.sparkSession, model, F.col("text"))
    name = free_name(docs, "found")
    out = docs.withColumn(name, found)
    return out.withColumns({"lang_pred": F.col(name)["lang"], "score": F.col(name)["score"], "spans": F.col(name)["spans"]}).drop(name)


def train_fold(docs: DataFrame, sample: int | None = SAMPLE) -> Model:
    return train(docs.where(F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"), 5, 0)), sample)


def op2_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), train_fold(docs)).select(
        "doc_id", fold(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
