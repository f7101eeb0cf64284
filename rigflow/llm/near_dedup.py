"""MinHash near-dedup with odd sketches.

Each document's distinct 5-word shingles are hashed to 64 bits; ``BANDS`` x ``ROWS`` MinHash
samples are banded for candidates, and folded into a parity bitmap (odd sketch) of ``BITS``
bits, whose XOR population count estimates the similarity of a candidate pair.  Pairs whose
estimate is clearly too low (``LOOSE``, some five standard deviations under the limit) are left
out.  A second parity bitmap, of the whole set and in step with its size, gives a bound: no more
bits can differ than shingles do, so a pair with more differing bits than the limit allows is
out for certain.  All others are confirmed on their full sets.

Documents with equal sets form one class, and only classes go on.  First each class is compared
with one hub: of the most popular members of its buckets, the one it shares most bands with.
That joins most of what belongs together, in one pair for each class.  Buckets that then hold
one component are settled.  In the others all members of different components are compared,
inside tasks that hold two tiles of at most ``TILE`` members, and only pairs that pass both
bitmaps come out; so no candidate pair goes unanswered and none is emitted needlessly.  (A bucket
of very many members that are nearly but not similar enough costs time by its square, in tiles.)

At 200 samples a pair at the limit of 0.75 shares no band with probability (1 - 0.75^5)^40,
2 in 100,000, and less above it.

Defined results: a text without words (or null) has an empty set, links with nothing; fewer
than five words are one shingle; rows without a doc_id link with nothing, have a null component
and are kept; rows that repeat a doc_id are one document for linking, one row each in the
result; an empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigflow.llm.common import attach_group, byte_words, column_slices, components, free_name
from rigflow.session import materialize

WORDS = 5
PER_CENT = 75
BANDS, ROWS = 40, 5
BITS = 512
LOOSE = 0.55
TILE = 512
CACHE = 100_000

_rng = np.random.Generator(np.random.PCG64(20240517))
_FACTORS = (_rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFTS = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_PLACES = _rng.integers(1, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = byte_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    out = h[:n] * _PLACES[0]
    for j in range(1, WORDS):
        out += h[j:j + n] * _PLACES[j]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """Sets x samples.  The sets must not be empty."""
    out = np.empty((len(sets), BANDS * ROWS), np.uint32)
    start = 0
    while start < len(sets):                       # a run of sets that fits the processor's cache
        stop, size = start, 0
        while stop < len(sets) and (stop == start or size + len(sets[stop]) <= 16_384):
            size += len(sets[stop])
            stop += 1
        x = (np.concatenate(sets[start:stop]) >> np.uint64(32)).astype(np.uint32)
        edges = np.cumsum([0, *(len(s) for s in sets[start:stop - 1])])
        y = np.empty_like(x)
        for i in range(BANDS * ROWS):
            np.multiply(x, _FACTORS[i], out=y)
            np.add(y, _SHIFTS[i], out=y)
            out[start:stop, i] = np.minimum.reduceat(y, edges)
        start = stop
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """Documents x bands: one 64-bit key of each band's samples."""
    s = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    h = (s * _BAND).sum(axis=2, dtype=np.uint64)
    h ^= h >> np.uint64(32)
    h *= _MIX
    return (h ^ (h >> np.uint64(29))).astype(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Documents x BITS / 64: bit h(i, sample i) is flipped for every sample i."""
    n, k = samples.shape
    at = samples.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))
    at *= _PLACES[0]
    at ^= at >> np.uint64(32)
    at *= _MIX
    at = (at >> np.uint64(64 - int(np.log2(BITS)))).astype(np.int64)
    counts = np.bincount((np.arange(n)[:, None] * BITS + at).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(counts.astype(np.uint8), axis=1).view(np.uint64).reshape(n, BITS // 64)


def parity(s: np.ndarray) -> bytes:
    """Parity bitmap of a whole set, of at least four bits for each shingle: a power of two, so
    that a longer bitmap folds onto a shorter one by XOR of its halves."""
    bits = 1 << max(8, int(4 * len(s)).bit_length())
    at = ((s * _PLACES[1]) >> np.uint64(64 - int(bits).bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap at ``size`` bytes.  Bits are placed by the hash's high bits, so folding takes neighbours together."""
    x = np.frombuffer(bitmap, np.uint8)
    while len(x) > size:
        bits = np.unpackbits(x)
        x = np.packbits(bits[0::2] ^ bits[1::2])
    return x


def plausible(u: np.ndarray, v: np.ndarray, n: np.ndarray, sketches: np.ndarray, bitmaps: list[bytes]) -> np.ndarray:
    """Which index pairs (u, v) the two bitmaps do not rule out.  ``sketches`` are uint64 rows."""
    odd = np.empty(len(u))
    for lo in range(0, len(u), 1 << 18):
        w = slice(lo, lo + (1 << 18))
        odd[w] = np.bitwise_count(sketches[u[w]] ^ sketches[v[w]]).sum(axis=1, dtype=np.int64)
    part = np.maximum(1 - 2 * odd / BITS, 1 / BITS)
    ok = np.flatnonzero(1 + BITS / (4 * BANDS * ROWS) * np.log(part) >= LOOSE)
    keep = np.zeros(len(u), bool)
    sizes = np.fromiter(map(len, bitmaps), np.int64, len(bitmaps))
    level = np.minimum(sizes[u[ok]], sizes[v[ok]])
    for size in np.unique(level):
        at = ok[level == size]
        used, place = np.unique(np.concatenate([u[at], v[at]]), return_inverse=True)
        rows = np.stack([_folded(bitmaps[i], size) for i in used]).view(np.uint64)
        x, y = place[:len(at)], place[len(at):]
        step = max(1, (1 << 21) // rows.shape[1])
        for lo in range(0, len(at), step):
            w = slice(lo, lo + step)
            differ = np.bitwise_count(rows[x[w]] ^ rows[y[w]]).sum(axis=1, dtype=np.int64)
            # similar enough means at most (|a| + |b|) / 7 different shingles at 75 per cent
            keep[at[w]] = (100 + PER_CENT) * differ <= (100 - PER_CENT) * (n[u[at[w]]] + n[v[at[w]]])
    return keep


_SKETCHED = "doc_id long, n_shingles long, same binary, bands array<long>, sketch binary, parity binary"
_SETS = "id long, shingles array<long>"


def _lists(values: np.ndarray) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(values.ravel()))


def _sketch(batches):
    hashes = _WordHashes()
    for b in batches:
        ids = b.column("doc_id")
        for lo, hi, texts in column_slices(b.column("text")):
            sets = [shingles(t, hashes) for t in texts]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            full = np.flatnonzero(sizes)
            bands, sketch = np.zeros((len(sets), BANDS), np.int64), np.zeros((len(sets), BITS // 64), np.uint64)
            if len(full):
                samples = minhashes([sets[i] for i in full])
                bands[full], sketch[full] = band_keys(samples), odd_sketches(samples)
            same = [xxhash.xxh3_128_digest(s.tobytes(), seed=len(s)) for s in sets]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes), pa.array(same, pa.binary()), _lists(bands),
                                              pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([parity(x) for x in sets], pa.binary())],
                                             ["doc_id", "n_shingles", "same", "bands", "sketch", "parity"])


def _sets(batches):
    hashes = _WordHashes()
    for b in batches:
        ids = b.column("id")
        for lo, hi, texts in column_slices(b.column("text")):
            sets = [shingles(t, hashes) for t in texts]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "shingles"])


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough."""
    a = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    shared = F.size(F.array_intersect("su", "sv"))
    union = F.size("su") + F.size("sv") - shared
    return materialize(pairs.select("u", "v").join(a, "u").join(b, "v").where(100 * shared >= PER_CENT * union).select("u", "v"), "links")[0]


def _labelled(frame: DataFrame, labels: DataFrame | None, id_: str, name: str) -> DataFrame:
    if labels is None:
        return frame.withColumn(name, F.col(id_))
    return frame.join(labels.select(F.col("id").alias(id_), F.col("component").alias("_c")), id_, "left").withColumn(name, F.coalesce("_c", id_)).drop("_c")


def _check_pairs(batches):
    """Rows of a pair with both sides' bitmaps: the pairs not ruled out."""
    for b in batches:
        n = b.num_rows
        both = lambda x, y: b.column(x).to_pylist() + b.column(y).to_pylist()
        sketches = np.frombuffer(b"".join(both("ku", "kv")), np.uint64).reshape(-1, BITS // 64)
        sizes = np.array(both("nu", "nv"), np.int64)
        keep = pa.array(plausible(np.arange(n), np.arange(n, 2 * n), sizes, sketches, both("pu", "pv")))
        yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], ["u", "v"])


def _check_tiles(batches):
    """Sorted rows of (key, i, j): the pairs of different components, one of each tile, not ruled out."""
    held: list[pa.RecordBatch] = []

    def compare(rows: pa.Table):
        c = rows.column("c").to_numpy()
        if len(c) < 2 or c.min() == c.max():
            return None
        ids, tile, n = (rows.column(x).to_numpy() for x in ("id", "tile", "n"))
        u, v = np.nonzero((c[:, None] != c[None, :]) & (ids[:, None] < ids[None, :]) & ((tile[:, None] != tile[None, :]) | (rows.column("i")[0] == rows.column("j")[0])))
        sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        keep = plausible(u, v, n, sketches, rows.column("parity").to_pylist())
        return ids[u[keep]], ids[v[keep]]

    def groups(rows: pa.Table, last: bool):
        """Whole groups at the front of ``rows``, and what is left."""
        at = np.stack([rows.column(x).to_numpy() for x in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1), rows.num_rows]
        found = [g for a, b in zip(cuts, cuts[1:] if last else cuts[1:-1]) if (g := compare(rows.slice(a, b - a))) is not None]
        pairs = [np.concatenate([g[k] for g in found]) if found else np.zeros(0, np.int64) for k in (0, 1)]
        seen = np.unique(np.stack(pairs), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(seen[0]), pa.array(seen[1])], ["u", "v"]), rows.slice(cuts[-2]) if not last else None

    for b in batches:
        held.append(b)
        out, rest = groups(pa.Table.from_batches(held).combine_chunks(), False)
        held = rest.to_batches()
        yield out
    if held:
        yield groups(pa.Table.from_batches(held).combine_chunks(), True)[0]


def _link(pairs: DataFrame, sketches: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) that the bitmaps do not rule out and the full sets confirm."""
    side = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"), F.col("parity").alias(f"p{x}"))
    checked, _ = materialize(pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(_check_pairs, "u long, v long"), "checked")
    return _confirm(checked, sets)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    sketched, total = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketch, _SKETCHED), "sketched")
    named = sketched.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes, _ = materialize(named.groupBy("same").agg(F.min("doc_id").alias("id"), F.count("*").alias("size")), "classes")
    # (a document's bands go on once for each class)
    own = classes.select(F.col("id").alias("doc_id"), "same")
    entries = named.select("doc_id", "same", "bands").join(own, ["doc_id", "same"], "left_semi").select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    entries, _ = materialize(entries, "entries")
    several = entries.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key")
    shared, rows = materialize(entries.join(several, "key", "left_semi"), "shared")
    labels = _components_of(docs, named, shared) if rows else None
    of_class, _ = materialize(_labelled(classes, labels, "id", "component_id").select("same", "size", "component_id"), "class-components")
    linked = attach_group(named, of_class, "same", "size", total).select("doc_id", "n_shingles", "component_id")
    alone = sketched.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components_of(docs: DataFrame, named: DataFrame, shared: DataFrame) -> DataFrame | None:
    """Labels (id, component) of the documents of ``shared`` (id, key) that link with another."""
    ids, _ = materialize(shared.select("id").distinct(), "shared-ids")
    sketches, _ = materialize(named.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "sketch", "parity").join(ids, "id", "left_semi"), "sketches")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id", "left_semi")
    sets, _ = materialize(texts.mapInArrow(_sets, _SETS), "sets")

    sizes = shared.groupBy("key").agg(F.count("*").alias("members"))
    popular, _ = materialize(shared.join(sizes, "key").groupBy("id").agg(F.sum("members").alias("weight")), "popular")
    hubs = shared.join(popular, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("hub"))
    votes = shared.join(hubs, "key").where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("votes"))
    best = votes.groupBy("id").agg(F.max(F.struct("votes", (-F.col("hub")).alias("minus"))).alias("top"))
    labels = _join(_link(best.select(F.col("id").alias("u"), (-F.col("top.minus")).alias("v")), sketches, sets), None)

    named_entries = _labelled(shared, labels, "id", "c")
    open_ = named_entries.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b"), F.count("*").alias("members")).where("a <> b")
    open_ = open_.select("key", F.ceil(F.col("members") / TILE).cast("int").alias("tiles"))
    left, rows = materialize(named_entries.join(open_, "key").withColumn("tile", F.pmod(F.xxhash64("id", "key"), F.col("tiles")).cast("int")), "open-buckets")
    if not rows:
        return labels
    sent = left.join(sketches, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    sent = sent.withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")}).select("key", "i", "j", "tile", "id", "c", "n", "sketch", "parity")
    pairs = sent.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_check_tiles, "u long, v long")
    pairs, _ = materialize(pairs.distinct(), "open-pairs")
    return _join(_confirm(pairs, sets), labels)


def _join(links: DataFrame, labels: DataFrame | None) -> DataFrame | None:
    """Labels after more links: the links join what had been joined before."""
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    between = _labelled(_labelled(links, labels, "u", "cu"), labels, "v", "cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    roots = components(between)
    every = labels.unionByName(roots.select("id", F.col("id").alias("component"))).groupBy("id").agg(F.min("component").alias("old"))
    step = roots.select(F.col("id").alias("old"), F.col("component").alias("new"))
    return materialize(every.join(step, "old", "left").select("id", F.coalesce("new", "old").alias("component")), "labels")[0]


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays, and those without a doc_id."""
    kept_id = free_name(docs, "kept_id")
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(kept_id)).distinct()
    return docs.join(kept, docs["doc_id"] == F.col(kept_id), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


def op4_near_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
