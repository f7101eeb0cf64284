"""Embedding near-dedup: subspace pigeonhole join, exact for any vectors.

Two unit vectors with cosine c are at squared distance 2 - 2c.  Vectors are rotated and split
into ``BLOCKS`` low-dimensional blocks, and the squared distance allowed is shared among them in
proportion to the energy each block holds; a pair within the whole is within its share in at
least one block.  So a range join in each block, whose union is then verified by the cosine in
double precision, finds every pair.

Equal vectors form one class first.  Classes are ordered along the first rotated axis and cut
into tiles of about ``TILE``; a tile meets only tiles whose axis range is near enough, so each
vector goes to the groups (tile, tile) it may have partners in.  A group holds two tiles at most,
whatever the data: an axis value with very many vectors is cut further by hash.  Within a group
the block distances are matrix products; a group returns for each vector the number of its
links and the smallest vector it is joined to there, never the pairs.

The rotation comes from a bounded sample (``SAMPLE`` vectors); it decides how much is left to
verify, not what is found.  For vectors without structure the work is quadratic in the number of
tiles, as for any exact join in many dimensions.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing, have n_links 0 and are their own component; vectors of different lengths never
link; rows without a vec_id are not compared (component null, kept); rows that repeat a vec_id
are one vertex, each a link of the other if their vectors link; an empty table gives an empty
result.  Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigflow.llm.common import attach_group, components, hash_sample, sample_rate
from rigflow.session import materialize

COSINE = 0.9
BLOCKS = 4
TILE = 8_192
SAMPLE = 4_096
SLACK = 1e-4            # of the single-precision block distances; what passes is verified in double
STRIP = 512             # rows of a tile compared at once


_READ = "id long, dim int, same binary, vector binary"


def _read(batches):
    """Finite non-zero vectors as doubles, with a digest; others with dimension 0."""
    for b in batches:
        out = []
        for v in b.column("embedding").to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.zeros(0)
            if not (len(x) and np.isfinite(x).all() and x.any()):
                x = np.zeros(0)
            out.append((x + 0.0).tobytes())          # no negative zero
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([len(x) // 8 for x in out], pa.int32()),
                                          pa.array([xxhash.xxh3_128_digest(x) for x in out], pa.binary()), pa.array(out, pa.binary())], ["id", "dim", "same", "vector"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)      # no overflow of the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(sample: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Principal axes of a sample of unit vectors; the axes of each block, of similar energy; the
    part of the squared distance allowed in each."""
    d = sample.shape[1]
    spread = sample - sample.mean(axis=0)
    values, axes = np.linalg.eigh(spread.T @ spread / max(len(sample), 1) + np.eye(d) * 1e-9)
    values, axes = values[::-1], axes[:, ::-1]
    n = min(BLOCKS, d)
    turn = np.arange(d) % (2 * n)
    owner = np.where(turn < n, turn, 2 * n - 1 - turn)
    blocks = [np.flatnonzero(owner == k) for k in range(n)]
    energy = np.array([values[b].sum() for b in blocks])
    return axes, blocks, np.maximum(energy / energy.sum(), 1e-3) / np.maximum(energy / energy.sum(), 1e-3).sum()


def _links(a: np.ndarray, b: np.ndarray, blocks, budgets, same_tile: bool, axes: np.ndarray, cosine: float):
    """Index pairs (into a and b) of unit vectors with cosine enough."""
    ra, rb = (a @ axes).astype(np.float32), (b @ axes).astype(np.float32)
    sides = []
    for axes_of, budget in zip(blocks, budgets):
        # |x - y|^2 <= r  as one product: (x, -|x|^2/2, 1) . (y, 1, -|y|^2/2) >= -r/2
        x, y = ra[:, axes_of], rb[:, axes_of]
        one = np.ones((len(x), 1), np.float32), np.ones((len(y), 1), np.float32)
        sides.append((np.hstack([x, -(x * x).sum(axis=1, keepdims=True) / 2, one[0]]), np.ascontiguousarray(np.hstack([y, one[1], -(y * y).sum(axis=1, keepdims=True) / 2]).T),
                      np.float32(-(budget * (2 - 2 * cosine) + SLACK) / 2)))
    for lo in range(0, len(a), STRIP):
        first = lo if same_tile else 0
        near = None
        for x, y, least in sides:
            part = x[lo:lo + STRIP] @ y[:, first:] >= least
            near = part if near is None else np.logical_or(near, part, out=near)
        u, v = np.nonzero(near)
        u, v = u + lo, v + first
        if same_tile:
            u, v = u[u < v], v[u < v]
        for s in range(0, len(u), 1 << 17):               # verified in double precision, in pieces
            p, q = u[s:s + (1 << 17)], v[s:s + (1 << 17)]
            hit = np.einsum("ij,ij->i", a[p], b[q]) >= cosine
            yield p[hit], q[hit]


def _group(dim: int, turned, cosine: float):
    axes, blocks, budgets = turned

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        tile = table.column("tile").to_numpy()
        order = np.argsort(tile, kind="stable")
        ids, sizes = table.column("id").to_numpy()[order], table.column("size").to_numpy()[order]
        x = _units(_matrix(table.column("vector").combine_chunks(), dim))[order]
        cut = int((tile == i).sum()) if i != j else len(ids)
        a, b, shift = x[:cut], x[cut:] if i != j else x, cut if i != j else 0
        links, label = np.zeros(len(ids), np.int64), ids.copy()
        us, vs = [], []
        for u, v in _links(a, b, blocks, budgets, i == j, axes, cosine):
            v = v + shift
            links += np.bincount(u, weights=sizes[v], minlength=len(ids)).astype(np.int64)
            links += np.bincount(v, weights=sizes[u], minlength=len(ids)).astype(np.int64)
            us.append(u.astype(np.int32))
            vs.append(v.astype(np.int32))
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            while len(u):                                  # smallest id reachable within the group
                least = np.minimum(label[u], label[v])
                before = label.copy()
                np.minimum.at(label, u, least)
                np.minimum.at(label, v, least)
                if (label == before).all():
                    break
                apart = label[u] != label[v]
                u, v = (u, v) if apart.any() else (u[:0], v[:0])
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some], "root": label[some]})

    return run


def _classes_linked(classes: DataFrame, dim: int, n: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(id, links), (u, v) of the classes (id, size, vector) of one dimension."""
    spark = classes.sparkSession
    sample = hash_sample(classes, F.col("id"), sample_rate(n, SAMPLE), 7).select("vector").toArrow().column("vector").combine_chunks()
    units = _units(_matrix(sample, dim)) if len(sample) else np.eye(dim)[:1]
    axes, blocks, budgets = turned = rotation(units)
    first = axes[:, 0]

    def place(batches):
        for b in batches:
            x = _units(_matrix(b.column("vector"), dim)) if len(b) else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("size"), b.column("vector"), pa.array(x @ first)], ["id", "size", "vector", "axis"])

    placed, _ = materialize(classes.select("id", "size", "vector").mapInArrow(place, "id long, size long, vector binary, axis double"), "axis")
    tiles = max(1, -(-n // TILE))
    edges = placed.agg(F.percentile_approx("axis", [k / tiles for k in range(1, tiles)], 10_000)).first()[0] if tiles > 1 else []
    edges = np.unique(np.array(edges, float))
    search = F.lit(0)
    if len(edges):
        at = spark.sparkContext.broadcast(edges)           # one number for each tile

        @F.pandas_udf("int")
        def bucket(axis: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(at.value, axis.to_numpy(), side="right").astype(np.int32))

        search = bucket("axis")
    placed, _ = materialize(placed.withColumn("bucket", search), "buckets")
    # what lies at one place of the axis is cut by hash, so that no tile is over its size
    found = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("axis").alias("low"), F.max("axis").alias("high")).orderBy("bucket").collect()
    reach, number, listed = np.sqrt(2 - 2 * cosine) + 1e-9, 0, []
    for r in found:
        parts = -(-r["n"] // TILE)
        listed += [(r["bucket"], number, parts, k, r["low"], r["high"]) for k in range(parts)]
        number += parts
    lows = np.array([x[4] for x in listed])
    last = [int(np.searchsorted(lows, x[5] + reach, side="right")) - 1 for x in listed]      # tiles lie in order of the axis
    highs = np.maximum.accumulate(np.array([x[5] for x in listed])) if listed else np.zeros(0)
    from_ = [int(np.searchsorted(highs, x[4] - reach, side="left")) for x in listed]
    rows = [(b, k, parts, start + k, from_[start + k], last[start + k]) for b, start, parts, k, _, _ in listed]
    plan = spark.createDataFrame(rows, "bucket int, part int, parts int, tile int, first int, last int")
    parts_of = {b: parts for b, _, parts, _, _, _ in listed}
    cut = placed.join(F.broadcast(plan.select("bucket", "parts").distinct()), "bucket") if len(parts_of) else placed.withColumn("parts", F.lit(1))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts")).cast("int"))
    tiled = cut.join(F.broadcast(plan.drop("parts")), ["bucket", "part"]).select("id", "size", "vector", "tile", "first", "last")
    sent = tiled.withColumn("other", F.explode(F.sequence("first", "last"))).select(
        "id", "size", "vector", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    linked = sent.groupBy("i", "j").applyInArrow(_group(dim, turned, cosine), "id long, links long, root long")
    linked, _ = materialize(linked, "vector-links")
    return linked.groupBy("id").agg(F.sum("links").alias("links")), linked.select(F.col("id").alias("u"), F.col("root").alias("v")).where("u <> v")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    read, total = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_read, _READ), "vectors")
    named = read.where("id IS NOT NULL AND dim > 0")
    # (equal vectors only: any of them is the class's vector)
    classes, _ = materialize(named.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("size"), F.first("dim").alias("dim"), F.first("vector").alias("vector")), "classes")
    counts, edges = None, None
    for r in classes.groupBy("dim").agg(F.count("*").alias("n")).orderBy("dim").collect():      # mostly one dimension
        links, joined = _classes_linked(classes.where(F.col("dim") == r["dim"]), r["dim"], r["n"], cosine)
        counts, edges = (links, joined) if counts is None else (counts.unionByName(links), edges.unionByName(joined))
    done = classes.select("same", "size", "id")
    if counts is None:
        done = done.withColumns({"links": F.lit(0).cast("long"), "component_id": F.col("id")})
    else:
        done = done.join(counts.groupBy("id").agg(F.sum("links").alias("links")), "id", "left").join(components(edges), "id", "left").withColumns(
            {"links": F.coalesce("links", F.lit(0)), "component_id": F.coalesce("component", "id")})
    done, _ = materialize(done.select("same", "size", "links", "component_id"), "vector-classes")
    linked = attach_group(named.select("same", F.col("id").alias("vec_id")), done, "same", "size", total).select(
        "vec_id", (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id")
    alone = read.where("id IS NULL OR dim = 0").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_embedding_dedup(spark, sf_dir):
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, pairs.w FROM reach JOIN pairs ON pairs.u = reach.r),
roots AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
degree AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN degree ON u = e.vec_id JOIN roots ON id = e.vec_id
"""
