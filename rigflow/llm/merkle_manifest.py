"""Merkle manifest of a dataset: one hash tree for each language, and one over their roots.

A row's leaf is the sha256 of its fields, each led by its length.  The leaves of a language
ascend by doc_id; every ``ARITY`` consecutive nodes hash to their parent until one is left, the
subroot; the subroots, ordered by language, hash to the root in the same way.

Positions come from a range sort (``common.numbered``), so a language may hold any part of the
rows.  Levels are computed ``LEVELS`` at a time in blocks of ``SPAN`` consecutive nodes: the
windows of a block give every node its siblings by lag and lead at fixed offsets, masked by the
node's slot and the length of its run, and the first child of a run hashes the parent.  The
blocks' own nodes, a 512th of the rows, go on in the same way.  Going down again, a block's
windows carry the siblings of its inner nodes along to all leaves below them, and one join on
the block, by which the rows are dealt already, brings what is above it: no proof is shuffled
level by level.

Defined results: null fields are "-", and a null lang is a group of its own, before all others;
rows that repeat a doc_id are separate leaves, in the order of their leaf hashes (those that are
equal in every column have equal leaves, so their order changes no hash); rows without a doc_id
come first and are not tampered with; an empty table gives an empty result.  Other columns are
not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigflow.llm.common import ascii_lower, numbered
from rigflow.session import materialize

ARITY, LEVELS = 8, 3
SPAN = ARITY ** LEVELS          # nodes of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(**fields: Column) -> Column:
    """The hash of one row's fields, each as its length in UTF-8, ":" and its value, or "-"."""
    texts = [c.cast("string") for c in fields.values()]
    return _hash(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _siblings(place: Column, count: Column, step: int, window) -> tuple[Column, Column]:
    """The hashes of a node's siblings before it and after it, each joined left to right.

    place: the node's place in its level; count: nodes of the level; step: rows from a node to the next.
    """
    slot = F.pmod(place, F.lit(ARITY))
    run = F.least(F.lit(ARITY), count - (place - slot))
    before = [F.when(slot >= j, F.lag("hash", j * step).over(window)) for j in range(ARITY - 1, 0, -1)]
    after = [F.when(slot + j < run, F.lead("hash", j * step).over(window)) for j in range(1, ARITY)]
    joined = [F.concat(*[F.coalesce(c, F.lit("")) for c in side]) for side in (before, after)]
    return joined[0], joined[1]


def _block(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("place") / SPAN))


def _in_block():
    return Window.partitionBy("tree", "block").orderBy("place")


def _up(count: Column, levels: int) -> Column:
    """Nodes ``levels`` levels above ``count`` nodes."""
    return F.ceil(count / ARITY ** levels).cast("long")


def climb(nodes: DataFrame) -> DataFrame:
    """The nodes ``LEVELS`` levels above ``nodes`` (tree, place, count, hash), the same columns.

    A tree that has come down to one node keeps it.
    """
    nodes = _block(nodes.select("tree", "place", "count", "hash"))
    for k in range(LEVELS):
        own, count = F.floor(F.col("place") / ARITY ** k), _up(F.col("count"), k)
        _, after = _siblings(own, count, 1, _in_block())                 # (a first child has none before it)
        parent = F.when(count > 1, _hash(F.col("hash"), F.col("after"))).otherwise(F.col("hash"))
        nodes = nodes.withColumn("after", after).where(F.pmod("place", F.lit(ARITY ** (k + 1))) == 0).withColumn("hash", parent).drop("after")
    return nodes.select("tree", F.col("block").alias("place"), _up(F.col("count"), LEVELS).alias("count"), "hash")


def descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``nodes`` with path: the siblings (before, after) on the way up to the root, lowest first.

    ``above``: tree, place, path of the nodes that ``climb`` made of these, and any more columns.
    """
    rows, steps = _block(nodes).withColumn("own", F.col("hash")), []
    for k in range(LEVELS):
        head = F.pmod("place", F.lit(ARITY ** k)) == 0             # the row that stands for a node of this level
        own, count = F.floor(F.col("place") / ARITY ** k), _up(F.col("count"), k)
        before, after = _siblings(own, count, ARITY ** k, _in_block())
        step = f"step{k}"
        rows = rows.withColumn(step, F.when(head & (count > 1), F.struct(before.alias("before"), after.alias("after"))))
        if k + 1 < LEVELS:
            first = F.pmod("place", F.lit(ARITY ** (k + 1))) == 0
            parent = F.when(count > 1, _hash(F.col(f"{step}.before"), F.col("hash"), F.col(f"{step}.after"))).otherwise(F.col("hash"))
            rows = rows.withColumn("hash", F.when(first, parent))
        if k:
            rows = rows.withColumn(step, F.last(step, ignorenulls=True).over(_in_block().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        steps.append(F.col(step))
    rows = rows.withColumn("hash", F.col("own")).withColumn("inside", F.array_compact(F.array(*steps)))
    top = above.withColumnsRenamed({"place": "block", "path": "outside"})
    joined = rows.hint("merge").join(top, ["tree", "block"]).withColumn("path", F.concat("inside", "outside"))
    return joined.select(*nodes.columns, "path", *[c for c in above.columns if c not in ("tree", "place", "path")])


def levels_of(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and, ``LEVELS`` levels apart, those above them; the last has one node for each tree."""
    out, most = [nodes], nodes.agg(F.max("count")).first()[0] or 0
    while most > 1:
        out.append(materialize(climb(out[-1]), "nodes")[0])
        most = -(-most // SPAN)
    return out


def _paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """``levels[0]`` with path; ``above``: tree, path of the last level's nodes, and more columns."""
    rows = levels[-1].join(above, "tree")
    extra = [c for c in above.columns if c not in ("tree", "path")]
    for nodes in reversed(levels[:-1]):
        rows = descend(nodes, rows.select("tree", "place", "path", *extra))
    return rows


def manifest(docs: DataFrame) -> tuple[DataFrame, str | None]:
    """One row per row of ``docs`` (doc_id, text, lang, source, n_chars): doc_id, hash (its leaf),
    tampered (the leaf of a changed text, where the drill changes it), subroot, path; and the root."""
    fields = {c: F.col(c) for c in FIELDS}
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    changed = F.when(hit, leaf(**{**fields, "text": ascii_lower(F.col("text"))}))
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))            # null first
    leaves, _ = materialize(docs.select("doc_id", tree.alias("tree"), leaf(**fields).alias("hash"), changed.alias("tampered")), "leaves")
    placed = numbered(leaves, "tree", [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("tampered")], "place")
    placed, _ = materialize(placed.withColumnRenamed("place_of", "count"), "placed")
    levels = levels_of(placed)
    tops, _ = materialize(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "hash"), "subroots")
    roots = numbered(tops, "tree", [F.col("of")], "place").withColumnRenamed("place_of", "count")
    root_levels = levels_of(materialize(roots, "subroots")[0])
    root = next((r["hash"] for r in root_levels[-1].select("hash").take(1)), None)
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    subroots = _paths(root_levels, root_levels[-1].select("tree", nothing.alias("path")))
    return _paths(levels, subroots.select(F.col("of").alias("tree"), "path", F.col("hash").alias("subroot"))), root


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's hash and its proof lead to."""
    return F.aggregate(path, start, lambda h, s: _hash(s["before"], h, s["after"]))


def proof_hash(path: Column) -> Column:
    """The hash of a proof: all its siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def op13_merkle_manifest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    rows, root = manifest(docs)
    folded = fold(F.coalesce("tampered", "hash"), F.col("path"))
    return rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof_hash(F.col("path")).alias("proof_sha256"),
                       folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _level_sql(name: str, k: int, key: str) -> str:
    """Nodes of level k + 1, each level-k node's siblings, and the leaves' proofs so far."""
    n, step = f"{name}{k}", ARITY
    group = f"PARTITION BY {key}, place // {step}" if key else f"PARTITION BY place // {step}"
    using, by = (f"{key}, ", f"GROUP BY {key}, place // {step}") if key else ("", f"GROUP BY place // {step}")
    on = f"l.{key} = s.{key} AND " if key else ""
    pair = f"a.{key} = b.{key} AND " if key else ""
    return f"""
{name}_sib{k} AS (
  SELECT {'a.' + key + ', ' if key else ''}a.place, a.n,
         coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM {n} a JOIN {n} b ON {pair}a.place // {step} = b.place // {step} GROUP BY ALL),
{name}{k + 1} AS (
  SELECT {using}place // {step} AS place, (any_value(n) + {step - 1}) // {step} AS n,
         CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY place)) ELSE any_value(h) END AS h
  FROM {n} {by}),
{name}_walk{k + 1} AS (
  SELECT l.* REPLACE (CASE WHEN s.n > 1 THEN l.proof || s.l || s.r ELSE l.proof END AS proof,
                      CASE WHEN s.n > 1 THEN sha256(s.l || l.f || s.r) ELSE l.f END AS f, l.spot // {step} AS spot)
  FROM {name}_walk{k} l JOIN {name}_sib{k} s ON {on}l.spot = s.place),"""


_LANG_LEVELS, _ROOT_LEVELS = 7, 3       # levels in the SQL below: two million leaves of a language, 512 languages
_FIELD_SQL = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in FIELDS[:-1])

OP13_SQL = r"""
WITH bits AS (
  SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
      lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))) AS crc FROM documents),
hashed AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(""" + _FIELD_SQL + r""" || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS h,
         CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other,
         """ + _FIELD_SQL + r""" AS head FROM bits),
leaves AS (
  SELECT doc_id, tree, h, sha256(head || coalesce(strlen(other)::VARCHAR || ':' || other, '-')) AS f,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
t0 AS (SELECT tree, place, n, h FROM leaves),
t_walk0 AS (SELECT doc_id, tree, h AS leaf, f, place AS spot, '' AS proof FROM leaves),""" + "".join(_level_sql("t", k, "tree") for k in range(_LANG_LEVELS)) + f"""
s0 AS (SELECT row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n, h, tree FROM t{_LANG_LEVELS}),
s_walk0 AS (SELECT w.doc_id, w.leaf, w.f, w.proof, s.h AS subroot, s.place AS spot FROM t_walk{_LANG_LEVELS} w JOIN s0 s USING (tree)),""" + "".join(_level_sql("s", k, "") for k in range(_ROOT_LEVELS)) + f"""
top AS (SELECT any_value(h) AS root FROM s{_ROOT_LEVELS})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified
FROM s_walk{_ROOT_LEVELS}, top
"""
