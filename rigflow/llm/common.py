"""Helpers shared by the text operators: words, folds, written tables, group joins, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rigflow.session import materialize

ASCII_SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A group at least this fraction of the rows is "heavy"; there are at most as many of them.
HEAVY = 4096


def load(spark, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    names = {c.lower() for c in df.columns}
    while base.lower() in names:
        base = f"_{base}"
    return base


def fold(key: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the key's text leaves ``remainder``; false for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8, A-Z in lower case.

    bytes.lower() and bytes.split() know ASCII only: exactly A-Z, and [\\x20\\x09-\\x0D].
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def text_slices(texts: list, limit: int = 4_000_000):
    """(start, end) of runs of texts of about ``limit`` characters; one long text is its own run."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def arrow_slices(column, limit: int = 4_000_000):
    """Runs of an Arrow column of texts of about ``limit`` bytes; one long text is its own run."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield column.slice(start, end - start)
        start = end


def column_slices(column, limit: int = 4_000_000):
    """(start, end, texts) of runs of an Arrow column of texts of about ``limit`` bytes, so that
    only one run at a time is held as Python strings."""
    start = 0
    for part in arrow_slices(column, limit):
        yield start, start + len(part), part.to_pylist()
        start += len(part)


def arrow_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``byte_words`` of an Arrow column of texts: all words (binary), one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lengths, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
    empty = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)     # (beside white space at either end)
    if empty.any():
        lengths = lengths - np.bincount(np.repeat(np.arange(len(lengths)), lengths)[empty], minlength=len(lengths))
        words = words.filter(pa.array(~empty))
    return words.cast(pa.binary()), lengths


def sample_rate(rows: int, wanted: int) -> float:
    return min(1.0, wanted / max(rows, 1))


def hash_sample(df: DataFrame, key: Column, rate: float, salt: int) -> DataFrame:
    """The rows whose keyed hash falls under ``rate``: the same rows at every run."""
    return df.where(F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < int(rate * (1 << 30)))


def attach_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined to their group (inner, on ``key``), whatever the size of a group.

    Groups with at least total / HEAVY rows number HEAVY at most: a proven bound, so those are
    broadcast.  The rows of all others meet in an ordinary join, no key of which is heavy.
    ``rows`` and ``groups`` should be written tables, since each is read twice.
    """
    floor = max(2, -(-total // HEAVY))
    heavy = F.broadcast(groups.where(F.col(size) >= floor))
    light = groups.where(F.col(size) < floor)
    names = heavy.select(key)
    return rows.join(heavy, key).unionByName(rows.join(F.broadcast(names), key, "left_anti").join(light, key))


def numbered(df: DataFrame, group: str, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` (a written table, ``group`` without nulls) with each row's place in its group by
    ``order``, from 0, and ``name``_of, the rows of the group.

    Rows are range-sorted by group and order and written; the place is the row's number in its
    partition plus the rows of the group in earlier partitions, a sum over one row for each group
    and partition.  So a group may hold any part of the rows; only rows that ``order`` cannot
    tell apart stay together.
    """
    by = [F.col(group), *order]
    at, part, first, before = "_at", "_part", "_first", "_before"
    rows, _ = materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumn(part, F.shiftright(at, 33))
    runs = rows.groupBy(group, part).agg(F.min(at).alias(first), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy(part)) - F.col("_n")
    runs, _ = materialize(runs.select(group, part, first, earlier.alias(before), F.sum("_n").over(Window.partitionBy(group)).alias(f"{name}_of")), "runs")
    placed = rows.join(runs, [group, part]).withColumn(name, F.col(at) - F.col(first) + F.col(before))
    return placed.drop(at, part, first, before)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v long): id, component = the smallest id reachable.

    Every round hooks each vertex to its smallest neighbour, follows the hooks to their roots
    by doubling, and keeps only edges between different roots; the number of vertices at least
    halves, so a chain takes a logarithmic number of rounds.  Each step is a join or a grouped
    minimum over written tables: nothing is gathered, and a hot vertex only makes a splittable
    join.  Ids without an edge are not in the result.
    """
    both = edges.where("u <> v").select("u", "v")
    cut, left = materialize(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = cut.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct()
    first = True
    while left:
        hooks = cut.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("h"), F.least("u", "m").alias("to"))
        hooks, _ = materialize(hooks, "hooks")
        while True:
            a, b = hooks.alias("a"), hooks.alias("b")
            one = a.join(b, F.col("a.to") == F.col("b.h")).select("a.h", F.col("a.to").alias("was"), F.col("b.to").alias("to"))
            two = one.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.h")).select("x.h", "x.was", F.col("y.to").alias("to"))
            moved, _ = materialize(two, "hooks")
            hooks = moved.select("h", "to")
            if moved.where("was <> to").isEmpty():
                break
        if first:
            labels, first = hooks.select(F.col("h").alias("id"), F.col("to").alias("component")), False
        else:
            step = hooks.select(F.col("h").alias("component"), F.col("to").alias("root"))
            labels, _ = materialize(labels.join(step, "component", "left").select("id", F.coalesce("root", "component").alias("component")), "labels")
        s, t = hooks.select(F.col("h").alias("u"), F.col("to").alias("ru")), hooks.select(F.col("h").alias("v"), F.col("to").alias("rv"))
        cut, left = materialize(cut.join(s, "u").join(t, "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "edges")
    return labels
