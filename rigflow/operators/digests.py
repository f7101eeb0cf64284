"""Where two versions of a table differ, found from digests instead of from the rows.

A row's digest is 128 bits in four lanes of 32; the lanes are summed per bucket of the key's
hash, and since sums add up, a coarser level of the tree is the sum of a finer one. Both tables
are read once for the sums (partial sums leave the map tasks: at most ``LEAVES`` rows each),
then only the rows of buckets that differ are read on: turned to JSON, shuffled and compared.
A table whose digests are kept beside it need not be read again at all where nothing changed.

Rows of equal digests are taken as equal (two different versions of a bucket agree by accident
with probability 2^-128). Repeated rows count as often as they are there; NULL keys share a
bucket; NULLs are told apart by place. Decimals, dates and texts are hashed by value, floating
numbers by their text (so -0.0 is not 0.0, as in JSON), nested values by their JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

LEAVES = 1 << 16          # buckets of the finest level
LANES = ("_l0", "_l1", "_l2", "_l3")


def _hashable(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return c.cast("string")
    plain = isinstance(field.dataType, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType,
                                        T.TimestampType, T.TimestampNTZType))
    return c if plain else F.to_json(F.struct(c))


def row_lanes(df: DataFrame) -> list[Column]:
    """The four lanes of a row's digest, over its column names, values and NULL marks."""
    names = F.lit("\n".join(df.columns))
    values = [_hashable(f) for f in df.schema.fields]
    marks = [F.col(f"`{c}`").isNull() for c in df.columns]
    out = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), names, *values, *marks)
        out += [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]
    return out


def leaf(key: str, leaves: int = LEAVES) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(leaves))


def bucket_digests(df: DataFrame, key: str, leaves: int = LEAVES) -> DataFrame:
    """Leaves of the tree: ``leaf``, number of rows, summed lanes."""
    lanes = dict(zip(LANES, row_lanes(df)))
    return (df.select(leaf(key, leaves).alias("leaf"), *[c.alias(n) for n, c in lanes.items()])
            .groupBy("leaf").agg(F.count("*").alias("rows"), *[F.sum(n).alias(n) for n in LANES]))


def coarser(digests: DataFrame, nodes: int) -> DataFrame:
    """The level of ``nodes`` nodes above (a divisor of the leaves; 1 is the root)."""
    return digests.groupBy(F.pmod("leaf", F.lit(nodes)).alias("leaf")).agg(
        *[F.sum(c).alias(c) for c in ("rows", *LANES)])


def differing_leaves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Leaves whose digests differ, of two tables of digests."""
    n = new.select(F.col("leaf").alias("_m"), F.struct("rows", *LANES).alias("_n"))
    j = old.select("leaf", F.struct("rows", *LANES).alias("_o")).join(n, F.col("leaf") == F.col("_m"), "full_outer")
    return j.where(~F.col("_o").eqNullSafe(F.col("_n"))).select(F.coalesce("leaf", "_m").alias("leaf"))


def differing_rows(old: DataFrame, new: DataFrame, key: str = "id", leaves: int = LEAVES) -> tuple[DataFrame, DataFrame]:
    """The rows of both versions that lie in differing buckets; all others are equal."""
    found, _ = materialize(differing_leaves(bucket_digests(old, key, leaves), bucket_digests(new, key, leaves))
                           .withColumnRenamed("leaf", "_leaf"), "leaves")
    return tuple(df.join(found, leaf(key, leaves) == F.col("_leaf"), "left_semi") for df in (old, new))
