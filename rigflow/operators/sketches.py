"""Distinct counts that add up: one sketch per group and day, merged over any range.

An exact count of distinct values over a new range reads the rows again; sketches (HyperLogLog,
Spark's own aggregate) of a few KB per group are read instead, whatever the number of rows. The
relative standard error is about 1.04 / sqrt(2^lg); ``bound`` gives the width that an estimate
keeps with high probability. NULL values are not counted, as in COUNT(DISTINCT)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG = 12


def bound(lg: int = LG, widths: float = 4.0) -> float:
    """Relative error within ``widths`` standard errors."""
    return widths * 1.04 / math.sqrt(1 << lg)


def distinct_sketches(df: DataFrame, by: list, value: str, lg: int = LG) -> DataFrame:
    """One sketch per group of ``by`` (columns or names); NULL groups are groups."""
    text = F.col(value).cast("string")
    return df.groupBy(*by).agg(F.hll_sketch_agg(text, F.lit(lg)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: list) -> DataFrame:
    """Sketches of coarser groups: the same as the sketch of all their rows together."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimate(sketch: str = "sketch") -> Column:
    return F.hll_sketch_estimate(sketch)
