"""Substring search through a trigram index.

The index holds, for every run of three characters of a lower-cased column, the keys of the rows
that have it: a posting table, range-sorted by trigram, so that the files' statistics leave one
or two files for a trigram. A search takes the trigrams of its term, counts their postings,
reads the keys of the rarest one only, and verifies the rows of these keys with the same LIKE as
``filters.search``. So the result is that of the scan, while rows that cannot match are never
read as text. Terms with wildcards (``%``, ``_``) or under three letters have no trigram and scan.

New rows are appended as a batch of postings of their own; a row that is indexed again only
repeats a key, which the verification takes once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import search

GRAM = 3


def grams(term: str) -> list[str]:
    """The trigrams of a term in lower case; none where it must scan."""
    t = term.lower()
    if len(t) < GRAM or set(t) & set("%_\\"):
        return []
    return sorted({t[i:i + GRAM] for i in range(len(t) - GRAM + 1)})


def postings(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(gram, column, key) of every trigram of the columns, each once a row; ``df`` has ``key`` unique."""
    parts = []
    for c in cols:
        text = F.lower(F.col(c).cast("string"))
        places = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1)))
        own = F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))
        parts.append(df.select(F.explode(own).alias("gram"), F.lit(c).alias("column"), F.col(key).alias("key")))
    return reduce(lambda a, b: a.unionByName(b), parts)


class TrigramIndex:
    """Postings in a folder that every executor sees, one subfolder for each batch."""

    def __init__(self, spark: SparkSession, path: str, key: str, cols: list[str]):
        self.spark, self.path, self.key, self.cols = spark, path.rstrip("/"), key, cols
        self.batches = 0

    def add(self, df: DataFrame) -> None:
        """Index the rows of ``df`` (key and the indexed columns)."""
        made = postings(df, self.key, self.cols)
        made.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("overwrite").parquet(f"{self.path}/batch-{self.batches:06d}")
        self.batches += 1

    def read(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/batch-{i:06d}" for i in range(self.batches)])

    def candidates(self, term: str) -> DataFrame | None:
        """The keys that hold the term's rarest trigram; None where the term must scan."""
        wanted = grams(term)
        if not wanted or not self.batches:
            return None
        found = self.read().where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.count("*").alias("n")).collect()   # at most a row a trigram
        sizes = dict.fromkeys(wanted, 0) | {r["gram"]: r["n"] for r in found}
        rarest = min(sizes, key=lambda g: (sizes[g], g))
        return self.read().where(F.col("gram") == rarest).select("key").distinct()

    def search(self, df: DataFrame, term: str | None) -> DataFrame:
        """The rows of ``df`` (all of them indexed) that ``filters.search`` gives over the indexed columns."""
        keys = self.candidates(term) if term else None
        if keys is None:
            return search(df, term, self.cols)
        near = df.join(keys.withColumnRenamed("key", "_candidate"), F.col(self.key) == F.col("_candidate"), "left_semi")
        return search(near, term, self.cols)
