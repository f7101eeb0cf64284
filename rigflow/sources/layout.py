"""Append-only tables laid out for reads by key and by time.

A ``KeyedTable`` keeps its rows in one partition folder per month, and in each month bucketed
and sorted by key: reads of a time span open only its months, and groupings or windows by key
take the buckets as they lie, without a shuffle. Appends add files; ``compact`` rewrites months
whose buckets have gathered several.

A bucket is read by one task. Where one bucket holds far more rows than the others (a hot key),
``read`` gives the files without their buckets, so that partial steps (top k per key before the
shuffle, partial sums) spread over all tasks again. Rows without a time share a partition of
their own, rows without a key a bucket. A retried append writes its rows again: append a batch
once, or drop repeats by id on reading.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

HOT = 4          # times the mean bucket from which on a bucket is too large for one task
UNDATED = "none"
LEAST = 1_000_000          # rows of a bucket that one task takes in any case


class KeyedTable:
    """A table under ``path`` (on storage that all executors share), by ``key`` and ``time``."""

    def __init__(self, spark: SparkSession, path: str, key: str, time: str, buckets: int = 64):
        self.spark, self.path, self.key, self.time, self.buckets = spark, path.rstrip("/"), key, time, buckets
        self.name = f"keyed_{uuid.uuid4().hex}"
        self.columns: list[str] = []

    def month(self, at: Column | None = None) -> Column:
        """The partition of a time."""
        return F.coalesce(F.date_format(F.col(self.time) if at is None else at, "yyyy-MM"), F.lit(UNDATED))

    def append(self, batch: DataFrame) -> None:
        """One file per bucket and month of the batch, sorted by key."""
        self.columns = self.columns or batch.columns
        rows = batch.select(*self.columns).withColumn("_month", self.month()).repartition(self.buckets, self.key)
        (rows.write.mode("append").partitionBy("_month").bucketBy(self.buckets, self.key).sortBy(self.key)
         .option("path", self.path).saveAsTable(self.name))

    def skewed(self) -> bool:
        """Whether one bucket holds more than ``HOT`` times the mean, and more than ``LEAST`` rows."""
        per = self.spark.read.parquet(self.path).groupBy(F.pmod(F.hash(self.key), F.lit(self.buckets)).alias("b")).agg(F.count("*").alias("n"))
        most, total = per.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        return most > max(LEAST, HOT * total / self.buckets)

    def read(self, since=None, until=None) -> DataFrame:
        """Rows with ``since`` <= time < ``until`` (all without bounds); only their months are opened."""
        df = self.spark.read.parquet(self.path) if self.skewed() else self.spark.table(self.name)
        if since is not None or until is not None:
            df = df.where(F.col("_month") != UNDATED)
        if since is not None:
            df = df.where((F.col("_month") >= self.month(F.lit(since))) & (F.col(self.time) >= F.lit(since)))
        if until is not None:
            df = df.where((F.col("_month") <= self.month(F.lit(until))) & (F.col(self.time) < F.lit(until)))
        return df.select(*self.columns)

    def files(self) -> dict[str, int]:
        """Files per month."""
        rows = self.spark.read.parquet(self.path).select("_month", F.input_file_name().alias("f")).distinct().groupBy("_month").count().collect()   # a row a month
        return {r["_month"]: r["count"] for r in rows}

    def compact(self) -> list[str]:
        """Rewrite the months that have more files than buckets; their names."""
        many = sorted(m for m, n in self.files().items() if n > self.buckets)
        if many:
            rows, _ = materialize(self.spark.table(self.name).where(F.col("_month").isin(many)), "compact")
            (rows.repartition(self.buckets, self.key).select(*self.columns, "_month").write
             .option("partitionOverwriteMode", "dynamic").mode("overwrite").insertInto(self.name))
        return many

    def forget(self) -> None:
        """Drop the catalog entry, once no frame that ``read`` gave is needed; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
