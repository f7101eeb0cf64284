"""Exact dedup over a persistent digest index.

The index is a Parquet table of one row per distinct text (its digest, the id that stays),
bucketed and sorted by digest.  New rows are first reduced to one row per digest by a grouped
minimum (partial sums before the shuffle, so a hot text costs one row per task), then
sort-merge anti-joined with the index, whose side needs no shuffle, and what is new is appended.

Defined results: null text counts as empty; of equal texts in a batch the smallest non-null
doc_id stays (one row of those that repeat it); rows without a doc_id stay only where no row
with one has their text, one of them; an empty table gives an empty result; other columns are
not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rigflow.llm.common import ASCII_SPACE, attach_group, free_name
from rigflow.session import ensure_checkpoint_dir, materialize


def digest(text: Column) -> Column:
    """sha256 (hex) of the text with each run of ASCII white space as one space."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " "), 256)


class DigestIndex:
    """One row per distinct text ever added: digest (binary), keep_id, batch.

    ``path`` must be in storage that every executor sees; opening an existing path goes on with
    what it holds.  The number of buckets is fixed when the index is made and stored beside it;
    another one is refused.  ``close`` takes the index out of the session's catalog; its files stay.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}"
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.buckets = self._stored(buckets)
        spark.sql(f"CREATE TABLE {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def _stored(self, buckets: int | None) -> int:
        beside = f"{self.path.rstrip('/')}-buckets"
        place = self.spark._jvm.org.apache.hadoop.fs.Path(beside, "_SUCCESS")
        if place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            held = self.spark.read.parquet(beside).first()["buckets"]
            if buckets not in (None, held):
                raise ValueError(f"the index has {held} buckets, not {buckets}")
            return held
        buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(beside)
        return buckets

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digests: DataFrame, batch: str | None = None) -> str:
        """Append the digests (digest, keep_id; one row each) that the index lacks; the batch's name."""
        batch = batch or uuid.uuid4().hex
        known = self.rows().select("digest").hint("merge")
        fresh = digests.select("digest", "keep_id").hint("merge").join(known, "digest", "left_anti").withColumn("batch", F.lit(batch))
        # one file per bucket: rows arrive dealt by the table's own bucket hash, sorted
        (fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))
        return batch


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    With an index that holds earlier batches, keep_id is the earlier row where there is one, and
    no row of such a text is kept.  group_size counts the rows of this batch.
    """
    spark = docs.sparkSession
    own = index is None
    index = index or DigestIndex(spark)
    rows, total = materialize(docs.select("doc_id", F.unhex(digest(F.col("text"))).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    groups, _ = materialize(rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("group_size")), "groups")
    batch = index.add(groups.select("digest", F.col("first.doc_id").alias("keep_id")))
    mine = index.rows().withColumnRenamed("digest", "d").hint("merge")
    owners, _ = materialize(groups.hint("merge").join(mine, F.col("digest") == F.col("d")).select(
        "digest", "group_size", "keep_id", F.when(F.col("batch") == batch, F.col("first.row")).alias("keep_row")), "owners")
    if own:
        index.close()
    return attach_group(rows, owners, "digest", "group_size", total).select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns."""
    kept_id, kept_digest, own = (free_name(docs, n) for n in ("kept_id", "kept_digest", "own_digest"))
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_digest))
    same = docs.withColumn(own, digest(F.col("text")))
    found = same.join(kept, same["doc_id"].eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_digest)))
    return found.dropDuplicates([kept_id, kept_digest]).select(*docs.columns)


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
