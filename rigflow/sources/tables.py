"""Reading and writing domain tables.

``read_table`` reads one table with its declared schema (no inference), so Parquet
column pruning and filter pushdown apply from the first ``select``/``where``. Tables
stored in a database are read with Spark's own JDBC source (``spark.read.jdbc`` with a
partition column and bounds so the read is split across tasks); no wrapper is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schemas import schema


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Table ``name`` under ``root`` (``<root>/<name>``) with its declared schema."""
    return spark.read.schema(schema(name)).format(fmt).load(f"{root.rstrip('/')}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite",
                partition_by: list[str] | None = None, fmt: str = "parquet") -> str:
    """Write a table (whole-table replace by default: a batch job's output version)."""
    path = f"{root.rstrip('/')}/{name}"
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_json_document(df: DataFrame, path: str) -> str:
    """A5 sink: the report as JSON lines (one record per row, written by the tasks)."""
    df.write.mode("overwrite").json(path)
    return path
