"""Session helpers: settings that matter at scale, and a checkpoint folder.

Nothing here creates global state; operators take DataFrames and return DataFrames.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings this library relies on. AQE re-plans joins from runtime sizes (a size-checked
# broadcast with sort-merge beyond it), coalesces small shuffle partitions and splits
# skewed ones. The broadcast threshold is Spark's own size check on the estimated side.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(input_tb: float, executors: int, cores_per_executor: int = 4,
                 target_partition_mb: int = 256) -> dict[str, str]:
    """Starting settings for a large cluster run (pass as ``extra`` or to spark-submit).

    Shuffle partitions are sized so a partition holds ~``target_partition_mb`` of the input
    (upper bound; AQE coalesces small ones and splits skewed ones at run time), scans read
    ~``target_partition_mb`` per task, and the broadcast threshold stays fixed, so only sides
    whose measured size is under it are broadcast.
    """
    total_mb = input_tb * 1024 * 1024
    parts = max(executors * cores_per_executor * 2, int(total_mb / target_partition_mb))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_partition_mb}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{target_partition_mb * 2}m",
        "spark.sql.files.maxPartitionBytes": f"{target_partition_mb}m",
        "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    }


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "rigflow", extra: dict | None = None) -> SparkSession:
    """A session for tests and the bench. On a cluster, pass the cluster's own settings."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder in use, registering ``spark.checkpoint.dir`` if needed.

    On a cluster the folder is set by the cluster (a shared file system) through
    ``spark.checkpoint.dir``; a cluster session without it is an error, since executors would
    write to disks of their own. Only a local session (tests) gets a scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a local SparkContext (e.g. Spark Connect)
        sc = None
    if sc is not None:
        current = sc.getCheckpointDir()
        if current:
            return current
        path = sc.getConf().get("spark.checkpoint.dir", None)
        if not path and sc.master.split("[")[0] == "local":
            path = tempfile.mkdtemp(prefix="rigflow-ckpt-")
    else:
        path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc is not None:
        sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    return path


ROWS_OF_TASK = 200_000     # about as many rows of a shuffle go to one task in ``small_tasks``


@contextlib.contextmanager
def small_tasks(spark: SparkSession, rows: int):
    """A block whose jobs shuffle about ``rows`` rows in more and smaller partitions.

    Narrow rows compress so well that partitions of AQE's usual size hold many times their bytes
    once a task sorts them. Here partitions grow in number with the rows, are put together up
    to a few MB only, and a hot key is split from a few MB on. The settings are put back after."""
    first = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_TASK))
    settings = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(first),
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16m"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_written: list[str] = []      # tables written by ``materialize``, oldest first


def materialize(df: DataFrame, name: str = "t") -> tuple[DataFrame, int]:
    """Write ``df`` as a Parquet table under the checkpoint folder and read it back.

    One job: the row count is observed while writing (``Observation``), so no second pass.
    The returned frame's lineage starts at the written files (a lost executor never
    recomputes what came before), and Spark sizes it from the real file sizes. The table
    stays until ``release`` (or the end of a ``scratch`` block) removes it.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/rigflow-{name}-{uuid.uuid4().hex}"
    obs = Observation(f"rows_{uuid.uuid4().hex[:8]}")
    _written.append(path)
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    rows = int(obs.get["n"])
    return spark.read.parquet(path), rows


def release(spark: SparkSession, since: int = 0) -> int:
    """Remove the tables ``materialize`` has written (after the first ``since`` of them), once
    no frame that reads them is needed any more; their number."""
    gone = _written[since:]
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    del _written[since:]
    return len(gone)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """A block whose written tables are removed at its end; its results must be written by then."""
    since = len(_written)
    try:
        yield
    finally:
        release(spark, since)
