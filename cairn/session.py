"""Session construction and cluster-safe settings.

Everything in the library takes DataFrames and returns DataFrames; this
module only builds a session for tests, the bench and the CLI-style entry
points. On a cluster the session comes from the platform and only
``ensure_checkpoint_dir`` is applied to it.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that matter at scale: AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "cairn",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = os.environ.get("CAIRN_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


# Shuffled bytes that one task gets. They are compressed and narrow: the rows that a task sorts, explodes
# or sums from them take some twenty times as much memory, which Spark's default of 64 MB does not allow for.
TASK_BYTES = 16 << 20
# Bytes of rows that go to a Python task at once: JVM and Python hold a batch, its result and what is made of it.
BATCH_BYTES = 8 << 20
# Partitions that a shuffle is dealt into before small ones are put together: 16 GB stay in tasks of that size.
SHUFFLE_PARTS = 1000


def size_tasks(spark: SparkSession) -> None:
    """Let a task's memory not grow with the tables: shuffles are dealt finely and small partitions
    put together by adaptive execution, and Python gets batches of bounded size. What the session has set itself stays."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if batch not in spark.conf.getAll:
        spark.conf.set(batch, f"{BATCH_BYTES}b")
    if spark.conf.get("spark.sql.adaptive.enabled") != "true" or spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") != "true":
        return
    for name, value in (("advisoryPartitionSizeInBytes", f"{TASK_BYTES}b"),
                        ("coalescePartitions.initialPartitionNum", str(max(SHUFFLE_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))):
        name = f"spark.sql.adaptive.{name}"
        if name not in spark.conf.getAll:
            spark.conf.set(name, value)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is unset
    and all runs in one local process (tests) create a private scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="cairn-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return configured


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Spark deletes the shuffle files of a write as soon as the write is done.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """What queries shuffle inside the block is deleted when they end."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def stored(df, name: str):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back: the
    lineage ends there, and what reads it several times sees the same rows. What the write
    shuffled is deleted with its end."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/cairn-{name}-{uuid.uuid4().hex}"
    with freed_shuffles(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def release(*tables) -> None:
    """Delete ``stored`` tables, once everything that reads them has been written."""
    for table in tables:
        spark = table.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(table.stored_at)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def reuse(df):
    """Keep an intermediate that a plan reads several times (memory, spilling
    to disk); lost blocks are recomputed from lineage."""
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)
