"""Spark session defaults and shared-storage helpers.

The engine never invents storage locations on a cluster: intermediate tables
and streaming checkpoints go under ``spark.checkpoint.dir``, which the cluster
is expected to set to a shared folder.  Only a single-process session where it
is unset (local tests) gets a scratch folder.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale: AQE re-plans joins and coalesces/splits
# partitions at run time; skew join splits hot partitions of a join side.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Text stages are CPU-heavy per byte: do not merge small shuffle outputs
    # below 256 KB per task (at scale partitions are far larger anyway).
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Partition values such as tweet ids must stay strings (A3).
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # Top-k per group is pushed below the shuffle (partial group limit).
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000000",
    # Streaming de-duplication keeps one key per post: RocksDB keeps that state
    # off the JVM heap and checkpoints it incrementally.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "stancelake") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("STANCELAKE_DRIVER_MEM", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's setting, else the context's folder.

    Only a session that runs in one process, as in tests, gets a scratch folder
    if both are unset; on a cluster that would be another folder on every machine,
    so there it is an error.
    """
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not current:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="stancelake-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh location under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


# A table that is written needs no shuffle file of its job any more; texts reach Python a few MB at a time.
WRITING_CONF = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """``conf`` for what runs inside; the values before come back."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def writing(spark: SparkSession):
    """Settings for writing a table: its shuffle files go when it stands, a batch for Python is bounded in bytes."""
    return settings(spark, WRITING_CONF)


def stored(df: DataFrame, name: str, path: str | None = None, by: str | None = None, **options) -> DataFrame:
    """``df`` written under the shared folder, with a folder for each value of ``by``, and read back; a ``path`` given is written anew."""
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    with writing(spark):
        (df.write.partitionBy(by) if by else df.write).options(**options).mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
