"""Session settings the operators rely on, the shared folder, and cached tables."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Dates are wall-clock values; one fixed zone keeps them stable between readers.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM never compiles methods beyond 8000 bytes of bytecode. Parsing expressions fused into one stage exceed
    # that; with this limit Spark generates them as several small methods instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session; sizes and parallelism stay the cluster's choice."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def pin_file_splits(spark: SparkSession) -> None:
    """Make two scans of the same files split alike even if executors come and go in between.

    The split size depends on the number of cores at planning time unless this setting names a number.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(max(spark.sparkContext.defaultParallelism, 1)))


def checkpoint_ready(spark: SparkSession) -> str:
    """Use the shared checkpoint folder the cluster names.

    A folder of this machine is chosen only where all executors run on it (local mode); elsewhere a missing setting
    raises, as other machines could not read such files.
    """
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablewright-"))
    return context.getCheckpointDir()


_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame read by several jobs; lost blocks are recomputed from the source. See ``kept_tables``."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(df)
    return df


@contextmanager
def kept_tables() -> Iterator[None]:
    """Release, at the end of the block, every table that operators cached inside it.

    Results are lazy, so read or write them inside the block: ``with kept_tables(): base_run(...).cleaned.rows.write...``
    """
    before = len(_kept)
    try:
        yield
    finally:
        while len(_kept) > before:
            _kept.pop().unpersist()
