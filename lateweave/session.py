"""Session helpers: where lineage is cut and where scratch tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lateweave.sources import paths


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A local master without that setting uses a folder below the warehouse; on a cluster a
    machine-local folder would be lost with its machine, so that case raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "")
    sc = spark.sparkContext
    if not folder:
        if sc.getCheckpointDir():
            return sc.getCheckpointDir()
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


BATCH_BYTES = 16 << 20
_BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Let the session end an Arrow batch at ``BATCH_BYTES`` too, unless it already has such a limit.

    By default only rows are counted (10,000). Texts and packed vectors are wide rows, and a batch is held
    outside the heap, once by the JVM and once by the worker, in every task.
    """
    if spark.conf.get(_BATCH_BYTES_KEY, None) is None:
        spark.conf.set(_BATCH_BYTES_KEY, str(BATCH_BYTES))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable, eager checkpoint: later steps restart from files, not from the inputs."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table, in this application's folder below the checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch_root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/scratch-{spark.sparkContext.applicationId}"


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the checkpoint folder and read it back: a table whose size Spark knows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application; results that still read them are lost."""
    paths.delete(spark, _scratch_root(spark))
