"""Sinks: replace, verify-then-swap, skip when done, metrics, gates.

Two renames are not atomic on an object store. Readers there may meet a short moment
without the table; the old version stays next to it until the new one is in place.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from lateweave.functions.gate import INIT_BIAS, Gate, init_gate
from lateweave.schemas import METRIC_ROW, require_columns
from lateweave.sources import paths

log = logging.getLogger(__name__)


def _swap(spark: SparkSession, tmp: str, path: str) -> None:
    old = paths.sibling(path, "old")
    if paths.exists(spark, path):       # else an earlier swap broke off and old is all there is
        paths.delete(spark, old)
        paths.rename(spark, path, old)
    paths.rename(spark, tmp, path)
    paths.delete(spark, old)


MANIFEST, INPUTS = "_manifest", "_inputs"    # folders inside a table that scans of it pass over


def write_replace(df: DataFrame, path: str, inputs: DataFrame | None = None) -> str:
    """Write beside the target, then put it in its place; a failed write changes nothing.

    ``inputs`` is a fingerprint of what the table was made from (``inputs_fingerprint``).
    """
    spark, tmp = df.sparkSession, paths.sibling(path, "tmp")
    df.write.mode("overwrite").parquet(tmp)
    if inputs is not None:
        inputs.write.mode("overwrite").parquet(f"{tmp}/{INPUTS}")
    _swap(spark, tmp, path)
    return path


def _fingerprint(columns: list[str]) -> list[Column]:
    """Row count and a sum of row hashes that does not depend on row order."""
    return [F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum")]


def _by_file(table: DataFrame) -> DataFrame:
    return table.groupBy(F.col("_metadata.file_name").alias("file")).agg(*_fingerprint(table.columns))


def write_verified(df: DataFrame, path: str, shards: int | None = None,
                   expect_rows: int | None = None, inputs: DataFrame | None = None) -> str:
    """Write, read everything back, compare with what was written, then swap.

    ``expect_rows`` also compares the number of rows with what they should be.

    The fingerprint of the input is observed during the write itself, after the
    repartitioning, so the input is computed once. On a mismatch the temporary table is
    left for inspection and the old one stays. What was read back of each file becomes the
    table's manifest, against which ``damaged_files`` holds the files later.
    """
    spark, tmp = df.sparkSession, paths.sibling(path, "tmp")
    if shards:
        df = df.repartition(shards)
    seen = Observation()
    df.observe(seen, *_fingerprint(df.columns)).write.mode("overwrite").parquet(tmp)
    wrote = seen.get
    if expect_rows is not None and wrote["n"] != expect_rows:
        raise ValueError(f"{wrote['n']} rows for {path}, expected {expect_rows}")
    _by_file(spark.read.parquet(tmp)).coalesce(1).write.mode("overwrite").parquet(f"{tmp}/{MANIFEST}")
    back = read_manifest(spark, tmp).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                                         F.sum("sum").cast("decimal(38,0)").alias("sum")).first()
    if (back["n"], back["sum"]) != (wrote["n"], wrote["sum"]):
        raise OSError(f"{tmp} does not read back as written: {back} after {wrote}")
    log.info("verified %d rows in %s", back["n"], tmp)
    if inputs is not None:
        inputs.write.mode("overwrite").parquet(f"{tmp}/{INPUTS}")
    _swap(spark, tmp, path)
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(file, n, sum)`` of the files that ``write_verified`` wrote."""
    return spark.read.schema("file string, n long, sum decimal(38,0)").parquet(f"{path}/{MANIFEST}")


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, n, problem)``: files that are not as the manifest has them, by name.

    ``unreadable`` covers missing and broken ones, ``changed`` other rows, ``unknown`` a file that
    was not written with the table. Every file is read whole, all of them by one job.
    """
    known = read_manifest(spark, path).select("file", "n", "sum")
    schema = spark.read.parquet(path).schema
    table = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    now = _by_file(table).select(F.col("file").alias("_file"), F.col("n").alias("_n"), F.col("sum").alias("_sum"))
    problem = (F.when(F.col("_file").isNull(), "unreadable").when(F.col("file").isNull(), "unknown")
               .when((F.col("n") != F.col("_n")) | ~F.col("sum").eqNullSafe(F.col("_sum")), "changed"))
    return (known.join(now, F.col("file") == F.col("_file"), "full").withColumn("problem", problem)
            .where(F.col("problem").isNotNull())
            .select(F.coalesce("file", "_file").alias("file"), F.coalesce("n", "_n").alias("n"), "problem"))


def inputs_fingerprint(spark: SparkSession, *inputs: str) -> DataFrame:
    """One row that changes when a file below the ``inputs`` is added, removed or written anew.

    From paths, lengths and times of modification; no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(inputs))
    return files.select("path", "length", "modificationTime").agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("sum"))


def is_complete(spark: SparkSession, path: str, columns: list[str], inputs: DataFrame | None = None) -> bool:
    """The table was finished, has the wanted columns, and was made from the ``inputs`` as they are."""
    if not paths.exists(spark, f"{path}/_SUCCESS"):
        return False
    if not set(columns) <= set(spark.read.parquet(path).columns):
        return False
    if inputs is None:
        return True
    if not paths.exists(spark, f"{path}/{INPUTS}"):
        return False
    return spark.read.schema(inputs.schema).parquet(f"{path}/{INPUTS}").first() == inputs.first()


def materialize_once(spark: SparkSession, path: str, columns: list[str],
                     build: Callable[[], DataFrame], inputs: list[str] | None = None) -> str:
    """Build and write the table unless it is already complete.

    ``inputs`` names the files or folders that it is built from; a change of them builds it anew.
    """
    made_from = inputs_fingerprint(spark, *inputs) if inputs else None
    if is_complete(spark, path, columns, made_from):
        log.info("%s is complete, skipping", path)
        return path
    return write_replace(require_columns(build(), columns, path).select(*columns), path, made_from)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows, one folder and file per run and split."""
    columns = METRIC_ROW.fieldNames()
    (require_columns(metrics, columns, "metrics").select(*columns)
     .repartition("run_id", "split").write.mode("append").partitionBy("run_id", "split").parquet(path))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metric rows written so far; none when nothing was written yet."""
    if not paths.exists(spark, path):
        return spark.createDataFrame([], METRIC_ROW)
    return spark.read.schema(METRIC_ROW).parquet(path)


def save_gate(spark: SparkSession, gate: Gate, path: str) -> str:
    """The gate as a table of one row."""
    row = Row(kind=gate.kind, w=gate.w, b=gate.b, w1=gate.w1, b1=gate.b1)
    schema = "kind string, w array<double>, b double, w1 array<array<double>>, b1 array<double>"
    return write_replace(spark.createDataFrame([row], schema).coalesce(1), path)


def load_gate(spark: SparkSession, path: str, require_gate: bool = True,
              dim: int | None = None) -> Gate:
    """The saved gate. A missing one raises, since scores would silently be worse;
    ``require_gate=False`` gives a gate of ``dim`` zeros that changes nothing instead.
    A gate for vectors of another size than ``dim`` raises."""
    if paths.exists(spark, path):
        row = spark.read.parquet(path).first()
        gate = Gate(list(row["w"]), row["b"], [list(r) for r in row["w1"]], list(row["b1"]))
        if dim is not None and gate.in_features != dim:
            raise ValueError(f"the gate at {path} is for vectors of {gate.in_features} values, not {dim}")
        return gate
    if require_gate:
        raise FileNotFoundError(f"no gate at {path}; pass require_gate=False to score without one")
    if dim is None:
        raise ValueError("dim is needed to score without a saved gate")
    return init_gate(dim, init_bias=INIT_BIAS)
