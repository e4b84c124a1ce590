"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lateweave.session import scratch_path
from lateweave.sources import paths

# Characters of text handled at a time inside a task; a longer text is a slice of its own.
SLICE_CHARS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let the session hand texts to Python in batches of ``rows``, less than by default.

    A batch is held outside the heap, once by the JVM and once by the worker, in every task; texts are
    wide rows, and whatever is done with them here costs far more than a batch.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    if df is not None:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            paths.delete(df.sparkSession, folder)


def per_process(key: tuple, make: Callable):
    """What ``make`` gave the first time in this Python process; for readers of files, not for results.

    Functions go to the tasks by value, so a module's globals start anew with every task; a worker
    process runs many of them.
    """
    kept = sys.__dict__.setdefault("_lateweave_kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def invert(matrix: np.ndarray) -> np.ndarray:
    """Inverse by elimination with row exchange, one element-wise update per column.

    Without calls into threaded linear algebra: those can block on a driver that runs Spark.
    """
    m = len(matrix)
    work = np.hstack([matrix.astype(float), np.eye(m)])
    for i in range(m):
        j = i + int(np.abs(work[i:, i]).argmax())
        if work[j, i] == 0.0:
            raise ValueError("the matrix is singular")
        if j != i:
            work[[i, j]] = work[[j, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0.0
        rows = np.flatnonzero(factor)
        work[rows] -= factor[rows, None] * work[i]
    return work[:, m:]


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                budget: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into slices of bounded text; a NULL text counts as empty."""
    for batch in batches:
        texts = batch.column(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in part.column(column).to_pylist()]
            start = stop


def with_columns(batch: pa.RecordBatch, keep: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The columns ``keep`` of ``batch`` and new ones."""
    return pa.RecordBatch.from_arrays(
        [batch.column(c) for c in keep] + list(new.values()), names=keep + list(new))


def keep_rows(docs: DataFrame, keeps: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """The rows whose text is kept, with all their columns, judged where they are read.

    ``keeps()`` runs once per task and gives a function from texts (NULL: empty) to booleans.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = keeps()
        for batch, texts in text_slices(batches):
            yield batch.filter(pa.array(keep(texts), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_documents(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is in ``kept``; a NULL id matches a NULL id."""
    ids = kept.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_kept_id")), "left_semi")
