"""Small file system steps through Hadoop's FileSystem, so any mounted store works."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, src: str, dst: str) -> None:
    fs, p = _fs(spark, src)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(dst)):
        raise OSError(f"could not rename {src} to {dst}")


def sibling(path: str, suffix: str) -> str:
    """``/a/b`` and ``tmp`` give ``/a/.b.tmp``."""
    parent, _, name = path.rstrip("/").rpartition("/")
    hidden = f".{name}.{suffix}"
    return f"{parent}/{hidden}" if parent else hidden


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [s.getPath().toString() for s in fs.listStatus(p)]


def arrow_location(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """The store and the path in it for Arrow's own readers, which tasks use; needs no session.

    Local and mounted folders, HDFS, S3, Google and Azure stores; others raise.
    """
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return arrow_fs.LocalFileSystem(), unquote(parts.path)
    try:
        return arrow_fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1).replace("abfss://", "abfs://", 1))
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"tasks can't open {parts.scheme}:// with Arrow; name another spark.checkpoint.dir") from e
