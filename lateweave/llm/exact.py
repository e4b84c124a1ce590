"""Exact deduplication by keyed streaming state.

Documents arrive as a stream of digests. The state, kept on disk by RocksDB and never expired,
holds for each digest the stable identifier (largest id so far), its content locator and the
number of copies. A digest with several arrivals is a hit; the whole normalised texts of hits are
then compared with the text at the locator, so equal digests of unequal texts do not merge.
"""

from __future__ import annotations

import string
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lateweave.llm.common import discard, keep_documents, materialize
from lateweave.session import scratch_path
from lateweave.sources import paths

_STATE = "spark.sql.streaming.stateStore."
STATE_CONF = {
    f"{_STATE}providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STATE}rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}rocksdb.maxMemoryUsageMB": "64",   # of an executor, for all its stores together
    f"{_STATE}rocksdb.writeBufferSizeMB": "4",
    f"{_STATE}rocksdb.maxWriteBufferNumber": "2",
    f"{_STATE}rocksdb.allowFAllocate": "false",  # many small stores: no space ahead of need
}


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; NULL counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


@contextmanager
def _settings(spark: SparkSession, conf: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def arrivals_of(docs: DataFrame, digest=sha256) -> DataFrame:
    """One slim row per document: digest, id, place of arrival and content locator."""
    return docs.select(
        digest(normalised(F.col("text"))).alias("digest"), sha256(normalised(F.col("text"))).alias("sha"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("arrival"),
        F.concat_ws("#", F.input_file_name(), F.col("doc_id").cast("string")).alias("locator"))


def classes_of(stream: DataFrame) -> DataFrame:
    """Streaming aggregation by digest, pre-aggregated in each task, without a watermark."""
    return stream.groupBy("digest").agg(
        F.max(F.struct("doc_id", "arrival", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))


def run_state(arrivals_path: str, schema, spark: SparkSession, state_path: str, batches: int = 4) -> DataFrame:
    """Stream the files at ``arrivals_path`` into the state at ``state_path``.

    Returns the newest class of every digest that arrived. Running again with the same
    ``state_path`` after more files came adds them to the classes already known. A micro-batch
    that is repeated after a failure overwrites its own folder.
    """
    files = [f for f in paths.children(spark, arrivals_path) if f.endswith(".parquet")]
    stream = (spark.readStream.schema(schema)
              .option("maxFilesPerTrigger", max(1, -(-len(files) // batches))).parquet(arrivals_path))
    found = f"{state_path}/classes"

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{found}/batch={batch}")

    with _settings(spark, STATE_CONF):
        query = (classes_of(stream).writeStream.outputMode("update").foreachBatch(keep)
                 .option("checkpointLocation", f"{state_path}/checkpoint")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    row = ("digest binary, keep struct<doc_id:bigint,arrival:bigint,locator:string>, n bigint, "
           "batch int")
    if not paths.exists(spark, found):
        return spark.createDataFrame([], row).drop("batch")
    return (spark.read.schema(row).parquet(found).groupBy("digest")
            .agg(F.max(F.struct("n", "keep")).alias("last")).select("digest", "last.keep", "last.n"))


def exact_duplicates(docs: DataFrame, digest=sha256, batches: int = 4) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal means identical after lower-casing A-Z; the row with the largest ``doc_id`` stays.
    NULL and empty texts are equal. A NULL id is smaller than any other. Of rows that repeat
    both id and text exactly one is kept. An empty table gives no rows. Extra columns are ignored.
    ``digest`` maps the normalised text to a binary key and may collide.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    path = scratch_path(spark, "arrivals")
    slim = arrivals_of(docs, digest)
    slim.write.parquet(path)
    arrivals = spark.read.schema(slim.schema).parquet(path)
    state_path = scratch_path(spark, "dedup-state")
    classes = materialize(run_state(path, slim.schema, spark, state_path, batches), "classes")
    paths.delete(spark, state_path)

    hits = classes.filter("n > 1").select(F.col("digest").alias("hit"), F.col("keep.doc_id").alias("at"))
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("body"),
                        digest(normalised(F.col("text"))).alias("digest"))
    members = materialize(whole.join(hits, F.col("digest") == F.col("hit")).drop("hit"), "members")
    # Written, so that the join below reads plain shuffles, whose large partitions Spark can split.
    stored = materialize(
        members.filter(F.col("doc_id").eqNullSafe(F.col("at"))).groupBy(F.col("digest").alias("hit"))
        .agg(F.min("body").alias("stored")), "stored")
    differs = materialize(
        members.join(stored, F.col("digest") == F.col("hit")).filter("body != stored")
        .select("digest", "doc_id", "body"), "differs")
    discard(members)
    discard(stored)
    variants = differs.groupBy("digest", "body").agg(
        F.max("doc_id").alias("other_keep"), F.count(F.lit(1)).alias("other_n"))
    other = (differs.join(variants, ["digest", "body"])
             .select(F.col("digest").alias("o_digest"), sha256(F.col("body")).alias("o_sha"), "other_keep",
                     "other_n").distinct())
    lost = differs.groupBy(F.col("digest").alias("l_digest")).agg(F.count(F.lit(1)).alias("lost"))
    out = (arrivals.drop("locator").join(classes, "digest")
           .join(lost, F.col("digest") == F.col("l_digest"), "left")
           .join(other, (F.col("digest") == F.col("o_digest")) & (F.col("sha") == F.col("o_sha")), "left"))
    return out.select(
        "doc_id", F.when(F.col("other_n").isNull(), F.col("keep.doc_id")).otherwise(F.col("other_keep"))
        .alias("keep_id"),
        F.coalesce("other_n", F.col("n") - F.coalesce("lost", F.lit(0))).alias("group_size"),
        F.when(F.col("other_n").isNull(), F.col("arrival") == F.col("keep.arrival"))
        .otherwise(F.col("doc_id").eqNullSafe(F.col("other_keep"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay; of rows that repeat an id and a text, one."""
    found = exact_duplicates(docs).select("doc_id", "kept", "text_sha256")
    found = materialize(found, "kept")
    stays = found.filter("kept").select(F.col("doc_id").alias("k_id"), F.col("text_sha256").alias("k_sha"))
    sha = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("k_id")) & (sha == F.col("k_sha"))
    out = docs.join(stays, here, "left_semi")
    again = (found.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
             .select("doc_id"))
    if again.isEmpty():
        return out
    repeated = keep_documents(out, again)
    ids = again.select(F.col("doc_id").alias("r_id")).distinct()
    once = out.join(ids, F.col("doc_id").eqNullSafe(F.col("r_id")), "left_anti")
    return once.unionByName(
        repeated.withColumn("_sha", sha).dropDuplicates(["doc_id", "_sha"]).drop("_sha"))
