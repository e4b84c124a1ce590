"""Merging, counting, shuffling and splitting of row tables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateweave.schemas import TRIPLE_COLUMNS, require_columns
from lateweave.session import write_scratch
from lateweave.sources import paths

SEED = 42


def merge_sources(sources: dict[str, DataFrame], keep: list[str] | None = None) -> DataFrame:
    """UNION ALL of triple tables with their ``source``; duplicates stay.

    ``keep`` names columns to carry along, such as a row key.
    """
    if not sources:
        raise ValueError("no sources to merge")
    columns = [*TRIPLE_COLUMNS, *(keep or [])]
    parts = [require_columns(df, columns, name).select(F.lit(name).alias("source"), *columns)
             for name, df in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def source_counts(raw: DataFrame, triples: DataFrame, source: str = "source") -> DataFrame:
    """Raw rows and triples per source, and the grand total under ``TOTAL``."""
    both = (raw.select(source, F.lit(1).alias("r"), F.lit(0).alias("t"))
            .unionAll(triples.select(source, F.lit(0), F.lit(1))))
    # Sums per source first: a rollup repeats every row it reads.
    sums = both.groupBy(source).agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    return (sums.rollup(source)
            .agg(F.sum("r").alias("raw_rows"), F.sum("t").alias("triples"),
                 F.grouping_id().alias("_total"))
            .select(F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col(source)).alias(source),
                    "raw_rows", "triples"))


def corpus_counts(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Queries and documents per split."""
    both = (queries.select("split", F.lit(1).alias("q"), F.lit(0).alias("d"))
            .unionAll(docs.select("split", F.lit(0), F.lit(1))))
    return both.groupBy("split").agg(F.sum("q").alias("queries"), F.sum("d").alias("docs"))


def numbered_copies(df: DataFrame, columns: list[str], block: int = 10_000) -> DataFrame:
    """``columns`` of every row and ``copy``, which numbers equal rows from 0.

    Equal rows can't be told apart, so they are counted, with partial sums before the shuffle,
    and made anew from the count: no task ever sorts or numbers the copies of one row. Those of
    a row that occurs more than ``block`` times are made by many tasks.
    """
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    few = counts.where(F.col("_n") <= block).select(
        *columns, F.explode(F.sequence(zero, F.col("_n") - 1)).alias("copy"))
    blocks = counts.where(F.col("_n") > block).select(
        *columns, "_n", F.explode(F.sequence(zero, F.col("_n") - 1, F.lit(block).cast("long"))).alias("_from"))
    many = blocks.repartition(*columns, "_from").select(*columns, F.explode(
        F.sequence(F.col("_from"), F.least(F.col("_from") + block, F.col("_n")) - 1)).alias("copy"))
    return few.unionByName(many)


def shuffle_key(keys: list[str], seed: int = SEED) -> Column:
    """A seeded hash of the row key: the same order however the rows are partitioned."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_shuffle(df: DataFrame, keys: list[str], seed: int = SEED,
                   shards: int | None = None) -> DataFrame:
    """Reproducible random order. ``keys`` must tell rows apart, so that copies spread too.

    The hash is uniform, so its leading digits cut the order into ``shards`` even ranges:
    a total order in one shuffle, without the sampling pass a sort would run over the
    input. ``shards`` is the number of partitions, and so of files when written; the
    session's shuffle partitions by default. Choose it by the size of the table.
    """
    n = shards or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = F.conv(F.substring("shuffle_key", 1, 7), 16, 10).cast("long")
    return (df.withColumn("shuffle_key", shuffle_key(keys, seed))
            .repartitionById(n, F.shiftright(head * n, 28).cast("int"))
            .sortWithinPartitions("shuffle_key", *keys))


PIECE_BYTES = 128 << 20     # text that one task of a shuffle should get


def cut_shards(df: DataFrame, columns: list[str], shards: int) -> int:
    """``shards``, or the least multiple of it with at most ``PIECE_BYTES`` of text in each on average.

    A shard that is too much for a task is several files then. The texts are read once to be measured.
    """
    size = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)).cast("long") for c in columns]
    total = df.agg(F.sum(reduce(Column.__add__, size))).first()[0] or 0
    return shards * max(1, math.ceil(total / (shards * PIECE_BYTES)))


_STEP = 4          # hex digits per refinement: at most 16**4 buckets are counted at a time
_SORT_ROWS = 100_000


class HashOrder:
    """The places of a table's rows in ``seeded_shuffle`` order, from one read of the table.

    Only the rows' hashes and keys are written; every count and boundary comes from them. Counts by
    hash prefix add up over partitions, and the prefix that holds a place is counted again with
    longer prefixes until it is small enough to sort.
    """

    def __init__(self, df: DataFrame, keys: list[str], seed: int = SEED) -> None:
        self.keys, self.seed = keys, seed
        self.types = {k: df.schema[k].dataType for k in keys}
        self.rows = write_scratch(df.select(shuffle_key(keys, seed).alias("_h"), *keys), "row-hashes")
        self.total = self.rows.count()      # from the file footers

    def first(self, n: int) -> Column:
        """A predicate true for exactly the first ``n`` rows; the table is filtered, not shuffled."""
        if n <= 0:
            return F.lit(False)
        if n >= self.total:
            return F.lit(True)
        prefix, before, inside = "", 0, self.total
        while inside > _SORT_ROWS:
            if len(prefix) >= 32:
                raise ValueError(f"row key {self.keys} repeats too often to cut at row {n}")
            counts = (self.rows.where(F.col("_h").startswith(prefix))
                      .groupBy(F.substring("_h", 1, len(prefix) + _STEP).alias("p"))
                      .agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect())
            for row in counts:
                if before + row["n"] >= n:
                    break
                before += row["n"]
            prefix, inside = row["p"], row["n"]
        order = ["_h", *self.keys]
        last = (self.rows.where(F.col("_h").startswith(prefix)).orderBy(*order)
                .limit(n - before).orderBy(*[F.desc(c) for c in order]).limit(1).collect()[0])
        here = F.struct(shuffle_key(self.keys, self.seed).alias("_h"), *[F.col(k) for k in self.keys])
        edge = F.struct(F.lit(last["_h"]).alias("_h"),
                        *[F.lit(last[k]).cast(self.types[k]).alias(k) for k in self.keys])
        return here <= edge

    def close(self) -> None:
        """Delete the written hashes; predicates made from them stay good."""
        for folder in {f.rpartition("/")[0] for f in self.rows.inputFiles()}:
            paths.delete(self.rows.sparkSession, folder)


def hash_cut(df: DataFrame, n: int, keys: list[str], seed: int = SEED) -> Column:
    """A predicate true for exactly the first ``n`` rows in ``seeded_shuffle`` order."""
    order = HashOrder(df, keys, seed)
    try:
        return order.first(n)
    finally:
        order.close()


def train_test_split(df: DataFrame, test_size: float, keys: list[str], seed: int = SEED,
                     ) -> tuple[DataFrame, DataFrame | None]:
    """``(train, test)`` with exactly ``ceil(test_size * rows)`` test rows, or ``(df, None)``."""
    if test_size <= 0:
        return df, None
    order = HashOrder(df, keys, seed)
    try:
        is_test = order.first(math.ceil(test_size * order.total))
    finally:
        order.close()
    return df.where(~is_test), df.where(is_test)


def limit_batches(df: DataFrame, max_steps: int, batch_size: int, keys: list[str],
                  seed: int = SEED) -> DataFrame:
    """The rows ``max_steps`` batches would use, in seeded order; 0 steps means no limit."""
    if not max_steps:
        return df
    return df.where(hash_cut(df, max_steps * batch_size, keys, seed))
