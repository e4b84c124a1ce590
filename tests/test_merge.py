import math

import pytest
from pyspark.sql import functions as F

import lateweave.operators.joins as joins
import lateweave.operators.merge as merge
from lateweave.operators.joins import left_join_hot
from lateweave.operators.merge import (
    corpus_counts, limit_batches, merge_sources, numbered_copies, seeded_shuffle, source_counts, train_test_split,
)


def triples(spark, n, source):
    return spark.range(n).select(F.concat(F.lit(source), F.col("id") % 3).alias("query"),
                                 F.lit("p").alias("positive"), F.lit("n").alias("negative"),
                                 F.lit(1).alias("extra"))


def test_merge_keeps_duplicates_and_counts(spark):
    merged = merge_sources({"a": triples(spark, 10, "a"), "b": triples(spark, 5, "b")})
    assert merged.columns == ["source", "query", "positive", "negative"]
    assert merged.count() == 15
    raw = spark.createDataFrame([("a",)] * 4 + [("c",)], "source string")
    got = {r.source: (r.raw_rows, r.triples) for r in source_counts(raw, merged).collect()}
    assert got == {"a": (4, 10), "b": (0, 5), "c": (1, 0), "TOTAL": (5, 15)}


def test_merge_guards(spark):
    with pytest.raises(ValueError):
        merge_sources({})
    with pytest.raises(ValueError, match="positive"):
        merge_sources({"a": triples(spark, 1, "a").drop("positive")})


def test_shuffle_does_not_depend_on_partitioning(spark):
    df = spark.range(500)
    orders = [[r.id for r in seeded_shuffle(df.repartition(p), ["id"], shards=s).collect()]
              for p, s in [(1, 3), (7, 3), (4, 16)]]
    assert orders[0] == orders[1] == orders[2] != list(range(500))
    assert sorted(orders[0]) == list(range(500))
    other = [r.id for r in seeded_shuffle(df, ["id"], seed=7).collect()]
    assert other != orders[0]


def test_shuffle_is_a_total_order(spark):
    keys = [r.shuffle_key for r in seeded_shuffle(spark.range(300), ["id"], shards=5).collect()]
    assert keys == sorted(keys)


@pytest.mark.parametrize("rows", [100_000, 40, 3])
def test_split_is_exact_and_follows_the_order(spark, monkeypatch, rows):
    monkeypatch.setattr(merge, "_SORT_ROWS", rows)
    monkeypatch.setattr(merge, "_STEP", 1)
    df = spark.range(701).withColumn("t", F.lit("same"))
    train, test = train_test_split(df, 0.13, ["id"])
    n = math.ceil(0.13 * 701)
    order = [r.id for r in seeded_shuffle(df, ["id"]).collect()]
    assert {r.id for r in test.collect()} == set(order[:n])
    assert {r.id for r in train.collect()} == set(order[n:])


def test_no_test_part(spark):
    df = spark.range(5)
    assert train_test_split(df, 0.0, ["id"]) == (df, None)


def test_all_rows_in_test(spark):
    train, test = train_test_split(spark.range(9), 1.0, ["id"])
    assert (train.count(), test.count()) == (0, 9)


def test_limit_batches(spark):
    df = spark.range(100)
    assert limit_batches(df, 3, 16, ["id"]).count() == 48
    assert limit_batches(df, 0, 16, ["id"]).count() == 100
    assert limit_batches(df, 50, 16, ["id"]).count() == 100


def test_repeated_key_raises(spark, monkeypatch):
    monkeypatch.setattr(merge, "_SORT_ROWS", 10)
    with pytest.raises(ValueError, match="repeats"):
        limit_batches(spark.range(50).withColumn("k", F.lit(1)), 1, 16, ["k"])


def test_corpus_counts(spark):
    q = spark.createDataFrame([("a",), ("a",), ("b",)], "split string")
    d = spark.createDataFrame([("a",), ("c",)], "split string")
    got = {r.split: (r.queries, r.docs) for r in corpus_counts(q, d).collect()}
    assert got == {"a": (2, 1), "b": (1, 0), "c": (0, 1)}


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_hot_and_missing_keys_join_whole(spark, monkeypatch, broadcast):
    """With the list of hot keys broadcast, and with it joined by a shuffle."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        _hot_and_missing_keys(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _hot_and_missing_keys(spark):
    keys = [None] * 40 + ["hot"] * 50 + ["gone"] * 30 + ["a", "b", "b"]
    left = spark.createDataFrame(list(enumerate(keys)), "n int, k string")
    right = spark.createDataFrame([("hot", 1, 0), ("hot", 2, 1), ("b", 3, 0), ("c", 4, 0)],
                                  "k string, x int, o int")
    for hot in (5, 1000):
        got = left_join_hot(left, right, "k", ["n"], hot, last_by=["o"]).collect()
        assert sorted((r.n, r.k, r.x) for r in got) == [
            (n, k, {"hot": 2, "b": 3}.get(k)) for n, k in enumerate(keys)]
        inner = left_join_hot(left, right, "k", ["n"], hot, how="inner")
        assert inner.count() == 50 * 2 + 2
    unkeyed = left_join_hot(left, right, "k", hot_rows=5)
    assert unkeyed.count() == 40 + 100 + 30 + 3


@pytest.mark.parametrize("block", [3, 10_000])
def test_numbered_copies(spark, block):
    df = spark.createDataFrame([("a", None)] * 10 + [("a", 1)] + [("b", 2)] * 3, "x string, y int")
    got = sorted((r.x, r.y or 0, r.copy) for r in numbered_copies(df, ["x", "y"], block).collect())
    assert got == [("a", 0, i) for i in range(10)] + [("a", 1, 0)] + [("b", 2, i) for i in range(3)]
    assert numbered_copies(df.limit(0), ["x", "y"], block).count() == 0


def test_a_cut_reads_its_input_twice_at_most(spark, tmp_path):
    """Once for the rows' hashes, and once when the cut is taken; the counts come from the hashes."""
    df = spark.range(5000)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    seen = df.mapInArrow(counted, "id long")
    train, test = merge.train_test_split(seen, 0.1, ["id"])
    assert reads.value == 5000
    assert test.count() == 500 and reads.value == 10_000
    assert train.count() == 4500 and reads.value == 15_000


def test_inner_hot_join_leaves_rows_without_a_key_out(spark):
    left = spark.createDataFrame([(i, None if i % 3 else "k") for i in range(30)], "n int, k string")
    right = spark.createDataFrame([("k", 1), (None, 2)], "k string, x int")
    for hot in (2, 100):
        assert left_join_hot(left, right, "k", ["n"], hot, how="inner").count() == 10
        rows = left_join_hot(left, right, "k", ["n"], hot).collect()
        assert len(rows) == 30 and all((r.x == 1) == (r.k == "k") for r in rows)
    with pytest.raises(ValueError):
        left_join_hot(left, right, "k", how="full")
