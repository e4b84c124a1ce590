"""Recall of the production parameters on a full shard, where the reranked share is what counts."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lateweave.llm import ann

ROWS, DIM, K = ann.SHARD_ROWS, 64, 5


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vectors(share, width, seed):
    """Unit rows, ``share`` of them within ``width`` of one centre, and which those are."""
    rng = np.random.default_rng(seed)
    x, m = rng.normal(size=(ROWS, DIM)), int(share * ROWS)
    x[:m] = unit(rng.normal(size=(1, DIM))) + width * unit(rng.normal(size=(m, DIM)))
    order = rng.permutation(ROWS)
    return unit(x)[order], order < m


def recall(shard, x, queries):
    most, hits = max(ann.LEAST, int(np.ceil(ann.SHARE * len(x)))), 0
    for q, orders in zip(queries, shard.orders(x[queries])):
        want = set(np.argsort(-(x @ x[q]), kind="stable")[:K + 1]) - {q}
        near, _ = shard.search(x[q], orders, most, K + 1)
        hits += len(want & set(near.tolist()))
    return hits / (K * len(queries))


@pytest.mark.parametrize("share, width", [(0, 0), (1 / 3, 0.001), (1 / 3, 0.01), (1 / 3, 0.05), (1 / 3, 0.3), (1 / 3, 0.8),
                                          (0.9, 0.05)])
def test_full_shard(share, width):
    x, crowded = vectors(share, width, 6)
    tables = [x[:ann.PIVOTS], ann.spread_pivots(x[:ann.SAMPLE], ann.PIVOTS)]
    shard = ann.Shard(x, list(range(ROWS)), tables, ann.NEAREST)
    for side in (crowded, ~crowded):
        queries = np.flatnonzero(side)[:80]
        if len(queries):
            found = recall(shard, x, queries)
            assert found >= 0.9, (share, width, found)


def test_query_with_a_crowded_third(spark, tmp_path):
    x, crowded = vectors(1 / 3, 0.05, 7)
    pq.write_table(pa.table({"vec_id": np.arange(ROWS), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}),
                   f"{tmp_path}/embeddings.parquet")
    got = ann.nearest_neighbours(spark.read.parquet(f"{tmp_path}/embeddings.parquet"),
                                 F.col("vec_id") % 100 == 0, K).toPandas()
    found = got.groupby("query_id").vec_id.agg(set)
    for side in (crowded, ~crowded):
        queries = [q for q in range(0, ROWS, 100) if side[q]]
        hits = sum(len((set(np.argsort(-(x @ x[q]), kind="stable")[:K + 1]) - {q}) & found[q]) for q in queries)
        assert hits / (K * len(queries)) >= 0.9


def test_runs_of_shards(spark, monkeypatch):
    """Many shards, blocks and runs, all of each shard reranked: exactly the nearest, ties by id."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ann, "RUN_SHARDS", 3)
    rng = np.random.default_rng(3)
    x = unit(rng.normal(size=(900, 8)))[np.r_[0:900, 0:60]]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 10 == 0, K, share=1.0).toPandas()
    found = got.sort_values("rank").groupby("query_id").vec_id.agg(list)
    assert len(found) == 96
    for q in found.index:
        s = (x @ x[q]).round(12)
        s[q] = -9
        assert found[q] == np.lexsort((np.arange(len(x)), -s))[:K].tolist()
