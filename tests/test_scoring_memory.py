"""What a task holds of documents is bounded, and written vectors are scored in few tasks."""

import pyarrow as pa

from lateweave.operators import scoring
from lateweave.plans import evaluate
from test_scoring_index import corpus, tables


def test_a_task_holds_one_bounded_chunk(monkeypatch):
    held = []
    joined = scoring.joined_index
    monkeypatch.setattr(scoring, "joined_index", lambda parts: held.append(sum(p.nbytes for p in parts)) or joined(parts))
    docs, masks, queries, weights = corpus(1, n_docs=300, words=150)
    d, q = tables(docs, masks, queries, weights)
    blocks = scoring.query_blocks(q, "norm")
    batches = d.to_batches(max_chunksize=5)
    most = max(scoring.doc_index(pa.Table.from_batches([b])).nbytes for b in batches)
    run = scoring._local_topk(lambda: [blocks], 5, "float64", 10 * most)
    assert sum(b.num_rows for b in run(batches)) >= 5 * len(queries)
    assert len(held) > 3 and max(held) <= 10 * most


def test_written_vectors_are_scored_in_few_tasks(spark, monkeypatch, tmp_path):
    spark.range(1000).repartition(40).write.parquet(str(tmp_path / "v"))
    most = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")     # a task per file
    try:
        few = evaluate._long_tasks(spark.read.parquet(str(tmp_path / "v")))
        assert few.rdd.getNumPartitions() <= 3 * spark.sparkContext.defaultParallelism < 40
        assert few.distinct().count() == 1000
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", most)
