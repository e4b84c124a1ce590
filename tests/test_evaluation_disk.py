"""An evaluation from texts stores no vectors of documents, and shuffles none by split."""

import os

import pytest
from pyspark.sql import functions as F

from lateweave.plans.evaluate import evaluate_texts, only_splits
from lateweave.session import cut_lineage
from lateweave.sources import paths
from workload.encoder import make_encoder


def stored(folder):
    return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(folder) for f in files)


def test_document_vectors_are_not_stored(spark, tmp_path, monkeypatch):
    held, delete = [], paths.delete

    def measured(spark, path):
        held.append(stored(paths.arrow_location(path)[1]))
        delete(spark, path)

    monkeypatch.setattr(paths, "delete", measured)
    words = F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.concat_ws("-", "id", i))
    docs = spark.range(200).select(F.lit("aops").alias("split"), F.col("id").cast("string").alias("doc_id"),
                                   F.array_join(words, " ").alias("text"))
    queries = spark.createDataFrame(
        [("aops", "1", "7-1 7-2", ["7"], []), ("aops", "2", "8-1", ["9"], ["8"])],
        "split string, qid string, query string, gold_ids array<string>, excluded_ids array<string>")
    got = evaluate_texts(spark, queries, docs, str(tmp_path / "metrics"), "r", make_encoder, make_encoder,
                         partitions=4)
    assert {r.metric: r.value for r in got.collect()}["ndcg@1"] == 0.5
    assert 0 < max(held) < 200 * 400 * 16 * 4 / 10      # a tenth of the vectors


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_wanted_splits_are_broadcast(spark, adaptive):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": adaptive}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = spark.range(100).selectExpr("string(id % 5) AS split", "id AS doc_id")
        kept = only_splits([docs], cut_lineage(docs.where("id < 3").select("split").dropDuplicates()))[0]
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert kept.count() == 60
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
