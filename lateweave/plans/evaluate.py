"""One evaluation run: score pending splits, exclude, judge, write, report."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateweave.functions.gate import Gate, with_gate_weights
from lateweave.functions.text import route_length
from lateweave.operators.metrics import (
    exclusions_from_lists, expected_runs, macro_mean, qrels_from_gold, resume_pending,
    retrieval_metrics, split_report,
)
from lateweave.operators.ranking import TOP_K, exclude_ids
from lateweave.operators.scoring import score_topk
from lateweave.operators.tokens import (
    DOCUMENT_LENGTH, QUERY_LENGTH, Encoder, embed_tokens, truncate_packed,
)
from lateweave.schemas import METRICS
from lateweave.session import cut_lineage, scratch_path, write_scratch
from lateweave.sources import paths
from lateweave.sources.writers import read_metrics, write_metrics


def rank_queries(queries: DataFrame, docs: DataFrame, gate: Gate | None = None, k: int = TOP_K,
                 **scoring) -> DataFrame:
    """Top k per query: weighted MaxSim with a gate, plain MaxSim without.

    ``queries``: ``split, qid, toks``, optionally ``excluded_ids``; exclusions apply
    after the cut.
    """
    weighted = queries if gate is None else with_gate_weights(queries, gate)
    ranked = score_topk(weighted, docs, k, "plain" if gate is None else "norm", **scoring)
    if "excluded_ids" not in queries.columns:
        return ranked
    return exclude_ids(ranked, exclusions_from_lists(queries))


def evaluate(queries: DataFrame, docs: DataFrame, gate: Gate | None = None, k: int = TOP_K,
             metrics: list[str] = METRICS, **scoring) -> DataFrame:
    """``(split, metric, value)`` for queries that also carry ``gold_ids``."""
    ranked = rank_queries(queries, docs, gate, k, **scoring)
    return retrieval_metrics(ranked, qrels_from_gold(queries), queries, metrics)


def pending_runs(spark: SparkSession, queries: DataFrame, path: str, run_id: str,
                 query_length: int, short_length: int) -> DataFrame:
    """``(run_id, split, qlen)`` of the splits without metrics.

    Cut off from its inputs, since the metrics table it was read from grows afterwards.
    """
    splits = queries.select("split").dropDuplicates()
    expected = expected_runs(splits, run_id, query_length, short_length)
    return cut_lineage(resume_pending(expected, read_metrics(spark, path)))


def only_splits(tables: list[DataFrame], wanted: DataFrame) -> list[DataFrame]:
    """The rows of the wanted splits; tables stored by split are pruned when the join runs.

    Splits are few, whatever Spark makes of the size of ``wanted``: vectors are never shuffled by split.
    """
    return [df.join(F.broadcast(wanted.select("split")), "split", "left_semi") for df in tables]


def evaluate_run(spark: SparkSession, queries: DataFrame, docs: DataFrame, path: str, run_id: str,
                 gate: Gate | None = None, query_length: int = QUERY_LENGTH,
                 short_length: int = 32, document_length: int = DOCUMENT_LENGTH,
                 **scoring) -> DataFrame:
    """Evaluate the splits of this run that have no metrics yet, and append theirs.

    All pending splits go through one job; tokens are capped per side, with the query
    cap routed by split.
    """
    pending = pending_runs(spark, queries, path, run_id, query_length, short_length)
    if not pending.isEmpty():
        q, d = only_splits([queries, docs], pending)
        q = truncate_packed(q, route_length(F.col("split"), query_length, short_length))
        d = truncate_packed(d, document_length)
        values = evaluate(q, d, gate, **scoring)
        write_metrics(values.join(pending, "split"), path)
    return read_metrics(spark, path).where(F.col("run_id") == run_id)


def evaluate_texts(spark: SparkSession, queries: DataFrame, docs: DataFrame, path: str,
                   run_id: str, query_encoder: Callable[[], Encoder],
                   document_encoder: Callable[[], Encoder], gate: Gate | None = None,
                   query_length: int = QUERY_LENGTH, short_length: int = 32,
                   document_length: int = DOCUMENT_LENGTH, partitions: int | None = None,
                   **scoring) -> DataFrame:
    """``evaluate_run`` from texts: embed the pending splits once, then score them.

    ``queries``: ``split, qid, query, gold_ids, excluded_ids``; ``docs``: ``split, doc_id,
    text``. The queries' vectors are read several times and are kept in the shared checkpoint folder until
    the metrics are written. Those of documents, many times as large as their texts, are read once: they go
    from the encoder to the scoring batch by batch and are never stored.
    """
    pending = pending_runs(spark, queries, path, run_id, query_length, short_length)
    if pending.isEmpty():
        return read_metrics(spark, path).where(F.col("run_id") == run_id)
    queries, docs = only_splits([queries, docs], pending)
    vectors = scratch_path(spark, "vectors")
    try:
        embed_tokens(queries, query_encoder, ["split", "qid", "gold_ids", "excluded_ids"],
                     "query", query_length).write.parquet(vectors)
        d = _long_tasks(embed_tokens(docs, document_encoder, ["split", "doc_id"], "text",
                                     document_length, partitions=partitions))
        return evaluate_run(spark, spark.read.parquet(vectors), d, path, run_id, gate,
                            query_length, short_length, document_length, **scoring)
    finally:
        paths.delete(spark, vectors)        # the metrics are written by now


TASKS_PER_CORE = 3


def _long_tasks(vectors: DataFrame) -> DataFrame:
    """Written or newly embedded vectors in a few tasks per core, without a shuffle.

    Vectors are much larger than their texts, so that a scan of them has very many tasks, each of which has
    to find out anew how good a document must be. A task holds one chunk, however much it reads.
    """
    return vectors.coalesce(TASKS_PER_CORE * vectors.sparkSession.sparkContext.defaultParallelism)


# Token caps of the small corpora.
SMALL_QUERY_LENGTH = 64
SMALL_DOCUMENT_LENGTH = 512


def evaluate_corpora(spark: SparkSession, corpora: list[dict[str, DataFrame]], path: str, run_id: str,
                     query_encoder: Callable[[], Encoder], document_encoder: Callable[[], Encoder],
                     gate: Gate | None = None, query_length: int = SMALL_QUERY_LENGTH,
                     document_length: int = SMALL_DOCUMENT_LENGTH, partitions: int | None = None,
                     metrics: list[str] = METRICS, **scoring) -> DataFrame:
    """Evaluate several small corpora as one run: those without metrics in one job, together.

    Each corpus is what ``load_beir_tables`` gives: ``queries`` and ``corpus`` with texts, and ``qrels``,
    all with the corpus' name as ``split``. A query is compared with its own corpus only. Finished
    corpora of the run are skipped; the result has the metrics of all.
    """
    tables = {name: reduce(DataFrame.unionByName, [c[name] for c in corpora])
              for name in ("queries", "corpus", "qrels")}
    pending = pending_runs(spark, tables["queries"], path, run_id, query_length, query_length)
    if not pending.isEmpty():
        queries, docs, qrels = only_splits([tables["queries"], tables["corpus"], tables["qrels"]], pending)
        q = write_scratch(embed_tokens(queries, query_encoder, ["split", "qid"], "text", query_length), "queries")
        d = write_scratch(embed_tokens(docs, document_encoder, ["split", "doc_id"], "text", document_length,
                                       partitions=partitions), "documents")
        d = _long_tasks(d)
        ranked = rank_queries(q, d, gate, **scoring)
        values = retrieval_metrics(ranked, qrels, q, metrics)
        write_metrics(values.join(pending, "split"), path)
    return read_metrics(spark, path).where(F.col("run_id") == run_id)


def report(metrics: DataFrame, expected: DataFrame, metric: str = "ndcg@10"
           ) -> tuple[DataFrame, DataFrame]:
    """Per-split report in percent and its macro mean."""
    rows = split_report(expected, metrics, metric)
    return rows, macro_mean(rows)
