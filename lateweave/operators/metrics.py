"""Judgements, retrieval metrics, reports and resumable runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lateweave.functions.text import route_length
from lateweave.schemas import METRICS

KEY = ["split", "qid"]


def qrels_from_gold(queries: DataFrame, gold: str = "gold_ids") -> DataFrame:
    """Explode the gold lists: distinct ``(split, qid, doc_id)`` with ``rel`` 1."""
    return (queries.select(*KEY, F.explode(F.col(gold).cast("array<string>")).alias("doc_id"))
            .where(F.col("doc_id").isNotNull())
            .dropDuplicates().withColumn("rel", F.lit(1)))


def exclusions_from_lists(queries: DataFrame, col: str = "excluded_ids") -> DataFrame:
    """Exploded exclusion lists; no column means no exclusions."""
    ids = F.col(col) if col in queries.columns else F.array()
    return (queries.select(*KEY, F.explode(ids.cast("array<string>")).alias("doc_id"))
            .dropDuplicates())


def qrels_from_pairs(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """Distinct pairs of the kept queries, grades ignored, ``rel`` 1."""
    return (pairs.select(*KEY, F.col("doc_id").cast("string").alias("doc_id"))
            .dropDuplicates()
            .join(queries.select(*KEY), KEY, "left_semi")
            .withColumn("rel", F.lit(1)))


def gold_counts(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Every query with its number of gold documents; 0 when it has none."""
    counts = qrels.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_gold"))
    return (queries.select(*KEY).dropDuplicates().join(counts, KEY, "left")
            .fillna(0, ["n_gold"]))


def join_qrels(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """Each ranked document with its judgement; 0 when not judged."""
    return (ranked.join(qrels.select(*KEY, "doc_id", "rel"), [*KEY, "doc_id"], "left")
            .withColumn("rel", F.coalesce("rel", F.lit(0))))


def _discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def _numerator(metric: str) -> Column:
    """Per query, over hits: the part of a metric above the fraction line."""
    if metric == "map":
        return F.sum(F.col("_hit") / F.col("rank"))
    name, _, k = metric.partition("@")
    inside = F.col("rank") <= int(k)
    if name == "ndcg":
        return F.sum(F.when(inside, _discount(F.col("rank"))))
    if name == "recall":
        return F.sum(F.when(inside, F.lit(1.0)))
    raise ValueError(f"unknown metric {metric!r}")


def _denominator(metric: str) -> Column:
    name, _, k = metric.partition("@")
    if name != "ndcg":
        return F.col("n_gold").cast("double")
    depth = F.least(F.lit(int(k)), F.col("n_gold").cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.lit(0.0),
                       lambda s, i: s + _discount(i))


def query_metrics(ranked: DataFrame, qrels: DataFrame, queries: DataFrame,
                  metrics: list[str] = METRICS, empty_gold: str = "zero") -> DataFrame:
    """One row per query, one column per metric.

    ``ranked`` holds at most k rows per query, and only its hits are aggregated. All
    distinct gold documents count below the line, also missing or excluded ones. A document
    that is ranked twice is one hit, at its better rank.
    Queries that return nothing score 0; queries without gold score 0 or, with
    ``empty_gold="skip"``, are left out.
    """
    hit_order = Window.partitionBy(*KEY).orderBy("rank")
    hits = (ranked.select(*KEY, "doc_id", "rank")
            .join(qrels.select(*KEY, "doc_id"), [*KEY, "doc_id"], "left_semi")
            .groupBy(*KEY, "doc_id").agg(F.min("rank").alias("rank"))
            .withColumn("_hit", F.row_number().over(hit_order)))
    sums = hits.groupBy(*KEY).agg(*[_numerator(m).alias(m) for m in metrics])
    judged = gold_counts(queries, qrels)
    if empty_gold == "skip":
        judged = judged.where(F.col("n_gold") > 0)
    return judged.join(sums, KEY, "left").select(*KEY, *[
        F.when(F.col("n_gold") > 0, F.coalesce(F.col(f"`{m}`"), F.lit(0.0)) / _denominator(m))
        .otherwise(0.0).alias(m) for m in metrics])


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, queries: DataFrame,
                      metrics: list[str] = METRICS, empty_gold: str = "zero") -> DataFrame:
    """``(split, metric, value)``: each metric averaged over the split's queries."""
    per_query = query_metrics(ranked, qrels, queries, metrics, empty_gold)
    means = per_query.groupBy("split").agg(*[F.avg(f"`{m}`").alias(m) for m in metrics])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").alias("value")) for m in metrics]))
    return means.select("split", pairs.alias("_m")).select("split", "_m.*")


def split_report(expected: DataFrame, values: DataFrame, metric: str = "ndcg@10") -> DataFrame:
    """Every expected split with its value in percent; NULL and ``missing`` when absent."""
    got = values.where(F.col("metric") == metric).select("split", (F.col("value") * 100).alias("pct"))
    return (expected.select("split").join(got, "split", "left")
            .withColumn("status", F.when(F.col("pct").isNull(), "missing").otherwise("done")))


def macro_mean(report: DataFrame) -> DataFrame:
    """Unweighted mean over the splits present, and how many of the expected they are."""
    return (report.agg(F.avg("pct").alias("mean_pct"), F.count("pct").alias("n_present"),
                       F.count(F.lit(1)).alias("n_expected"))
            .where(F.col("n_present") > 0))


def expected_runs(splits: DataFrame, run_id: str, query_length: int = 256,
                  short_length: int = 32) -> DataFrame:
    """``(run_id, split, qlen)`` for every split, with the length its queries use."""
    return splits.select(F.lit(run_id).alias("run_id"), "split",
                         route_length(F.col("split"), query_length, short_length).alias("qlen"))


def resume_pending(expected: DataFrame, finished: DataFrame) -> DataFrame:
    """The expected ``(run_id, split, qlen)`` that have no finished metrics yet."""
    key = ["run_id", "split", "qlen"]
    return expected.join(finished.select(*key), key, "left_anti")


def splits_present(wanted: DataFrame, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(present, missing)`` of the wanted splits, judged by the rows of ``table``."""
    have = table.select("split").dropDuplicates()
    return wanted.join(have, "split", "left_semi"), wanted.join(have, "split", "left_anti")
