"""Ranking, top-k and exclusions on ``(split, qid, doc_id, score)`` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lateweave.functions.text import preview

QUERY_KEY = ["split", "qid"]
TOP_K = 100
FAN_IN = 32


def topk_per_query(scored: DataFrame, k: int = TOP_K, ties: str = "first",
                   fan_in: int = FAN_IN, by: str = "score", place: str = "doc_id") -> DataFrame:
    """The ``k`` best documents per query with their 1-based ``rank``.

    Rows compare by the column ``by``. Equal ones go by the column ``place``: ``ties="first"`` puts the
    smaller one first, ``"last"`` the larger one. NaN is dropped, since it would sort above everything.

    Two levels: the best ``k`` inside each of ``fan_in`` hash buckets of a query, then
    the best of those. One query never needs more than ``fan_in * k`` rows in its last
    task, however many candidates it has, and both levels cut before their shuffle.
    """
    tie = F.asc(place) if ties == "first" else F.desc(place)
    order = [F.desc(by), tie]
    part = Window.partitionBy(*QUERY_KEY, "_bucket").orderBy(*order)
    final = Window.partitionBy(*QUERY_KEY).orderBy(*order)
    best = (scored.where(~F.isnan(by))
            .withColumn("_bucket", F.pmod(F.xxhash64("doc_id"), F.lit(fan_in)))
            .withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
            .drop("_bucket", "rank"))
    return best.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)


def exclude_ids(ranked: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Drop excluded documents from a cut ranking and close the ranks up.

    Runs after the top-k: excluded documents have used up slots, so fewer than k may stay.
    """
    kept = ranked.join(exclusions.select(*QUERY_KEY, "doc_id"), [*QUERY_KEY, "doc_id"], "left_anti")
    order = Window.partitionBy(*QUERY_KEY).orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order))


def display_ranking(scored: DataFrame, texts: DataFrame, k: int, chars: int = 60,
                    place: str | None = None) -> DataFrame:
    """Ranking for reading: the later document first on ties, with the start of each text.

    Documents go by the column ``place``; without one by their ids, of which whole numbers come
    first, by value. Pass all scored documents: a table already cut at ``k`` has lost the ones that
    tie with its last.
    """
    if place is None:
        number = F.expr("try_cast(doc_id AS decimal(38, 0))")
        scored, place = scored.withColumn("_place", F.struct(
            number.isNull().alias("text"), number.alias("number"), F.col("doc_id").alias("id"))), "_place"
    top = topk_per_query(scored, k, ties="last", place=place)
    # Cut the texts before the join: only the preview travels.
    short = texts.select("doc_id", preview(F.col("text"), chars).alias("preview"))
    return top.join(short, "doc_id", "left").select(
        *QUERY_KEY, "rank", "score", "doc_id", "preview")
