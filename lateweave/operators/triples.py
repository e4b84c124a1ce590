"""Nested source records to flat (query, positive, negative) triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateweave.functions.text import (
    format_query, join_words, longer_than, null_to_empty, py_strip, safe_get,
)
from lateweave.operators.joins import HOT_ROWS, last_wins, left_join_hot
from lateweave.schemas import TRIPLE_COLUMNS, require_columns

# Length limits and caps of the sources.
MIN_TEXT = 10
MAX_POS = 2
MAX_NEG = 4


def _size(arr: Column) -> Column:
    return F.coalesce(F.size(arr), F.lit(0))


def last_wins_dim(documents: DataFrame, order: list[str], id_col: str = "id",
                  content_col: str = "content") -> DataFrame:
    """``(doc_id, content)`` with one row per id; the greatest ``order`` wins."""
    dim = documents.select(F.col(id_col).cast("string").alias("doc_id"),
                           F.col(content_col).cast("string").alias("content"), *order)
    return last_wins(dim, ["doc_id"], [F.col(c) for c in order]).select("doc_id", "content")


def min_length_filter(triples: DataFrame, n: int = MIN_TEXT) -> DataFrame:
    """Keep triples whose positive and negative are both longer than ``n`` characters."""
    return triples.where(longer_than(F.col("positive"), n) & longer_than(F.col("negative"), n))


def resolve_record(records: DataFrame, documents: DataFrame, order: list[str],
                   row_key: list[str] | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Records whose positives are ``[prefix, id]``: look the id up, keep it when unknown.

    ``documents`` holds ``id, content``; a repeated id resolves to its last row by ``order``.

    A positive counts only as a pair; prefix and text are joined by one space when the
    prefix is not empty. A two-element negative is joined by a space as it is, a
    one-element negative is itself. Only flat strings reach the join.
    """
    pos0, neg0 = safe_get(F.col("pos"), 0), safe_get(F.col("neg"), 0)
    is_pair = _size(pos0) > 1
    keep = row_key or []
    flat = records.select(
        *keep,
        join_words(records, "query").alias("query"),
        F.when(is_pair, null_to_empty(safe_get(pos0, 0))).otherwise("").alias("_prefix"),
        F.when(is_pair, safe_get(pos0, 1)).otherwise("").alias("_id"),
        F.when(_size(neg0) > 1, F.concat(safe_get(neg0, 0), F.lit(" "), safe_get(neg0, 1)))
        .when(_size(neg0) == 1, safe_get(neg0, 0)).otherwise("").alias("negative"),
    )
    texts = documents.select(F.col("id").cast("string").alias("_id"),
                             F.col("content").cast("string").alias("_text"), *order)
    joined = left_join_hot(flat, texts, "_id", row_key, hot_rows, last_by=order)
    text = F.coalesce(F.col("_text"), F.col("_id"))
    positive = F.when(F.col("_prefix") != "", F.concat("_prefix", F.lit(" "), text)).otherwise(text)
    return joined.select(*keep, "query", positive.alias("positive"), "negative")


def _flat_text(items: Column) -> Column:
    first = safe_get(items, 0)
    return (F.when(_size(first) > 1,
                   py_strip(F.concat(safe_get(first, 0), F.lit(" "), safe_get(first, 1))))
            .when(_size(first) == 1, safe_get(first, 0)).otherwise(""))


def flatten_record(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Records with the text inside: pairs are joined and stripped, single items kept as is."""
    return records.select(
        *(keep or []),
        join_words(records, "query").alias("query"),
        _flat_text(F.col("pos")).alias("positive"),
        _flat_text(F.col("neg")).alias("negative"),
    )


def _usable_items(items: Column, cap: int, min_len: int) -> Column:
    capped = F.transform(F.slice(items, 1, cap), lambda t: py_strip(null_to_empty(t)))
    return F.filter(capped, lambda t: F.length(t) >= min_len)


def explode_product(records: DataFrame, max_pos: int = MAX_POS, max_neg: int = MAX_NEG,
                    min_len: int = MIN_TEXT, keep: list[str] | None = None) -> DataFrame:
    """Prompted records to every (positive, negative) combination of their capped lists.

    The caps come before the length filter, as in the source rule. Each record gives at
    most ``max_pos * max_neg`` rows, inside its own task.
    """
    keep = keep or []
    lists = records.select(
        *keep,
        format_query(F.col("prompt"), F.col("query")).alias("query"),
        _usable_items(F.col("pos"), max_pos, min_len).alias("_pos"),
        _usable_items(F.col("neg"), max_neg, min_len).alias("_neg"),
    ).where(F.col("query") != "")
    return (lists.select(*keep, "query", F.explode("_pos").alias("positive"), "_neg")
            .select(*keep, "query", "positive", F.explode("_neg").alias("negative")))


def project_triple(df: DataFrame) -> DataFrame:
    return require_columns(df, TRIPLE_COLUMNS, "triple table").select(*TRIPLE_COLUMNS)
