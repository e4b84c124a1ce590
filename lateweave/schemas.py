"""Schemas, fixed names and the column guard."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns of a training triple.
TRIPLE_COLUMNS = ["query", "positive", "negative"]

# The twelve evaluation domains.
DOMAINS = [
    "biology", "earth_science", "economics", "psychology",
    "robotics", "stackoverflow", "sustainable_living",
    "leetcode", "pony", "aops",
    "theoremqa_questions", "theoremqa_theorems",
]

# The thirteen small corpora of the sanity evaluation.
SMALL_CORPORA = [
    "climatefever", "dbpedia", "fever", "fiqa2018", "hotpotqa", "msmarco", "nfcorpus",
    "nq", "quoraretrieval", "scidocs", "arguana", "scifact", "touche2020",
]

# The reported metrics.
METRICS = ["map", "ndcg@1", "ndcg@10", "ndcg@100", "recall@10", "recall@100"]

TRIPLE = T.StructType([T.StructField(c, T.StringType()) for c in TRIPLE_COLUMNS])

_PAIRS = T.ArrayType(T.ArrayType(T.StringType()))

# Nested source whose positives carry a prefix and an id (or a text).
NESTED_RECORD = T.StructType([
    T.StructField("query", T.ArrayType(T.StringType())),
    T.StructField("pos", _PAIRS),
    T.StructField("neg", _PAIRS),
])

# Prompted JSONL source; every key may be absent.
PROMPTED_RECORD = T.StructType([
    T.StructField("prompt", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("pos", T.ArrayType(T.StringType())),
    T.StructField("neg", T.ArrayType(T.StringType())),
])

METRIC_ROW = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("qlen", T.IntegerType()),
    T.StructField("metric", T.StringType()),
    T.StructField("value", T.DoubleType()),
])

# Columns of a versioned tree, whatever types its files have; ids and lists of ids become strings.
VERSIONED_EXAMPLES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("query", T.StringType()),
    T.StructField("gold_ids", T.ArrayType(T.StringType())),
    T.StructField("excluded_ids", T.ArrayType(T.StringType())),
])
VERSIONED_DOCUMENTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("text", T.StringType()),
])

STEP_LOG = T.StructType([
    T.StructField("step", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("head_w_mean", T.DoubleType()),
    T.StructField("head_w_std", T.DoubleType()),
    T.StructField("head_w_min", T.DoubleType()),
    T.StructField("head_w_max", T.DoubleType()),
    T.StructField("run", T.StringType()),
    T.StructField("written", T.LongType()),
])


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    """Raise before any job runs when a column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df
