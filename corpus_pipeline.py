"""The corpus pipeline: language, toxicity, exact copies, near copies, packed sequences.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.

NULL texts count as empty and go in the first stage, with all texts that have no letter. Rows are judged
one by one there and in the second; rows that repeat an id are different documents to both. Of rows
that repeat id and text one stays; rows that repeat an id with different texts are of one class of
near copies and stay or go together. Rows without an id stay where their text does, and are packed with a
NULL id. Extra columns are carried along up to the last stage, whatever their names. Empty tables
go through all stages and give no rows.
"""

from __future__ import annotations

import os
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import lateweave  # noqa: E402
from lateweave.llm import exact, langid, minhash, packing, toxicity  # noqa: E402
from lateweave.llm.common import documents, materialize, small_batches  # noqa: E402
from lateweave.llm.queries import BYTE_BPE  # noqa: E402

cloudpickle.register_pickle_by_value(lateweave)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose predicted language is no better than a guess, go."""
    small_batches(spark)
    return langid.keep_languages(docs, langid.fit_languages(docs))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    small_batches(spark)
    field = toxicity.fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, field)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    small_batches(spark)
    return exact.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    small_batches(spark)
    return minhash.drop_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of 2048."""
    small_batches(spark)
    return packing.pack_documents(docs, BYTE_BPE)


STAGES = [("language", language), ("toxicity", toxic), ("exact_copies", exact_copies),
          ("near_copies", near_copies), ("packing", packed)]

# Models, shingles and token ids are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
