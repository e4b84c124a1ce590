"""The operators over the whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateweave.llm import (
    ann, exact, langid, licenses, minhash, packing, passages, pieces, prefix_trie, records, toxicity, variants, warc)
from lateweave.llm.common import documents, materialize
from lateweave.session import scratch_path

# Files of the public tokenizers; another folder by the environment.
_FOLDER = os.environ.get("TOKENIZERS_DIR")


def _tokenizer(name: str) -> str:
    if _FOLDER:
        return f"{_FOLDER}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


BYTE_BPE = _tokenizer("byte_bpe_50k.json")
PIECES = _tokenizer("piece_bpe_32k.model")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_round_trip(documents(spark, sf_dir), PIECES).select(
        "doc_id", "n_pieces", "ids_crc32", F.md5("text").alias("text_md5"))


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = warc.response_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    out = warc.derivative_records(responses)
    return out.select(F.col("source_id").cast("bigint").alias("page_id"),
                      *(c for c in out.columns if c not in ("source_id", "record")),
                      F.octet_length("record").cast("bigint").alias("record_bytes"),
                      F.md5("record").alias("record_md5"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(documents(spark, sf_dir))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-records")
    manifest = records.write_token_records(documents(spark, sf_dir), folder, BYTE_BPE)
    return records.record_digests(records.read_token_records(spark, manifest, folder))


def op8_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return langid.predict_languages(docs, langid.fit_languages(docs))


def op9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), BYTE_BPE)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = toxicity.fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_documents(docs, field)


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.drop_repeated_passages(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix_trie.turn_rows(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    nodes, ends = prefix_trie.prefix_trie(*prefix_trie.shared_beginnings(materialize(rows, "turns")))
    found = prefix_trie.end_digests(ends).withColumnRenamed("node", "e_node")
    return nodes.join(found, F.col("node") == F.col("e_node"), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    op1_near_duplicates, op2_pieces, op3_warc_derivatives, op4_licenses, op5_nearest, op6_exact_duplicates,
    op7_token_records, op8_languages, op9_packed, op10_toxicity, op11_repeated_passages, op12_prefix_trie,
    op13_spelling_variants)}
