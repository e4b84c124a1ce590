"""Inputs of the operators, derived by Spark from the given tables. Nothing is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lateweave.functions.gate import Gate
from lateweave.operators.joins import left_join_hot
from lateweave.operators.tokens import pack_tokens
from lateweave.schemas import DOMAINS
from lateweave.sources.readers import in_scan_order

# Constants of the example gates; the SQL states the same rules.
DIM = 64
GATE = Gate([((i % 7) - 3) / 4.0 for i in range(DIM)], 0.5)
MLP = Gate([1.0, -0.5], 0.25,
           [[((i % 5) - 2) / 2.0 for i in range(DIM)], [((i % 3) - 1) / 2.0 for i in range(DIM)]],
           [0.1, -0.1])
WIDE = Gate([((j % 3) - 1) / 4.0 for j in range(32)], 0.25,
            [[((i + 2 * j) % 7 - 3) / 8.0 for i in range(DIM)] for j in range(32)],
            [((j % 5) - 2) / 10.0 for j in range(32)])
WORD_GATE = Gate([((i % 7) - 3) / 4.0 for i in range(16)], 0.5)
TOKENS_PER_DOC = 8


# Declared, so that opening a table starts no job to infer its schema.
SCHEMAS = {
    "embeddings": "vec_id long, embedding array<float>, label int",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
    "events": "event_id long, user_id long, event_type string, value double",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight consecutive vectors are the tokens of one document."""
    return table(spark, sf_dir, "embeddings").select(
        F.expr(f"vec_id div {TOKENS_PER_DOC}").cast("string").alias("id"),
        (F.col("vec_id") % TOKENS_PER_DOC).cast("int").alias("pos"),
        F.col("embedding").alias("v"), "label")


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, toks, label)``, the labels in token order."""
    return pack_tokens(tokens(spark, sf_dir), ["id"], ["label"])


def one_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document is also a query, all in one split."""
    texts = packed(spark, sf_dir).select(F.lit("all").alias("split"), "id", "toks")
    return texts.withColumnRenamed("id", "qid"), texts.withColumnRenamed("id", "doc_id")


def domain_corpora(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every document is also a query; the first token's label names its split.

    Gold: per token, the document ``label + 1`` places further, which repeats ids, leaves
    the split and runs past the last document. Excluded: the query's own document.
    """
    name = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.get("label", F.lit(0)) + 1)
    texts = packed(spark, sf_dir).select(name.alias("split"), "id", "toks", "label")
    gold = F.transform("label", lambda x: (F.col("id").cast("long") + x + 1).cast("string"))
    queries = texts.select("split", F.col("id").alias("qid"), "toks", gold.alias("gold_ids"),
                           F.array("id").alias("excluded_ids"))
    return queries, texts.select("split", F.col("id").alias("doc_id"), "toks")


def token_triples(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(triples, queries, docs)``: the next document is positive, the one after negative."""
    queries, docs = one_corpus(spark, sf_dir)
    n = F.col("qid").cast("long")
    triples = queries.select(n.alias("triple_id"), "qid", (n + 1).cast("string").alias("pos_id"),
                             (n + 2).cast("string").alias("neg_id"))
    return triples, queries.select("qid", "toks"), docs.select("doc_id", "toks")


def id_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record per document: a positive that names the next document.

    The prefix is empty for English texts; Spanish texts have a one-element positive, the
    last document names an unknown id; negatives have two elements, one, or none.
    """
    d = table(spark, sf_dir, "documents")
    next_id = (F.col("doc_id") + 1).cast("string")
    prefix = F.when(F.col("lang") == "en", "").otherwise(F.concat(F.lit("about "), F.col("source")))
    none = F.array().cast("array<array<string>>")
    return d.select(
        "doc_id",
        F.array(F.concat(F.lit("in "), F.col("lang")), F.col("source")).alias("query"),
        F.when(F.col("lang") == "es", F.array(F.array(next_id)))
        .otherwise(F.array(F.array(prefix, next_id))).alias("pos"),
        F.when(F.col("lang") == "de", F.array(F.array("text")))
        .when(F.col("lang") == "fr", F.array(F.array(F.lit(""), F.col("text"))))
        .when(F.col("source") == "src0", none)
        .otherwise(F.array(F.array(F.col("source"), F.col("text")))).alias("neg"))


def id_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, then benchmark items under the same ids: the later one wins."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows = in_scan_order(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("content")),
                         items.select(F.col("item_id").alias("id"), F.col("text").alias("content")))
    return rows


def repeated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with two rows after each other under every even id of either table."""
    return id_documents(spark, sf_dir).withColumn("id", F.col("id") - F.col("id") % 2)


def text_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark passages as queries over all documents, in one split.

    Gold: the documents with the passage's number and the seventh after it; excluded: the
    one right after it.
    """
    n = F.col("item_id")
    queries = table(spark, sf_dir, "benchmark").select(
        F.lit("biology").alias("split"), n.cast("string").alias("qid"),
        F.col("text").alias("query"),
        F.array(n, n + 7).cast("array<string>").alias("gold_ids"),
        F.array(n + 1).cast("array<string>").alias("excluded_ids"))
    docs = table(spark, sf_dir, "documents").select(
        F.lit("biology").alias("split"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return queries, docs


def answered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, query, answer)``: user turns followed by an assistant turn."""
    c = table(spark, sf_dir, "conversations")
    user = c.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("query"))
    answer = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return user.join(answer, ["conv_id", "turn"])


def text_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records with the text inside: the answer is positive, the question negative.

    Outer whitespace is put around both; pairs lose it, one-element lists keep it.
    """
    pad = F.lit("\u2003\n")
    return answered_turns(spark, sf_dir).select(
        "conv_id", "turn",
        F.array(F.lit("turn"), F.col("turn").cast("string"), F.col("query")).alias("query"),
        F.when(F.col("turn") == 0, F.array(F.array(F.concat(pad, "answer", pad))))
        .otherwise(F.array(F.array(F.concat(pad, F.lit("re:")), F.concat("answer", pad)))).alias("pos"),
        F.when(F.col("turn") == 2, F.array(F.array(F.concat("query", pad))))
        .otherwise(F.array(F.array(pad, F.col("query")))).alias("neg"))


def prompted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per answered turn; positives are the lines of the answer, negatives the
    lines of the answer at the same turn of the next conversation, the prompt its system
    turn. The role of the splits is played by the turn number."""
    turns = answered_turns(spark, sf_dir)
    system = (table(spark, sf_dir, "conversations").where(F.col("role") == "system")
              .select("conv_id", F.col("text").alias("prompt")))
    other = turns.select((F.col("conv_id") - 1).alias("conv_id"), "turn",
                         F.split("answer", "\n").alias("neg"))
    both = turns.join(other, ["conv_id", "turn"], "left")
    return (left_join_hot(both, system, "conv_id", row_key=["conv_id", "turn"])
            .select(F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("split"),
                    "conv_id", "turn", "prompt", "query",
                    F.split("answer", "\n").alias("pos"), "neg"))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one long run: one step per event."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("step"), F.col("value").alias("loss"))
