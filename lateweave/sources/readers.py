"""Scans: triples, nested and prompted records, evaluation tables."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateweave.functions.text import non_empty_text, text_column
from lateweave.operators.joins import last_wins
from lateweave.operators.metrics import (
    exclusions_from_lists, qrels_from_gold, qrels_from_pairs, splits_present,
)
from lateweave.schemas import (
    DOMAINS, PROMPTED_RECORD, SMALL_CORPORA, TRIPLE_COLUMNS, VERSIONED_DOCUMENTS,
    VERSIONED_EXAMPLES, require_columns,
)
from lateweave.sources import paths

log = logging.getLogger(__name__)


def select_domains(split: str = "all", known: list[str] = DOMAINS) -> list[str]:
    """All known domains, or the named one; an unknown name raises."""
    if split == "all":
        return list(known)
    if split not in known:
        raise ValueError(f"unknown split {split!r}; must be 'all' or one of {known}")
    return [split]


def require_rows(df: DataFrame) -> DataFrame:
    """Raise when nothing was produced; stops at the first row found."""
    if df.isEmpty():
        raise RuntimeError("no rows were produced")
    return df


def scan_jsonl(spark: SparkSession, folder: str, domains: list[str],
               schema: T.StructType = PROMPTED_RECORD) -> DataFrame:
    """One JSON object per line, one ``<domain>.jsonl`` per domain, with its ``split``.

    The name may be a file or a folder of files. Blank lines are skipped and a malformed line fails the read; absent keys are NULL.
    """
    files = [f"{folder.rstrip('/')}/{d}.jsonl" for d in domains]
    rows = (spark.read.schema(schema).option("mode", "FAILFAST").json(files))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl(?:/[^/]*)?$", 1)
    return rows.select(name.alias("split"), *schema.fieldNames())


def scan_tolerant(spark: SparkSession, *files: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet read by the physical columns alone.

    The columns are those of one footer, that of the first file; no other file is opened for its
    schema, and whatever else its metadata holds is not consulted. With a ``schema``, its columns that
    the footer has, by name, cast to its types. A file that lacks one of them gives NULL there.
    """
    scan = spark.read.option("mergeSchema", "false")
    found = scan.parquet(files[0]).schema
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is not None:
        found = T.StructType([found[c] for c in schema.fieldNames() if c in found.fieldNames()])
    rows = scan.schema(found).parquet(*files)
    if schema is None:
        return rows
    return rows.select(*[F.col(f.name).cast(schema[f.name].dataType).alias(f.name) for f in found])


def in_scan_order(*scans: DataFrame) -> DataFrame:
    """Union by name of scanned tables, with each row's ``position``: table, file, number in the file.

    The position is data, so it survives any shuffle; its order is that in which a reader of the
    tables one after another, files by name, meets the rows. Each must be a scan of files,
    without anything after it that hides where its rows come from.
    """
    parts = [df.select(*df.columns, F.struct(
        F.lit(i).alias("part"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row")).alias("position")) for i, df in enumerate(scans)]
    return reduce(DataFrame.unionByName, parts)


def scan_latest_version(spark: SparkSession, root: str, splits: list[str], prefix: str = "bright"
                        ) -> tuple[dict[str, str], dict[str, str]]:
    """Newest ``(examples, documents)`` file per split below a versioned tree.

    Layout: ``examples/<version>/.../<prefix>-<split>.parquet``, a file or a folder of
    files, and the same under ``documents``. Paths compare component by component. A
    split counts only when both sides exist. Only paths are listed; no file is opened.
    """
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
              .option("pathGlobFilter", "*.parquet").load(root).select("path"))
    shape = rf"^(.*/(examples|documents)/(?:.*/)?{prefix}-([^/]+)\.parquet)(?:/[^/]*)?$"
    table, side, split = (F.regexp_extract("path", shape, i) for i in (1, 2, 3))
    newest = (listed.select(table.alias("path"), side.alias("side"), split.alias("split"))
              .where((F.col("side") != "") & F.col("split").isin(splits))
              .groupBy("side", "split")
              .agg(F.max_by("path", F.split("path", "/")).alias("path")))
    found: dict[str, dict[str, str]] = {"examples": {}, "documents": {}}
    for row in newest.collect():        # two paths per requested split
        found[row["side"]][row["split"]] = row["path"]
    both = set(found["examples"]) & set(found["documents"])
    return ({s: p for s, p in found["examples"].items() if s in both},
            {s: p for s, p in found["documents"].items() if s in both})


def _with_split(df: DataFrame, split: str) -> DataFrame:
    return df.withColumn("split", F.lit(split))


def query_rows(df: DataFrame) -> DataFrame:
    """``(split, qid, query, gold_ids, excluded_ids)`` with every id a string."""
    def ids(name: str):
        if name in df.columns:
            return F.col(name).cast("array<string>")
        return F.array().cast("array<string>")

    return df.select("split", F.col("id").cast("string").alias("qid"),
                     F.col("query").cast("string").alias("query"),
                     ids("gold_ids").alias("gold_ids"), ids("excluded_ids").alias("excluded_ids"))


def document_rows(df: DataFrame) -> DataFrame:
    """``(split, doc_id, text)``; the text comes from ``content``, else ``text``, else ""."""
    return df.select("split", F.col("id").cast("string").alias("doc_id"),
                     text_column(df).alias("text"))


def load_versioned_split(spark: SparkSession, root: str | None, splits: list[str],
                         fallback=None, prefix: str = "bright") -> tuple[DataFrame, DataFrame]:
    """Query and document rows of each split from its newest files.

    A split without both files comes from ``fallback(split) -> (examples, documents)``.
    """
    examples, documents = ({}, {}) if root is None else scan_latest_version(
        spark, root, splits, prefix)
    q_parts, d_parts = [], []
    for split in splits:
        if split in examples:
            q = scan_tolerant(spark, examples[split], schema=VERSIONED_EXAMPLES)
            d = scan_tolerant(spark, documents[split], schema=VERSIONED_DOCUMENTS)
        elif fallback is not None:
            q, d = fallback(split)
        else:
            raise FileNotFoundError(f"no files for split {split!r} below {root}")
        q_parts.append(query_rows(_with_split(q, split)))
        d_parts.append(document_rows(_with_split(d, split)))
    return reduce(DataFrame.unionByName, q_parts), reduce(DataFrame.unionByName, d_parts)


def load_eval_tables(examples: DataFrame, documents: DataFrame, splits: list[str] | None = None,
                     order: list[str] | None = None) -> dict[str, DataFrame]:
    """Flat ``queries``, ``corpus``, ``qrels`` and ``exclusions`` for the chosen splits.

    ``examples``: ``split, id, query, gold_ids``; ``documents``: ``split, id, content``.
    Splits without queries are logged and skipped; splits without documents are simply
    absent from the corpus. A repeated id keeps its last row in the order of the columns
    ``order``, which should tell its rows apart; without them, the greatest row by content.
    """
    names = list(splits or DOMAINS)
    wanted = examples.sparkSession.createDataFrame([(s,) for s in names], "split string")
    _, missing = splits_present(wanted, examples)
    for row in missing.collect():       # at most one row per requested split
        log.warning("split %r has no queries", row["split"])
        names.remove(row["split"])

    def chosen(df: DataFrame) -> DataFrame:
        # A literal list reaches the scan and prunes partitions by split.
        df = df.where(F.col("split").isin(names)).withColumn("id", F.col("id").cast("string"))
        keys = ["split", "id"]
        return last_wins(df, keys, [F.col(c) for c in order or [c for c in df.columns if c not in keys]])

    queries, corpus = query_rows(chosen(examples)), document_rows(chosen(documents))
    return {"queries": queries.select("split", "qid", "query"), "corpus": corpus,
            "qrels": qrels_from_gold(queries), "exclusions": exclusions_from_lists(queries)}


def load_beir_tables(corpus: DataFrame, queries: DataFrame, pairs: DataFrame, split: str,
                     known: list[str] = SMALL_CORPORA) -> dict[str, DataFrame]:
    """Corpus, queries and judgements of one named corpus; empty texts are dropped."""
    select_domains(split, known)

    def rows(df: DataFrame, out: str) -> DataFrame:
        return (df.where(non_empty_text(F.col("text")))
                .select(F.lit(split).alias("split"), F.col("_id").cast("string").alias(out),
                        F.col("text").cast("string").alias("text")))

    kept = rows(queries, "qid")
    judged = pairs.select(F.lit(split).alias("split"),
                          F.col("query-id").cast("string").alias("qid"),
                          F.col("corpus-id").cast("string").alias("doc_id"))
    return {"queries": kept, "corpus": rows(corpus, "doc_id"),
            "qrels": qrels_from_pairs(judged, kept)}


ROW_KEY = ["file", "row_index"]
_RUN = "-[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"


def load_triples(spark: SparkSession, path: str, row_key: bool = False) -> DataFrame:
    """A finished triple table: its three columns, and each row's place with ``row_key``.

    A place is the file's name without the id of the job that wrote it, and the row's
    number in the file: the same again when the table is rebuilt from the same input. The folder must be complete. When it holds one table per split, the first by name
    is taken.
    """
    if not paths.exists(spark, f"{path}/_SUCCESS"):
        splits = [c for c in paths.children(spark, path) if paths.exists(spark, f"{c}/_SUCCESS")]
        if not splits:
            raise FileNotFoundError(f"no finished table at {path}")
        path = min(splits)
    table = require_columns(spark.read.parquet(path), TRIPLE_COLUMNS, path)
    file = F.regexp_replace(F.col("_metadata.file_name"), _RUN, "").alias("file")
    place = [file, "_metadata.row_index"] if row_key else []
    return table.select(*TRIPLE_COLUMNS, *place)
