"""The triple build: nested and prompted sources, each written once, then merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lateweave.operators.merge import SEED, cut_shards, merge_sources, numbered_copies, seeded_shuffle
from lateweave.operators.triples import (
    MAX_NEG, MAX_POS, explode_product, flatten_record, min_length_filter, project_triple,
    resolve_record,
)
from lateweave.schemas import TRIPLE_COLUMNS
from lateweave.sources.readers import (
    load_triples, require_rows, scan_jsonl, select_domains,
)
from lateweave.sources.writers import materialize_once, write_replace, write_verified


def hq_triples(records: DataFrame, documents: DataFrame, order: list[str],
               row_key: list[str] | None = None) -> DataFrame:
    """Records with ids, resolved against the documents and filtered by length."""
    return min_length_filter(resolve_record(records, documents, order, row_key))


def vl_triples(records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Records with their text inside, filtered by length."""
    return min_length_filter(flatten_record(records, keep))


def materialize(spark: SparkSession, config: str, path: str, records: DataFrame,
                documents: DataFrame | None = None, order: list[str] | None = None,
                inputs: list[str] | None = None) -> str:
    """Write the ``hq`` or ``vl`` triples unless they are already there, made from the same ``inputs``."""
    if config == "hq":
        return materialize_once(spark, path, TRIPLE_COLUMNS,
                                lambda: hq_triples(records, documents, order), inputs)
    if config == "vl":
        return materialize_once(spark, path, TRIPLE_COLUMNS, lambda: vl_triples(records), inputs)
    raise ValueError(f"unknown config {config!r}")


def prompted_triples(spark: SparkSession, folder: str, split: str = "all",
                     max_pos: int = MAX_POS, max_neg: int = MAX_NEG) -> DataFrame:
    """Triples of the JSONL domains; raises when there are none."""
    records = scan_jsonl(spark, folder, select_domains(split))
    return require_rows(explode_product(records, max_pos, max_neg, keep=["split"]))


def materialize_prompted(spark: SparkSession, folder: str, path: str, split: str = "all",
                         max_pos: int = MAX_POS, max_neg: int = MAX_NEG, seed: int = SEED,
                         shards: int | None = None) -> str:
    """Write the triples of the JSONL domains in a seeded order, replacing the table.

    The order depends on the rows alone, not on how the input is cut into files. Large ``shards`` are
    written as several files each.
    """
    triples = prompted_triples(spark, folder, split, max_pos, max_neg)
    shards = shards and cut_shards(triples, TRIPLE_COLUMNS, shards)
    rows = numbered_copies(triples, TRIPLE_COLUMNS)
    mixed = seeded_shuffle(rows, [*TRIPLE_COLUMNS, "copy"], seed, shards)
    return write_replace(project_triple(mixed), path)


def merge_tables(spark: SparkSession, inputs: dict[str, str], path: str, seed: int = SEED,
                 shards: int | None = None) -> str:
    """Merge finished triple tables in a seeded order, written and verified.

    The order comes from each row's source, content and number among its equals, so equal
    rows spread as well and the same rows in other files give the same order. The merged rows
    must be as many as the inputs' rows together. Large ``shards`` are written as several files each.
    """
    sources = {n: load_triples(spark, p) for n, p in inputs.items()}
    total = sum(df.count() for df in sources.values())      # from the file footers
    keys = ["source", *TRIPLE_COLUMNS]
    merged = merge_sources(sources)
    shards = shards and cut_shards(merged, TRIPLE_COLUMNS, shards)
    mixed = seeded_shuffle(numbered_copies(merged, keys), [*keys, "copy"], seed, shards)
    return write_verified(project_triple(mixed), path, expect_rows=total)
