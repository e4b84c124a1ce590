"""Token vector tables: long form ``(id, pos, v)`` and packed form ``(id, toks)``."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateweave.functions.gate import Gate, gate_block
from lateweave.functions.text import null_to_empty
from lateweave.functions.vectors import as_double
from lateweave.session import bounded_batches

# Default token caps per side, and the tolerances of the drift check.
QUERY_LENGTH = 256
DOCUMENT_LENGTH = 2048
MAX_HEAD_DRIFT = 5e-2
MIN_TAIL = 1e-4

# Texts are encoded in batches of so many tokens with padding, as estimated by their bytes, and
# batches are made of the texts of a window.
BATCH_TOKENS = 16_384
WINDOW_TOKENS = 65_536
TOKEN_BYTES = 4

Encoder = Callable[..., Sequence[np.ndarray]]


def truncate_tokens(tokens: DataFrame, max_len: int | Column, pos: str = "pos") -> DataFrame:
    """Cap a long table at ``max_len`` tokens per text; may be a column, e.g. per split."""
    return tokens.where(F.col(pos) < max_len)


def truncate_packed(packed: DataFrame, max_len: int | Column, toks: str = "toks") -> DataFrame:
    """Cap a packed table at ``max_len`` tokens per text."""
    n = F.lit(max_len) if isinstance(max_len, int) else max_len
    return packed.withColumn(toks, F.slice(F.col(toks), F.lit(1), n))


def pack_tokens(tokens: DataFrame, by: list[str], extra: list[str] | None = None,
                max_len: int | None = None) -> DataFrame:
    """Long to packed form; all tokens of a text, or at most ``max_len`` where the caller says so.

    ``extra`` columns (a mask, a weight) are packed in the same token order.
    """
    columns = {"toks": "v", **{c: c for c in extra or []}}
    # One list per column, so that a reader of one column does not shuffle the others.
    lists = [F.sort_array(F.collect_list(F.struct("pos", c))).alias(out)
             for out, c in columns.items()]
    # A field of an array of structs is the array of that field.
    kept = tokens if max_len is None else truncate_tokens(tokens, max_len)
    return kept.groupBy(*by).agg(*lists).select(
        *by, *[F.col(f"{out}.{c}").alias(out) for out, c in columns.items()])


def unpack_tokens(packed: DataFrame, by: list[str]) -> DataFrame:
    """Packed to long form, one row per token."""
    return packed.select(*by, F.posexplode("toks").alias("pos", "v"))


def vector_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """``[T, D]`` arrays to one ``array<array<float>>`` column, without Python lists."""
    counts = [len(a) for a in arrays]
    flat = [np.asarray(a, dtype="float32") for a in arrays if len(a)]
    width = flat[0].shape[1] if flat else 0
    values = np.concatenate(flat).ravel() if flat else np.empty(0, dtype="float32")
    if len(values) >= 1 << 31:
        raise ValueError(f"{sum(counts)} vectors of {width} values are too many for one Arrow batch")
    vectors = pa.ListArray.from_arrays(
        pa.array(np.arange(sum(counts) + 1) * width, pa.int32()), pa.array(values))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), vectors)


def token_batches(tokens: np.ndarray, budget: int = BATCH_TOKENS, most: int | None = None) -> list[np.ndarray]:
    """Rows of similar length together: number times longest is at most ``budget``, or one row."""
    order, out, start = np.argsort(tokens, kind="stable"), [], 0
    for i in range(len(order) + 1):
        n = i - start
        if n and (i == len(order) or (n + 1) * tokens[order[i]] > budget or n == most):
            out.append(order[start:i])
            start = i
    return out


def _windows(tokens: np.ndarray, budget: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``budget`` tokens, at least one row each."""
    ends, start = np.cumsum(tokens), 0
    while start < len(tokens):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
        yield start, stop
        start = stop


def embed_tokens(texts: DataFrame, make_encoder: Callable[[], Encoder], id_cols: list[str],
                 text_col: str = "text", max_tokens: int | None = None,
                 batch_size: int | None = None, partitions: int | None = None,
                 gate: Gate | None = None, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Texts to packed token vectors with a user's encoder, in Arrow batches, no shuffle.

    ``make_encoder`` runs once per task and returns a function from a list of texts to
    one ``[T, D]`` array each; it should cache a heavy model itself, so that a reused
    Python worker loads it once. ``max_tokens`` is the length limit; a function that has a
    parameter of this name is given it, so that it does not encode what is cut off.
    Batches hold texts of similar length, ``batch_tokens`` estimated tokens with padding
    (and ``batch_size`` texts at most); rows come out in the order in which they came.
    ``partitions`` first spreads the texts of a small or badly split table over more tasks.
    Arrow batches of texts are bounded by bytes in the session (``bounded_batches``).
    With a ``gate`` each token's weight comes along as ``w``, for the query side.
    """
    bounded_batches(texts.sparkSession)
    source = texts.select(*id_cols, null_to_empty(F.col(text_col).cast("string")).alias("_text"))
    if partitions:
        source = source.repartition(partitions, *id_cols)
    schema = T.StructType(
        [texts.schema[c] for c in id_cols]
        + [T.StructField("toks", T.ArrayType(T.ArrayType(T.FloatType())))]
        + ([T.StructField("w", T.ArrayType(T.DoubleType()))] if gate else []))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make_encoder()
        limited = max_tokens is not None and "max_tokens" in inspect.signature(encoder).parameters
        limit = {"max_tokens": max_tokens} if limited else {}
        for batch in batches:
            size = pc.binary_length(batch.column("_text")).to_numpy(zero_copy_only=False)
            tokens = np.minimum(size // TOKEN_BYTES + 1, max_tokens or size.max(initial=0) + 1)
            for start, stop in _windows(tokens, WINDOW_TOKENS):
                part = batch.slice(start, stop - start)
                words, toks = part.column("_text").to_pylist(), [None] * part.num_rows
                for rows in token_batches(tokens[start:stop], batch_tokens, batch_size):
                    for i, vectors in zip(rows.tolist(), encoder([words[i] for i in rows.tolist()], **limit)):
                        toks[i] = vectors[:max_tokens]
                columns = [*(part.column(c) for c in id_cols), vector_lists(toks)]
                if gate:
                    weights = [gate_block(np.asarray(e, dtype="float32"), gate) for e in toks]
                    columns.append(pa.array(weights, pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return source.mapInArrow(encode, schema)


def embedding_drift(old: DataFrame, new: DataFrame, max_head: float = MAX_HEAD_DRIFT,
                    min_tail: float = MIN_TAIL) -> DataFrame:
    """Compare two versions of token vectors, the second one possibly wider.

    Per text: the greatest change on the old dimensions, the greatest absolute value on
    the added ones (0 when there are none), and whether both are within bounds. A token that
    only one version has, or whose new vector is the shorter one, makes the text not ok.
    """
    o = old.select("id", "pos", as_double(F.col("v")).alias("o"))
    n = new.select("id", "pos", as_double(F.col("v")).alias("n"))
    width = F.size("o")
    head = F.array_max(F.zip_with(F.slice("n", F.lit(1), width), "o", lambda a, b: F.abs(a - b)))
    added = F.slice("n", width + 1, F.greatest(F.size("n") - width, F.lit(0)))
    tail = F.coalesce(F.array_max(F.transform(added, F.abs)), F.lit(0.0))
    alike = F.coalesce(F.size("n") >= width, F.lit(False)) & F.col("o").isNotNull() & F.col("n").isNotNull()
    within = (F.col("head_drift") <= max_head) & (F.col("tail_max") >= min_tail)
    return (o.join(n, ["id", "pos"], "full")
            .groupBy("id").agg(F.max(F.when(alike, head)).alias("head_drift"),
                               F.max(F.when(alike, tail)).alias("tail_max"), F.min(alike).alias("_alike"))
            .withColumn("ok", F.col("_alike") & F.coalesce(within, F.lit(False))).drop("_alike"))
