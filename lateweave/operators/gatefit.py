"""Fitting the gate: features once, then one distributed gradient sum per step."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lateweave.functions.gate import Gate, gate_block, init_gate
from lateweave.functions.vectors import MASKED_SCORE, MIN_WEIGHT_SUM
from lateweave.operators.joins import HOT_ROWS, last_wins, left_join_hot
from lateweave.operators.scoring import Scratch, best_per_token, even_runs, token_rows
from lateweave.operators.tokens import DOCUMENT_LENGTH, QUERY_LENGTH, Encoder, embed_tokens
from lateweave.schemas import STEP_LOG, require_columns
from lateweave.session import scratch_path, write_scratch
from lateweave.sources import paths

# The training recipe.
LEARNING_RATE = 5e-4
CLIP_NORM = 1.0
MAX_STEPS = 3000
PIECE_BYTES = 16 << 20      # of a batch of vectors that is worked on at once
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


def align_triple(triples: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``(triple_id, q_toks, p_toks, n_toks)`` from ``(triple_id, qid, pos_id, neg_id)``.

    Equi joins on ids; a triple without all three vectors is dropped. Every join carries
    the vectors joined before it, so for fitting ``triple_features`` moves far less.
    """
    q = queries.select("qid", F.col("toks").alias("q_toks"))
    p = docs.select(F.col("doc_id").alias("pos_id"), F.col("toks").alias("p_toks"))
    n = docs.select(F.col("doc_id").alias("neg_id"), F.col("toks").alias("n_toks"))
    rows = triples
    for side, key in ((q, "qid"), (p, "pos_id"), (n, "neg_id")):
        rows = left_join_hot(rows, side, key, ["triple_id"], how="inner", count_on=triples)
    return rows.select("triple_id", "q_toks", "p_toks", "n_toks")


_VECTORS = "array<array<float>>"


def _best(q: np.ndarray, toks: np.ndarray, scratch: Scratch) -> np.ndarray:
    if not len(toks):
        return np.full(len(q), MASKED_SCORE)
    return best_per_token(toks, np.zeros(1, dtype=int), q, None, scratch)[0]


def _pieces(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``PIECE_BYTES`` of token vectors, at least one row each.

    Vectors become double and are multiplied, which takes several times the memory of a slice.
    """
    tokens = np.zeros(batch.num_rows, dtype="int64")
    for c in columns:
        tokens += pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    for lo, hi in even_runs(tokens, max(1, int(PIECE_BYTES * tokens.sum() / max(1, batch.nbytes)))):
        yield batch.slice(lo, hi - lo)


def _with_best(rows: DataFrame, keep: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Replace token columns by best matches: ``pairs`` maps output to (query, document).

    One row in, one row out, by Arrow batches.
    """
    used = sorted({c for pair in pairs.values() for c in pair} - set(keep))
    source = rows.select(*keep, *[F.col(c).cast(_VECTORS).alias(c) for c in used])
    schema = T.StructType([source.schema[c] for c in keep]
                          + [T.StructField(o, T.ArrayType(T.DoubleType())) for o in pairs])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch = Scratch("float64")
        vectors = sorted({c for pair in pairs.values() for c in pair})
        for batch in (piece for whole in batches for piece in _pieces(whole, vectors)):
            side = {}
            for c in vectors:
                toks, counts = token_rows(batch.column(c), "float64")
                side[c] = np.split(toks, np.cumsum(counts)[:-1])
            out = [pa.array([_best(q, d, scratch) for q, d in zip(side[a], side[b])],
                            pa.list_(pa.float64())) for a, b in pairs.values()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *out], names=[*keep, *pairs])

    return source.mapInArrow(run, schema)


def _minus(a: str, b: str) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def gate_features(aligned: DataFrame) -> DataFrame:
    """``(triple_id, q_toks, delta)``: per query token, best positive minus best negative match.

    For triples whose vectors are in the row already. The vectors are frozen, so this is
    all that fitting ever needs of the documents.
    """
    rows = aligned.withColumn("q_toks", F.col("q_toks").cast(_VECTORS))
    best = _with_best(rows, ["triple_id", "q_toks"],
                      {"_p": ("q_toks", "p_toks"), "_n": ("q_toks", "n_toks")})
    return best.select("triple_id", "q_toks", _minus("_p", "_n").alias("delta"))


def triple_features(triples: DataFrame, queries: DataFrame, docs: DataFrame,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same features from ids: ``(triple_id, qid, pos_id, neg_id)`` and two vector tables.

    Every distinct (query, document) pair is matched once, however many triples hold it, and leaves
    as one number per query token. A document's vectors are shuffled once to all its pairs; a
    document or query of very many pairs is salted. A triple without all three vectors is dropped.
    """
    sides = triples.select("triple_id", "qid", F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col("pos_id").alias("doc_id")),
        F.struct(F.lit(0).alias("side"), F.col("neg_id").alias("doc_id")))).alias("_s")).select(
        "triple_id", "qid", "_s.*")
    pair = ["qid", "doc_id"]
    pairs = write_scratch(sides.select(*pair).dropDuplicates(), "pairs")
    q = queries.select("qid", F.col("toks").cast(_VECTORS).alias("q_toks"))
    d = docs.select("doc_id", F.col("toks").alias("d_toks"))
    joined = left_join_hot(pairs, q, "qid", pair, hot_rows, how="inner")
    joined = left_join_hot(joined, d, "doc_id", pair, hot_rows, how="inner", count_on=pairs)
    best = _with_best(joined, pair, {"best": ("q_toks", "d_toks")})
    delta = (sides.join(best, pair).groupBy("triple_id")
             .agg(F.max_by("best", "side").alias("_p"), F.min_by("best", "side").alias("_n"),
                  F.first("qid").alias("qid"), F.count(F.lit(1)).alias("_sides"))
             .where(F.col("_sides") == 2).select("triple_id", "qid", _minus("_p", "_n").alias("delta")))
    return (left_join_hot(delta, q, "qid", ["triple_id"], hot_rows, how="inner", count_on=triples)
            .select("triple_id", "q_toks", "delta"))


def text_features(triples: DataFrame, query_encoder: Callable[[], Encoder], document_encoder: Callable[[], Encoder],
                  query_length: int = QUERY_LENGTH, document_length: int = DOCUMENT_LENGTH,
                  partitions: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same features from texts: ``(triple_id, query, positive, negative)`` and two encoders.

    Texts are known by their SHA-256. Each distinct query, and each distinct text that is a positive
    or a negative, is encoded once and written; the triples carry hashes only. NULL texts are
    empty ones, whose best match is that of a document without tokens.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("query", "positive", "negative")}
    key = {c: F.sha2(t.cast("binary"), 256) for c, t in text.items()}
    refs = write_scratch(triples.select("triple_id", key["query"].alias("qid"), key["positive"].alias("pos_id"),
                                        key["negative"].alias("neg_id")), "triples")
    queries = triples.select(key["query"].alias("qid"), text["query"].alias("text")).dropDuplicates(["qid"])
    docs = triples.select(F.explode(F.array(*[F.struct(key[c].alias("doc_id"), text[c].alias("text"))
                                              for c in ("positive", "negative")])).alias("_t")
                          ).select("_t.*").dropDuplicates(["doc_id"])
    q = write_scratch(embed_tokens(queries, query_encoder, ["qid"], max_tokens=query_length, partitions=partitions),
                      "query-vectors")
    d = write_scratch(embed_tokens(docs, document_encoder, ["doc_id"], max_tokens=document_length,
                                   partitions=partitions), "document-vectors")
    return triple_features(refs, q, d, hot_rows)


def logistic_loss(x: Column) -> Column:
    """``log(1 + exp(-x))`` without overflow: two-way cross entropy with the positive first."""
    return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def score_loss(scored: DataFrame, pos: str, neg: str) -> DataFrame:
    """One row: the mean loss of two score columns, and the number of rows."""
    x = F.col(pos) - F.col(neg)
    return scored.agg(F.avg(logistic_loss(x)).alias("loss"),
                      F.count(F.lit(1)).alias("n_triples"))


def pairwise_loss(features: DataFrame, gate: Gate, mode: str = "unnorm") -> DataFrame:
    """One row: the mean loss of a gate over triples and their number."""
    return (_named(_partial_sums(features, gate, mode), gate).where(F.col("param") == "loss")
            .select((F.col("total") / F.col("n")).alias("loss"), F.col("n").alias("n_triples")))


def _gradient_sums(q: np.ndarray, delta: np.ndarray, counts: np.ndarray, gate: Gate,
                   mode: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Summed gradients per parameter, the losses and the weights of one block of triples."""
    owner = np.repeat(np.arange(len(counts)), counts)
    w = gate_block(q, gate)
    x = np.bincount(owner, w * delta, minlength=len(counts))
    slope = delta
    if mode == "norm":
        sums = np.bincount(owner, w, minlength=len(counts))
        free = sums > MIN_WEIGHT_SUM        # a clamped sum is a constant
        scale = np.maximum(sums, MIN_WEIGHT_SUM)
        x = x / scale
        slope = (delta - (x * free)[owner]) / scale[owner]
    loss = np.maximum(-x, 0.0) + np.log1p(np.exp(-np.abs(x)))
    pull = -np.exp(-np.logaddexp(0.0, x))    # d loss / d x
    dz = pull[owner] * slope * w * (1.0 - w)
    if gate.w1:
        pre = q @ np.asarray(gate.w1).T + np.asarray(gate.b1)
        back = np.outer(dz, gate.w) * (pre > 0)
        grads = {"w": dz @ np.maximum(pre, 0.0), "b": dz.sum(keepdims=True),
                 "w1": (back.T @ q).ravel(), "b1": back.sum(axis=0)}
    else:
        grads = {"w": dz @ q, "b": dz.sum(keepdims=True)}
    return grads, loss, w


_SUMS = "share int, totals array<double>, low double, high double, n long"


def _parts(gate: Gate) -> list[tuple[str, int]]:
    """The gradient's parts and their sizes, as they stand in an array of sums; then the loss and
    the moments of the weights."""
    sizes = [("w", len(gate.w)), ("b", 1)]
    if gate.w1:
        sizes += [("w1", sum(map(len, gate.w1))), ("b1", len(gate.b1))]
    return [*sizes, ("loss", 1), ("moments", 3)]


def _added(rows: DataFrame, keep_share: bool) -> DataFrame:
    """Element-wise sums of the arrays that meet in a task, one row for each."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high, n, share = None, np.inf, -np.inf, 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.column("totals")[row].values.to_numpy()
                total = part.copy() if total is None else total + part
            if batch.num_rows:
                share = batch.column("share")[0].as_py()
                low = min(low, *batch.column("low").to_pylist())
                high = max(high, *batch.column("high").to_pylist())
                n += sum(batch.column("n").to_pylist())
        if total is not None:
            yield _sum_row(share if keep_share else 0, total, low, high, n)
    return rows.mapInArrow(run, _SUMS)


def _sum_row(share: int, total: np.ndarray, low: float, high: float, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([share], pa.int32()), pa.array([total], pa.list_(pa.float64())), pa.array([low], pa.float64()),
        pa.array([high], pa.float64()), pa.array([n], pa.int64())], names=["share", "totals", "low", "high", "n"])


def _partial_sums(features: DataFrame, gate: Gate, mode: str) -> DataFrame:
    """One row: an array of the sums of ``_parts`` over all triples, the weights' bounds, the triples.

    Every task adds up its triples in one array. On a cluster of many cores the arrays of some tasks
    meet in a first merge, so that the last one does not read the arrays of all others.
    """
    centre = float(1.0 / (1.0 + np.exp(-gate.b)))
    names = [name for name, _ in _parts(gate)]
    shares = max(1, math.isqrt(features.sparkSession.sparkContext.defaultParallelism) // 2)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high, rows = None, np.inf, -np.inf, 0
        for batch in (piece for whole in batches for piece in _pieces(whole, ["q_toks"])):
            q, counts = token_rows(batch.column("q_toks"), "float64")
            if not len(q):
                continue
            delta = batch.column("delta").flatten().to_numpy(zero_copy_only=False)
            parts, loss, w = _gradient_sums(q, delta, counts, gate, mode)
            off = w - centre
            parts.update(loss=loss.sum(keepdims=True),
                         moments=np.array([len(w), off.sum(), (off * off).sum()]))
            flat = np.concatenate([parts[name] for name in names])
            total = flat if total is None else total + flat
            low, high, rows = min(low, w.min()), max(high, w.max()), rows + batch.num_rows
        if rows:
            yield _sum_row(TaskContext.get().partitionId() % shares, total, low, high, rows)

    each = features.select("q_toks", "delta").mapInArrow(run, _SUMS)
    if shares > 1:
        each = _added(each.repartitionById(shares, "share"), True)
    return _added(each.repartition(1), False)


def _named(sums: DataFrame, gate: Gate) -> DataFrame:
    """``(param, idx, total, n)``: the array of sums, one row per element."""
    sizes = _parts(gate)
    name = [p for p, size in sizes for _ in range(size)]
    place = [i for _, size in sizes for i in range(size)]
    return sums.select("n", F.posexplode("totals").alias("_i", "total")).select(
        F.element_at(F.lit(name), F.col("_i") + 1).alias("param"),
        F.element_at(F.lit(place), F.col("_i") + 1).cast("int").alias("idx"), "total", "n")


def gate_gradient(features: DataFrame, gate: Gate, mode: str = "unnorm") -> DataFrame:
    """``(param, idx, grad)``: gradient of the mean loss for every gate parameter."""
    return (_named(_partial_sums(features, gate, mode), gate).where(~F.col("param").isin("loss", "moments"))
            .select("param", "idx", (F.col("total") / F.col("n")).alias("grad")))


def _flat(gate: Gate) -> np.ndarray:
    return np.concatenate([np.ravel(gate.w), [gate.b], np.ravel(gate.w1), np.ravel(gate.b1)])


def _unflat(theta: np.ndarray, like: Gate) -> Gate:
    sizes = np.cumsum([len(like.w), 1, len(like.b1) * like.in_features if like.w1 else 0])
    w, b, w1, b1 = np.split(theta, sizes)
    return Gate(w.tolist(), float(b[0]),
                w1.reshape(-1, like.in_features).tolist() if like.w1 else [], b1.tolist())


def fit_gate(features: DataFrame, gate: Gate | None = None, dim: int | None = None,
             steps: int = MAX_STEPS, batches: int = 1, lr: float = LEARNING_RATE,
             mode: str = "unnorm", log_path: str | None = None,
             save_steps: int = 0, on_save=None, run: str = "") -> tuple[Gate, list[dict]]:
    """Fit the gate with AdamW (no weight decay) and a gradient norm clipped at 1.

    The features are written once, in ``batches`` folders by a hash of the triple id, below the
    shared checkpoint folder; each step reads one folder (a single batch is cached) and brings
    back one array of sums. A batch is a large share of the table rather than a handful of
    rows: that changes the optimiser's path but not its objective. Returns the gate and the step
    log; ``log_path`` also adds it to a table under the name ``run``, every ``save_steps`` steps
    (or at the end), where ``on_save(step, gate)`` runs too.
    """
    spark = features.sparkSession
    path = scratch_path(spark, "gate-features")
    digits = F.substring(F.md5(F.col("triple_id").cast("string").cast("binary")), 1, 7)
    batched = features.withColumn("batch", (F.conv(digits, 16, 10).cast("long") % batches).cast("int"))
    if batches > 1:     # few files per batch folder, and no batch in a single task
        per_batch = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches)
        batched = batched.repartition("batch", F.pmod(F.xxhash64(F.lit(1), "triple_id"),
                                                      F.lit(per_batch)))
    try:
        batched.write.partitionBy("batch").parquet(path)
        return _fit_batches(features, path, gate, dim, steps, batches, lr, mode, log_path, save_steps, on_save,
                            run)
    finally:
        paths.delete(spark, path)


def _fit_batches(features: DataFrame, path: str, gate: Gate | None, dim: int | None, steps: int,
                 batches: int, lr: float, mode: str, log_path: str | None, save_steps: int,
                 on_save, run: str) -> tuple[Gate, list[dict]]:
    """The steps of ``fit_gate`` over the folders ``batch=i`` below ``path``."""
    spark = features.sparkSession
    folders = [f"{path}/batch={i}" for i in range(batches)]
    parts = [spark.read.schema(features.schema).parquet(f) if paths.exists(spark, f) else None for f in folders]
    if batches == 1 and parts[0] is not None:
        parts[0] = parts[0].persist(StorageLevel.MEMORY_AND_DISK)
    if gate is None:
        some = next((p for p in parts if p is not None), None)
        dim = dim or (some.select(F.size(F.get("q_toks", F.lit(0)))).first()[0] if some is not None else None)
        if dim is None:
            raise ValueError("no features to fit; pass a gate or dim")
        gate = init_gate(dim)
    theta = _flat(gate)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    log: list[dict] = []
    unsaved: list[dict] = []
    for step in range(1, steps + 1):
        part = parts[(step - 1) % batches]
        sums = [] if part is None else _partial_sums(part, gate, mode).collect()
        if not sums:
            continue
        n = sums[0]["n"]
        total = np.array(sums[0]["totals"])
        grad = total[:len(theta)] / n
        grad *= min(1.0, CLIP_NORM / (np.sqrt((grad * grad).sum()) + 1e-6))
        entry = _log_entry(step, total[len(theta):], sums[0], n, gate.b)
        log.append(entry)
        unsaved.append(entry)
        m = BETA1 * m + (1 - BETA1) * grad
        v = BETA2 * v + (1 - BETA2) * grad * grad
        theta = theta - lr * (m / (1 - BETA1 ** step)) / (np.sqrt(v / (1 - BETA2 ** step)) + EPSILON)
        gate = _unflat(theta, gate)
        if save_steps and step % save_steps == 0:
            if on_save:
                on_save(step, gate)
            if log_path:
                append_step_log(spark, unsaved, log_path, run)
                unsaved = []
    if batches == 1 and parts[0] is not None:
        parts[0].unpersist()
    if log_path and unsaved:
        append_step_log(spark, unsaved, log_path, run)
    return gate, log


def _log_entry(step: int, got: np.ndarray, bounds, n: int, b: float) -> dict:
    """Loss before the step, and the weights over the whole batch (sample deviation)."""
    loss, count, shift, square = got.tolist()
    var = max(0.0, square - shift * shift / count) / (count - 1) if count > 1 else float("nan")
    return {"step": step, "loss": loss / n,
            "head_w_mean": float(1.0 / (1.0 + np.exp(-b))) + shift / count,
            "head_w_std": float(np.sqrt(var)),
            "head_w_min": bounds["low"], "head_w_max": bounds["high"]}


def append_step_log(spark, entries: list[dict], path: str, run: str = "") -> None:
    """Add step rows of a run to the long-lived log table.

    Nothing is rewritten: every call adds a file, and of rows with the same run and step the one
    written last counts (``read_step_log``). So a portion that is written again after a failure, or by
    a run that was resumed from an earlier step, replaces its rows.
    """
    rows = spark.createDataFrame([{**e, "run": run} for e in entries], STEP_LOG)
    append_steps(rows.drop("written").coalesce(1), path)


def append_steps(rows: DataFrame, path: str) -> None:
    """The same for a table of steps with their runs, as one portion."""
    columns = [c for c in STEP_LOG.fieldNames() if c != "written"]
    (require_columns(rows, columns, "step log").select(*columns, F.lit(time.time_ns()).alias("written"))
     .write.mode("append").parquet(path))


def read_step_log(spark, path: str) -> DataFrame:
    """The log table, one row per run and step: the one written last."""
    rows = spark.read.schema(STEP_LOG).parquet(path) if paths.exists(spark, path) else (
        spark.createDataFrame([], STEP_LOG))
    return last_wins(rows, ["run", "step"], [F.col("written"), F.struct(*[
        c for c in rows.columns if c not in ("run", "step", "written")])]).drop("written")
