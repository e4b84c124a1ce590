"""Sequence packing as a cutting-stock problem.

Documents are cut at multiples of the sequence length; full pieces fill a sequence alone. The rest
pieces are counted by length class. A linear program over patterns (which classes share a
sequence) is solved by column generation: a knapsack over the current dual prices proposes the
next pattern until none pays. Patterns are rounded down, what is left over is packed by best fit,
and the pieces, ranked within their class, take the slots of the patterns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lateweave.llm.bpe import ChunkEncoder
from lateweave.llm.common import invert, materialize, text_slices

PIECES = ("doc_id bigint, start bigint, length int, ids_crc32 bigint, doc_tokens bigint, "
          "class int, part int, nth bigint")
FULL = 0  # class of the pieces that fill a sequence


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, length: int, granule: int) -> DataFrame:
    """One row per piece, numbered within its class and task."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = ChunkEncoder.of_process(tokenizer_path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(-(-length // granule) + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4")
        for batch, texts in text_slices(batches):
            flat, counts = encode(texts)
            at, rows, crcs = 0, [], []
            for i, n in enumerate(counts.tolist()):
                ids = np.concatenate([flat[at:at + n], end]).astype("<u4")
                at += n
                for start in range(0, n + 1, length):
                    piece = ids[start:start + length]
                    rows.append((i, start, len(piece), n + 1))
                    crcs.append(zlib.crc32(piece.tobytes()))
            row = np.array(rows, dtype=np.int64).reshape(-1, 4)
            kind = np.where(row[:, 2] == length, FULL, -(-row[:, 2] // granule))
            nth = pd.Series(kind).groupby(kind).cumcount().to_numpy() + seen[kind]
            seen += np.bincount(kind, minlength=len(seen))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(row[:, 0])), "start": row[:, 1],
                "length": row[:, 2].astype(np.int32), "ids_crc32": np.array(crcs, dtype=np.int64),
                "doc_tokens": row[:, 3], "class": kind.astype(np.int32),
                "part": np.full(len(row), part, dtype=np.int32), "nth": nth})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


def _price(values: np.ndarray, sizes: np.ndarray, back: list[np.ndarray]) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pattern of largest value that fits the capacity.

    ``sizes`` rise; ``back[room]`` is the room that is left after each size that fits.
    """
    best, take = np.zeros(len(back)), np.full(len(back), -1)
    for room, rest in enumerate(back):
        if len(rest):
            gain = best[rest] + values[:len(rest)]
            i = gain.argmax()
            if gain[i] > best[room - 1]:
                best[room], take[room] = gain[i], i
            else:
                best[room] = best[room - 1]
    pattern = np.zeros(len(sizes), dtype=np.int64)
    room = len(back) - 1
    while room > 0:
        if take[room] < 0:
            room -= 1
        else:
            pattern[take[room]] += 1
            room -= sizes[take[room]]
    return float(best[-1]), pattern


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", matrix, vector)


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3,
                   rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation for the linear relaxation: patterns (rows) and how often each is used.

    Stops when no pattern pays, when the dual bound is within ``gap`` of the solution, or when as
    many steps as there are classes have not improved it (degenerate steps of small demands).
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)  # columns are patterns
    inverse = np.diag(1.0 / np.diag(basis))
    amount = _times(inverse, demand)
    best, since = np.inf, 0
    least = float((sizes * demand).sum()) / capacity
    back = [room - sizes[:np.searchsorted(sizes, room, side="right")] for room in range(capacity + 1)]
    for step in range(rounds):
        if amount.sum() < best * (1 - 1e-5):
            best, since = amount.sum(), step
        elif step - since > m:
            break
        prices = inverse.sum(axis=0)
        value, pattern = _price(np.maximum(prices, 0.0), sizes, back)
        if value <= 1 + 1e-9 or amount.sum() - max(least, amount.sum() / value) <= gap * amount.sum():
            break
        change = _times(inverse, pattern)
        rows = change > 1e-9
        if not rows.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rows] = amount[rows] / change[rows]
        out = int(np.argmin(ratio))
        basis[:, out] = pattern
        if step % 64 == 63:
            inverse = invert(basis)
        else:
            pivot = inverse[out] / change[out]
            inverse -= change[:, None] * pivot
            inverse[out] = pivot
        amount = np.maximum(_times(inverse, demand), 0.0)
    return basis.T.round().astype(np.int64), amount


def _best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Largest class first into each open pattern until nothing fits; all of ``left`` is placed."""
    left, patterns = left.copy(), []
    order = np.argsort(-sizes)
    while left.any():
        room, pattern = capacity, np.zeros(len(sizes), dtype=np.int64)
        for i in order:
            n = min(int(left[i]), room // int(sizes[i]))
            pattern[i] += n
            left[i] -= n
            room -= n * int(sizes[i])
        times = int(np.min((left[pattern > 0] // pattern[pattern > 0]))) + 1
        left -= pattern * (times - 1)
        patterns.append((pattern, times))
    return patterns


def plan_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) pairs that hold every piece counted in ``demand`` exactly once."""
    if not len(sizes):
        return []
    patterns, amount = solve_patterns(sizes, demand, capacity)
    left, plan = demand.copy(), []
    for i in np.argsort(-amount, kind="stable"):
        use = patterns[i] > 0
        times = int(min(np.floor(amount[i] + 1e-9), (left[use] // patterns[i][use]).min()))
        if times > 0:
            plan.append((patterns[i], times))
            left = left - times * patterns[i]
    return plan + _best_fit(sizes, left, capacity)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, length: int = 2048,
                   granule: int = 8) -> DataFrame:
    """Every id of every document in exactly one piece, pieces in sequences of ``length`` tokens.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. NULL and empty texts
    give the end id alone. Rows that repeat an id are packed apart, NULL ids stay NULL, an empty
    table gives no rows, extra columns are ignored. Only counts per length class reach the
    driver, ``length / granule`` of them.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, end_id, length, granule), "pieces")
    by_part = materialize(pieces.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["class"]: r["n"] for r in by_part.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    kinds = np.array(sorted(k for k in counts if k != FULL), dtype=np.int64)
    plan = plan_patterns(kinds, np.array([counts[k] for k in kinds], dtype=np.int64), length // granule)

    # Slots of each class: where a pattern's share begins, its pieces per sequence, its first sequence.
    slots: dict[int, list] = {int(k): [] for k in kinds}
    taken, first = dict.fromkeys(slots, 0), counts.get(FULL, 0)
    for pattern, times in plan:
        place = 0
        for i in np.flatnonzero(pattern):
            k, each = int(kinds[i]), int(pattern[i])
            slots[k].append((taken[k], each, first, place))
            taken[k] += each * times
            place += each
        first += times
    tables = {k: np.array(v, dtype=np.int64).reshape(-1, 4) for k, v in slots.items()}

    @F.pandas_udf("sequence_id bigint, slot bigint")
    def seat(kind: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, slot = rank.to_numpy(copy=True), np.zeros(len(rank), dtype=np.int64)
        kind = kind.to_numpy()
        for k in np.unique(kind):
            if k != FULL:
                here = np.flatnonzero(kind == k)
                table, r = tables[int(k)], rank.to_numpy()[here]
                row = table[np.searchsorted(table[:, 0], r, side="right") - 1]
                sequence[here] = row[:, 2] + (r - row[:, 0]) // row[:, 1]
                slot[here] = row[:, 3] + (r - row[:, 0]) % row[:, 1]
        return pd.DataFrame({"sequence_id": sequence, "slot": slot})

    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    seated = (pieces.join(bases, ["class", "part"])
              .withColumn("seat", seat("class", F.col("nth") + F.col("base"))))
    inside = (Window.partitionBy("sequence_id").orderBy("slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (seated.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                          "doc_tokens", "seat.sequence_id", "seat.slot")
            .withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slot"))
