"""Removal of passages that an earlier document holds, after a count-min prefilter.

A window is a run of ``window`` consecutive words of one document. To find the repeated ones without
sending all of them around, a count-min sketch counts them first. Windows are counted by their
anchor: of the shorter word runs inside a window the one with the smallest hash. Equal windows have
equal anchors, and neighbouring windows mostly share theirs, so the sketch holds about one entry for
13 words and what it says of an anchor is never below the number of documents with the window.

1. Every task sketches its documents; the sketches are merged by slices.
2. The second pass marks the windows whose anchor is estimated to be in two documents or more, and
   the documents without any are done. Neighbouring windows with one anchor are a run. Runs are
   grouped by their words: one whose words an earlier document has as a run is covered as a whole.
   What is left to compare are anchors with runs of different words; there the first run of each
   kind is taken apart into its windows, which are grouped by their words.
3. Words covered by a window that starts in a document with a smaller id go.

The sketch grows with the text up to ``sketch_bytes``. Beyond that it marks more windows than need
be, and the exact groups of runs (one for 13 words) do the work: nothing is lost at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateweave.llm.common import discard, materialize

WINDOW = 50
ANCHOR = 25
DEPTH = 2
CELLS = 12                    # cells of the sketch for each expected anchor
SKETCH_BYTES = 64 << 20       # two bits a cell: seen once, seen again
SLICE_CELLS = 1 << 19
SLICE_BYTES = 2_000_000       # bytes of text handled at a time; a longer text is a slice of its own
BLOCK_BYTES = 500_000         # bytes of text hashed at a time
LONG_WORD = 1 << 16           # a word of more bytes is hashed alone
TASK_BYTES = 64 << 20         # text that a task reads, about

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True  # fixed values: space and tab to carriage return


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def byte_slices(batches: Iterator[pa.RecordBatch], budget: int = SLICE_BYTES):
    """Slices of bounded text: the batch, its text bytes, and where each text begins and ends in them."""
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        start = 0
        while start < len(texts):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + budget, side="right")) - 1)
            yield (batch.slice(start, stop - start), data[offsets[start]:offsets[stop]],
                   offsets[start:stop + 1] - offsets[start])
            start = stop


def _hash_block(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each word of a block; the words are ``data[starts:ends]``."""
    length = ends - starts
    edge = np.cumsum(length) - length
    inside = np.arange(int(length.sum())) - np.repeat(edge, length)
    letters = data[np.repeat(starts, length) + inside].astype(np.uint64) + np.uint64(1)
    out = []
    for lane in _LANES:
        powers = np.cumprod(np.full(int(length.max()), lane | np.uint64(1)))
        out.append(_mix(np.add.reduceat(letters * powers[inside], edge) + length.astype(np.uint64) * lane))
    return out


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every word, and how many words each text has; text by blocks."""
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = ~space[firsts]
    ends = ~space
    ends[:-1] &= space[1:]
    lasts = offsets[1:][np.diff(offsets) > 0] - 1
    ends[lasts] = ~space[lasts]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    out = np.zeros((2, len(starts)), dtype=np.uint64)
    long = stops - starts > LONG_WORD
    for i in np.flatnonzero(long).tolist():
        whole = xxhash.xxh3_128_intdigest(data[starts[i]:stops[i]].tobytes())
        out[:, i] = whole & (1 << 64) - 1, whole >> 64
    short, i = np.flatnonzero(~long), 0
    while i < len(short):
        j = max(i + 1, int(np.searchsorted(starts[short], starts[short[i]] + BLOCK_BYTES)))
        out[:, short[i:j]] = _hash_block(data, starts[short[i:j]], stops[short[i:j]])
        i = j
    return out[0], out[1], counts


def run_hashes(words: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A hash of the ``size`` words that start at each place, put together from runs of 1, 2, 4 ... words."""
    total = max(len(words) - size + 1, 0)
    out, done, part, width = np.zeros(total, dtype=np.uint64), 0, words, 1
    while done < size and total:
        if size & width:
            out = _mix(out * _LANES[lane] + part[done:done + total] + np.uint64(width))
            done += width
        if 2 * width <= size:
            part = _mix(part[:-width] * _LANES[1 - lane] + part[width:])
        width *= 2
    return out


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest value of the ``size`` that start at each place."""
    width, part = 1, values
    while 2 * width <= size:
        part = np.minimum(part[:-width], part[width:])
        width *= 2
    return np.minimum(part[:len(values) - size + 1], part[size - width:]) if size > width else part


def anchors(words: np.ndarray, window: int = WINDOW, size: int = ANCHOR) -> np.ndarray:
    """The anchor of the window at each place."""
    if len(words) < window:
        return np.zeros(0, dtype=np.uint64)
    return _least(run_hashes(words, size), window - size + 1)


class Sketch:
    """Count-min sketch whose cells say "once" and "again"; a count above two is as good as two."""

    def __init__(self, cells: int, depth: int = DEPTH):
        self.row = max(cells // depth // SLICE_CELLS, 1) * SLICE_CELLS
        self.depth = depth
        self.once = np.zeros(self.row * depth // 8, dtype=np.uint8)
        self.again = np.zeros_like(self.once)

    def places(self, keys: np.ndarray, row: int) -> np.ndarray:
        h = _mix(keys * _LANES[row % 2] + np.uint64(row + 1))
        return (h % np.uint64(self.row)).astype(np.int64) + row * self.row

    def add(self, keys: np.ndarray) -> None:
        """Count every one of ``keys``; one that stands there twice counts twice."""
        if not len(keys):
            return
        for row in range(self.depth):
            place, n = np.unique(self.places(keys, row), return_counts=True)
            bit = np.left_shift(1, place & 7).astype(np.uint8)
            first = np.flatnonzero(np.diff(place >> 3, prepend=-1))
            at = (place >> 3)[first]
            seen = np.bitwise_or.reduceat(bit, first)
            many = np.bitwise_or.reduceat(np.where(n > 1, bit, 0).astype(np.uint8), first)
            self.again[at] |= many | (self.once[at] & seen)
            self.once[at] |= seen

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        """Whether the estimate, the smallest cell of a key, is above one."""
        out = np.ones(len(keys), dtype=bool)
        for row in range(self.depth):
            place = self.places(keys, row)
            out &= (self.again[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        return out

    def slices(self) -> Iterator[tuple[int, bytes]]:
        """The slices that are not empty, packed."""
        step = SLICE_CELLS // 8
        for i in range(len(self.once) // step):
            once = self.once[i * step:(i + 1) * step]
            if once.any():
                yield i, pack(once, self.again[i * step:(i + 1) * step])

    def put(self, i: int, once: np.ndarray, again: np.ndarray) -> None:
        step = SLICE_CELLS // 8
        self.once[i * step:(i + 1) * step] = once
        self.again[i * step:(i + 1) * step] = again


def pack(once: np.ndarray, again: np.ndarray) -> bytes:
    return zlib.compress(once.tobytes() + again.tobytes(), 1)


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
    return both[:len(both) // 2].copy(), both[len(both) // 2:].copy()


def _merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """One row per slice and key: the sketches of many tasks added up, one after another."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in keys]
            for key, raw in zip(zip(*names), batch.column("cells")):
                once, again = unpack(raw.as_py())
                if key in held:
                    a, b = held[key]
                    b |= again | (a & once)
                    a |= once
                else:
                    held[key] = (once, again)
        for key, (once, again) in held.items():
            yield pa.RecordBatch.from_pydict(
                {**{c: pa.array([v], pa.int32()) for c, v in zip(keys, key)}, "cells": pa.array([pack(once, again)])})

    schema = ", ".join(f"{c} int" for c in keys) + ", cells binary"
    return sketches.repartition(*keys).mapInArrow(merge, schema)


def sketch_windows(docs: DataFrame, cells: int, size: int, window: int = WINDOW, anchor: int = ANCHOR) -> Sketch:
    """The merged sketch of the anchors of all documents (``size`` bytes of text), each counted once
    in a document. What reaches the driver is bounded by the cells.

    Tasks' sketches are merged in two steps, first by slice and share of the tasks, so that no task
    reads the slices of all others.
    """
    shape = Sketch(cells)
    tasks = max(1, int(np.sqrt(size / TASK_BYTES)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Sketch(cells)
        for _, data, offsets in byte_slices(batches):
            words, _, counts = hash_words(data, offsets)
            edges = np.concatenate([[0], np.cumsum(counts)])
            found = [np.unique(anchors(words[a:b], window, anchor)) for a, b in zip(edges, edges[1:])]
            mine.add(np.concatenate(found or [np.zeros(0, dtype=np.uint64)]))
        share = TaskContext.get().partitionId() % tasks
        for i, raw in mine.slices():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "share": pa.array([share], pa.int32()),
                                              "cells": pa.array([raw])})

    parts = docs.select("text").mapInArrow(sketch, "slice int, share int, cells binary")
    if tasks > 1:
        parts = _merged(parts, "slice", "share")
    for r in _merged(parts.drop("share"), "slice").collect():
        shape.put(r["slice"], *unpack(bytes(r["cells"])))
    return shape


def _runs(sketch: Sketch, a: np.ndarray, b: np.ndarray, window: int, anchor: int) -> list[dict] | None:
    """Runs of marked windows with one anchor: the anchor, the first window, how many, and the words.

    No run is longer than a window, so that its first and last window have all its words between
    them; their hashes and the number of windows stand for the words.
    """
    keys = anchors(a, window, anchor)
    if not len(keys):
        return None
    starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
    # A run of one anchor over and over again (equal words) is cut before it outgrows a window.
    size = np.diff(np.concatenate([starts, [len(keys)]]))
    pieces = -(-size // window)
    inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = np.repeat(starts, pieces) + inside * window
    size = np.diff(np.concatenate([starts, [len(keys)]]))
    keep = sketch.repeated(keys[starts])
    if not keep.any():
        return None
    starts, size = starts[keep], size[keep]
    sides = []
    for lane, words in enumerate((a, b)):
        h = run_hashes(words, window, lane)
        sides.append(_mix(_mix(h[starts] + size.astype(np.uint64)) * _LANES[lane] + h[starts + size - 1]).view(np.int64))
    return [{"anchor": k, "first": f, "n": n, "s1": x, "s2": y} for k, f, n, x, y in zip(
        keys[starts].view(np.int64).tolist(), starts.tolist(), size.tolist(), sides[0].tolist(), sides[1].tolist())]


RUN = pa.struct([("anchor", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("s1", pa.int64()),
                 ("s2", pa.int64())])


def _marked(docs: DataFrame, shared, window: int, anchor: int) -> DataFrame:
    """Every row with its words joined by single spaces and its runs of marked windows."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, row = shared.value, TaskContext.get().partitionId() << 33
        for batch, data, offsets in byte_slices(batches):
            a, b, counts = hash_words(data, offsets)
            edges = np.concatenate([[0], np.cumsum(counts)])
            known = batch.column("doc_id").is_valid().to_pylist()
            texts = [b" ".join(data[x:y].tobytes().split()).decode() for x, y in zip(offsets, offsets[1:])]
            runs = [_runs(sketch, a[x:y], b[x:y], window, anchor) if k else None
                    for k, x, y in zip(known, edges, edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(texts))), batch.column("doc_id"), pa.array(counts, pa.int64()),
                 pa.array(texts, pa.string()), pa.array(runs, pa.list_(RUN))],
                names=["row", "doc_id", "n_words", "words", "runs"])
            row += len(texts)

    return docs.mapInArrow(mark, "row bigint, doc_id bigint, n_words bigint, words string, "
                                 "runs array<struct<anchor:bigint,first:int,n:int,s1:bigint,s2:bigint>>")


def _windows(todo: DataFrame, window: int) -> DataFrame:
    """row, doc_id, at, k1, k2: the windows of the runs, told apart by 128 bits of their words."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in byte_slices(batches):
            a, b, counts = hash_words(data, offsets)
            edges = np.concatenate([[0], np.cumsum(counts)])
            runs = batch.column("runs").to_pylist()
            at = [np.unique(np.concatenate([np.arange(r["first"], r["first"] + r["n"]) for r in x])) for x in runs]
            keys = [[run_hashes(lane[s:e], window, k)[p] for p, s, e in zip(at, edges, edges[1:])]
                    for k, lane in enumerate((a, b))]
            which = pa.array(np.repeat(np.arange(len(at)), [len(x) for x in at]))
            for start in range(0, len(which), 1 << 18):
                part = slice(start, start + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(which[part]), batch.column("doc_id").take(which[part]),
                     pa.array(np.concatenate(at)[part], pa.int32()),
                     *(pa.array(np.concatenate(k)[part].view(np.int64)) for k in keys)],
                    names=["row", "doc_id", "at", "k1", "k2"])

    return (todo.select("row", "doc_id", F.col("words").alias("text"), "runs")
            .mapInArrow(emit, "row bigint, doc_id bigint, at int, k1 bigint, k2 bigint"))


def _cut(window: int):
    """A function of rows with the places of their covered windows (first, number): what goes, what stays."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("first", pa.int32()), ("n", pa.int32())])
        for batch in batches:
            kept, removed, gone = [], [], []
            for text, n, at in zip(batch.column("words"), batch.column("n_words").to_pylist(), batch.column("at")):
                first, number = (x.to_numpy() for x in at.values.flatten())
                edge = np.zeros(n + 1, dtype=np.int32)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + number - 1 + window, -1)
                hidden = np.cumsum(edge[:-1]) > 0
                words = text.as_py().split(" ")
                kept.append(" ".join([w for w, h in zip(words, hidden.tolist()) if not h]))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hidden, [0]])))
                removed.append([{"first": int(f), "n": int(e - f)} for f, e in zip(edges[::2], edges[1::2])])
                gone.append(int(hidden.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(gone, pa.int64()),
                 pa.array(removed, pa.list_(span)), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    return cut


def drop_repeated_passages(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, cells: int = CELLS,
                           sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, removed, kept for every row.

    Words are runs of anything but space and U+0009 to U+000D, unchanged. A word goes if a window
    of ``window`` words covers it whose words also stand, as a window, in a row with a smaller
    ``doc_id``; all windows are judged on the input. ``removed`` holds the runs of words that go
    (first word, number), ``kept`` the other words joined by single spaces.

    NULL and empty texts have no words. A row without an id keeps its words and takes none from
    others. Rows that repeat an id take nothing from each other. An empty table gives no rows;
    extra columns are ignored.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor has at least one word and no more than a window")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About six bytes a word; anchors change every (window - anchor + 2) / 2 words.
    expected = size / 6 * 2 / (window - anchor + 2)
    sketch = sketch_windows(docs.filter("doc_id IS NOT NULL"), int(min(cells * expected, sketch_bytes * 4)), size,
                            window, anchor)
    shared = spark.sparkContext.broadcast(sketch)
    rows = materialize(_marked(docs, shared, window, anchor), "marked")
    shared.unpersist()

    # A copy of a whole text is covered by the one with the smallest id, which stands for it in what follows.
    slim = materialize(rows.filter("runs IS NOT NULL").select(
        "row", "doc_id", F.unhex(F.sha2(F.col("words").cast("binary"), 256)).alias("sha"), "runs"), "slim")
    first = materialize(slim.groupBy(F.col("sha").alias("f_sha")).agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first")
    named = slim.join(first, F.col("sha") == F.col("f_sha"), "left").select(
        "row", "doc_id", (F.coalesce("first_id", "doc_id") < F.col("doc_id")).alias("copy"), "runs")
    named = materialize(named, "named")
    marked = materialize(named.filter("NOT copy").select("row", "doc_id", F.explode("runs").alias("run"))
                         .select("row", "doc_id", "run.*"), "runs")
    spans = materialize(marked.groupBy(F.col("s1").alias("g1"), F.col("s2").alias("g2")).agg(
        F.min("doc_id").alias("low"), F.first("anchor").alias("of")), "spans")
    # Equal windows have equal anchors: an anchor with runs of the same words only has nothing to compare.
    mixed = materialize(spans.groupBy(F.col("of").alias("m_of")).agg(F.count(F.lit(1)).alias("m"))
                        .filter("m > 1").select("m_of"), "mixed")
    kinds = materialize(spans.join(mixed, F.col("of") == F.col("m_of"), "left").select(
        "g1", "g2", "low", F.col("m_of").isNotNull().alias("mixed")), "kinds")
    judged = materialize(
        marked.join(kinds, (F.col("s1") == F.col("g1")) & (F.col("s2") == F.col("g2")))
        .filter("doc_id > low OR mixed").select("row", "first", "n", (F.col("doc_id") > F.col("low")).alias("covered")),
        "judged")
    discard(marked)
    left = judged.filter("NOT covered").groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("runs"))
    texts = rows.filter("runs IS NOT NULL").drop("runs")
    todo = materialize(texts.join(left, "row"), "todo")
    windows = materialize(_windows(todo, window), "windows")
    discard(todo)
    owners = materialize(windows.groupBy(F.col("k1").alias("o1"), F.col("k2").alias("o2")).agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("o1", "o2", "low"), "owners")
    hits = (windows.join(owners, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")))
            .filter("doc_id > low").select("row", F.col("at").alias("first"), F.lit(1).alias("n")))
    places = materialize(hits.unionByName(judged.filter("covered").select("row", "first", "n"))
                         .groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("at")), "places")
    discard(windows)
    discard(owners)
    cut = materialize(texts.join(places, "row").select("row", "doc_id", "n_words", "words", "at"), "hits")
    done = cut.drop("row").mapInArrow(
        _cut(window), "doc_id bigint, n_words bigint, n_removed bigint, removed array<struct<first:int,n:int>>, kept string")
    copies = named.filter("copy").select("row")
    whole = texts.join(copies, "row", "left_semi").select(
        "doc_id", "n_words", F.col("n_words").alias("n_removed"),
        F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("n"))).alias("removed"),
        F.lit("").alias("kept"))
    changed = materialize(copies.unionByName(cut.select("row")), "changed")
    none = F.array().cast("array<struct<first:int,n:int>>")
    as_is = (rows.filter("runs IS NULL").unionByName(
        rows.filter("runs IS NOT NULL").join(changed, "row", "left_anti"))
        .select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), none.alias("removed"),
                F.col("words").alias("kept")))
    for table in (slim, first, spans, mixed, kinds, judged, places):
        discard(table)
    return as_is.unionByName(whole).unionByName(done)
