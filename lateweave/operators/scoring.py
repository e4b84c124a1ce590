"""MaxSim of every query against every document of its split, cut to the top k.

The documents stay where their scan put them and are read once: no shuffle, no join, no row per
pair. A task gathers its Arrow batches into a chunk of bounded size and scores it against all
queries, block by block. A chunk holds each distinct vector once, with the documents it occurs in.
Of long documents only the vectors close to a query token are followed to their documents; what
else a document holds is bounded by that closeness, and what can be among the best by this bound is
scored exactly (``indexed_documents``). Short ones are multiplied out (``best_documents``). Queries that fit ``pass_bytes`` are broadcast; more of them are written
to a table below the shared checkpoint folder, whose files every task streams over for each chunk,
so a task holds one chunk of documents and one block of queries, however many there are.

Similarities are computed in single precision first. Documents that can be among a query's best k,
by a bound on the rounding errors, are scored again in double precision, and these scores count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateweave.functions.vectors import MASKED_SCORE, MIN_WEIGHT_SUM, all_seen
from lateweave.operators.ranking import QUERY_KEY, TOP_K, topk_per_query
from lateweave.schemas import require_columns
from lateweave.session import bounded_batches, scratch_path
from lateweave.sources import paths

QUERY_PASS_BYTES = 128 << 20    # query vectors in a broadcast or in a file of the query table
CHUNK_BYTES = 32 << 20          # distinct document vectors, places and best matches that a task holds
PIECE_BYTES = 8 << 20           # document vectors of an Arrow batch that are looked at together
DENSE_BYTES = 32 << 20          # document vectors that are multiplied out together
CANDIDATE_BYTES = 256 << 20     # best documents of the queries of one pass in one task
CANDIDATE_ROW_BYTES = 160
BLOCK_TOKENS = 1024
GUESSES = 8                     # documents from which the closeness is guessed that is followed up
LEAST_PLACES = 64               # distinct vectors of a document on average below which all is multiplied out
CLOSE_LIMIT = 1 << 20           # (vector, token) pairs held for a block
PLACES_AT_ONCE = 1 << 18
SINGLE = float(np.finfo("float32").eps)
MODES = ("plain", "norm", "unnorm")

# Decimals that count when scores are compared: matrix products of equal documents differ
# in the last bits with their place in a block, and copies should tie.
DECIMALS = {"float64": 10, "float32": 5}

_OUT = "split string, qid string, doc_id string, score double, grade double"


@dataclass
class QueryBlock:
    """Queries of one split, their token vectors stacked."""

    qids: np.ndarray
    toks: np.ndarray       # [T, D]
    weights: np.ndarray    # [T]
    starts: np.ndarray     # first token of each query
    divisors: np.ndarray   # one per query


def token_rows(col: pa.Array, dtype: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``array<array<float>>`` column to stacked vectors ``[T, D]`` and tokens per row.

    Without ``dtype`` in the precision in which they are stored. Vectors of unequal sizes raise.
    """
    counts = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    vectors = col.flatten()
    sizes = pc.min_max(pc.fill_null(pc.list_value_length(vectors), -1)).as_py()
    if sizes["min"] != sizes["max"]:
        raise ValueError(f"token vectors of unequal sizes: {sizes['min']} to {sizes['max']}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    flat = flat if dtype is None else flat.astype(dtype, copy=False)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0), counts


def _runs(counts: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` tokens, at least one row each."""
    start, total = 0, 0
    for i, n in enumerate(counts):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(counts) > start:
        yield start, len(counts)


def query_blocks(table: pa.Table, mode: str) -> dict[str, list[tuple]]:
    """Group the queries of one pass by split, in blocks of bounded tokens.

    Plain tuples of ``QueryBlock`` fields: a broadcast value must load without this package.
    """
    blocks: dict[str, list[tuple]] = {}
    table = table.sort_by([("split", "ascending"), ("qid", "ascending")]).combine_chunks()
    for split in pc.unique(table["split"]).to_pylist():
        part = table.filter(pc.equal(table["split"], split)).combine_chunks()
        toks, counts = token_rows(part["toks"].combine_chunks())
        weights = (np.ones(len(toks)) if mode == "plain" else
                   part["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
        if len(weights) != len(toks):
            raise ValueError("every query token needs one weight")
        qids = np.asarray(part["qid"].to_pylist(), dtype=object)
        ends = np.cumsum(counts)
        for lo, hi in _runs(counts, BLOCK_TOKENS):
            first = ends[lo] - counts[lo]
            n, vecs, w = counts[lo:hi], toks[first:ends[hi - 1]], weights[first:ends[hi - 1]]
            if (n == 0).any():     # a query without tokens sums to zero
                at = np.cumsum(n)[n == 0]
                vecs = np.insert(vecs, at, 0.0, axis=0)
                w, n = np.insert(w, at, 0.0), np.maximum(n, 1)
            starts = np.cumsum(n) - n
            sums = np.maximum(np.add.reduceat(w, starts), MIN_WEIGHT_SUM)
            divisors = sums if mode == "norm" else np.ones(len(n))
            blocks.setdefault(split, []).append(
                (qids[lo:hi], vecs, w.astype("float64"), starts, divisors))
    return blocks


class Scratch:
    """One similarity buffer per task; fresh large arrays would cost more than the products."""

    def __init__(self, dtype: str) -> None:
        self.flat = np.empty(0, dtype=dtype)

    def shaped(self, rows: int, cols: int) -> np.ndarray:
        if len(self.flat) < rows * cols:
            self.flat = np.empty(rows * cols, dtype=self.flat.dtype)
        return self.flat[:rows * cols].reshape(rows, cols)


def best_per_token(docs: np.ndarray, starts: np.ndarray, queries: np.ndarray,
                   hidden: np.ndarray | None, scratch: Scratch) -> np.ndarray:
    """``[documents, query tokens]``: each query token's best match in each document.

    Several documents together hold at most ``BLOCK_TOKENS`` tokens; a longer single
    document, like a longer query, is worked through in blocks of that size.
    """
    best = np.full((len(starts), len(queries)), -np.inf, dtype=docs.dtype)
    if not queries.shape[1]:    # a block of queries without tokens
        return np.zeros_like(best)
    ends = [*starts[1:], len(docs)]
    for q0 in range(0, len(queries), BLOCK_TOKENS):
        q = queries[q0:q0 + BLOCK_TOKENS]
        found = best[:, q0:q0 + len(q)]
        for d0 in range(0, len(docs), BLOCK_TOKENS):
            d = docs[d0:d0 + BLOCK_TOKENS]
            sims = np.matmul(d, q.T, out=scratch.shaped(len(d), len(q)))
            if hidden is not None:
                sims[hidden[d0:d0 + len(d)]] = MASKED_SCORE
            if len(starts) == 1:
                np.maximum(found[0], sims.max(axis=0), out=found[0])
                continue
            # One reduction per document is about ten times faster than maximum.reduceat.
            for row, lo, hi in zip(found, starts, ends):
                np.maximum.reduce(sims[lo:hi], axis=0, out=row)
    return best


@dataclass
class Chunk:
    """Documents of one split, their token vectors stacked as they are stored."""

    ids: pa.Array
    toks: np.ndarray       # [T, D]
    starts: np.ndarray     # first token of each document
    counts: np.ndarray     # tokens of each document, at least one
    hidden: np.ndarray     # per token


def numbered(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that stand for the distinct ones, and for each row the place of its like among them."""
    if not vectors.size:
        return np.arange(min(1, len(vectors))), np.zeros(len(vectors), dtype="int64")
    words = np.ascontiguousarray(vectors).view("uint32").reshape(len(vectors), -1)
    odd = np.random.default_rng(words.shape[1]).integers(1 << 62, size=words.shape[1], dtype="uint64") * 2 + 1
    key = np.zeros(len(words), dtype="uint64")
    for word, factor in zip(words.T, odd):
        key = (key ^ (key >> np.uint64(29))) * factor + word
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    other = np.zeros(len(words), dtype=bool)
    for i in range(0, len(words), 1 << 16):
        part = slice(i, i + (1 << 16))
        other[part] = (words[first[same[part]]] != words[part]).any(axis=1)
    alone = np.flatnonzero(other)       # equal keys, other vectors: each counts as distinct
    same[alone] = len(first) + np.arange(len(alone))
    return np.concatenate([first, alone]), same


@dataclass
class DocIndex:
    """Documents of one split: their distinct vectors, and which of them each document holds."""

    ids: pa.Array
    toks: np.ndarray       # [V, D], distinct
    places: np.ndarray     # numbers of vectors, document by document, none twice in one
    counts: np.ndarray     # places of each document
    hidden: np.ndarray     # per document, whether it has a hidden token or none at all

    @property
    def nbytes(self) -> int:
        return self.toks.nbytes + 12 * len(self.places) + 4 * BLOCK_TOKENS * len(self.counts)

    def holders(self) -> Holders:
        docs = np.repeat(np.arange(len(self.counts)), self.counts)
        return Holders(self.places, docs, len(self.toks), len(self.counts))


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.Table]:
    """The rows of a batch in tables of at most ``limit`` bytes of vectors, at least one row each."""
    toks = batch.column("toks")
    counts = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
    vectors = toks.flatten()
    values = vectors.flatten()
    one = len(values) * values.type.bit_width // 8 / max(1, len(vectors))
    for lo, hi in even_runs(counts, max(1, int(limit / max(1, one)))):
        yield pa.Table.from_batches([batch.slice(lo, hi - lo)])


def doc_index(rows: pa.Table) -> DocIndex:
    """The index of one piece of a batch."""
    rows = rows.combine_chunks()
    toks, counts = token_rows(rows.column("toks").combine_chunks())
    doc = np.repeat(np.arange(len(counts)), counts)
    hidden = counts == 0
    if "mask" in rows.schema.names:
        seen = pc.fill_null(rows.column("mask").combine_chunks().flatten(), False).to_numpy(zero_copy_only=False)
        hidden[doc[~seen]] = True
        toks, doc = toks[seen], doc[seen]
    kept, same = numbered(toks)
    pairs = np.sort(doc * max(1, len(kept)) + same)
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])[:len(pairs)]]
    doc, places = np.divmod(pairs, max(1, len(kept)))
    return DocIndex(rows.column("doc_id").combine_chunks(), toks[kept], places.astype("int32"),
                    np.bincount(doc, minlength=len(counts)), hidden)


def joined_index(parts: list[DocIndex]) -> DocIndex:
    """One index of the documents of several."""
    full = [p.toks for p in parts if len(p.toks)]
    if len({t.shape[1] for t in full}) > 1:
        raise ValueError(f"token vectors of unequal sizes: {sorted({t.shape[1] for t in full})}")
    toks = np.concatenate(full) if full else np.zeros((0, 0), dtype="float32")
    kept, same = numbered(toks)
    before = np.cumsum([0] + [len(p.toks) for p in parts])
    places = np.concatenate([same[p.places + n].astype("int32") for p, n in zip(parts, before)])
    return DocIndex(pa.concat_arrays([p.ids for p in parts]), toks[kept], places,
                    np.concatenate([p.counts for p in parts]), np.concatenate([p.hidden for p in parts]))


def dense_chunks(index: DocIndex, dim: int) -> Iterator[Chunk]:
    """The documents with their vectors written out, in chunks of bounded size."""
    toks = index.toks if len(index.toks) else np.zeros((0, dim), dtype="float32")
    ends = np.cumsum(index.counts)
    for lo, hi in _runs(index.counts, max(1, DENSE_BYTES // max(1, toks.itemsize * toks.shape[1]))):
        counts, extra = index.counts[lo:hi], index.hidden[lo:hi]
        rows = toks[index.places[ends[lo] - index.counts[lo]:ends[hi - 1]]]
        at = np.cumsum(counts)[extra]       # one hidden token stands for all of a document
        rows, hidden = np.insert(rows, at, 0.0, axis=0), np.insert(np.zeros(len(rows), dtype=bool), at, True)
        counts = counts + extra
        yield Chunk(index.ids[lo:hi], rows, np.cumsum(counts) - counts, counts, hidden)


def _summed(best: np.ndarray, block: QueryBlock) -> np.ndarray:
    return np.add.reduceat(best * block.weights, block.starts, axis=1) / block.divisors


def single_scores(chunk: Chunk, block: QueryBlock, scratch: Scratch) -> np.ndarray:
    """``[documents, queries]`` with similarities in single precision."""
    queries = block.toks.astype("float32", copy=False)
    out = np.empty((len(chunk.counts), len(block.qids)))
    for lo, hi in _runs(chunk.counts, BLOCK_TOKENS):
        first, last = chunk.starts[lo], chunk.starts[hi - 1] + chunk.counts[hi - 1]
        toks = chunk.toks[first:last].astype("float32", copy=False)
        hidden = chunk.hidden[first:last]
        best = best_per_token(toks, chunk.starts[lo:hi] - first, queries, hidden if hidden.any() else None, scratch)
        out[lo:hi] = _summed(best.astype("float64"), block)
    return out


def rounding_bound(chunk: Chunk, block: QueryBlock) -> np.ndarray:
    """Per query, how far a score of ``single_scores`` can be from the one in double precision."""
    if not block.toks.shape[1]:
        return np.zeros(len(block.qids))
    lengths = np.sqrt(np.einsum("ij,ij->i", block.toks, block.toks, dtype="float64"))
    each = rounding_length(chunk.toks) * lengths
    return np.add.reduceat(each * np.abs(block.weights), block.starts) / block.divisors


def double_scores(chunk: Chunk, block: QueryBlock, wanted: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Scores of the ``wanted`` pairs ``[documents, queries]`` in double precision, in row order."""
    out = []
    ends = np.append(block.starts[1:], len(block.toks))
    queries = block.toks.astype("float64", copy=False)
    for d in np.flatnonzero(wanted.any(axis=1)):
        q = np.flatnonzero(wanted[d])
        first, last = chunk.starts[d], chunk.starts[d] + chunk.counts[d]
        hidden = chunk.hidden[first:last]
        sizes = ends[q] - block.starts[q]
        at = np.repeat(block.starts[q] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        best = best_per_token(chunk.toks[first:last].astype("float64", copy=False), np.zeros(1, dtype=int),
                              queries[at], hidden if hidden.any() else None, scratch)[0]
        out.append(np.add.reduceat(best * block.weights[at], np.cumsum(sizes) - sizes) / block.divisors[q])
    return np.concatenate(out) if out else np.zeros(0)


def _may_be_best(scores: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Which documents can be among a query's best ``k`` if scores are off by ``slack`` at most."""
    if len(scores) <= k:
        return np.ones(scores.shape, dtype=bool)
    known = np.where(np.isnan(scores), -np.inf, scores)
    kth = np.partition(known, len(scores) - k, axis=0)[len(scores) - k]
    return ~(scores < kth - 2 * slack)


def best_documents(chunk: Chunk, block: QueryBlock, k: int, dtype: str, single: Scratch,
                   double: Scratch) -> pa.Table:
    """The best ``k`` documents of a chunk for every query: q, grade, score, doc_id.

    Documents compare by ``grade``, the score as a whole number of its last decimal; ties go to the
    smaller document id.
    """
    unit = 10.0 ** DECIMALS[dtype]
    scores = single_scores(chunk, block, single)
    if dtype == "float32":
        wanted = _may_be_best(np.rint(scores * unit), k, np.zeros(len(block.qids)))
        found = scores[wanted]
    else:
        wanted = _may_be_best(scores, k, rounding_bound(chunk, block) + 1 / unit)
        found = double_scores(chunk, block, wanted, double)
    return _cut(chunk.ids, *np.nonzero(wanted), found, unit, k)


def _cut(ids: pa.Array, d: np.ndarray, q: np.ndarray, found: np.ndarray, unit: float, k: int) -> pa.Table:
    rows = pa.table({"q": q, "grade": np.rint(found * unit), "score": found, "doc_id": ids.take(pa.array(d))})
    rows = rows.take(pc.sort_indices(rows, sort_keys=[
        ("q", "ascending"), ("grade", "descending"), ("doc_id", "ascending")]))
    q = rows["q"].to_numpy()
    return rows.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < k))


class Holders:
    """The documents that hold each vector, of all documents of an index or of some."""

    def __init__(self, places: np.ndarray, docs: np.ndarray, vectors: int, documents: int) -> None:
        pairs = places.astype("int64")
        pairs *= documents
        pairs += docs
        pairs.sort()
        pairs %= documents
        self.ends = np.cumsum(np.bincount(places, minlength=vectors))
        self.docs = pairs.astype("int32")

    def of(self, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each place in ``vectors`` with each holder of the vector named there."""
        stop = self.ends[vectors]
        count = stop - np.where(vectors > 0, self.ends[vectors - 1], 0)
        found = np.flatnonzero(count)
        count, start = count[found], stop[found] - count[found]
        for lo, hi in even_runs(count, PLACES_AT_ONCE):
            n = count[lo:hi]
            at = np.repeat(start[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield np.repeat(found[lo:hi], n), self.docs[at].astype("int64")


class Close:
    """The document vectors that are close to the tokens of one block of queries.

    ``level`` is the closeness per distinct token: pairs at or above it are held, in single precision.
    It is the least of the best matches of some long documents, since it's those that others have to
    beat. ``best`` ``[documents, distinct tokens]`` is a document's best match, or the value just below
    the level where none of its vectors is that close, which is then a bound.
    """

    def __init__(self, index: DocIndex, holders: Holders, guesses: np.ndarray, block: QueryBlock,
                 scratch: Scratch, double: Scratch) -> None:
        kept, self.column = numbered(block.toks)
        self.index, self.block, self.double = index, block, double
        self.queries = block.toks[kept]
        single = self.queries.astype("float32", copy=False)
        lengths = np.sqrt(np.einsum("ij,ij->i", self.queries, self.queries, dtype="float64"))
        self.error = rounding_length(index.toks) * lengths
        self.ends = np.cumsum(index.counts)
        self.level = np.full(len(single), np.inf, dtype="float32")
        for i in guesses:
            best = best_per_token(self._toks(i).astype("float32", copy=False), np.zeros(1, dtype=int), single,
                                  None, scratch)
            np.minimum(self.level, best[0], out=self.level)
        np.maximum(self.level, np.float32(MASKED_SCORE), out=self.level)
        self._collect(single, scratch)
        below = np.nextafter(self.level, np.float32(-np.inf))
        self.sure = below + 2 * self.error
        self.best = np.empty((len(index.counts), len(single)), dtype="float32")
        self.best[:] = below
        self.best[index.counts == 0] = MASKED_SCORE
        for pair, doc in holders.of(self.vector):
            np.maximum.at(self.best.reshape(-1), doc * len(single) + self.token[pair], self.sim[pair])

    def _toks(self, doc: int) -> np.ndarray:
        """A document's distinct vectors."""
        return self.index.toks[self.index.places[self.ends[doc] - self.index.counts[doc]:self.ends[doc]]]

    def _collect(self, single: np.ndarray, scratch: Scratch) -> None:
        """The pairs (vector, token) at or above the level, which rises where they are too many."""
        toks, held, number = self.index.toks, [], 0
        step = max(1, BLOCK_TOKENS // 2)
        for lo in range(0, len(toks), step):
            part = toks[lo:lo + step].astype("float32", copy=False)
            sims = np.matmul(part, single.T, out=scratch.shaped(len(part), len(single)))
            at = np.flatnonzero(sims >= self.level)
            v, c = np.divmod(at, len(single))
            held.append(((v + lo).astype("int32"), c.astype("int32"), sims.reshape(-1)[at]))
            number += len(at)
            if number > CLOSE_LIMIT:
                top = self.level.copy()
                for _, c, sim in held:
                    np.maximum.at(top, c, sim)
                self.level = np.maximum(self.level, (self.level + top) / 2)
                held = [self._at_level(*part) for part in held]
                number = sum(len(v) for v, _, _ in held)
        held = [self._at_level(*part) for part in held]
        self.vector, self.token, self.sim = (np.concatenate(x) for x in zip(*held))

    def _at_level(self, v: np.ndarray, c: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, ...]:
        keep = sim >= self.level[c]
        return v[keep], c[keep], sim[keep]

    def bounds(self) -> np.ndarray:
        """``[documents, queries]``: no score in single precision is larger."""
        weights = np.zeros((len(self.queries), len(self.block.qids)))
        owner = np.searchsorted(self.block.starts, np.arange(len(self.column)), side="right") - 1
        np.add.at(weights, (self.column, owner), self.block.weights / self.block.divisors[owner])
        self.member = np.zeros(weights.shape, dtype="float32")
        self.member[self.column, owner] = 1
        return np.concatenate([self.best[i:i + BLOCK_TOKENS].astype("float64") @ weights
                               for i in range(0, len(self.best), BLOCK_TOKENS)])

    def exact(self, wanted: np.ndarray) -> np.ndarray:
        """Scores of the ``wanted`` pairs ``[documents, queries]`` in double precision, in row order."""
        docs = np.flatnonzero(wanted.any(axis=1))
        return np.concatenate([np.zeros(0)] + [self._exact(docs[i:i + BLOCK_TOKENS], wanted)
                                               for i in range(0, len(docs), BLOCK_TOKENS)])

    def _exact(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        index, block, width = self.index, self.block, len(self.queries)
        need = wanted[docs].astype("float32") @ self.member.T > 0
        best = self.best[docs]
        known = need & (best >= self.sure)
        near = np.where(known, best - 2 * self.error, np.inf)
        out = np.full(need.shape, -np.inf)
        out[index.hidden[docs]] = MASKED_SCORE
        sizes, ends = index.counts[docs], self.ends[docs]
        at = np.repeat(ends - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
        some = Holders(index.places[at], np.repeat(np.arange(len(docs)), sizes), len(index.toks), len(docs))
        for pair, doc in some.of(self.vector):
            at = doc * width + self.token[pair]
            keep = self.sim[pair] >= near.reshape(-1)[at]
            pair, at = pair[keep], at[keep]
            for i in range(0, len(pair), PLACES_AT_ONCE // 16):
                part = pair[i:i + PLACES_AT_ONCE // 16]
                sims = np.einsum("ij,ij->i", index.toks[self.vector[part]], self.queries[self.token[part]],
                                 dtype="float64")
                np.maximum.at(out.reshape(-1), at[i:i + PLACES_AT_ONCE // 16], sims)
        missing = need & ~known
        for i in np.flatnonzero(missing.any(axis=1)):      # no vector of the document is close enough
            tokens = np.flatnonzero(missing[i])
            best = best_per_token(self._toks(docs[i]).astype("float64", copy=False), np.zeros(1, dtype=int),
                                  self.queries[tokens].astype("float64", copy=False), None, self.double)
            out[i, tokens] = np.maximum(out[i, tokens], best[0])
        best = np.where(need, out, 0.0)[:, self.column]
        return _summed(best, block)[wanted[docs]]


def even_runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """``_runs`` for very many small sizes."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def rounding_length(toks: np.ndarray) -> float:
    """How far an inner product in single precision can be off, for a query token of length one."""
    longest = np.sqrt(np.einsum("ij,ij->i", toks, toks, dtype="float64").max(initial=0.0))
    return (toks.shape[1] + 4) * SINGLE * longest


def long_documents(index: DocIndex, k: int) -> np.ndarray | None:
    """Some of the ``k`` longest documents, or None where it's better to multiply all out.

    That is so with short documents and with vectors that are not finite.
    """
    if len(index.places) < LEAST_PLACES * len(index.counts):
        return None
    if not all(np.isfinite(index.toks[i:i + (1 << 16)]).all() for i in range(0, len(index.toks), 1 << 16)):
        return None
    longest = np.argsort(-index.counts, kind="stable")[:k]
    longest = longest[index.counts[longest] > 0]
    return longest[np.unique(np.linspace(0, len(longest) - 1, GUESSES).astype("int64"))]


def indexable(block: QueryBlock) -> bool:
    """A bound of each best match bounds the score: no weight is negative, all values are finite."""
    return bool(block.toks.shape[1] and (block.weights >= 0).all() and np.isfinite(block.toks).all()
                and np.isfinite(block.weights).all())


def indexed_documents(index: DocIndex, holders: Holders, guesses: np.ndarray, block: QueryBlock, k: int,
                      known: np.ndarray, single: Scratch, double: Scratch) -> pa.Table:
    """What ``best_documents`` gives, for long documents; same scores, fewer products.

    ``known`` ``[queries, k]`` holds the best grades of the task so far, in ascending order, and is
    brought up to date. Documents that can't be among the task's best ``k`` are left out.
    """
    unit = 10.0 ** DECIMALS["float64"]
    close = Close(index, holders, guesses, block, single, double)
    bounds = close.bounds()
    slack = 2 * rounding_bound(index, block) + 2 / unit
    first = bounds >= known[:, 0] / unit - slack
    if len(bounds) > k:
        kth = np.partition(bounds, len(bounds) - k, axis=0)[len(bounds) - k]
        first &= bounds >= kth
    found = [(*np.nonzero(first), close.exact(first))]
    _remember(known, *found[0][1:], unit)
    rest = (bounds >= known[:, 0] / unit - slack) & ~first
    found.append((*np.nonzero(rest), close.exact(rest)))
    _remember(known, *found[1][1:], unit)
    d, q, scores = (np.concatenate(x) for x in zip(*found))
    good = np.rint(scores * unit) >= known[q, 0]
    return _cut(index.ids, d[good], q[good], scores[good], unit, k)


def _remember(known: np.ndarray, q: np.ndarray, scores: np.ndarray, unit: float) -> None:
    """Add new grades to the best known ones."""
    order = np.argsort(q, kind="stable")
    q, grades = q[order], np.rint(scores[order] * unit)
    for i in np.unique(q):
        lo, hi = np.searchsorted(q, [i, i + 1])
        known[i] = np.sort(np.concatenate([known[i], grades[lo:hi]]))[-known.shape[1]:]


def _local_topk(passes: Callable[[], Iterable[dict[str, list[tuple]]]], k: int, dtype: str, chunk_bytes: int,
                remember: bool = False):
    """``passes()`` gives the query blocks of one pass after another; with ``remember`` the task keeps
    the best grades of all queries from chunk to chunk."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = Scratch("float32"), Scratch("float64")
        grades: dict[tuple[str, int], np.ndarray] = {}

        def scored(held: dict[str, list[DocIndex]]) -> Iterator[pa.RecordBatch]:
            indexes = {}
            for blocks in passes():
                for split, of_split in blocks.items():
                    if split not in held and split not in indexes:
                        continue
                    of_split = [QueryBlock(*b) for b in of_split]
                    if split not in indexes:
                        index = joined_index(held.pop(split))
                        guesses = long_documents(index, k) if dtype == "float64" else None
                        indexes[split] = index, guesses, None if guesses is None else index.holders()
                    index, guesses, holders = indexes[split]
                    for i, block in enumerate(of_split):
                        if guesses is not None and indexable(block):
                            known = grades.get((split, i), np.full((len(block.qids), k), -np.inf))
                            if remember:
                                grades[split, i] = known
                            tables = [indexed_documents(index, holders, guesses, block, k, known, single, double)]
                        else:
                            dim = max(b.toks.shape[1] for b in of_split)
                            tables = (best_documents(chunk, block, k, dtype, single, double)
                                      for chunk in dense_chunks(index, dim))
                        for rows in tables:
                            out = pa.table({
                                "split": pa.array([split] * rows.num_rows, pa.string()),
                                "qid": pa.array(block.qids[rows["q"].to_numpy()], pa.string()),
                                "doc_id": rows["doc_id"].cast(pa.string()),
                                "score": rows["score"], "grade": rows["grade"]})
                            yield from out.combine_chunks().to_batches()

        held, size = {}, 0
        for batch in batches:
            for table in pieces(batch):
                for split in pc.unique(table["split"]).to_pylist():
                    part = doc_index(table.filter(pc.equal(table["split"], split)))
                    if held and size + part.nbytes > chunk_bytes:
                        yield from scored(held)
                        held, size = {}, 0
                    held.setdefault(split, []).append(part)
                    size += part.nbytes
        if held:
            yield from scored(held)
    return run


def _stored_passes(files: list[list[str]], mode: str) -> Callable[[], Iterable[dict[str, list[tuple]]]]:
    """The passes of a written query table, read one after another; ``files`` by pass."""
    def passes() -> Iterator[dict[str, list[tuple]]]:
        for of_pass in files:
            tables = []
            for uri in of_pass:
                store, path = paths.arrow_location(uri)
                with store.open_input_file(path) as source:
                    tables.append(pq.read_table(source))
            yield query_blocks(pa.concat_tables(tables), mode)
    return passes


def _passes(queries: DataFrame, k: int, pass_bytes: int, itemsize: int) -> tuple[DataFrame, int]:
    """Give every query a pass number such that no pass exceeds its two bounds.

    One is ``pass_bytes`` of query vectors, the other what a task may hold of candidates.
    """
    most = max(1, CANDIDATE_BYTES // (k * CANDIDATE_ROW_BYTES))
    one = (F.size("toks").cast("long") * itemsize
           * F.coalesce(F.size(F.get("toks", F.lit(0))), F.lit(0)))
    sized = queries.withColumn("_bytes", one)
    total, largest, rows = sized.agg(F.sum("_bytes"), F.max("_bytes"), F.count(F.lit(1))).first()
    if (largest or 0) > pass_bytes:
        raise ValueError(f"one query holds {largest} bytes, more than a pass of {pass_bytes}; "
                         "truncate its tokens or raise pass_bytes")
    n = max(1, math.ceil((total or 0) / pass_bytes), math.ceil(rows / most))
    while True:
        numbered = sized.withColumn("_pass", F.pmod(F.xxhash64(*QUERY_KEY), F.lit(n)).cast("int"))
        if n == 1:
            return numbered, n
        widest, fullest = (numbered.groupBy("_pass")
                           .agg(F.sum("_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
                           .agg(F.max("b"), F.max("n")).first())
        if widest <= pass_bytes and fullest <= most:
            return numbered, n
        n += max(1, n // 2)


def score_topk(queries: DataFrame, docs: DataFrame, k: int = TOP_K, mode: str = "plain",
               dtype: str = "float64", pass_bytes: int = QUERY_PASS_BYTES,
               partitions: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Exact top ``k`` documents per query: ``(split, qid, doc_id, score, rank)``.

    ``queries``: ``split, qid, toks`` and, unless ``mode`` is plain, ``w`` per token.
    ``docs``: ``split, doc_id, toks`` and optionally a boolean ``mask`` per token (false
    tokens score -1e4, as does a document without tokens; a NULL mask hides nothing). ``mode``: ``plain`` sums the
    best matches, ``unnorm`` weights them, ``norm`` also divides by the weight sum.

    Queries are measured first. Up to ``pass_bytes`` of vectors are broadcast; more are written
    to the shared checkpoint folder in passes of that size, and every task reads these files one
    by one for each chunk of documents. Either way ``docs`` is read once, by the one job that the
    result is part of. A task holds ``chunk_bytes`` of documents, one pass, ``k`` rows per
    query of a block, and of broadcast queries ``k`` grades each. The query table stays until ``session.clear_scratch``.
    Arrow batches are bounded by bytes in the session (``bounded_batches``).
    ``partitions`` spreads a small document table over more tasks. Scores that agree to
    ``DECIMALS`` tie and go by ``doc_id``. ``dtype="float32"`` keeps the scores of single precision.
    """
    if mode not in MODES:
        raise ValueError(f"unknown score mode {mode!r}")
    spark = queries.sparkSession
    bounded_batches(spark)
    cols = [*QUERY_KEY, "toks"] + ([] if mode == "plain" else ["w"])
    queries = require_columns(queries, cols, "query table").select(*cols)
    mask = [all_seen(F.col("mask"), F.col("toks")).alias("mask")] if "mask" in docs.columns else []
    docs = require_columns(docs, ["split", "doc_id", "toks"], "document table").select(
        "split", F.col("doc_id").cast("string").alias("doc_id"), "toks", *mask)
    if partitions:
        docs = docs.repartition(partitions, "doc_id")

    queries = queries.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        numbered, n = _passes(queries, k, pass_bytes, np.dtype(dtype).itemsize)
        if n == 1:
            shared = spark.sparkContext.broadcast(query_blocks(numbered.select(*cols).toArrow(), mode))
            passes = _one_pass(shared)
        else:
            table = scratch_path(spark, "queries")
            numbered.select("_pass", *cols).repartitionById(n, "_pass").write.partitionBy("_pass").parquet(table)
            files = [[f for f in paths.children(spark, f"{table}/_pass={i}") if f.endswith(".parquet")] for i in range(n)]
            paths.arrow_location(table)     # raises here, not in a task, where Arrow can't open the store
            passes = _stored_passes([f for f in files if f], mode)
    finally:
        queries.unpersist()
    local = docs.mapInArrow(_local_topk(passes, k, dtype, chunk_bytes, n == 1), _OUT)
    return topk_per_query(local, k, by="grade").drop("grade")


def _one_pass(shared) -> Callable[[], Iterable[dict[str, list[tuple]]]]:
    return lambda: [shared.value]
