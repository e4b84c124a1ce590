"""Toxic spans by a linear-chain conditional random field over words.

Labels are per document, so tokens are labelled first: a word (or word beginning) that occurs in
toxic documents far more often than chance explains marks its tokens in toxic training documents.
The field has two tags with transition weights; emissions are hashed features of the word, its
beginnings and its neighbours. Forward-backward marginals give the spans, and a logistic curve over
the strongest and the summed marginals gives the document's score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateweave.llm.common import discard, held_out, invert, keep_rows, materialize, text_slices

WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 17
KINDS = 3  # the word itself, its first five and its first four letters
# The bounded sample: about so many labelled rows of each label, by hash of the text.
SAMPLE_PER_LABEL = 800
# Words of the sample that reach the driver; longer samples are cut by whole documents.
SAMPLE_WORDS = 1_000_000
THRESHOLD = 0.3


def word_features(word: str) -> tuple[int, int, int]:
    return (xxhash.xxh32_intdigest(word) % BUCKETS, xxhash.xxh32_intdigest("5" + word[:5]) % BUCKETS,
            xxhash.xxh32_intdigest("4" + word[:4]) % BUCKETS)


class Words:
    """Numbers words and keeps the hashed features of each."""

    def __init__(self):
        self.seen: dict[str, int] = {}
        self.features: list[tuple[int, int, int]] = []

    def numbers(self, words: list[str]) -> list[int]:
        out, seen = [], self.seen
        for w in words:
            i = seen.get(w)
            if i is None:
                i = seen[w] = len(seen)
                self.features.append(word_features(w))
            out.append(i)
        return out


@dataclass
class Field:
    """Log-odds parameters: emissions of tag 1 against tag 0, and three transition weights."""

    here: np.ndarray    # BUCKETS, for the token's own features
    before: np.ndarray  # BUCKETS, for the previous word
    after: np.ndarray   # BUCKETS, for the next word
    bias: float
    moves: np.ndarray   # 2 x 2 transition scores
    curve: np.ndarray   # logistic: strongest marginal's log-odds, log of the marginals' sum, constant


def emissions(field: Field, features: np.ndarray, order: np.ndarray, first: np.ndarray,
              last: np.ndarray) -> np.ndarray:
    """Score of tag 1 for every token; ``order`` indexes the rows of ``features``."""
    own = field.here[features].sum(axis=1)
    prev, nxt = field.before[features[:, 0]], field.after[features[:, 0]]
    e = own[order] + field.bias
    e[1:] += np.where(first[1:], 0.0, prev[order[:-1]])
    e[:-1] += np.where(last[:-1], 0.0, nxt[order[1:]])
    return e


def _grid(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by falling length: their order, first tokens, and how many reach each position."""
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    starts = (np.cumsum(counts) - counts)[order]
    longest = int(counts[order[0]]) if len(order) else 0
    alive = len(order) - np.searchsorted(np.sort(counts[order]), np.arange(longest), side="right")
    return order, starts, alive


def forward_backward(e: np.ndarray, counts: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Marginal of tag 1 for every token, all documents side by side; log of the partition sums.

    Messages are kept as log-odds of tag 1 against tag 0, so nothing overflows. With ``pairs`` the
    expected number of each transition is returned as well.
    """
    order, starts, alive = _grid(counts)
    f, b = np.zeros(len(e)), np.zeros(len(e))
    m00, m01, m10, m11 = moves[0, 0], moves[0, 1], moves[1, 0], moves[1, 1]
    log_z = np.zeros(len(order))
    for t, n in enumerate(alive):
        at = starts[:n] + t
        if t:
            x = f[at - 1]
            stay = np.logaddexp(m00, x + m10)
            f[at] = e[at] + np.logaddexp(m01, x + m11) - stay
            log_z[:n] += stay
        else:
            f[at] = e[at]
    ends = starts + counts[order] - 1
    log_z += np.logaddexp(0.0, f[ends])
    for t in range(len(alive) - 1, 0, -1):
        at = starts[:alive[t]] + t
        y = e[at] + b[at]
        b[at - 1] = np.logaddexp(m10, m11 + y) - np.logaddexp(m00, m01 + y)
    odds = f + b
    marginal = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    if not pairs:
        return marginal, odds
    first = np.zeros(len(e), dtype=bool)
    first[starts] = True
    at = np.flatnonzero(~first)
    x, y = f[at - 1], e[at] + b[at]
    logs = np.stack([np.full(len(at), m00), m01 + y, m10 + x, m11 + x + y])
    top = logs.max(axis=0)
    p = np.exp(logs - top)
    p /= p.sum(axis=0)
    return marginal, p.sum(axis=1).reshape(2, 2), log_z.sum()


def _induce(docs: list[np.ndarray], features: np.ndarray, toxic: np.ndarray, least: float = 25.0) -> np.ndarray:
    """Words whose features occur in toxic documents far beyond chance (likelihood ratio)."""
    marked = np.zeros(len(features), dtype=bool)
    n1, n0 = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    for kind in range(KINDS):
        seen = np.zeros((2, BUCKETS))
        for words, label in zip(docs, toxic):
            seen[int(label), np.unique(features[words, kind])] += 1
        k1, k0 = seen[1], seen[0]
        p = (k1 + k0) / (n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            g = 2 * (np.where(k1 > 0, k1 * np.log(k1 / (n1 * p)), 0) + np.where(k0 > 0, k0 * np.log(k0 / (n0 * p)), 0)
                     + np.where(k1 < n1, (n1 - k1) * np.log((1 - k1 / n1) / (1 - p)), 0)
                     + np.where(k0 < n0, (n0 - k0) * np.log((1 - k0 / n0) / (1 - p)), 0))
        strong = (np.nan_to_num(g) >= least) & (k1 / n1 > 8 * (k0 + 0.5) / n0)
        marked |= strong[features[:, kind]]
    return marked


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps, without threaded linear algebra."""
    z = np.column_stack([x, np.ones(len(x))])
    c, hold = np.zeros(z.shape[1]), 1e-3 * np.diag([1.0] * x.shape[1] + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip((z * c).sum(axis=1), -30, 30)))
        h = np.einsum("i,ij,ik->jk", weight * p * (1 - p), z, z) + hold + 1e-9 * np.eye(len(c))
        pull = (z * (weight * (p - y))[:, None]).sum(axis=0) + (hold * c).sum(axis=1)
        c -= np.clip((invert(h) * pull).sum(axis=1), -2, 2)
    return c


def summary(odds: np.ndarray, marginal: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document: log-odds of its strongest token, log of one plus the summed clear marginals."""
    out = np.zeros((len(counts), 2))
    out[:, 0] = -12.0
    full = np.flatnonzero(counts > 0)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        out[full, 0] = np.clip(np.maximum.reduceat(odds, starts), -12, 12)
        out[full, 1] = np.log1p(np.add.reduceat(np.where(marginal >= 0.5, marginal, 0.0), starts))
    return out


def fit_field(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, steps: int = 25,
              penalty: float = 1e-4, sample_words: int | None = None) -> Field | None:
    """Learn from labelled rows that are not held out.

    The sample is bounded: ``per_label`` ids of each label by a hash of the id, one row of each id
    (its smallest text), and for each label at most half of ``sample_words`` (``SAMPLE_WORDS``) words in whole documents;
    one that exceeds what is left is passed over for the next. The ids, at most twice ``per_label``,
    are broadcast, so the documents are read where they are. None if a label is missing or no document has one; if a label that
    exists has no document in the sample, a ValueError. A document with several labels counts as
    toxic if one of them says so.
    """
    budget = (sample_words or SAMPLE_WORDS) // 2
    marks = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(F.col("toxic") > 0).alias("y")))
    marks = materialize(marks, "marks")
    counts = {r["y"]: r["n"] for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    # An id that no document has takes no place: labels are held against the ids first.
    known = marks.join(docs.select(F.col("doc_id").cast("long").alias("l_id")), "l_id", "left_semi")
    known = materialize(known, "labelled")
    picked = reduce(DataFrame.unionByName, [
        known.filter(F.col("y") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(per_label) for y in (True, False)])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            found = [WORD.findall(t.lower()) for t in texts]
            # One that can't fit in any case is only counted.
            yield pa.RecordBatch.from_arrays(
                [batch.column("y"), batch.column("doc_id"),
                 pa.array([w if len(w) <= budget else None for w in found], pa.list_(pa.string()))],
                names=["y", "doc_id", "words"])

    found = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .join(F.broadcast(picked), F.col("doc_id") == F.col("l_id")).groupBy("y", "doc_id")
             .agg(F.min(F.coalesce("text", F.lit(""))).alias("text")))
    rows = materialize(found.mapInArrow(words, "y boolean, doc_id bigint, words array<string>"), "sample")
    table, seqs, toxic, left, seen = Words(), [], [], {True: budget, False: budget}, 0
    for row in rows.orderBy(F.xxhash64("doc_id")).toLocalIterator():
        seen += 1
        if row["words"] is None or len(row["words"]) > left[row["y"]]:
            continue
        seqs.append(np.array(table.numbers(row["words"]), dtype=np.int64))
        toxic.append(row["y"])
        left[row["y"]] -= len(seqs[-1])
    for table_ in (marks, known, rows):
        discard(table_)
    toxic = np.array(toxic, dtype=bool)
    if len(counts) < 2 or not seen:
        return None
    if not toxic.any() or toxic.all():
        raise ValueError(f"{seen} labelled documents, but none that fits the sample is "
                         + ("clean" if toxic.any() else "toxic"))
    features = np.array(table.features, dtype=np.int64).reshape(-1, KINDS)
    marked = _induce(seqs, features, toxic)

    # Toxic documents without a marked word say nothing about tokens; long clean stretches are dropped.
    use = [i for i in range(len(seqs)) if len(seqs[i]) and (not toxic[i] or marked[seqs[i]].any())]
    order = np.concatenate([seqs[i] for i in use]) if use else np.zeros(0, dtype=np.int64)
    counts_ = np.array([len(seqs[i]) for i in use], dtype=np.int64)
    tags = np.concatenate([marked[seqs[i]] & toxic[i] for i in use]) if use else np.zeros(0, dtype=bool)
    field = _train(features, order, counts_, tags, steps, penalty)

    order = np.concatenate(seqs)
    lengths = np.array([len(s) for s in seqs], dtype=np.int64)
    marginal, odds = score_tokens(field, features, order, lengths)
    # Each label weighs as much as in the whole table, however many of its rows were picked.
    weight = np.where(toxic, counts[True] / toxic.sum(), counts[False] / (~toxic).sum())
    weight *= len(seqs) / weight.sum()
    field.curve = _fit_curve(summary(odds, marginal, lengths), toxic.astype(float), weight)
    return field


def _edges(counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    full = counts > 0
    ends = np.cumsum(counts)
    first[(ends - counts)[full]] = True
    last[ends[full] - 1] = True
    return first, last


def score_tokens(field: Field, features: np.ndarray, order: np.ndarray, counts: np.ndarray):
    first, last = _edges(counts, len(order))
    return forward_backward(emissions(field, features, order, first, last), counts, field.moves)


def _train(features: np.ndarray, order: np.ndarray, counts: np.ndarray, tags: np.ndarray, steps: int,
           penalty: float) -> Field:
    """Maximum likelihood by diagonal-scaled gradient steps (AdaGrad) over the whole sample."""
    field = Field(np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS), -2.0, np.zeros((2, 2)), np.zeros(3))
    if not len(order):
        return field
    first, last = _edges(counts, len(order))
    inner, words = ~first, len(features)
    want = np.zeros((2, 2))
    a, b = tags[:-1][inner[1:]].astype(int), tags[1:][inner[1:]].astype(int)
    np.add.at(want, (a, b), 1)
    squares = [np.full(BUCKETS, 1e-3) for _ in range(3)] + [1e-3, np.full((2, 2), 1e-3)]
    docs = len(counts)
    for _ in range(steps):
        e = emissions(field, features, order, first, last)
        marginal, pairs, _ = forward_backward(e, counts, field.moves, pairs=True)
        gap = (marginal - tags) / docs
        own = np.bincount(order, weights=gap, minlength=words)
        prev = np.bincount(order[:-1], weights=gap[1:] * inner[1:], minlength=words)
        nxt = np.bincount(order[1:], weights=gap[:-1] * inner[1:], minlength=words)
        grads = [sum(np.bincount(features[:, k], weights=own, minlength=BUCKETS) for k in range(KINDS)),
                 np.bincount(features[:, 0], weights=prev, minlength=BUCKETS),
                 np.bincount(features[:, 0], weights=nxt, minlength=BUCKETS), gap.sum(), (pairs - want) / docs]
        now = [field.here, field.before, field.after, field.bias, field.moves]
        new = []
        for i, (value, grad) in enumerate(zip(now, grads)):
            grad = grad + penalty * value
            squares[i] = squares[i] + grad ** 2
            new.append(value - 0.7 * grad / np.sqrt(squares[i]))
        field.here, field.before, field.after, field.bias, field.moves = new
    return field


def spans_of(marginal: np.ndarray, places: list[tuple[int, int]], at: float = 0.5) -> list[tuple[int, int, float]]:
    """Runs of tokens whose marginal reaches ``at``: first and last character offset, strongest marginal."""
    out: list[tuple[int, int, float]] = []
    before = -2
    for i in np.flatnonzero(marginal >= at).tolist():
        start, end = places[i]
        if i == before + 1:
            start, _, strongest = out.pop()
            out.append((start, end, max(strongest, float(marginal[i]))))
        else:
            out.append((start, end, float(marginal[i])))
        before = i
    return out


class Scorer:
    """Scores texts by a field; remembers the features of some words."""

    def __init__(self, field: Field | None, limit: int = 150_000):
        self.field, self.limit, self.table = field, limit, Words()

    def __call__(self, texts: list[str], with_spans: bool = True) -> tuple[np.ndarray, list[list]]:
        """The score of every text and its toxic spans."""
        field, scores, spans = self.field, np.zeros(len(texts)), [[] for _ in texts]
        if field is None:
            return scores, spans
        if len(self.table.seen) > self.limit:
            self.table = Words()
        lowered = [t.lower() for t in texts]
        rows = [self.table.numbers(WORD.findall(t)) for t in lowered]
        counts = np.array([len(r) for r in rows], dtype=np.int64)
        order = np.fromiter((w for r in rows for w in r), dtype=np.int64, count=int(counts.sum()))
        features = np.array(self.table.features, dtype=np.int64).reshape(-1, KINDS)
        used, order = np.unique(order, return_inverse=True)
        marginal, odds = score_tokens(field, features[used], order, counts)
        x = np.column_stack([summary(odds, marginal, counts), np.ones(len(texts))])
        scores = 1 / (1 + np.exp(-np.clip((x * field.curve).sum(axis=1), -30, 30)))
        starts = np.cumsum(counts) - counts
        for i in np.flatnonzero(x[:, 1] > 0).tolist() if with_spans else ():
            same = len(lowered[i]) == len(texts[i])
            places = [m.span() for m in WORD.finditer(lowered[i] if same else texts[i].lower())]
            spans[i] = spans_of(marginal[starts[i]:starts[i] + counts[i]], places)
        return scores, spans


def score_documents(docs: DataFrame, field: Field | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, spans for every row, from the whole text alone.

    ``spans`` holds the character offsets and the strongest marginal of each toxic run. NULL counts
    as empty; an empty text gets the score of a text without any toxic token. Without a field (no
    labels of both kinds) every score is 0. Repeated rows get equal scores, an empty table gives no
    rows, extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch, texts in text_slices(batches):
            scores, spans = scorer(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array((scores >= threshold).astype(np.int32)),
                 pa.array([[{"start": s, "end": e, "marginal": p} for s, e, p in x] for x in spans],
                          pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()),
                                              ("marginal", pa.float64())])))],
                names=["doc_id", "held_out", "score", "predicted", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       "text")
    return rows.mapInArrow(
        score, "doc_id bigint, held_out boolean, score double, predicted int, "
               "spans array<struct<start:int,end:int,marginal:double>>")


def drop_toxic(docs: DataFrame, field: Field | None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a score below ``threshold``, judged row by row, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def keeps():
        scorer = Scorer(shared.value)
        return lambda texts: scorer(texts, with_spans=False)[0] < threshold

    return keep_rows(docs, keeps)
