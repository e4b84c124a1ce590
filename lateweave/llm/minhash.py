"""Near-duplicate documents by DartMinHash signatures and exact comparison.

A document is the weighted set of its five-word shingles; the weight is how often one occurs. The
weight axis of every shingle is cut into regions [2^v - 1, 2^(v+1) - 1). In each region darts
arrive in order of rank at a rate equal to the region's height; place and coordinate of a dart are
hashed from the shingle and the region alone, so equal shingles get equal darts in all documents. A
dart below the shingle's weight counts, and for each coordinate the dart of lowest rank is kept. Two
documents keep the same dart with a probability equal to their weighted Jaccard similarity. Only
darts of rank below a bound are thrown, which scales with one over the total weight: work does not
grow with the signature times the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateweave.llm.common import discard, materialize, text_slices
from lateweave.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 5
# Texts and characters that a block of a bucket holds on average; two blocks meet in one task.
BLOCK_TEXTS = 512
BLOCK_CHARS = 1_000_000
# Shingles that are multiplied at a time when two blocks are compared.
COLUMNS = 8192

_WORD = re.compile(r"\w+")
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[str]:
    """Lower-case words; a text without letters and digits keeps its marks."""
    text = text.lower()
    return _WORD.findall(text) or text.split()


def word_key(words: list[str]) -> bytes:
    """Stands for a word sequence."""
    return hashlib.md5(" ".join(words).encode()).digest()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def uniform(h: np.ndarray) -> np.ndarray:
    """(0, 1) from the upper 53 bits."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def shingles(words: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order and their counts; fewer words than ``size`` are one shingle."""
    if not words:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    out = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for i in range(size):
        out = mix(out * _STEP + h[i:len(h) - size + 1 + i] + np.uint64(i + 1))
    return np.unique(out, return_counts=True)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity: summed minima over summed maxima; two empty sets are equal."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both)


def dart_signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """One row of ``k`` darts per weighted set (weights of any positive size); all sets at once."""
    out = np.zeros((len(sets), k), dtype=np.uint64)
    weight = np.array([float(np.sum(w)) for _, w in sets])
    todo = np.flatnonzero(weight > 0)
    # So many darts hit every coordinate with a probability of 1 - exp(-2); the rest throws again.
    bound = np.zeros(len(sets))
    bound[todo] = k * (np.log(k) + 2.0) / weight[todo]
    while len(todo):
        missing = _throw([sets[i] for i in todo], bound[todo], k, out, todo)
        todo = todo[missing]
        bound[todo] *= 2
    return out


def _throw(sets, bound, k, out, rows) -> np.ndarray:
    """Throw all darts of rank below ``bound``; fill ``out[rows]``; which sets miss a coordinate."""
    owner = np.repeat(np.arange(len(sets)), [len(h) for h, _ in sets])
    element = np.concatenate([h for h, _ in sets])
    weight = np.concatenate([np.asarray(w, dtype=np.float64) for _, w in sets])
    regions = np.floor(np.log2(1 + weight)).astype(np.int64) + 1
    regions -= (2.0 ** (regions - 1) - 1 >= weight) & (regions > 1)
    which = np.repeat(np.arange(len(element)), regions)
    level = np.arange(len(which)) - np.repeat(np.cumsum(regions) - regions, regions)
    owner, weight = owner[which], weight[which]
    state = mix(element[which] + _SALT * (level + 1).astype(np.uint64))
    height = 2.0 ** level
    rank = np.zeros(len(state))
    keys, ranks, darts = [], [], []
    while len(state):
        state = mix(state + _STEP)
        rank = rank - np.log(uniform(state)) / height
        on = rank < bound[owner]
        state, rank, owner, weight, height = state[on], rank[on], owner[on], weight[on], height[on]
        dart = mix(state ^ _SALT)
        below = height - 1 + uniform(mix(dart)) * height < weight
        keys.append(owner[below] * k + (dart[below] % np.uint64(k)).astype(np.int64))
        ranks.append(rank[below])
        darts.append(dart[below])
    key, r, d = np.concatenate(keys), np.concatenate(ranks), np.concatenate(darts)
    order = np.lexsort((r, key))
    key, d = key[order], d[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    filled = np.zeros(len(sets) * k, dtype=bool)
    filled[key[first]] = True
    best = np.zeros(len(sets) * k, dtype=np.uint64)
    best[key[first]] = d[first]
    out[rows] = best.reshape(-1, k)
    return ~filled.reshape(-1, k).all(axis=1)


def band_hashes(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket per band, distinct between bands."""
    h = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for part in np.moveaxis(signatures.reshape(len(signatures), bands, -1), 2, 0):
        h = mix(h * _STEP + part)
    return h


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key (of the word sequence), characters and one bucket per band."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, budget=1_000_000):
            words = [words_of(t) for t in texts]
            sets = [shingles(w) for w in words]
            buckets = band_hashes(dart_signatures(sets, bands * rows), bands).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([word_key(w) for w in words], pa.binary()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array(list(buckets), pa.list_(pa.int64()))],
                names=["doc_id", "key", "chars", "buckets"])

    return docs.mapInArrow(sign, "doc_id bigint, key binary, chars bigint, buckets array<bigint>")


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Exact similarity of ``pairs (a, b)``: a, b, similarity. ``texts`` holds node and text."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            found = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb")):
                if a != last:
                    last, known = a, shingles(words_of(ta.as_py()))
                found.append(jaccard(known, shingles(words_of(tb.as_py()))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return (pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .select("a", "b", "ta", "tb").mapInArrow(score, "a bigint, b bigint, similarity double"))


def _leads(member: DataFrame) -> DataFrame:
    """bucket, lead: of every bucket the member that meets the most others, ties to the smallest."""
    pick = F.max(F.struct("meets", (-F.col("node")).alias("low")))
    return member.groupBy("bucket").agg(pick.alias("pick")).select("bucket", (-F.col("pick.low")).alias("lead"))


def _block_links(similarity: float):
    """A function of one group of texts in sides 0 and 1 (or 0 alone): links a, b that join what
    has at least ``similarity``, as a forest, so that alike texts give no more links than texts."""
    def links(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        right = right if len(right) else left
        texts, node = group.column("text"), group.column("node").to_numpy()
        # A shingle that occurs n times is n different ones: minima of counts become common elements.
        sets = []
        for t in texts:
            h, n = shingles(words_of(t.as_py()))
            many = np.repeat(h, n)
            sets.append(mix(many + _SALT * (np.arange(len(many)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)))
        size = np.array([len(x) for x in sets])
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        # What only one text holds is common to none.
        shared = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, dtype=bool)
        row, column = row[shared], np.cumsum(np.diff(column[shared], prepend=-1) > 0) - 1
        both = np.zeros((len(left), len(right)), dtype=np.float64)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, (first, first + COLUMNS))
            has = np.zeros((len(sets), COLUMNS), dtype=np.float32)
            has[row[lo:hi], column[lo:hi] - first] = 1
            both += has[left] @ has[right].T
        total = size[left][:, None] + size[right][None, :]
        # Quotients of whole numbers in double precision, as in jaccard().
        i, j = np.nonzero(both / np.maximum(total - both, 1) >= similarity)
        class_, out = group.column("class").to_numpy(), []
        root = {c: c for c in class_.tolist()}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for x, y in zip(left[i].tolist(), right[j].tolist()):
            cx, cy = top(class_[x].item()), top(class_[y].item())
            if cx != cy:
                root[cx] = cy
                out.append((node[x].item(), node[y].item()))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return links


def _links_apart(apart: DataFrame, kinds: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between members of a bucket that are in different classes. ``apart`` holds bucket, node
    and class of all that are left to compare, ``kinds`` texts and characters per bucket and class.

    A bucket is dealt into blocks by hash: a class that fills a block has blocks of its own, which
    are not compared with each other; the rest share blocks. Each pair of blocks is one group.
    """
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("chars") / BLOCK_CHARS)).cast("long")
    large = (F.col("n") >= BLOCK_TEXTS) | (F.col("chars") >= BLOCK_CHARS)
    owned = kinds.withColumn("owner", F.when(large, F.col("class")))
    dealt = (owned.groupBy("bucket", "owner").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"),
                                                  F.count(F.lit(1)).alias("kinds"))
             .select("bucket", "owner", "kinds", F.greatest(blocks, F.lit(1)).alias("blocks")))
    home = owned.select("bucket", "class", "owner").join(
        dealt.select(F.col("bucket").alias("at"), F.col("owner").alias("of"), "blocks"),
        (F.col("bucket") == F.col("at")) & F.col("owner").eqNullSafe(F.col("of")))
    member = apart.join(home.select("bucket", "class", "owner", "blocks"), ["bucket", "class"]).select(
        "bucket", "node", "class",
        F.struct("owner", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("part")).alias("block"))
    each = dealt.select("bucket", "kinds", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("part"),
                        "owner").select("bucket", "kinds", F.struct("owner", "part").alias("x"))
    meets = (each.join(each.select("bucket", F.col("x").alias("y"), F.col("kinds").alias("k")), "bucket")
             .filter("x <= y AND NOT (x.owner IS NOT NULL AND x.owner <=> y.owner)")
             # A shared block of one small class has nothing to compare in itself.
             .filter("NOT (x = y AND kinds = 1)")
             .withColumn("meeting", F.xxhash64("bucket", "x", "y")))
    sides = (meets.select("bucket", "meeting", F.col("x").alias("block"), F.lit(0).alias("side"))
             .union(meets.filter("x != y").select("bucket", "meeting", F.col("y").alias("block"), F.lit(1))))
    met = (member.join(sides, ["bucket", "block"]).select("bucket", "meeting", "side", "node", "class")
           .join(texts, "node"))
    return met.groupBy("bucket", "meeting").applyInArrow(_block_links(similarity), "a bigint, b bigint")


def _texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """node, text of the ``keys`` (node, key, low): the text of the row ``low`` that has these words."""
    rows = docs.join(keys.select("node", "key", "low"), F.col("doc_id") == F.col("low")).select(
        "node", "key", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.isEmpty():
        return rows.select("node", "text")

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            keep = [word_key(words_of(t)) == k for t, k in zip(texts, batch.column("key").to_pylist())]
            yield batch.select(["node", "text"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(same, "node bigint, text string").groupBy("node").agg(F.min("text").alias("text"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (its smallest doc_id), class_size.

    Two different texts are linked when they share a bucket and their weighted Jaccard similarity is
    at least ``similarity``; a class is a connected component. Copies of one word sequence share
    a class from the start and are compared once. Within a bucket every member is compared with
    the one that meets the most others; buckets whose other members are still in different classes
    are compared whole, block against block, so no link is lost and no bucket is cut. That last step
    is quadratic in such a bucket, but its rows are only the texts times the blocks they meet.

    NULL counts as empty, and texts without words are copies of each other. Rows that repeat
    an id are in one class. A row without an id is a class of its own: class_id NULL, size 1.
    An empty table gives no rows; extra columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(signatures(docs.filter("doc_id IS NOT NULL"), bands, rows), "signatures")
    # A node is a word sequence, not an id: of an id with several texts each is compared for itself.
    keys = signed.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("chars").alias("chars"),
                                     F.first("buckets").alias("buckets"))
    keys = materialize(keys.withColumn("node", F.monotonically_increasing_id()), "keys")
    copies = materialize(signed.select("doc_id", "key").join(
        keys.select(F.col("key").alias("k"), "node"), F.col("key") == F.col("k")).select("doc_id", "node"), "copies")
    discard(signed)
    posted = keys.select("node", "chars", F.explode("buckets").alias("bucket"))
    full = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    met = materialize(posted.join(full, "bucket"), "met")
    # How often a text meets others: the original of many edited copies meets the most.
    involved = materialize(met.groupBy("node").agg(F.sum("m").alias("meets")), "involved")
    member = materialize(met.join(involved, "node").select("bucket", "node", "meets", "chars"), "members")
    discard(met)
    texts = materialize(_texts_of(docs, keys.join(involved.select("node"), "node", "left_semi")), "texts")
    discard(involved)

    leads = materialize(_leads(member), "leads")
    posts = member.join(leads, "bucket")
    pairs = posts.filter("node != lead").select(F.least("lead", "node").alias("a"),
                                                F.greatest("lead", "node").alias("b")).distinct()
    linked = materialize(compare(pairs, texts).filter(F.col("similarity") >= similarity).select("a", "b"), "linked")
    classes = components(linked)
    # The first one of a bucket has met all others; the rest matters where it is of two classes or more.
    apart = materialize(posts.filter("node != lead").join(classes, "node", "left").select(
        "bucket", "node", "chars", F.coalesce("class", "node").alias("class")), "apart")
    kinds = materialize(apart.groupBy("bucket", "class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars")), "kinds")
    mixed = kinds.groupBy("bucket").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("bucket")
    several = materialize(kinds.join(mixed, "bucket"), "mixed")
    more = materialize(_links_apart(apart, several, texts, similarity), "more")
    if not more.isEmpty():
        discard(classes)
        classes = components(linked.unionByName(more))
    for table in (texts, keys, member, leads, linked, apart, kinds, several, more):
        discard(table)

    labelled = materialize(copies.join(classes, "node", "left")
                           .select("doc_id", F.coalesce("class", "node").alias("class")), "labelled")
    discard(copies)
    discard(classes)
    # Rows that repeat an id with other texts tie their classes together.
    twice = materialize(labelled.groupBy("doc_id").agg(F.min("class").alias("a"), F.max("class").alias("b"))
                        .filter("a != b").select("a", "b"), "twice")
    if not twice.isEmpty():
        # Not only the smallest and the largest class of an id: all of them.
        tied = labelled.join(labelled.groupBy("doc_id").agg(F.min("class").alias("a")), "doc_id").select(
            "a", F.col("class").alias("b")).filter("a != b").distinct()
        merged = components(tied).select(F.col("node").alias("class"), F.col("class").alias("whole"))
        labelled = materialize(labelled.join(merged, "class", "left").select(
            "doc_id", F.coalesce("whole", "class").alias("class")), "labelled")
    # Written, so that the join below reads plain shuffles, whose large partitions Spark can split.
    sizes = materialize(labelled.groupBy(F.col("class").alias("of")).agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")), "sizes")
    without = docs.filter("doc_id IS NULL").select(
        "doc_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(1).cast("bigint").alias("class_size"))
    named = labelled.join(sizes, F.col("class") == F.col("of")).select("doc_id", "class_id", "class_size")
    return named.unionByName(without)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """Of each class the document with the smallest id stays; rows without an id stay."""
    found = near_duplicates(docs)
    gone = materialize(found.filter("doc_id != class_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
