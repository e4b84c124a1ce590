"""Spelling variants of frequent words by a variable-length gram index.

A gram that many words share is no good key, so the dictionary of frequent grams says where to read
on: the gram at a place of a word is its shortest one of at least ``SHORTEST`` letters that is not
frequent, of ``LONGEST`` letters at most. It depends on its own letters alone. Hence one edit at a
place destroys at most the grams that cover the place, and the largest such number over all places
of a word, its bound, is how many of its grams an edit can cost. Two words one edit apart keep a
gram in common among the ``bound + 1`` rarest of either; it stands at the same distance from the
start in both words, or at the same distance from the end. Only these short lists are merged, and
what meets in one is verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lateweave.llm.common import discard, materialize, text_slices

RUN = re.compile("[a-zÀ-ÿ]+")  # after A-Z have been lower-cased
TYPO_EVERY = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
SHORTEST, LONGEST = 2, 5
FREQUENT = 200        # a gram of more words than this is read on
DICTIONARY = 200_000  # grams in the dictionary at most, the most frequent ones
# Words counted in a task before they are handed on, rows and pairs handled at a time.
REMEMBERED = 400_000
PAIRS = 1_000_000
# Words that a block of a list holds on average; two blocks of a longer list meet in one group.
BLOCK_WORDS = 2_048
# A word of more letters is compared on its own.
WIDE = 32
_START, _END = "\x02", "\x03"


def spelled(doc_id, run: str, start: int | None = None) -> str:
    """The run as it is counted: without one letter where the checksum of id and run says so."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{doc_id}:".encode()) if start is None else start)
    if h % TYPO_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: how often each word of the whole texts occurs, summed in each task first."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def handed() -> pa.RecordBatch:
            words = [w for w in total if len(w) >= least_letters]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])

        crc = zlib.crc32
        for batch, texts in text_slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts):
                # bytes.lower() touches A-Z only.
                runs = Counter(RUN.findall(text.encode().lower().decode()))
                start = crc(f"{doc_id}:".encode())
                odd = [w for w in runs if not crc(w.encode(), start) % TYPO_EVERY]
                for w in odd:
                    total[spelled(doc_id, w, start)] += runs.pop(w)
                total.update(runs)
            if len(total) > REMEMBERED:
                yield handed()
                total.clear()
        yield handed()

    return (docs.filter("doc_id IS NOT NULL AND text IS NOT NULL")
            .select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(count, "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def gram_dictionary(words: DataFrame, frequent: int = FREQUENT, most: int = DICTIONARY) -> dict[str, int]:
    """Grams that more than ``frequent`` words hold, and how many do; at most ``most``, the most
    frequent ones. With a gram all its beginnings are there, as these are in no fewer words."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for word in batch.column("word").to_pylist():
                x = f"{_START}{word}{_END}"
                found.update({x[p:p + q] for q in range(SHORTEST, LONGEST + 1) for p in range(len(x) - q + 1)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["gram", "n"])

    counted = (words.select("word").mapInArrow(grams, "gram string, n bigint")
               .groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") > frequent))
    rows = counted.orderBy(F.desc("n"), F.length("gram"), "gram").limit(most).collect()
    return {r["gram"]: r["n"] for r in rows}


def variable_grams(word: str, dictionary: dict[str, int]) -> list[tuple[int, int]]:
    """(start, end) of the gram at every place of the word between its start and end marks."""
    x, out = f"{_START}{word}{_END}", []
    for p in range(len(x) - SHORTEST + 1):
        e = p + SHORTEST
        while e < len(x) and e - p < LONGEST and x[p:e] in dictionary:
            e += 1
        out.append((p, e))
    return out


def affected_bound(spans: list[tuple[int, int]]) -> int:
    """How many of the grams one edit can cost at most: a letter deleted or replaced hits those that
    hold it, an inserted one those that hold what is on both sides of it."""
    size = spans[-1][0] + SHORTEST if spans else 0
    hit, cut = [0] * (size + 2), [0] * (size + 2)
    for p, e in spans:
        hit[p] += 1
        hit[e] -= 1
        cut[p + 1] += 1
        cut[e] -= 1
    most = here = 0
    for i in range(size - 1):  # the end mark itself is never edited
        here += hit[i]
        most = max(most, here if i else 0)
    here = 0
    for i in range(size):
        here += cut[i]
        most = max(most, here)
    return most


def short_list(word: str, dictionary: dict[str, int]) -> list[tuple[str, int, int]]:
    """(gram, start, distance of its start from the end) of the ``bound + 1`` rarest grams."""
    x, spans = f"{_START}{word}{_END}", variable_grams(word, dictionary)
    order = sorted((dictionary.get(x[p:e], 0), x[p:e], p) for p, e in spans)
    return [(g, p, len(x) - p) for _, g, p in order[:affected_bound(spans) + 1]]


def postings(words: DataFrame, dictionary) -> DataFrame:
    """key, n_letters, word, n: every word in the lists of its rarest grams, once by the place from
    the start and once by that from the end. Equal hashes of unequal keys cost a comparison only.

    ``dictionary`` is a broadcast of the gram dictionary.
    """
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, hashed = dictionary.value, xxhash.xxh3_64_intdigest
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                keys, row, words = [], [], part.column("word").to_pylist()
                for i, word in enumerate(words):
                    for g, p, q in short_list(word, grams):
                        # The lowest bit tells the two kinds of lists apart.
                        keys.append(hashed(f"{g}<{p}") & ~1)
                        keys.append(hashed(f"{g}>{q}") | 1)
                        row += (i, i)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                     pa.array([len(w) for w in words], pa.int32()).take(row),
                     part.column("word").take(row), part.column("n").take(row)],
                    names=["key", "letters", "word", "n"])

    return words.select("word", "n").mapInArrow(post, "key bigint, letters int, word string, n bigint")


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point leads from ``a`` to ``b``."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def _verified(a: np.ndarray, b: np.ndarray, letters: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Which pairs of rows are one edit apart; ``b`` has as many letters as ``a`` or one more."""
    ok = np.zeros(len(a), dtype=bool)
    same = letters[a] == letters[b]
    at = np.flatnonzero(same)
    ok[at] = (codes[a[at]] != codes[b[at]]).sum(axis=1) == 1
    at = np.flatnonzero(~same)
    x, y = codes[a[at]], codes[b[at]]
    differ = x != y
    first = differ.argmax(axis=1)  # there is one: at the place of the longer word's last letter at the latest
    shifted = np.ones_like(differ)
    shifted[:, :-1] = x[:, :-1] == y[:, 1:]
    behind = np.arange(codes.shape[1])[None, :]
    ok[at] = (shifted | (behind < first[:, None]) | (behind >= letters[a[at]][:, None])).all(axis=1)
    return ok


def _list_pairs(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one list (and of different sides, if it is cut into blocks) that are one
    edit apart. Rows are sorted by list, letters and word."""
    words = table.column("word").to_pylist()
    letters = table.column("letters").to_numpy()
    key, x, y = (table.column(c).to_numpy() for c in ("key", "x", "y"))
    side = table.column("side").to_numpy()
    whole = x == y
    new = np.ones(len(words), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    group = np.cumsum(new) - 1
    # As far as a row's partners reach: the same list, at most one letter more.
    place = group.astype(np.int64) * (1 << 31) + letters
    reach = np.searchsorted(place, place + 1, side="right")
    number = reach - np.arange(len(words)) - 1
    wide = letters > WIDE
    width = int(letters[~wide].max(initial=0)) + 1
    short = ["" if w else word for word, w in zip(words, wide)]
    codes = np.array(short, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    codes = codes.astype(np.uint8 if codes.max(initial=0) < 256 else np.uint32)
    marks = np.zeros(len(words), dtype=np.uint64)
    for column in codes.T:
        marks |= np.where(column > 0, np.uint64(1) << (column.astype(np.uint64) & np.uint64(63)), np.uint64(0))
    ends = np.cumsum(number)
    from_end = (key & 1).astype(bool)
    start = 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        n = number[start:stop]
        a = np.repeat(np.arange(start, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        # Equal length: the place from the start alone decides. Two blocks: one word of either.
        keep = (whole[a] | (side[a] != side[b])) & ~(from_end[a] & (letters[a] == letters[b]))
        a, b = a[keep], b[keep]
        narrow = ~wide[a] & ~wide[b]
        near = np.bitwise_count(marks[a] ^ marks[b]) <= 2
        a2, b2 = a[narrow & near], b[narrow & near]
        ok = _verified(a2, b2, letters, codes)
        far = [(i, j) for i, j in zip(a[~narrow].tolist(), b[~narrow].tolist()) if one_edit(words[i], words[j])]
        far = np.array(far, dtype=np.int64).reshape(-1, 2)
        yield np.concatenate([a2[ok], far[:, 0]]), np.concatenate([b2[ok], far[:, 1]])
        start = stop


def near_words(words: DataFrame, frequent: int = FREQUENT, block: int = BLOCK_WORDS,
               dictionary: int = DICTIONARY) -> DataFrame:
    """a, na, b, nb: every pair of ``words (word, n)`` that are one edit apart, a before b, once.

    Words have ``LEAST_LETTERS`` letters or more, so that an edit never costs all grams. Lists are
    dealt over tasks by key; one of more than ``block`` words is cut into blocks, and two blocks
    meet in a group. No pair is sent around before it is verified.
    """
    grams = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, frequent, dictionary))
    posted = materialize(postings(words, grams), "postings")
    long = materialize(posted.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > block)
                       .select(F.col("key").alias("l_key"), F.ceil(F.col("m") / block).cast("int").alias("blocks")),
                       "long-lists")
    dealt = (posted.join(long, F.col("key") == F.col("l_key"), "left")
             .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                     (F.col("own") > F.col("other")).cast("int").alias("side"), "letters", "word", "n"))
    order = ["key", "x", "y", "letters", "word"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            word, n = table.column("word"), table.column("n")
            for a, b in _list_pairs(table):
                yield pa.table({"w1": word.take(pa.array(a)), "n1": n.take(pa.array(a)),
                                "w2": word.take(pa.array(b)), "n2": n.take(pa.array(b))}).combine_chunks().to_batches()

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key, x, y = (held.column(c).to_numpy() for c in ("key", "x", "y"))
            last = np.flatnonzero((key != key[-1]) | (x != x[-1]) | (y != y[-1])) if len(key) else []
            if len(last):  # the last list may go on in the next batch
                for found in pairs(held.slice(0, int(last[-1]) + 1)):
                    yield from found
                held = held.slice(int(last[-1]) + 1)
        if held is not None and held.num_rows:
            for found in pairs(held):
                yield from found

    found = (dealt.repartition("key", "x", "y").sortWithinPartitions(*order)
             .mapInArrow(merge, "w1 string, n1 bigint, w2 string, n2 bigint"))
    flip = F.col("w1") > F.col("w2")
    side = lambda p, q: F.when(flip, F.col(p)).otherwise(F.col(q))
    return (found.select(side("w2", "w1").alias("a"), side("n2", "n1").alias("na"),
                         side("w1", "w2").alias("b"), side("n1", "n2").alias("nb"))
            .groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb")))


def _roots(links: DataFrame) -> DataFrame:
    """word, root for ``links (word, form)``: forms followed to the last. The count at least doubles
    with every step, so there is no circle; every round doubles the length of the steps."""
    step = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = materialize(step.join(on, F.col("root") == F.col("at"), "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(step)
        step = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return step


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT,
                      frequent: int = FREQUENT, block: int = BLOCK_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the maximal runs of ``[A-Za-z]`` and U+00C0 to U+00FF with A-Z lower-cased, of
    ``least_letters`` letters and ``least_count`` occurrences or more; of a run whose checksum with
    its document's id is divisible by 97 one letter is left out (see ``spelled``). ``form`` is the
    most frequent word one edit away (ties: the smallest by code points) if it is at least twice
    as frequent as the word, else NULL; ``root`` follows the forms to the last.

    A NULL text has no words, and neither has a row without an id, as the checksum needs one. Rows that
    repeat an id count like others. An empty table gives no rows; extra columns are ignored.
    """
    if least_letters < LONGEST:
        raise ValueError(f"words of fewer than {LONGEST} letters may lose all their grams by one edit")
    words = materialize(word_counts(docs, least_letters, least_count), "words")
    pairs = materialize(near_words(words, frequent, block), "near-words")
    directed = (pairs.select(F.col("a").alias("w"), F.col("b").alias("near"), F.col("nb").alias("m"))
                .unionByName(pairs.select(F.col("b").alias("w"), F.col("a").alias("near"), F.col("na").alias("m"))))
    best = directed.groupBy("w").agg(F.count(F.lit(1)).alias("n_near"),
                                     F.min(F.struct((-F.col("m")).alias("low"), "near")).alias("best"))
    taken = F.coalesce(-F.col("best.low") >= 2 * F.col("n"), F.lit(False))
    named = materialize(words.join(best, F.col("word") == F.col("w"), "left").select(
        "word", F.when(taken, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, -F.col("best.low")).alias("form_n")), "named")
    roots = _roots(named.filter("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "r_word")
    discard(words)
    discard(pairs)
    return named.join(roots, F.col("word") == F.col("r_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
