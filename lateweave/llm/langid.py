"""Language identification in two steps: the family first, then the language within it.

Features are hashed byte n-grams (2 to 4) of the whole lower-cased text, as shares of all its
n-grams. Every step is a set of one-versus-one linear support vector machines that vote.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lateweave.llm.common import discard, held_out, invert, keep_rows, materialize, text_slices

# ISO 639-1 codes by branch. A language outside the table is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "gu", "pa", "ne"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "uralic": ["fi", "et", "hu"],
}
UNDETERMINED = "und"
BUCKETS = 1 << 15
ORDERS = (2, 3, 4)
# Bytes hashed at a time; a longer text is read in pieces of this size.
BLOCK = 1_000_000
# The bounded sample: about so many rows of each language, by hash of the text.
SAMPLE_PER_LANGUAGE = 600
# And of them whole texts with so many distinct n-grams together; languages beyond the bound raise.
SAMPLE_GRAMS = 4_000_000
LANGUAGES = 400
# A prediction with less is no better than a guess among the languages.
LEAST_SCORE = 0.3

_LETTER = re.compile(r"[^\W\d_]")
_ASCII = np.arange(256, dtype=np.uint8)
_ASCII[[c for c in range(128) if not chr(c).isalpha()]] = 32


def has_letter(text: str) -> bool:
    """Whether a character is a letter; superscripts, fractions and Roman numerals are numbers."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def gram_hashes(data: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each byte of ``data``."""
    h = np.zeros(max(len(data) - order + 1, 0), dtype=np.uint32)
    for i in range(order):
        h = h * np.uint32(257) + data[i:len(data) - order + 1 + i]
    h = (h ^ np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    return (h >> np.uint32(16) ^ h) & np.uint32(BUCKETS - 1)


def _bytes(text: str) -> np.ndarray:
    return _ASCII[np.frombuffer(f" {text.lower()}   ".encode(), dtype=np.uint8)]


def _blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces of ``data`` such that each n-gram of the longest order starts in exactly one."""
    over = max(ORDERS) - 1
    for start in range(0, max(len(data) - over, 1), BLOCK):
        yield data[start:start + BLOCK + over]


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in the text, and how often."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for block in _blocks(_bytes(text)):
        for order in ORDERS:
            starts = max(len(block) - max(ORDERS) + 1, 0)
            total += np.bincount(gram_hashes(block, order)[:starts], minlength=BUCKETS)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


def gram_sums(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the summed weight rows of all its n-grams and their number."""
    sums, numbers = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        for block in _blocks(_bytes(text)):
            starts = max(len(block) - max(ORDERS) + 1, 0)
            for order in ORDERS:
                grams = gram_hashes(block, order)[:starts]
                if len(grams) > BUCKETS // 2:
                    sums[i] += np.bincount(grams, minlength=BUCKETS) @ weights
                else:
                    sums[i] += weights[grams].sum(axis=0, dtype=np.float64)
                numbers[i] += len(grams)
    return sums, numbers


@dataclass
class Duel:
    """One linear machine: positive margins speak for ``yes``; ``slope, shift`` map to a chance."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


@dataclass
class LanguageModel:
    families: dict[str, list[str]]
    duels: list[Duel]

    def weights(self) -> np.ndarray:
        if not self.duels:
            return np.zeros((BUCKETS, 1))
        return np.stack([d.weights for d in self.duels], axis=1)


def _fit_duel(yes: str, no: str, rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, sign: np.ndarray,
              penalty: float, steps: int) -> Duel:
    """Squared-hinge support vector machine by accelerated gradient steps on sparse rows."""
    n = len(sign)
    mean = np.bincount(cols, weights=vals, minlength=BUCKETS) / n
    scale = 1.0 / np.sqrt(mean + 1e-5)
    x = vals * scale[cols]
    balance = np.where(sign > 0, 0.5 / max((sign > 0).sum(), 1), 0.5 / max((sign < 0).sum(), 1))
    norm = np.bincount(rows, weights=x * x, minlength=n).max() + 1.0
    step = 1.0 / (2 * norm + penalty)
    w, b, vw, vb, t = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), 0.0, 1.0
    for _ in range(steps):
        margin = np.bincount(rows, weights=x * vw[cols], minlength=n) + vb
        pull = -2 * balance * sign * np.maximum(0.0, 1 - sign * margin)
        nw = vw - step * (np.bincount(cols, weights=x * pull[rows], minlength=BUCKETS) + penalty * vw)
        nb = vb - step * pull.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    margin = np.bincount(rows, weights=x * w[cols], minlength=n) + b
    # A logistic curve through the margins, smoothed as if one more row of each kind were at zero.
    slope, shift = 1.0, 0.0
    target = np.where(sign > 0, 1 - 1 / (n + 2), 1 / (n + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -30, 30)))
        g = np.array([((p - target) * margin * balance).sum() + 1e-3 * (slope - 1),
                      ((p - target) * balance).sum()])
        v = p * (1 - p) * balance
        h = np.array([[(v * margin ** 2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        move = (invert(h) * g).sum(axis=1)
        slope, shift = max(slope - np.clip(move[0], -2, 2), 0.1), shift - np.clip(move[1], -2, 2)
    return Duel(yes, no, w * scale, float(b), float(slope), float(shift))


def fit_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, penalty: float = 1e-4,
                  steps: int = 60) -> LanguageModel:
    """Learn from rows that are not held out and have a language and a letter.

    The sample is bounded: ``per_language`` rows of each language at most, by a hash of text and id,
    and of these whole texts of ``SAMPLE_GRAMS`` distinct n-grams together; a text that is beyond what
    is left is passed over for the next. Only their hashed counts reach the driver, in one row
    after another. More than ``LANGUAGES`` languages raise.
    """
    rows = (docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id")))
            .filter("lang IS NOT NULL AND text IS NOT NULL"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
              .limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages; the sample of so many is not bounded")
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(1.2 * per_language / n)).otherwise(share)
    rank = F.xxhash64("text", "doc_id")
    chance = F.pmod(rank, F.lit(1_000_003)) / 1_000_003

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            keep = [i for i, t in enumerate(texts) if has_letter(t)]
            at = pa.array(keep, pa.int64())
            for start in range(0, len(keep), 64):
                found = [gram_counts(texts[i]) for i in keep[start:start + 64]]
                yield pa.RecordBatch.from_pydict({
                    "lang": batch.column("lang").take(at[start:start + 64]),
                    "rank": batch.column("rank").take(at[start:start + 64]),
                    "buckets": pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                    "counts": pa.array([f[1] for f in found], pa.list_(pa.int64()))})

    drawn = materialize(rows.withColumn("rank", rank).filter(chance < share).select("text", "lang", "rank")
                        .mapInArrow(features, "lang string, rank bigint, buckets array<int>, counts array<bigint>"),
                        "sample")
    # Of rows that are equal in id and text one: their number is no bound of anything.
    place = Window.partitionBy("lang").orderBy("rank")
    first = (drawn.select("lang", "rank").distinct().withColumn("place", F.row_number().over(place))
             .filter(F.col("place") <= per_language).select("lang", "rank", "place"))
    chosen = drawn.dropDuplicates(["lang", "rank"]).join(F.broadcast(first), ["lang", "rank"])
    langs, buckets, shares, left = [], [], [], {lang: SAMPLE_GRAMS for lang in counts}
    for r in chosen.orderBy("lang", "place").toLocalIterator():
        if len(r["buckets"]) > left[r["lang"]]:
            continue
        left[r["lang"]] -= len(r["buckets"])
        langs.append(r["lang"])
        buckets.append(np.asarray(r["buckets"], dtype=np.int32))
        shares.append((np.asarray(r["counts"]) / np.sum(r["counts"])).astype(np.float32))
    discard(drawn)
    langs = np.array(langs, dtype=object)
    family = {lang: name for name, group in FAMILIES.items() for lang in group}
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family.get(lang, lang), []).append(lang)
    of = np.array([family.get(lang, lang) for lang in langs], dtype=object)

    def duels(kind: np.ndarray, names: list[str]) -> list[Duel]:
        out = []
        for yes, no in combinations(names, 2):
            pick = np.flatnonzero((kind == yes) | (kind == no))
            cols = np.concatenate([buckets[i] for i in pick])
            vals = np.concatenate([shares[i] for i in pick])
            rows = np.repeat(np.arange(len(pick)), [len(buckets[i]) for i in pick])
            out.append(_fit_duel(yes, no, rows, cols, vals, np.where(kind[pick] == yes, 1.0, -1.0),
                                 penalty, steps))
        return out

    found = duels(of, sorted(families))
    for name in sorted(families):
        found += duels(langs, families[name])
    return LanguageModel(families, found)


def _vote(names: list[str], chance: dict[tuple[str, str], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Winner per row by votes of the pairs, ties by summed chances; its mean chance."""
    votes, sums = np.zeros((n, len(names))), np.zeros((n, len(names)))
    place = {name: i for i, name in enumerate(names)}
    for (yes, no), p in chance.items():
        if yes in place and no in place:
            votes[:, place[yes]] += p >= 0.5
            votes[:, place[no]] += p < 0.5
            sums[:, place[yes]] += p
            sums[:, place[no]] += 1 - p
    won = np.argmax(votes + sums / (len(names) + 1), axis=1)
    mean = sums[np.arange(n), won] / (len(names) - 1) if len(names) > 1 else np.ones(n)
    return won, mean


def predict_texts(model: LanguageModel, weights: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every text."""
    names, n = sorted(model.families), len(texts)
    known = np.array([bool(model.families) and has_letter(t) for t in texts], dtype=bool)
    sums, numbers = gram_sums(texts, weights)
    margins = sums / np.maximum(numbers, 1)[:, None]
    chance = {(d.yes, d.no): 1 / (1 + np.exp(-np.clip(d.slope * (margins[:, i] + d.bias) + d.shift, -30, 30)))
              for i, d in enumerate(model.duels)}
    lang, score = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
    if names:
        family, sure = _vote(names, chance, n)
        for i, name in enumerate(names):
            group = model.families[name]
            won, within = _vote(group, chance, n)
            here = known & (family == i)
            lang[here] = np.array(group, dtype=object)[won[here]]
            score[here] = (sure * within)[here]
    return lang, score


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from the whole text alone.

    ``und`` with score 0 if the text is NULL or has no letter, or nothing was learned. The score is
    the chance of the family times that of the language within it. Repeated rows get equal
    results; an empty table gives no rows; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, model.weights().astype(np.float32)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            lang, score = predict_texts(*shared.value, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)],
                names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                       "text")
    return rows.mapInArrow(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_languages(docs: DataFrame, model: LanguageModel, wanted: list[str] | None = None,
                   least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents in a ``wanted`` language (NULL: any learned one), predicted with ``least_score``.

    A document without a letter goes, as it has no language. Where nothing was learned, nothing
    can be said of a language, and every document with a letter stays. Rows are judged one by one
    and keep all their columns.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model, model.weights().astype(np.float32)))

    def keeps():
        model, weights = shared.value

        def keep(texts: list[str]) -> np.ndarray:
            if not model.families:
                return np.array([has_letter(t) for t in texts], dtype=bool)
            lang, score = predict_texts(model, weights, texts)
            fits = (lang != UNDETERMINED) & (score >= least_score)
            return fits if wanted is None else fits & np.isin(lang.astype(str), wanted)

        return keep

    return keep_rows(docs, keeps)
