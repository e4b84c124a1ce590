"""Spelling variants against all pairs of words, and the parts of the gram index."""

import random
import re
import zlib
from collections import Counter

import pandas as pd
import pytest

from lateweave.llm import variants
from lateweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def counted(rows):
    """Words of (doc_id, text) rows by the contract, letter by letter."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    total = Counter()
    for doc_id, text in rows:
        if doc_id is None or text is None:
            continue
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    return out - {word}


def brute(counts):
    letters = sorted(set("".join(counts)))
    near = {w: [x for x in edits(w, letters) if x in counts] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), None if form[w] is None else counts[form[w]])
            for w, n in counts.items()}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_whole_table(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    got = QUERIES["op13_spelling_variants"](spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got_rows = got.collect()
    want = brute(counted(zip(d.doc_id.tolist(), d.text)))
    assert len(got_rows) == len(want) > 100
    assert {tuple(r) for r in got_rows} == want


@pytest.mark.parametrize("frequent,block", [(0, 3), (2, 4), (10, 2048)])
def test_dense_words(spark, frequent, block):
    """Few letters, so that most words are near others: every setting of the index finds all pairs."""
    rng = random.Random(frequent)
    words = {"".join(rng.choice("abß") for _ in range(rng.randint(5, 8))) for _ in range(250)}
    words |= {"a" * n for n in range(5, 50)} | {"b" * 40 + c for c in ("", "a", "ba")}
    table = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = variants.near_words(table, frequent, block).collect()
    letters = sorted(set("".join(words)))
    want = {tuple(sorted((w, x))) for w in words for x in edits(w, letters) if x in words}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    n = {w: 3 + i for i, w in enumerate(sorted(words))}
    assert all((r.na, r.nb) == (n[r.a], n[r.b]) for r in got)


def test_small_dictionary_loses_nothing(spark):
    words = [f"wort{a}{b}{c}" for a in "abcd" for b in "efg" for c in ("", "x", "yz")]
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    some = {(r.a, r.b) for r in variants.near_words(table, 0, 2048, dictionary=3).collect()}
    assert some == {(r.a, r.b) for r in variants.near_words(table).collect()}
    assert some == {(a, b) for a in words for b in words if a < b and variants.one_edit(a, b)}


def test_bound_holds_for_every_edit():
    """Grams that survive an edit are at least all grams but the bound."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(200)]
    grams = Counter()
    for w in words:
        x = f"\x02{w}\x03"
        grams.update({x[p:p + q] for q in range(2, 6) for p in range(len(x) - q + 1)})
    dictionary = {g: n for g, n in grams.items() if n > 12}
    for w in words[:60]:
        spans = variants.variable_grams(w, dictionary)
        mine = {(w_, p) for p, e in spans for w_ in [f"\x02{w}\x03"[p:e]]}
        for x in edits(w, "abc"):
            theirs = variants.variable_grams(x, dictionary)
            marked = f"\x02{x}\x03"
            left = {(marked[p:e], p) for p, e in theirs}
            right = {(marked[p:e], p + len(w) - len(x)) for p, e in theirs}
            kept = len(mine & (left | right))
            assert kept >= len(spans) - variants.affected_bound(spans) >= 1


def test_odd_rows(spark):
    schema = "doc_id long, text string, word string, form string, n long, key long"
    rows = [(1, None), (2, ""), (None, "hidden hidden hidden hidden"), (3, "Straße STRASSE straße Straße"),
            (4, "straße straßen straßen straßen 12 ×÷×÷× ×÷×÷× ×÷×÷×"), (4, "straße " * 9),
            (5, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5000 + " " + ("x" * 5001 + " ") * 6)]
    frame = spark.createDataFrame([(i, t, "w", "f", 1, 2) for i, t in rows], schema)
    got = variants.spelling_variants(frame)
    assert rows_of(got) == brute(counted(rows))
    assert any(len(r.word) >= 4999 for r in got.collect())
    assert variants.spelling_variants(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        variants.spelling_variants(frame, least_letters=4)
