"""Repeated passages against plain sets of word tuples, and the parts of the prefilter."""

import hashlib
import random
import re

import numpy as np
import pandas as pd
import pytest

from lateweave.llm import passages
from lateweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, window):
    """(doc_id, n_words, removed words, kept text) of (doc_id, text) rows."""
    texts = [(i, re.findall("[^\\x20\\x09-\\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, words in texts:
        for p in range(len(words) - window + 1 if i is not None else 0):
            key = tuple(words[p:p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, words in texts:
        gone = set()
        for p in range(len(words) - window + 1 if i is not None else 0):
            if first[tuple(words[p:p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(out, key=str)


def rows_of(df):
    got = df.collect()
    for r in got:
        assert r.n_removed == sum(x.n for x in r.removed)
        assert all(a.first + a.n < b.first for a, b in zip(r.removed, r.removed[1:]))
    return sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got], key=str)


def test_whole_table(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    got = QUERIES["op11_repeated_passages"](spark, SF).collect()
    want = brute(zip(d.doc_id.tolist(), d.text), 50)
    assert sum(n for _, _, n, _ in want) > 0
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == sorted(
        [(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in want], key=str)


def mosaics(seed, n=150):
    """Documents put together from shared passages, some copied whole, some ids repeated."""
    rng = random.Random(seed)
    passages_ = [[f"w{rng.randrange(40)}" for _ in range(rng.randint(3, 40))] for _ in range(25)]
    rows = []
    for i in range(n):
        words = [w for _ in range(rng.randint(0, 6)) for w in rng.choice(passages_)]
        rows.append((rng.randrange(n) if rng.random() < 0.1 else 1000 + i, " ".join(words)))
    rows += [(2000 + i, t) for i, (_, t) in enumerate(rows[:20])] + [(None, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,anchor", [(10, 5), (7, 7), (8, 1)])
def test_mosaics(spark, window, anchor):
    rows = mosaics(window)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(passages.drop_repeated_passages(frame, window, anchor)) == brute(rows, window)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """A sketch that takes every window for a repeated one only makes more work."""
    rows = mosaics(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(passages.Sketch, "repeated", lambda self, keys: np.ones(len(keys), dtype=bool))
    assert rows_of(passages.drop_repeated_passages(frame, 10, 5)) == brute(rows, 10)


def test_sketch_overestimates_only(spark):
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 63, size=60_000, dtype=np.uint64)
    parts = [rng.choice(keys, size=20_000) for _ in range(4)]
    whole = passages.Sketch(1 << 20)
    merged = passages.Sketch(1 << 20)
    held = {}
    for part in parts:
        one = passages.Sketch(1 << 20)
        one.add(part)
        whole.add(part)
        for i, raw in one.slices():
            once, again = passages.unpack(raw)
            a, b = held.get(i, (np.zeros_like(once), np.zeros_like(again)))
            held[i] = (a | once, b | again | (a & once))
    for i, (once, again) in held.items():
        merged.put(i, once, again)
    np.testing.assert_array_equal(merged.once, whole.once)
    np.testing.assert_array_equal(merged.again, whole.again)
    n = pd.Series(np.concatenate(parts)).value_counts()
    said = whole.repeated(n.index.to_numpy())
    assert said[n.to_numpy() > 1].all() and said[n.to_numpy() == 1].mean() < 0.05


def test_merged_by_tasks_as_by_one(spark, monkeypatch):
    frame = spark.createDataFrame(mosaics(9), "doc_id long, text string")
    one = passages.sketch_windows(frame.coalesce(1), 1 << 20, 1, 10, 5)
    many = passages.sketch_windows(frame.repartition(7), 1 << 20, 9 * passages.TASK_BYTES, 10, 5)
    np.testing.assert_array_equal(one.again, many.again)
    np.testing.assert_array_equal(one.once, many.once)


def test_run_hashes_and_anchors():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 3, size=400).astype(np.uint64)
    for size in (1, 2, 5, 25, 50):
        h = passages.run_hashes(words, size)
        assert len(h) == 400 - size + 1
        seen = {}
        for i, v in enumerate(h.tolist()):
            assert seen.setdefault(tuple(words[i:i + size].tolist()), v) == v
        assert len(set(seen.values())) == len(seen)
    h = passages.run_hashes(words, 5)
    assert passages.anchors(words, 12, 5).tolist() == [h[i:i + 8].min() for i in range(400 - 11)]
    assert len(passages.run_hashes(words[:3], 5)) == 0


def test_words_do_not_depend_on_slices(spark):
    text = " a\tbc\n　 x  日本語\r\x0b\x0cé " + "y" * 70_000 + " end"
    data = np.frombuffer((text + text).encode(), np.uint8)
    n = len(text.encode())
    a, b, counts = passages.hash_words(data, np.array([0, 0, n, n, 2 * n]))
    words = re.findall("[^\\x20\\x09-\\x0D]+", text)
    assert counts.tolist() == [0, len(words), 0, len(words)]
    assert (a[:len(words)] == a[len(words):]).all() and len(set(zip(a, b))) == len(set(words))


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a b"), (4, "a b"), (None, long), (5, long), (6, long),
            (7, long.upper()), (8, "head " + long[200_000:] + " tail"), (9, ("same " * 120).strip()), (9, "same " * 60),
            (10, "same " * 55), (11, "same " * 80), (-5, "same " * 50), (12, "z" * 100_000)]
    schema = "doc_id long, text string, row long, words string, runs string, at int, kept string"
    frame = spark.createDataFrame([(i, t, 1, "x", "y", 3, "k") for i, t in rows], schema)
    assert rows_of(passages.drop_repeated_passages(frame)) == brute(rows, 50)
    assert passages.drop_repeated_passages(frame.limit(0)).collect() == []
    with pytest.raises(ValueError):
        passages.drop_repeated_passages(frame, 5, 6)
