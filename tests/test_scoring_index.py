"""Long documents: the index of distinct vectors against plain products."""

import numpy as np
import pyarrow as pa
import pytest

from lateweave.operators import scoring
from lateweave.operators.tokens import vector_lists
from workload.encoder import make_encoder


def corpus(seed, n_docs=60, n_queries=7, words=400, longest=300, dim=5):
    """Documents of repeated words: some long, a copy, an empty one, one with all tokens hidden."""
    rng = np.random.default_rng(seed)
    vocabulary = rng.standard_normal((words, dim)).astype("float32")
    picks = (words * rng.random((n_docs, longest)) ** 2).astype(int)
    docs = [vocabulary[p[:rng.integers(80, longest)]] for p in picks]
    docs[3], docs[5] = docs[1], docs[5][:0]
    masks = [rng.random(len(d)) < 0.9 for d in docs]
    masks[3], masks[7] = masks[1], np.zeros(len(docs[7]), dtype=bool)
    queries = [np.concatenate([vocabulary[rng.integers(0, words, 3)], rng.standard_normal((2, dim))]).astype("float32")
               for _ in range(n_queries)]
    return docs, masks, queries, [rng.random(5) for _ in queries]


def tables(docs, masks, queries, weights):
    d = pa.table({"split": ["a"] * len(docs), "doc_id": [f"d{i:02}" for i in range(len(docs))],
                  "toks": vector_lists(docs), "mask": pa.array([m.tolist() for m in masks], pa.list_(pa.bool_()))})
    q = pa.table({"split": ["a"] * len(queries), "qid": [f"q{i}" for i in range(len(queries))],
                  "toks": vector_lists(queries), "w": pa.array([w.tolist() for w in weights], pa.list_(pa.float64()))})
    return d, q


def best(docs, masks, queries, weights, k):
    out = {}
    for i, (q, w) in enumerate(zip(queries, weights)):
        rows = []
        for j, (d, m) in enumerate(zip(docs, masks)):
            sims = q.astype("float64") @ d.astype("float64").T
            sims[:, ~m] = -1e4
            top = sims.max(axis=1) if len(d) else np.full(len(q), -1e4)
            rows.append((-round(float((top * w).sum() / w.sum()), 8), f"d{j:02}"))
        out[f"q{i}"] = [d for _, d in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("limit", [scoring.CLOSE_LIMIT, 40])
@pytest.mark.parametrize("chunk_bytes,rows", [(1 << 30, 60), (1 << 30, 11), (100_000, 7)])
def test_index_gives_the_same_documents(monkeypatch, limit, chunk_bytes, rows):
    monkeypatch.setattr(scoring, "CLOSE_LIMIT", limit)
    monkeypatch.setattr(scoring, "PLACES_AT_ONCE", 64)
    monkeypatch.setattr(scoring, "BLOCK_TOKENS", 16)
    monkeypatch.setattr(scoring, "best_documents", None)     # nothing is multiplied out
    for seed in range(4):
        docs, masks, queries, weights = corpus(seed)
        d, q = tables(docs, masks, queries, weights)
        blocks = scoring.query_blocks(q, "norm")
        run = scoring._local_topk(lambda: [blocks], 9, "float64", chunk_bytes, True)
        got = pa.Table.from_batches(list(run(d.to_batches(max_chunksize=rows)))).to_pylist()
        want = best(docs, masks, queries, weights, 9)
        for qid in want:
            mine = sorted((r for r in got if r["qid"] == qid), key=lambda r: (-r["grade"], r["doc_id"]))
            assert [r["doc_id"] for r in mine][:9] == want[qid]


def test_few_documents_and_negative_weights():
    docs, masks, queries, weights = corpus(9)
    for n, sign in [(4, 1), (60, -1)]:
        weights = [w * [sign, 1, 1, 1, 1] for w in weights]
        d, q = tables(docs[:n], masks[:n], queries, weights)
        blocks = scoring.query_blocks(q, "unnorm")
        run = scoring._local_topk(lambda: [blocks], 9, "float64", 1 << 30, True)
        got = pa.Table.from_batches(list(run(d.to_batches()))).to_pylist()
        sums = [w / w.sum() for w in weights] if sign == 1 else weights
        want = best(docs[:n], masks[:n], queries, [w if sign == 1 else w for w in sums], 9) if sign == 1 else None
        for i in range(len(queries)):
            mine = [r["doc_id"] for r in sorted((r for r in got if r["qid"] == f"q{i}"),
                                                key=lambda r: (-r["grade"], r["doc_id"]))]
            if sign == 1:
                assert mine == want[f"q{i}"]
            else:
                score = {f"d{j:02}": sum(w * (np.where(m, d @ t, -1e4).max() if len(d) else -1e4)
                                         for t, w in zip(queries[i], weights[i]))
                         for j, (d, m) in enumerate(zip(docs, masks))}
                least = min(score[x] for x in mine)
                assert all(s <= least + 1e-3 for x, s in score.items() if x not in mine)


def test_vectors_with_equal_keys_are_kept_apart():
    rows = np.array([[1, 2], [3, 4], [1, 2], [5, 6]], dtype="float32")
    kept, same = scoring.numbered(rows)
    assert len(kept) == 3 and (rows[kept][same] == rows).all()
    unique = np.unique

    def colliding(key, **options):
        return unique(key // np.uint64(1 << 63), **options)

    np.unique = colliding
    try:
        kept, same = scoring.numbered(rows)
    finally:
        np.unique = unique
    assert (rows[kept][same] == rows).all()


def test_repeated_words_are_multiplied_once(monkeypatch):
    """The products grow with the distinct vectors, not with the tokens of the documents."""
    made = []
    shaped = scoring.Scratch.shaped
    monkeypatch.setattr(scoring.Scratch, "shaped", lambda self, r, c: made.append(r * c) or shaped(self, r, c))
    docs, masks, queries, weights = corpus(2, n_docs=400, words=150)
    d, q = tables(docs, [np.ones(len(x), bool) for x in docs], queries, weights)
    blocks = scoring.query_blocks(q, "norm")
    run = scoring._local_topk(lambda: [blocks], 5, "float64", 1 << 30)
    assert sum(b.num_rows for b in run(d.to_batches())) >= 5 * len(queries)
    assert sum(made) < sum(map(len, docs)) * sum(map(len, queries)) / 5


def test_the_encoder_forgets_words():
    texts = ["a b c a", " ".join(f"w{i}" for i in range(50)), "", "c b"]
    for mine, all_known in zip(make_encoder(7)(texts), make_encoder()(texts)):
        assert np.array_equal(mine, all_known)
