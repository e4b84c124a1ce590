"""A task looks at a wide Arrow batch in pieces of bounded size, and Spark bounds the batch itself by bytes."""

import numpy as np
import pyarrow as pa
import pytest

from lateweave import session
from lateweave.operators import scoring
from lateweave.operators.scoring import score_topk
from lateweave.operators.tokens import embed_tokens, vector_lists
from test_scoring_index import corpus, tables
from workload.encoder import make_encoder


def wide(n_docs=900, words=400, dim=64):
    """One batch of 92 MB of vectors."""
    vocabulary = np.random.default_rng(3).standard_normal((words, dim)).astype("float32")
    toks = vector_lists([np.roll(vocabulary, i, axis=0) for i in range(n_docs)])
    return pa.RecordBatch.from_arrays([pa.array(["a"] * n_docs), pa.array([f"d{i:04}" for i in range(n_docs)]), toks],
                                      names=["split", "doc_id", "toks"])


def test_a_task_looks_at_a_wide_batch_in_pieces(monkeypatch):
    seen, made = [], scoring.doc_index
    monkeypatch.setattr(scoring, "doc_index", lambda rows: seen.append((rows.num_rows, rows.nbytes)) or made(rows))
    batch = wide()
    _, q = tables(*corpus(1, dim=64))
    run = scoring._local_topk(lambda: [scoring.query_blocks(q, "norm")], 5, "float64", scoring.CHUNK_BYTES)
    assert sum(b.num_rows for b in run([batch])) >= 5 * q.num_rows
    assert sum(n for n, _ in seen) == batch.num_rows
    assert max(size for _, size in seen) < 10 << 20 < batch.nbytes


@pytest.mark.parametrize("limit", [1, 100, 3_000, 1 << 30])
def test_pieces_are_the_rows_of_the_batch(limit):
    docs, masks, queries, weights = corpus(2)
    table, _ = tables(docs, masks, queries, weights)
    toks = table["toks"].to_pylist()
    toks[9] = None
    table = table.set_column(2, "toks", pa.array(toks, table["toks"].type))
    batch = table.combine_chunks().to_batches()[0].slice(2, 50)
    got = list(scoring.pieces(batch, limit))
    assert pa.concat_tables(got).equals(pa.Table.from_batches([batch]))
    assert all(p.num_rows == 1 or sum(len(d or []) for d in p["toks"].to_pylist()) * 20 <= limit for p in got)
    assert not list(scoring.pieces(batch.slice(0, 0), limit))


def test_a_chunk_of_any_size_gives_the_same_documents(monkeypatch):
    docs, masks, queries, weights = corpus(4, n_docs=200)
    d, q = tables(docs, masks, queries, weights)
    blocks = scoring.query_blocks(q, "norm")
    whole = scoring.pieces

    def best(limit, chunk_bytes):
        monkeypatch.setattr(scoring, "pieces", lambda batch: whole(batch, limit))
        run = scoring._local_topk(lambda: [blocks], 6, "float64", chunk_bytes, True)
        rows = pa.Table.from_batches(list(run(d.to_batches()))).to_pylist()
        return {i: sorted((-r["grade"], r["doc_id"]) for r in rows if r["qid"] == i)[:6] for i in q["qid"].to_pylist()}

    assert best(2_000, 50_000) == best(40_000, 300_000) == best(1 << 30, 1 << 30)


@pytest.mark.parametrize("set_by_user", [None, "1048576"])
def test_batches_of_wide_rows_are_bounded_by_bytes(spark, set_by_user):
    key = session._BATCH_BYTES_KEY
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    if set_by_user:
        spark.conf.set(key, set_by_user)
    try:
        texts = spark.range(4000).selectExpr("'a' AS split", "string(id) AS doc_id", "repeat('word ', 2000) AS text")
        embedded = embed_tokens(texts, make_encoder, ["split", "doc_id"], max_tokens=400)
        queries = embedded.limit(1).withColumnRenamed("doc_id", "qid")
        assert score_topk(queries, embedded.limit(20), 3).count() == 3
        most = int(set_by_user or session.BATCH_BYTES)
        assert spark.conf.get(key) == str(most)

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})

        got = texts.coalesce(1).mapInArrow(sizes, "rows long, size long").collect()
        assert sum(r["rows"] for r in got) == 4000
        assert max(r["size"] for r in got) < 1.1 * most
    finally:
        spark.conf.unset(key)
        if before is not None:
            spark.conf.set(key, before)
