"""The block kernel against a direct statement of MaxSim."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lateweave.functions.gate import Gate, gate_block, gate_udf, gate_value, init_gate, with_gate_weights
from lateweave.functions.vectors import l2_normalise, maxsim, weighted_maxsim
from lateweave.operators import scoring
from lateweave.operators.scoring import score_topk
from lateweave.operators.tokens import (
    embed_tokens, embedding_drift, pack_tokens, token_batches, truncate_packed, truncate_tokens,
    unpack_tokens,
)
from workload.encoder import make_encoder

DIM = 6
GATE = Gate([0.7, -0.4, 0.2, 0.0, -0.9, 0.5], 0.3)


def make(seed=0, n_queries=9, n_docs=40, splits=("a", "b", "c")):
    rng = np.random.default_rng(seed)

    def toks(most):
        return rng.standard_normal((rng.integers(0, most + 1), DIM)).astype("float32")

    queries = [(splits[i % 2], f"q{i}", toks(5)) for i in range(n_queries)]
    docs = [(splits[i % len(splits)], f"d{i}", toks(7)) for i in range(n_docs)]
    docs += [(s, i + "-copy", t) for s, i, t in docs[:12]]          # exact ties
    masks = [rng.random(len(t)) < 0.6 for _, _, t in docs]
    return queries, docs, masks


def frames(spark, queries, docs, masks=None):
    q = spark.createDataFrame([(s, i, [list(map(float, v)) for v in t]) for s, i, t in queries],
                              "split string, qid string, toks array<array<float>>")
    rows = [(s, i, [list(map(float, v)) for v in t], m.tolist())
            for (s, i, t), m in zip(docs, masks or [np.ones(len(t), bool) for _, _, t in docs])]
    d = spark.createDataFrame(rows, "split string, doc_id string, toks array<array<float>>, mask array<boolean>")
    return q, d if masks else d.drop("mask")


def one_score(q, d, mask, mode):
    q, d = q.astype("float64"), d.astype("float64")
    sims = q @ d.T
    sims[:, ~mask] = -1e4
    best = sims.max(axis=1) if sims.shape[1] else np.full(len(q), -1e4)
    w = np.ones(len(q)) if mode == "plain" else gate_block(q, GATE) if len(q) else np.zeros(0)
    total = float((best * w).sum())
    return total / max(w.sum(), 1e-6) if mode == "norm" else total


def brute(queries, docs, masks, mode, k):
    out = {}
    for qs, qid, q in queries:
        scored = [(i, one_score(q, d, m, mode)) for (ds, i, d), m in zip(docs, masks) if ds == qs]
        scored.sort(key=lambda x: (-round(x[1], 9), x[0]))
        out[qid] = [(i, round(s, 6)) for i, s in scored[:k]]
    return out


def collected(ranked):
    out = {}
    for r in ranked.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.doc_id, round(r.score, 6)))
    return out


@pytest.mark.parametrize("mode", ["plain", "norm", "unnorm"])
@pytest.mark.parametrize("masked", [False, True])
def test_topk_matches_brute_force(spark, mode, masked, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_TOKENS", 11)     # many blocks on small data
    queries, docs, masks = make()
    seen = masks if masked else [np.ones(len(t), bool) for _, _, t in docs]
    q, d = frames(spark, queries, docs, masks if masked else None)
    if mode != "plain":
        q = with_gate_weights(q, GATE)
    want = brute(queries, docs, seen, mode, 8)
    assert collected(score_topk(q, d, 8, mode)) == want
    assert collected(score_topk(q, d.repartition(5), 8, mode)) == want
    assert collected(score_topk(q, d, 8, mode, partitions=3)) == want


def test_several_passes_give_the_same_result(spark):
    queries, docs, masks = make(1)
    q, d = frames(spark, queries, docs)
    want = brute(queries, docs, [np.ones(len(t), bool) for _, _, t in docs], "plain", 8)
    assert collected(score_topk(q, d, 8, pass_bytes=400)) == want
    assert collected(score_topk(q, d.repartition(3), 8, pass_bytes=400, chunk_bytes=300)) == want


def test_documents_are_read_once_for_all_passes(spark, tmp_path, monkeypatch):
    queries, docs, masks = make(5)
    q, d = frames(spark, queries, docs, masks)
    d.write.parquet(str(tmp_path / "docs"))
    d = spark.read.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(type(q), "toArrow", None)       # nothing of several passes goes through the driver
    got = score_topk(with_gate_weights(q, GATE), d, 8, "norm", pass_bytes=400)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "MapInArrow" in plan
    assert collected(got) == brute(queries, docs, masks, "norm", 8)


def test_single_precision_only_preselects(spark):
    """Scores that differ by less than single precision tells apart, in any order of documents."""
    rng = np.random.default_rng(11)
    base = rng.standard_normal(DIM)
    docs = [("a", f"d{i:03}", (base + 1e-8 * rng.standard_normal(DIM)).reshape(1, -1)) for i in range(300)]
    queries = [("a", "q", base.reshape(1, -1)), ("a", "r", np.stack([base, -base]))]
    schema = "split string, {} string, toks array<array<double>>"
    q = spark.createDataFrame([(s, i, t.tolist()) for s, i, t in queries], schema.format("qid"))
    d = spark.createDataFrame([(s, i, t.tolist()) for s, i, t in docs], schema.format("doc_id"))
    got = score_topk(q, d.repartition(3), 5).collect()
    for _, qid, toks in queries:
        scores = {i: float((toks @ t.T).max(axis=1).sum()) for _, i, t in docs}
        want = sorted(scores, key=lambda i: (-round(scores[i], 10), i))[:5]
        assert [r.doc_id for r in sorted((r for r in got if r.qid == qid), key=lambda r: r["rank"])] == want


def test_rounding_bound_holds():
    rng = np.random.default_rng(3)
    for size in (1e-3, 1.0, 1e4):
        toks = size * rng.standard_normal((60, 16))
        chunk = scoring.Chunk(None, toks, np.arange(0, 60, 3), np.full(20, 3), np.zeros(60, dtype=bool))
        w = rng.random(8)
        block = scoring.QueryBlock(np.array(["q", "r"]), rng.standard_normal((8, 16)), w, np.array([0, 5]),
                                   np.array([w[:5].sum(), 1.0]))
        single = scoring.single_scores(chunk, block, scoring.Scratch("float32"))
        double = scoring.double_scores(chunk, block, np.ones((20, 2), dtype=bool), scoring.Scratch("float64"))
        gap = np.abs(single - double.reshape(20, 2)).max(axis=0)
        assert (gap <= scoring.rounding_bound(chunk, block)).all() and gap.max() > 0


def test_vectors_of_unequal_sizes_raise(spark):
    q = spark.createDataFrame([("a", "q", [[1.0, 2.0]])], "split string, qid string, toks array<array<float>>")
    d = spark.createDataFrame([("a", "d", [[1.0], [2.0, 3.0, 4.0]])], "split string, doc_id string, toks array<array<float>>")
    with pytest.raises(Exception, match="unequal sizes"):
        score_topk(q, d, 3).collect()


def test_query_beyond_a_pass_raises(spark):
    q, d = frames(spark, *make(1)[:2])
    with pytest.raises(ValueError, match="truncate"):
        score_topk(q, d, 8, pass_bytes=50)


def test_single_precision_ranks_alike(spark):
    queries, docs, _ = make(2)
    q, d = frames(spark, queries, docs)
    a = collected(score_topk(q, d, 8))
    b = collected(score_topk(q, d, 8, dtype="float32"))
    for qid, rows in a.items():
        assert [s for _, s in rows] == pytest.approx([s for _, s in b[qid]], abs=1e-3)


def test_uniform_weights_rank_like_plain(spark):
    queries, docs, _ = make(3)
    queries = [x for x in queries if len(x[2])]
    q, d = frames(spark, queries, docs)
    plain = collected(score_topk(q, d, 8))
    no_op = collected(score_topk(with_gate_weights(q, init_gate(DIM)), d, 8, "norm"))
    assert {k: [i for i, _ in v] for k, v in plain.items()} == \
           {k: [i for i, _ in v] for k, v in no_op.items()}


def test_queries_without_tokens_only(spark):
    empty = np.zeros((0, DIM), "float32")
    q, d = frames(spark, [("a", "q", empty)], [("a", "d1", empty), ("a", "d2", np.ones((2, DIM), "float32"))])
    assert collected(score_topk(q, d, 5)) == {"q": [("d1", 0.0), ("d2", 0.0)]}


def test_null_mask_hides_nothing(spark):
    queries, docs, masks = make(8)
    q, d = frames(spark, queries, docs, masks)
    part = d.withColumn("mask", F.when(F.col("doc_id").endswith("copy"), F.col("mask")))
    seen = [m if i.endswith("copy") else np.ones(len(t), bool) for (_, i, t), m in zip(docs, masks)]
    assert collected(score_topk(q, part, 8)) == brute(queries, docs, seen, "plain", 8)
    one = part.where("mask is null").limit(1).select(
        maxsim(F.col("toks"), F.col("toks"), F.col("mask")).alias("a"),
        maxsim(F.col("toks"), F.col("toks")).alias("b")).first()
    assert one.a == one.b


def test_guards(spark):
    q, d = frames(spark, *make()[:2])
    with pytest.raises(ValueError, match="mode"):
        score_topk(q, d, mode="max")
    with pytest.raises(ValueError, match="w"):
        score_topk(q, d, mode="norm")
    with pytest.raises(ValueError, match="toks"):
        score_topk(q, d.drop("toks"))


def test_pair_expressions_match(spark):
    queries, docs, masks = make(4)
    pairs = [(qid, i, q, t, m) for _, qid, q in queries for (_, i, t), m in zip(docs, masks)]
    df = spark.createDataFrame(
        [(a, b, q.astype(float).tolist(), t.astype(float).tolist(), m.tolist()) for a, b, q, t, m in pairs],
        "qid string, doc_id string, toks array<array<double>>, d array<array<double>>, m array<boolean>")
    q, d, m, w = F.col("toks"), F.col("d"), F.col("m"), F.col("w")
    got = with_gate_weights(df, GATE).select(
        "qid", "doc_id", maxsim(q, d).alias("plain"), weighted_maxsim(q, w, d, m).alias("norm"),
        weighted_maxsim(q, w, d, mode="unnorm").alias("unnorm"))
    by_id = {(a, b): (q, t, m) for a, b, q, t, m in pairs}
    for r in got.collect():
        q_, t_, m_ = by_id[r.qid, r.doc_id]
        full = np.ones(len(t_), bool)
        assert r.plain == pytest.approx(one_score(q_, t_, full, "plain"), abs=1e-6)
        assert r.norm == pytest.approx(one_score(q_, t_, m_, "norm"), abs=1e-6)
        assert r.unnorm == pytest.approx(one_score(q_, t_, full, "unnorm"), abs=1e-6)


def test_gate_forms_agree(spark):
    rng = np.random.default_rng(5)
    mlp = Gate([1.0, -2.0, 0.5], 0.1, rng.standard_normal((3, DIM)).tolist(), [0.2, -0.1, 0.0])
    v = rng.standard_normal((50, DIM))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "i int, v array<double>")
    for gate in (GATE, mlp):
        want = gate_block(v, gate)
        rows = df.select("i", gate_value(F.col("v"), gate).alias("a"), gate_udf(gate)("v").alias("b"))
        wide = df.select("i", F.array("v", "v").alias("toks")).unionByName(
            df.limit(1).select(F.lit(-1).alias("i"), F.array().cast("array<array<double>>").alias("toks")))
        none = wide.limit(1).select(F.lit(-2).alias("i"), F.lit(None).cast("array<array<double>>").alias("toks"))
        for r in with_gate_weights(wide.unionByName(none), gate).collect():
            assert r.w == (None if r.i == -2 else pytest.approx([want[r.i]] * 2 if r.i >= 0 else []))
        short = df.limit(1).select(F.array(F.slice("v", 1, 1)).alias("toks"))
        with pytest.raises(Exception, match="the gate takes vectors of"):
            with_gate_weights(short, gate).collect()
        for r in rows.collect():
            assert r.a == pytest.approx(want[r.i]) and r.b == pytest.approx(want[r.i])


def test_pack_unpack_truncate(spark):
    rows = [("x", p, [float(p), 0.0], p % 2 == 0) for p in range(12)] + [("y", 0, [9.0, 9.0], True)]
    long = spark.createDataFrame(rows, "id string, pos int, v array<float>, mask boolean")
    packed = pack_tokens(long.repartition(5), ["id"], ["mask"])
    got = {r.id: (r.toks, r["mask"]) for r in packed.collect()}
    assert [t[0] for t in got["x"][0]] == list(map(float, range(12)))
    assert got["x"][1] == [p % 2 == 0 for p in range(12)]
    assert unpack_tokens(packed, ["id"]).count() == 13
    assert truncate_tokens(long, 4).count() == 5
    assert [len(r.toks) for r in truncate_packed(packed, 4).orderBy("id").collect()] == [4, 1]


def test_embed_tokens(spark):
    texts = ["a b  a", "", "c"] + ["w%d x" % i for i in range(70)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: np.array(r.toks) for r in embed_tokens(df, make_encoder, ["id"]).collect()}
    encode = make_encoder()
    for i, want in enumerate(encode(texts)):
        assert len(got[i]) == len(want)
        if len(want):
            np.testing.assert_allclose(got[i], want, atol=1e-6)
    capped = embed_tokens(df, make_encoder, ["id"], max_tokens=1, partitions=3)
    assert {len(r.toks) for r in capped.collect()} == {0, 1}


def test_normalise(spark):
    r = spark.createDataFrame([([3.0, 4.0],)], "v array<float>").select(l2_normalise(F.col("v"))).first()
    assert r[0] == pytest.approx([0.6, 0.8])


def test_drift(spark):
    def table(rows):
        return spark.createDataFrame(rows, "id string, pos int, v array<double>")

    old = table([(i, 0, [1.0, 2.0]) for i in "abcd"])
    new = table([("a", 0, [1.01, 2.0, 0.5]), ("b", 0, [1.2, 2.0, 0.5]),
                 ("c", 0, [1.0, 2.0, 0.0]), ("d", 0, [1.0, 2.0])])
    got = {r.id: (round(r.head_drift, 6), r.tail_max, r.ok) for r in embedding_drift(old, new).collect()}
    assert got == {"a": (0.01, 0.5, True), "b": (0.2, 0.5, False), "c": (0.0, 0.0, False),
                   "d": (0.0, 0.0, False)}


def test_many_small_queries_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(scoring, "CANDIDATE_BYTES", 3 * 8 * scoring.CANDIDATE_ROW_BYTES)
    queries, docs, _ = make(6)
    q, d = frames(spark, queries, docs)
    numbered, n = scoring._passes(q, 8, scoring.QUERY_PASS_BYTES, 8)
    assert n >= 3 and numbered.groupBy("_pass").count().agg({"count": "max"}).first()[0] <= 3
    want = brute(queries, docs, [np.ones(len(t), bool) for _, _, t in docs], "plain", 8)
    assert collected(score_topk(q, d, 8)) == want


def test_long_texts_are_worked_through_in_blocks(monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_TOKENS", 7)
    rng = np.random.default_rng(7)
    docs, queries = rng.standard_normal((40, 3)), rng.standard_normal((25, 3))
    hidden = rng.random(40) < 0.5
    sims = docs @ queries.T
    scratch = scoring.Scratch("float64")
    one = scoring.best_per_token(docs, np.array([0]), queries, None, scratch)
    np.testing.assert_allclose(one[0], sims.max(axis=0))
    sims[hidden] = -1e4
    masked = scoring.best_per_token(docs, np.array([0]), queries, hidden, scratch)
    np.testing.assert_allclose(masked[0], sims.max(axis=0))
    assert len(scratch.flat) <= 49


def test_batches_by_tokens():
    tokens = np.array([5, 100, 1, 7, 30, 7])
    batches = token_batches(tokens, 30)
    assert sorted(np.concatenate(batches).tolist()) == list(range(6))
    assert all(len(b) * tokens[b].max() <= 30 or len(b) == 1 for b in batches)
    assert [len(b) for b in token_batches(tokens, 10_000, 4)] == [4, 2] and token_batches(tokens[:0]) == []


def test_the_encoder_is_given_the_limit_and_rows_keep_their_order(spark):
    """A text of 20,000 words is not encoded past its limit; batches by length come back in order."""
    texts = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in enumerate([20_000, 0, 3, 900, 1, 40] * 5)]

    def make():
        plain = make_encoder()

        def encode(texts, max_tokens=None):
            out = plain(texts, max_tokens)
            assert max_tokens == 50 and max(map(len, out)) <= 50 and len(texts) <= 2_000 // max(1, *map(len, out))
            return out
        return encode

    df = spark.createDataFrame(texts, "id long, text string").coalesce(2)
    rows = embed_tokens(df, make, ["id"], max_tokens=50, batch_tokens=2_000)
    got = [(r.id, len(r.toks), r.toks[-1] if r.toks else None) for r in rows.collect()]
    plain = make_encoder()
    assert [g[:2] for g in got] == [(i, min(50, len(t.split()))) for i, t in texts]
    for (_, _, last), (_, t) in zip(got, texts):
        want = plain([t], 50)[0]
        assert last is None and not len(want) or last == pytest.approx(want[-1].tolist(), abs=1e-6)


def test_inner_product_of_unequal_sizes_raises(spark):
    from lateweave.functions.vectors import dot

    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([], []), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(dot(F.col("a"), F.col("b"))).collect()] == [11.0, 0.0, None]
    bad = spark.createDataFrame([([1.0, 2.0], [3.0])], "a array<double>, b array<double>")
    with pytest.raises(Exception, match="equal size"):
        bad.select(dot(F.col("a"), F.col("b"))).collect()
    with pytest.raises(Exception, match="equal size"):
        bad.select(maxsim(F.array("a"), F.array("b"))).collect()
