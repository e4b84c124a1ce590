import math
import os
import time

import numpy as np
import pytest

from lateweave.functions.gate import Gate, gate_block, gate_stats, init_gate
from lateweave.operators import gatefit
from lateweave.operators.gatefit import (
    align_triple, append_step_log, fit_gate, gate_features, gate_gradient, pairwise_loss, read_step_log,
    score_loss, text_features, triple_features,
)
from lateweave.schemas import STEP_LOG
from lateweave.session import write_scratch
from workload.encoder import make_encoder

DIM = 4
LINEAR = Gate([0.5, -1.0, 0.25, 0.1], 0.3)
MLP = Gate([1.0, -0.7, 0.4], 0.2, [[0.3, -0.2, 0.9, 0.1], [-0.5, 0.4, 0.2, 0.8], [0.6, 0.6, -0.3, 0.2]],
           [0.05, -0.02, 0.1])


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)

    def toks(n, most):
        return [rng.standard_normal((rng.integers(1, most + 1), DIM)).astype("float32") for _ in range(n)]

    qs, ds = toks(12, 4), toks(10, 6)
    triples = [(i, str(i % 12), str(0 if i % 2 else i % 10), str((i * 3 + 1) % 10)) for i in range(30)]
    triples.append((99, "0", "1", "missing"))
    as_rows = lambda arrays: [(str(i), a.astype(float).tolist()) for i, a in enumerate(arrays)]
    return (spark.createDataFrame(triples, "triple_id long, qid string, pos_id string, neg_id string"),
            spark.createDataFrame(as_rows(qs), "qid string, toks array<array<float>>"),
            spark.createDataFrame(as_rows(ds), "doc_id string, toks array<array<float>>"),
            [(qs[int(q)], ds[int(p)], ds[int(n)]) for _, q, p, n in triples[:-1]])


@pytest.fixture(scope="module")
def features(tables):
    return triple_features(*tables[:3]).cache()


def reference_loss(triples, gate, mode):
    out = []
    for q, p, n in triples:
        q, p, n = (x.astype("float64") for x in (q, p, n))
        w = gate_block(q, gate)
        x = (w * ((q @ p.T).max(1) - (q @ n.T).max(1))).sum()
        out.append(math.log1p(math.exp(-(x / max(w.sum(), 1e-6) if mode == "norm" else x))))
    return sum(out) / len(out)


def test_both_feature_paths_agree(tables, features):
    a = {r.triple_id: r.delta for r in features.collect()}
    b = {r.triple_id: r.delta for r in gate_features(align_triple(*tables[:3])).collect()}
    c = {r.triple_id: r.delta for r in triple_features(*tables[:3], hot_rows=4).collect()}
    assert len(a) == 30 and set(a) == set(b) == set(c)
    for i, (q, p, n) in enumerate(tables[3]):
        want = (q @ p.T).max(1) - (q @ n.T).max(1)
        for got in (a, b, c):
            assert got[i] == pytest.approx(want.tolist(), abs=1e-5)


@pytest.mark.parametrize("gate", [LINEAR, MLP])
@pytest.mark.parametrize("mode", ["unnorm", "norm"])
def test_loss_and_gradient(tables, features, gate, mode):
    triples = tables[3]
    row = pairwise_loss(features, gate, mode).first()
    assert row.n_triples == 30
    assert row.loss == pytest.approx(reference_loss(triples, gate, mode), abs=1e-6)
    got = {(r.param, r.idx): r.grad for r in gate_gradient(features, gate, mode).collect()}
    eps = 1e-5

    def moved(name, i, by):
        w, b, w1, b1 = list(gate.w), gate.b, [list(r) for r in gate.w1], list(gate.b1)
        if name == "b":
            b += by
        elif name == "w1":
            w1[i // DIM][i % DIM] += by
        else:
            {"w": w, "b1": b1}[name][i] += by
        return reference_loss(triples, Gate(w, b, w1, b1), mode)

    assert len(got) == len(gate.w) + 1 + len(gate.b1) * (DIM + 1)
    for (name, i), grad in got.items():
        assert grad == pytest.approx((moved(name, i, eps) - moved(name, i, -eps)) / (2 * eps), abs=1e-6)


def test_loss_of_equal_scores_is_ln_2(spark):
    df = spark.createDataFrame([(3.0, 3.0), (-2.0, -2.0)], "a double, b double")
    assert score_loss(df, "a", "b").first().loss == pytest.approx(math.log(2))
    wide = spark.createDataFrame([(1e4, -1e4), (-1e4, 1e4)], "a double, b double")
    assert score_loss(wide, "a", "b").first().loss == pytest.approx(1e4)


@pytest.mark.parametrize("batches", [1, 3])
def test_fit_lowers_the_loss_and_logs(spark, tmp_path, features, batches):
    saved = []
    path = str(tmp_path / "log")
    gate, log = fit_gate(features, dim=DIM, steps=6, batches=batches, lr=0.2, log_path=path,
                         save_steps=4, on_save=lambda step, g: saved.append(step))
    assert pairwise_loss(features, gate).first().loss < pairwise_loss(features, init_gate(DIM)).first().loss
    assert [e["step"] for e in log] == list(range(1, 7)) and saved == [4]
    first = log[0]
    no_op = 1 / (1 + math.exp(-5))
    assert [first[k] for k in ("head_w_mean", "head_w_min", "head_w_max")] == pytest.approx([no_op] * 3)
    assert first["head_w_std"] == pytest.approx(0.0)
    assert sorted(r.step for r in read_step_log(spark, path).collect()) == list(range(1, 7))


def test_step_log_keeps_the_last_row_of_a_step(spark, tmp_path):
    path = str(tmp_path / "log")
    assert read_step_log(spark, path).collect() == []
    entry = dict.fromkeys(STEP_LOG.fieldNames()[1:6], 0.5)
    first = [{"step": i, **entry} for i in range(1, 6)]
    append_step_log(spark, first, path, "a")
    append_step_log(spark, first, path, "b")
    append_step_log(spark, first, path, "a")                                    # the same portion again
    append_step_log(spark, [{"step": i, **entry, "loss": 0.1} for i in (4, 5, 6)], path, "a")   # resumed at 4
    got = {(r.run, r.step): r.loss for r in read_step_log(spark, path).collect()}
    assert got == {("b", i): 0.5 for i in range(1, 6)} | {("a", i): 0.5 for i in (1, 2, 3)} | {
        ("a", i): 0.1 for i in (4, 5, 6)}


@pytest.mark.parametrize("cores", [8, 64])
def test_sums_move_one_array_per_task(features, monkeypatch, cores):
    """With one merge, and with two."""
    monkeypatch.setattr(type(features.sparkSession.sparkContext), "defaultParallelism", cores)
    written = write_scratch(features.repartition(6), "features")
    plan = gatefit._partial_sums(written, LINEAR, "unnorm")
    each = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in each and each.count("MapInArrow") == (2 if cores == 8 else 3)
    row = plan.collect()
    assert len(row) == 1 and len(row[0].totals) == DIM + 1 + 1 + 3 and row[0].n == 30


def test_every_distinct_text_is_encoded_once(spark, tmp_path):
    """Repeated texts, one that is positive and negative, NULL and empty ones."""
    texts = ["a b", "c d e", "a b", "f", "", "g h"]
    rows = [(i, f"q {i % 2}", texts[i % 6], texts[(i + 1) % 6]) for i in range(24)] + [(99, None, None, "a b")]
    triples = spark.createDataFrame(rows, "triple_id long, query string, positive string, negative string")
    seen = str(tmp_path / "seen")
    os.mkdir(seen)

    def counting(side):
        def make():
            plain = make_encoder()

            def encode(texts):
                for t in texts:
                    with open(f"{seen}/{side}-{os.getpid()}-{time.time_ns()}", "w") as f:
                        f.write(t)
                return plain(texts)
            return encode
        return make

    got = {r.triple_id: r for r in text_features(triples.repartition(5), counting("q"), counting("d")).collect()}
    for side, want in [("q", {"q 0", "q 1", ""}), ("d", set(texts))]:
        files = [f for f in os.listdir(seen) if f.startswith(side)]
        read = []
        for f in files:
            with open(f"{seen}/{f}") as handle:
                read.append(handle.read())
        assert sorted(read) == sorted(want)
    encode = make_encoder()
    for i, query, positive, negative in rows:
        q, p, n = (x.astype("float32").astype("float64") for x in encode([query or "", positive or "", negative or ""]))
        best = lambda d: (q @ d.T).max(axis=1) if len(d) else np.full(len(q), -1e4)
        assert got[i].delta == pytest.approx((best(p) - best(n)).tolist(), abs=1e-9)


def test_fit_two_layer_gate(features):
    gate, log = fit_gate(features, gate=init_gate(DIM, hidden=3, init_random=True), steps=4, lr=0.05)
    assert gate.kind == "mlp" and len(gate.w1) == 3 and log[-1]["loss"] < log[0]["loss"]


def test_first_step_is_the_adamw_step(features):
    gate, _ = fit_gate(features, gate=LINEAR, steps=1, lr=0.01)
    grads = {(r.param, r.idx): r.grad for r in gate_gradient(features, LINEAR).collect()}
    for i, (old, new) in enumerate(zip(LINEAR.w, gate.w)):
        assert new - old == pytest.approx(-0.01 * math.copysign(1, grads["w", i]), rel=1e-3)


def test_logged_deviation_is_the_sample_one(features):
    _, log = fit_gate(features, gate=LINEAR, steps=1)
    weights = np.concatenate([gate_block(np.array(r.q_toks), LINEAR) for r in features.collect()])
    assert log[0]["head_w_std"] == pytest.approx(weights.std(ddof=1))
    assert log[0]["head_w_mean"] == pytest.approx(weights.mean())


def test_gate_stats(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "w double")
    values = np.array([1.0, 2.0, 4.0])
    assert gate_stats(df).first()["std"] == pytest.approx(values.std())
    assert gate_stats(df, ddof=1).first()["std"] == pytest.approx(values.std(ddof=1))


def test_init_gate():
    gate = init_gate(3)
    assert gate.w == [0.0] * 3 and gate.b == 5.0 and gate.kind == "linear"
    assert init_gate(3, init_random=True).w == init_gate(3, init_random=True).w != gate.w
    mlp = init_gate(3, hidden=2)
    assert mlp.w == [0.0] * 2 and mlp.in_features == 3
    assert gate_block(np.ones((1, 3)), mlp)[0] == pytest.approx(1 / (1 + math.exp(-5)))
