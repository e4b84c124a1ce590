"""Large batches of vectors are worked through in pieces."""

import numpy as np
from pyspark.sql import functions as F

from lateweave.functions.gate import Gate
from lateweave.operators import gatefit
from lateweave.operators.gatefit import gate_features, gate_gradient

GATE = Gate([0.3, -0.2, 0.1, 0.4], 0.2)


def test_pieces_hold_few_vectors_and_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, *[rng.standard_normal((rng.integers(0, 60), 4)).tolist() for _ in "qpn"]) for i in range(300)]
    kind = "array<array<float>>"
    df = spark.createDataFrame(rows, f"triple_id long, q_toks {kind}, p_toks {kind}, n_toks {kind}").coalesce(1)

    def results():
        features = gate_features(df)
        return (sorted((r.triple_id, tuple(np.round(r.delta, 9))) for r in features.collect()),
                [(r.param, r.idx, round(r.grad, 9)) for r in gate_gradient(features, GATE).orderBy("param", "idx").collect()])

    want = results()
    monkeypatch.setattr(gatefit, "PIECE_BYTES", 4_000)
    assert results() == want
    table = df.limit(300).select("q_toks", "p_toks").toArrow().combine_chunks().to_batches()[0]
    pieces = list(gatefit._pieces(table, ["q_toks", "p_toks"]))
    assert len(pieces) > 20 and sum(p.num_rows for p in pieces) == 300
    assert max(p.nbytes for p in pieces if p.num_rows > 1) < 8_000
    assert list(gatefit._pieces(table.slice(0, 0), ["q_toks"])) == []
    assert df.where(F.size("q_toks") == 0).count() > 0
