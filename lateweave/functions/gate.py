"""The per-token importance gate: parameters, expressions and the same rule on NumPy blocks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lateweave.functions.vectors import as_double, dot

# Fixed value: the starting bias, sigmoid(5) is about 0.993.
INIT_BIAS = 5.0


@dataclass
class Gate:
    """``w`` and ``b`` of the output layer; ``w1`` and ``b1`` only for the two-layer gate."""

    w: list[float]
    b: float
    w1: list[list[float]] = field(default_factory=list)
    b1: list[float] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return "mlp" if self.w1 else "linear"

    @property
    def in_features(self) -> int:
        return len(self.w1[0]) if self.w1 else len(self.w)


def init_gate(dim: int, hidden: int = 0, init_bias: float = INIT_BIAS,
              init_random: bool = False, seed: int = 42) -> Gate:
    """Zero output weights and a bias of 5, so the gate starts as a no-op.

    ``init_random`` draws the output weights from N(0, 1). The hidden layer of a
    two-layer gate starts Xavier-uniform with zero bias.
    """
    rng = np.random.default_rng(seed)
    n_out = hidden or dim
    w1 = []
    if hidden:
        bound = float(np.sqrt(6.0 / (dim + hidden)))
        w1 = rng.uniform(-bound, bound, size=(hidden, dim)).tolist()
    w = rng.standard_normal(n_out).tolist() if init_random else [0.0] * n_out
    return Gate(w, float(init_bias), w1, [0.0] * hidden)


def sigmoid(c: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c))


def gate_linear(v: Column, w: list[float], b: float) -> Column:
    """Gate value of one token vector under the one-layer gate."""
    return sigmoid(dot(F.lit([float(x) for x in w]), as_double(v)) + F.lit(float(b)))


def gate_mlp(v: Column, gate: Gate) -> Column:
    """Gate value of one token vector under the two-layer gate, all in the JVM.

    Every hidden weight becomes a literal; for wide hidden layers use ``gate_udf``.
    """
    d = as_double(v)
    rows = F.array(*[
        F.struct(F.lit([float(x) for x in r]).alias("r"), F.lit(float(c)).alias("c"))
        for r, c in zip(gate.w1, gate.b1)
    ])
    hidden = F.transform(rows, lambda h: F.greatest(dot(h["r"], d) + h["c"], F.lit(0.0)))
    return gate_linear(hidden, gate.w, gate.b)


def gate_value(v: Column, gate: Gate) -> Column:
    return gate_mlp(v, gate) if gate.kind == "mlp" else gate_linear(v, gate.w, gate.b)


def gate_block(q: np.ndarray, gate: Gate) -> np.ndarray:
    """Gate values of a ``[T, D]`` block of token vectors."""
    h = np.maximum(q @ np.asarray(gate.w1).T + np.asarray(gate.b1), 0.0) if gate.w1 else q
    return 1.0 / (1.0 + np.exp(-(h @ np.asarray(gate.w) + gate.b)))


def gate_udf(gate: Gate):
    """Arrow-batched gate for wide hidden layers: token vectors in, one weight each out."""

    @F.pandas_udf("double")
    def value(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        return pd.Series(gate_block(np.stack(v.to_numpy()).astype("float64"), gate))

    return value


def packed_gate_udf(gate: Gate):
    """As ``gate_udf``, for packed texts: one matrix product per batch. NULL tokens give NULL,
    a vector of another size than the gate's input raises."""

    @F.arrow_udf("array<double>")
    def values(toks: pa.Array) -> pa.Array:
        vectors = toks.flatten()
        sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        if (sizes != gate.in_features).any():
            raise ValueError(f"the gate takes vectors of {gate.in_features} values")
        q = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
        counts = pc.fill_null(pc.list_value_length(toks), 0).to_numpy(zero_copy_only=False)
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(gate_block(q.reshape(-1, gate.in_features), gate)),
                                        mask=pc.is_null(toks))

    return values


def with_gate_weights(packed: DataFrame, gate: Gate, toks: str = "toks",
                      out: str = "w") -> DataFrame:
    """Add one weight per token of a packed table (meant for the query side).

    A token vector of another size than the gate's input raises; NULL tokens give NULL.
    """
    if gate.kind == "mlp":
        return packed.withColumn(out, packed_gate_udf(gate)(toks))

    def weight(t: Column) -> Column:
        wrong = F.raise_error(F.lit(f"the gate takes vectors of {gate.in_features} values"))
        return F.when(F.size(t) == gate.in_features, gate_value(t, gate)).otherwise(wrong.cast("double"))

    return packed.withColumn(out, F.transform(F.col(toks), weight))


def gate_stats(values: DataFrame, col: str = "w", by: list[str] | None = None,
               ddof: int = 0) -> DataFrame:
    """Mean, deviation, least and greatest gate value; ``ddof`` 0 population, 1 sample."""
    std = F.stddev_pop(col) if ddof == 0 else F.stddev_samp(col)
    return values.groupBy(*(by or [])).agg(
        F.avg(col).alias("mean"), std.alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"))
