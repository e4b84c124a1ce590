"""Vector and MaxSim expressions over arrays, for pairs that are already joined.

Scoring every query against every document goes through ``operators.scoring``; these
expressions score the pair in one row and never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The score of a masked token and the smallest weight sum.
MASKED_SCORE = -1e4
MIN_WEIGHT_SUM = 1e-6


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two double arrays; arrays of unequal sizes raise, a NULL one gives NULL."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # The shorter array is filled with NULLs, so only a NULL sum can come from unequal sizes.
    wrong = F.raise_error("the inner product needs vectors of equal size").cast("double")
    return F.coalesce(total, F.when(F.size(a) != F.size(b), wrong))


def l2_normalise(v: Column) -> Column:
    d = as_double(v)
    norm = F.sqrt(dot(d, d))
    return F.transform(d, lambda x: x / norm)


def all_seen(mask: Column, toks: Column) -> Column:
    """The mask, or true for every token where there is none."""
    return F.coalesce(mask, F.transform(toks, lambda _: F.lit(True)))


def best_match(q_toks: Column, d_toks: Column, d_mask: Column | None = None) -> Column:
    """Per query token, its best similarity over the document's tokens.

    Masked tokens score ``MASKED_SCORE``; so does a document without tokens.
    """
    q = q_toks.cast("array<array<double>>")
    d = d_toks.cast("array<array<double>>")

    def one(qt: Column) -> Column:
        sims = F.transform(d, lambda dt: dot(qt, dt))
        if d_mask is not None:
            sims = F.zip_with(sims, all_seen(d_mask, sims), lambda s, m: F.when(m, s).otherwise(MASKED_SCORE))
        return F.coalesce(F.array_max(sims), F.lit(MASKED_SCORE))

    return F.transform(q, one)


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def clamp_min(c: Column, low: float) -> Column:
    return F.greatest(c, F.lit(low))


def maxsim(q_toks: Column, d_toks: Column, d_mask: Column | None = None) -> Column:
    """Sum over query tokens of the best match."""
    return array_sum(best_match(q_toks, d_toks, d_mask))


def weighted_maxsim(q_toks: Column, w: Column, d_toks: Column, d_mask: Column | None = None,
                    mode: str = "norm") -> Column:
    """``norm``: weighted sum divided by the sum of weights; ``unnorm``: not divided."""
    total = dot(as_double(w), best_match(q_toks, d_toks, d_mask))
    if mode == "unnorm":
        return total
    if mode != "norm":
        raise ValueError(f"unknown score mode {mode!r}")
    return total / clamp_min(array_sum(as_double(w)), MIN_WEIGHT_SUM)
