"""The plan of patterns against enumeration, and the driver's linear algebra beside a session."""

import itertools
import time

import numpy as np

from lateweave.llm.common import invert
from lateweave.llm.packing import _price, plan_patterns, solve_patterns


def all_patterns(sizes, capacity):
    """Every non-empty pattern that fits."""
    ranges = [range(capacity // s + 1) for s in sizes]
    return [p for p in itertools.product(*ranges) if any(p) and np.dot(p, sizes) <= capacity]


def test_inverse():
    rng = np.random.default_rng(3)
    for m in (1, 2, 7, 40):
        a = rng.normal(size=(m, m))
        np.testing.assert_allclose(np.einsum("ij,jk->ik", a, invert(a)), np.eye(m), atol=1e-9)
    np.testing.assert_allclose(invert(np.array([[0.0, 2.0], [4.0, 0.0]])), [[0, 0.25], [0.5, 0]])


def test_knapsack_prices_the_best_pattern():
    rng = np.random.default_rng(5)
    for _ in range(30):
        sizes = np.sort(rng.choice(np.arange(2, 14), size=4, replace=False))
        values, capacity = rng.random(4), 16
        back = [room - sizes[:np.searchsorted(sizes, room, side="right")] for room in range(capacity + 1)]
        value, pattern = _price(values, sizes, back)
        best = max((np.dot(p, values) for p in all_patterns(sizes, capacity)), default=0.0)
        assert abs(value - best) < 1e-12 and abs(np.dot(pattern, values) - best) < 1e-12
        assert np.dot(pattern, sizes) <= capacity


def least_sequences(sizes, demand, capacity):
    """Fewest sequences by exhaustive search over what is left."""
    patterns, known = all_patterns(sizes, capacity), {}

    def least(left):
        if not any(left):
            return 0
        if left not in known:
            known[left] = 1 + min(least(tuple(max(a - b, 0) for a, b in zip(left, p)))
                                  for p in patterns if any(a and b for a, b in zip(left, p)))
        return known[left]

    return least(tuple(demand))


def test_plan_holds_all_and_is_near_the_optimum():
    rng = np.random.default_rng(7)
    for _ in range(12):
        sizes = np.sort(rng.choice(np.arange(3, 11), size=3, replace=False))
        demand = rng.integers(0, 7, size=3)
        plan = plan_patterns(sizes, demand, 12)
        held = sum((np.asarray(p) * n for p, n in plan), np.zeros(3, dtype=int))
        assert (held == demand).all()
        assert all(np.dot(p, sizes) <= 12 for p, _ in plan)
        assert sum(n for _, n in plan) <= least_sequences(sizes, demand.tolist(), 12) + 1


def test_relaxation_is_below_any_plan():
    sizes, demand = np.array([3, 5, 7]), np.array([30, 20, 10])
    _, amount = solve_patterns(sizes, demand, 12)
    assert amount.sum() <= least_sequences([3, 5, 7], [6, 4, 2], 12) * 5 + 1e-6
    assert amount.sum() >= (sizes * demand).sum() / 12 - 1e-6


def test_plan_beside_a_session_ends(spark):
    """A plan of all classes after a job has run: the driver must not wait for its own threads."""
    assert spark.range(1000).selectExpr("sum(id)").first()[0] == 499500
    rng = np.random.default_rng(11)
    sizes = np.arange(2, 257, 2)
    demand = rng.integers(1, 500, size=128)
    start = time.perf_counter()
    plan = plan_patterns(sizes, demand, 256)
    assert time.perf_counter() - start < 60
    held = sum((np.asarray(p) * n for p, n in plan), np.zeros(128, dtype=int))
    assert (held == demand).all()
    _, amount = solve_patterns(sizes, demand, 256)
    assert sum(n for _, n in plan) <= amount.sum() + 128
