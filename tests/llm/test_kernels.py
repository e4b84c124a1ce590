"""Kernels inside tasks against enumeration: tag paths, increasing subsequences, alignments, darts."""

import itertools
import random

import numpy as np
import pytest

from lateweave.llm import licenses, minhash, toxicity


@pytest.mark.parametrize("seed", range(4))
def test_forward_backward_against_all_tag_paths(seed):
    rng = np.random.default_rng(seed)
    counts = np.array([3, 0, 1, 6, 2])
    e, moves = 2 * rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    marginal, odds = toxicity.forward_backward(e, counts, moves)
    again, pairs, log_z = toxicity.forward_backward(e, counts, moves, pairs=True)
    np.testing.assert_allclose(marginal, again)
    want, want_pairs, want_z, start = [], np.zeros((2, 2)), 0.0, 0
    for n in counts:
        if not n:
            continue
        scores = {}
        for path in itertools.product((0, 1), repeat=int(n)):
            total = sum(e[start + i] for i in range(n) if path[i])
            scores[path] = total + sum(moves[a, b] for a, b in zip(path, path[1:]))
        z = np.logaddexp.reduce(list(scores.values()))
        want_z += z
        for i in range(n):
            want.append(sum(np.exp(s - z) for p, s in scores.items() if p[i]))
        for p, s in scores.items():
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += np.exp(s - z)
        start += n
    np.testing.assert_allclose(marginal, want, atol=1e-12)
    np.testing.assert_allclose(odds, np.log(want) - np.log1p(-np.array(want)), atol=1e-8)
    np.testing.assert_allclose(pairs, want_pairs, atol=1e-12)
    assert log_z == pytest.approx(want_z)


def test_longest_increasing_against_all_subsequences():
    rng = random.Random(2)
    for _ in range(60):
        values = [rng.randrange(8) for _ in range(rng.randint(0, 9))]
        got = [values[i] for i in licenses.longest_increasing(values)]
        assert all(a < b for a, b in zip(got, got[1:]))
        best = max(n for n in range(len(values) + 1) for c in itertools.combinations(values, n)
                   if all(a < b for a, b in zip(c, c[1:])))
        assert len(got) == best


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return row[-1]


def test_alignment_against_the_longest_common_subsequence():
    """A common subsequence in order; the longest one where words are unique on both sides."""
    rng = random.Random(3)
    for _ in range(200):
        template = [f"w{i}" for i in range(12)]
        text = [w for w in template if rng.random() < 0.8]
        for _ in range(rng.randint(0, 4)):
            text.insert(rng.randint(0, len(text)), f"x{rng.randrange(50)}")
        if rng.random() < 0.5 and len(text) > 2:
            i = rng.randrange(len(text) - 1)
            text[i], text[i + 1] = text[i + 1], text[i]
        pairs = licenses.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:]))
        if len(set(text)) == len(text):
            # Words taken from the two ends at once may cost one of a swapped pair, never more.
            assert len(pairs) >= common(text, template) - 1
    repeated = ["a", "b"] * 6
    assert len(licenses.align(repeated, repeated)) == 12


def test_darts_agree_with_the_similarity():
    """Coordinates agree as often as the weighted Jaccard similarity says."""
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, size=400, dtype=np.uint64)
    for share in (0.3, 0.7, 0.95):
        a, b = rng.integers(1, 6, size=400), rng.integers(1, 6, size=400)
        b = np.where(rng.random(400) < share, a, b)
        sets = [minhash.dart_signatures([(keys, w)], 2000)[0] for w in (a, b)]
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((sets[0] == sets[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 2000) + 1e-3
