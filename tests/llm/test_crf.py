from itertools import product

import numpy as np
import pytest

from tessera.llm.crf import Crf, scan


@pytest.fixture
def model():
    rng = np.random.default_rng(0)
    m = Crf(12, 3)
    m.weights, m.steps, m.starts, m.ends = rng.normal(size=(12, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3)
    return m


def every(model, e):
    """All taggings of a chain and their weights."""
    for tags in product(range(3), repeat=len(e)):
        w = model.starts[tags[0]] + model.ends[tags[-1]] + sum(e[i, t] for i, t in enumerate(tags)) + sum(model.steps[a, b] for a, b in zip(tags, tags[1:], strict=False))
        yield tags, w


def test_viterbi_and_marginals_match_all_taggings(model):
    rng, lengths = np.random.default_rng(1), np.array([1, 5, 3, 1, 6, 2])
    e = rng.normal(size=(lengths.sum(), 3))
    heads = np.zeros(len(e), bool)
    heads[np.r_[0, np.cumsum(lengths)[:-1]]] = True
    best, marginals, at = model.viterbi(e, lengths), model.marginals(e, heads), 0
    for n in lengths:
        rows = list(every(model, e[at : at + n]))
        assert tuple(best[at : at + n]) == max(rows, key=lambda r: r[1])[0]
        total = sum(np.exp(w) for _, w in rows)
        for i in range(n):
            for t in range(3):
                assert marginals[at + i, t] == pytest.approx(sum(np.exp(w) for tags, w in rows if tags[i] == t) / total)
        at += n


def test_long_chain_stays_finite(model):
    e = np.random.default_rng(2).normal(size=(50_000, 3)) * 5
    heads = np.zeros(len(e), bool)
    heads[0] = True
    m = model.marginals(e, heads)
    assert np.isfinite(m).all() and np.allclose(m.sum(axis=1), 1)


def test_scan_in_blocks_equals_products_in_turn():
    m = np.random.default_rng(3).random((2, 2, 300))
    got, now = scan(m, 16), np.eye(2)
    for i in range(300):
        now = now @ m[:, :, i]
        now /= now.max()
        assert np.allclose(got[:, :, i], now)


def test_training_learns_a_rule():
    rng, chains = np.random.default_rng(4), []
    for _ in range(60):
        ids = rng.integers(1, 6, (8, 1))
        chains.append((ids, (ids[:, 0] == 3).astype(int)))
    m = Crf(6, 2).train(chains, rounds=60)
    ids = rng.integers(1, 6, (50, 1))
    assert (m.viterbi(m.emissions(ids), np.array([50])) == (ids[:, 0] == 3)).all()
