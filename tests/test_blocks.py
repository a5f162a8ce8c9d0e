import numpy as np
import pytest

from quillon.operators import blocks
from quillon.operators.blocks import ByTerm


def sparse(rng, rows, terms, of):
    full = rng.random((rows, terms)) * (rng.random((rows, terms)) < of)
    row, term = np.nonzero(full)
    return full, ByTerm.of(rows, terms, row, term, full[row, term])


@pytest.mark.parametrize("lot", [3, 500_000])
def test_dots(monkeypatch, lot):
    monkeypatch.setattr(blocks, "LOT", lot)
    monkeypatch.setattr(blocks, "SLAB", 2)
    rng = np.random.default_rng(1)
    for dense in (0.0, 0.02, 2.0):
        monkeypatch.setattr(blocks, "DENSE", dense)
        for na, nb in ((1, 1), (40, 70), (3, 0)):
            (x, a), (y, b) = sparse(rng, na, 30, rng.random(30)), sparse(rng, nb, 30, rng.random(30))
            assert np.allclose(blocks.dots(a, b), x @ y.T, atol=1e-12)
            assert np.array_equal(blocks.dots(a.ones(), b.ones()), ((x > 0) * 1.0) @ ((y > 0) * 1.0).T)
            assert np.allclose(blocks.dots(a.part(0, 1), b.part(1, 5)), (x @ y.T)[:1, 1:5], atol=1e-12)


def test_best():
    rng = np.random.default_rng(2)
    for k in (1, 3, 20):
        score = rng.integers(0, 4, (30, 11)) / 4
        rows, columns = blocks.best(score, k)
        got = sorted(zip(rows.tolist(), columns.tolist()))
        assert got == sorted((i, j) for i in range(30) for j in sorted(range(11), key=lambda j: (-score[i, j], j))[:k] if score[i, j] > 0)
