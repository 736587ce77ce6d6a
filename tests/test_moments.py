import numpy as np
import pytest

from driftline.operators import lowess
from driftline.operators.moments import Nodes, Tree, points, whole


def times(kind, n, rng):
    if kind == "even":
        return np.arange(n, dtype=float)
    if kind == "repeated":
        return np.sort(rng.integers(0, n // 3 + 1, n)).astype(float)
    return np.cumsum(rng.choice([1e-6, 1.0, 5e3], n, p=[0.45, 0.5, 0.05])) + 1e6


@pytest.mark.parametrize("kind", ["even", "repeated", "clustered"])
def test_sums_are_those_row_by_row(kind):
    rng = np.random.default_rng(7)
    n = 700
    t, y = times(kind, n, rng), rng.normal(size=n)
    w = np.where(rng.random(n) < 0.3, 0.0, rng.random(n))
    start = rng.integers(0, n, 300)
    stop = np.minimum(n, start + rng.integers(0, 400, 300))
    at = t[np.clip((start + stop) // 2, 0, n - 1)]
    reach = np.array([np.abs(t[a:b] - x).max(initial=0.0) for a, b, x in zip(start, stop, at)])
    tree = Tree(points(t, y, w))
    got = tree.around(start, stop, at, reach)
    want = lowess.range_sums(t, y, w, at, reach, start, stop) if lowess.MANY_NEIGHBOURS > 400 else None
    assert np.allclose(got, want, rtol=0, atol=1e-9 * max(1, w.sum()))
    assert tree.used <= 4 * (np.log2(n) + 1) * len(at)


def test_a_node_of_nodes_is_the_node_of_their_rows():
    rng = np.random.default_rng(1)
    t, y, w = np.sort(rng.random(101)), rng.normal(size=101), rng.random(101)
    parts = [whole(points(t[a:b], y[a:b], w[a:b])) for a, b in ((0, 40), (40, 41), (41, 101))]
    joined = whole(Nodes(*[np.concatenate([getattr(p, c) for p in parts], axis=-1) for c in ("low", "high", "mu", "nu")]))
    every = whole(points(t, y, w))
    assert np.allclose(joined.mu, every.mu, atol=1e-12) and np.allclose(joined.nu, every.nu, atol=1e-12)


def test_smoothing_of_many_rows_by_moments(monkeypatch):
    """100,000 rows with a fifth of them as neighbours: equal to plain sums where those are made, with few nodes a row."""
    rng = np.random.default_rng(3)
    n = 100_000
    t = np.cumsum(rng.exponential(size=n))
    y = np.sin(t / 5e3) + 0.3 * rng.normal(size=n)
    y[::500] += 20.0
    used = []
    plain = Tree.around

    def counted(self, *args):
        out = plain(self, *args)
        used.append(self.used)
        return out

    monkeypatch.setattr(Tree, "around", counted)
    k = lowess.neighbours(n, 0.2)
    first = lowess.first_neighbours(t, k)
    weights = rng.random(n)
    got = lowess.moment_fits(t, y, weights, first, k)
    some = np.sort(rng.choice(n, 60, replace=False))
    want = lowess.local_fits(t, y, weights, first, k, [slice(i, i + 1) for i in some])
    assert np.allclose(got[some], want[some], rtol=0, atol=1e-9)
    assert max(used) <= 4 * (np.log2(n) + 1) * n


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_robust_passes_by_moments(kind, monkeypatch):
    rng = np.random.default_rng(2)
    t, y = times(kind, 1500, rng), rng.normal(size=1500)
    y[::50] += 30.0
    y[::70] = np.nan
    by_rows = lowess.smooth_array(t, y, 0.2)
    monkeypatch.setattr(lowess, "MANY_NEIGHBOURS", 2)
    assert np.allclose(lowess.smooth_array(t, y, 0.2), by_rows, atol=1e-6, equal_nan=True)
