import math
import random

import numpy as np
import pytest

from driftline.llm import whitening
from driftline.llm.whitening import eigenpairs, one_sided_jacobi, pivoted_cholesky, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, part int, vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, None) for i, v in rows], SCHEMA)


def plain(rows):
    """The contract with Python integers and numpy's symmetric eigenvalues."""
    held = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    n = len(held)
    total = [sum(x[d] for _, x in held) for d in range(len(held[0][1]))]
    z = np.array([[n * a - s for a, s in zip(x, total)] for _, x in held], object)
    v = np.array(z.T.dot(z) / n ** 3, float)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    return {i: sum(int(a) ** 2 for a in row) for (i, _), row in zip(held, z)}, n, values, vectors, np.array(z / n, float), [i for i, _ in held]


def draw(n, d, seed=3):
    base = np.random.default_rng(seed)
    mixed = base.normal(size=(n, d)) @ (base.normal(size=(d, d)) * np.linspace(2, 0.05, d)[:, None]) + base.normal(size=d)
    return [(i, x.tolist()) for i, x in enumerate(mixed)]


def check(got, rows, components=8):
    deviation, n, values, vectors, centred, ids = plain(rows)
    want = centred @ vectors[:, :components] / np.sqrt(values[:components])
    assert len(got) == n * components
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    sign = {}
    for i, row in zip(ids, want):
        for c in range(1, components + 1):
            r = by[i][c]
            assert (r.n, r.deviation) == (n, deviation[i])
            sign.setdefault(c, math.copysign(1, r.whitened * row[c - 1]) if abs(row[c - 1]) > 1e-3 else None)
            if sign[c]:
                assert r.whitened == pytest.approx(sign[c] * row[c - 1], abs=1e-7)
            elif sign[c] is None:
                del sign[c]
            assert r.explained == pytest.approx(values[c - 1] / values.sum(), rel=1e-10) and 0 <= r.identity_error < 1e-9


def test_whitening_is_that_of_a_plain_covariance(spark, monkeypatch):
    monkeypatch.setattr(whitening, "_FAN", 3)
    rows = draw(400, 12)
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] + [0.0] * 11), (1003, [0.0] * 11 + [float("inf")]), (1004, [0.5] * 5 + [None] + [0.5] * 6)]
    got = whiten(table(spark, rows + bad + bad).repartition(17)).collect()
    check(got, rows)


def test_fewer_dimensions_than_components_and_repeated_rows(spark):
    rows = draw(60, 3)
    doubled = rows + [(i + 100, v) for i, v in rows] + [(i + 200, v) for i, v in rows[:1] * 1]
    check(whiten(table(spark, doubled)).collect(), doubled, 3)


def test_rank_ends_the_components(spark):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)]
    got = whiten(table(spark, rows)).collect()
    assert {r.component for r in got} == {1} and got[0].identity_error < 1e-9 and got[0].explained == pytest.approx(1)
    assert whiten(table(spark, [(1, [1.0, 2.0])] * 5)).count() == 0


def test_empty_tables_and_vectors(spark):
    assert whiten(table(spark, []).limit(0)).count() == 0
    assert whiten(table(spark, [(1, None), (2, [None])])).count() == 0
    assert whiten(table(spark, [(1, []), (None, [])])).count() == 0
    got = whiten(table(spark, [(None, [1.0]), (None, [1.0]), (7, [2.0])])).collect()
    assert sorted((r.vec_id is None, r.deviation) for r in got) == [(False, 2048 ** 2), (True, 1024 ** 2), (True, 1024 ** 2)]


def test_different_lengths_fail(spark):
    with pytest.raises(Exception, match="different lengths"):
        whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_small_eigenvalues_keep_their_precision():
    base = np.random.default_rng(5)
    q, _ = np.linalg.qr(base.normal(size=(20, 20)))
    want = np.logspace(0, -9, 20)
    v = (q * want) @ q.T
    values, vectors = eigenpairs((v + v.T) / 2)
    assert np.allclose(values, want, rtol=1e-5) and np.allclose(vectors.T @ vectors, np.eye(20), atol=1e-6)
    factor, order = pivoted_cholesky(v)
    assert np.allclose(factor @ factor.T, v[order][:, order], atol=1e-12) and np.allclose(factor, np.tril(factor))
    turned = one_sided_jacobi(factor)
    assert np.allclose(turned @ turned.T, factor @ factor.T, atol=1e-12)


def test_jacobi_meets_all_pairs():
    for r in range(0, 9):
        pairs = [(a, b) for i, j in whitening._rounds(r) for a, b in zip(i.tolist(), j.tolist())] if r else []
        assert sorted(pairs) == [(a, b) for a in range(r) for b in range(a + 1, r)]


def test_long_deviations_are_exact():
    model = whitening.Whitening(3, [random.Random(1).randrange(10 ** 9) for _ in range(4)], np.ones(0), np.ones((4, 0)), 1.0)
    x = np.array([[5 * 10 ** 8, 1, 2, 3], [0, 0, 0, 0]])
    assert model.deviation(x).tolist() == [sum((3 * a - s) ** 2 for a, s in zip(r, model.total)) for r in x.tolist()]
