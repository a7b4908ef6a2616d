"""Block Lanczos against dense eigenvectors, and whitening of odd rows."""

import numpy as np
import pytest

from loomsearch.llm import whitening


def dense(spectrum, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(spectrum), len(spectrum))))
    return (q * np.asarray(spectrum, float)) @ q.T


@pytest.mark.parametrize("spectrum", [np.arange(40, 0, -1), 0.7 ** np.arange(30), np.r_[np.full(20, 3.0), np.ones(20)], np.r_[5.0, 4.0, np.zeros(50)], np.linspace(1, 2, 300)[::-1] ** 8, [2.0], np.zeros(6)])
def test_eigenpairs_are_the_dense_ones(spectrum):
    a, passes = dense(spectrum), []

    def apply(block):
        passes.append(block.shape[1])
        return a @ block

    values, directions = whitening.block_lanczos(apply, len(a), 16, most_basis=64)
    k = min(16, len(a))
    top = max(spectrum[0], 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-12 * top) and np.allclose(directions.T @ directions, np.eye(k), atol=1e-12)
    assert np.linalg.norm(a @ directions - directions * values, axis=0).max() <= 1e-11 * top
    assert len(passes) < 60 and max(passes) <= 16


def test_breakdown_restarts_with_fresh_directions():
    rng = np.random.default_rng(1)
    basis = np.linalg.qr(rng.standard_normal((12, 4)))[0]
    block = np.column_stack([basis[:, 0], np.zeros(12), basis @ np.ones(4)])
    new = whitening._orthogonal(block, basis, rng)
    assert np.allclose(new.T @ new, np.eye(3)) and np.abs(basis.T @ new).max() < 1e-12


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(2)
    good = [(k, rng.standard_normal(5).tolist()) for k in range(60)]
    copies = [(100 + k, good[0][1]) for k in range(90)]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0]), (202, [float("nan")] * 5), (203, [1.0, 2.0, float("inf"), 0.0, 0.0]), (204, [1.0, 2.0]), (205, [])]
    return spark.createDataFrame([*good, *copies, *bad, (None, good[1][1])], "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as x", "'a' as component", "3 as n")


def test_odd_rows(odd):
    vectors = whitening.on_grid(odd)
    fitted = whitening.fit(vectors)
    assert fitted.n == 60 and fitted.identity_error < 1e-10
    rows = whitening.whiten(vectors, fitted).collect()
    assert len(rows) == 5 * 151 and {r["component"] for r in rows} == {1, 2, 3, 4, 5}
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append((r["component"], r["whitened"], r["deviation"]))
    assert sorted(by[0]) == sorted(by[150]) and sorted(by[None]) == sorted(by[1])
    assert np.isclose(sum(fitted.shares), 1)


@pytest.mark.parametrize("values", [[], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]])
def test_nothing_to_whiten(spark, values):
    vectors = whitening.on_grid(spark.createDataFrame(values, "vec_id long, embedding array<float>"))
    assert whitening.whiten(vectors, whitening.fit(vectors)).count() == 0


def test_a_flat_direction_has_no_component(spark):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)]
    vectors = whitening.on_grid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert len(whitening.fit(vectors).values) == 2


def test_huge_entries_do_not_crash(spark):
    rows = [(k, [float(k), 1e300 if k == 3 else 0.0]) for k in range(9)]
    vectors = whitening.on_grid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = whitening.whiten(vectors, whitening.fit(vectors)).collect()
    assert {r["id"] for r in found} == set(range(9)) and all(r["deviation"] is None for r in found)
