"""Whitening against NumPy's eigensolver and exact integers."""

from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from forumlake.llm import whitening
from forumlake.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, x int, dims int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4) for i, v in rows], SCHEMA)


def wanted(rows, components=4):
    """(vec_id, n, deviation, centred vector) of the remaining rows, and the covariance."""
    kept = []
    for i, v in rows:
        if v and all(c is not None and math.isfinite(np.float32(c)) for c in v):
            kept.append((i, tuple(math.floor(256 * float(np.float32(c))) for c in v)))
    fit = sorted({x for _, x in kept})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    cov = np.asarray([[float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n**3)) for j in range(dims)] for i in range(dims)])
    return [(i, n, sum((n * c - s) ** 2 for c, s in zip(x, sums)), [float(Fraction(n * c - s, n)) for c, s in zip(x, sums)]) for i, x in kept], cov


def check(got, rows):
    kept, cov = wanted(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    by_row = defaultdict(list)
    for r in got:
        by_row[(r.vec_id, r.deviation)].append(r)
        assert r.n == kept[0][1] and r.identity_error < 1e-9
        assert math.isclose(r.explained, values[r.component - 1] / np.trace(cov), rel_tol=1e-9)
    assert len(got) == len(kept) * len(values)
    assert by_row.keys() == {(i, d) for i, _, d, _ in kept}
    white = np.asarray([c for *_, c in kept]) @ vectors / np.sqrt(values)
    mine = np.asarray([[next(r.whitened for r in by_row[(i, d)] if r.component == k + 1) for k in range(len(values))] for i, _, d, _ in kept])
    signs = np.sign((mine * white).sum(axis=0))  # one sign for all rows
    np.testing.assert_allclose(mine, white * signs, atol=1e-8)


def test_whitening_by_hand_made_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(7) * [3, 2, 1.5, 1, 0.5, 0.2, 0.1] + 20).tolist()) for i in range(80)]
    rows += [(900, rows[0][1]), (0, rows[0][1]), (None, rows[1][1])] * 3  # copies, a repeated row, NULL ids
    rows += [(901, None), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0, 1.0]), (903, [math.nan] * 7), (904, [math.inf] + [0.0] * 6), (905, [])]
    check(whitening.whitened_embeddings(table(spark, rows)).collect(), [r for r in rows if r[0] != 905])


def test_other_lengths_go_and_empty_tables_are_empty(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.3, 0.1]), (3, [0.9, 0.9]), (4, [0.5])]
    got = whitening.whitened_embeddings(table(spark, rows)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and {r.component for r in got} == {1, 2}
    for none in ([], [(1, None)], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        empty = whitening.whitened_embeddings(table(spark, none))
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(5) * 1e6).tolist()) for i in range(30)]
    got = whitening.whitened_embeddings(table(spark, rows)).collect()
    kept, _ = wanted(rows)
    assert {(r.vec_id, r.deviation) for r in got} == {(i, d if d < 2**63 else None) for i, _, d, _ in kept}
    assert all(r.identity_error < 1e-9 for r in got)
    assert len(whitening.whitened_embeddings(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 5.0])])).collect()) == 2


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * np.asarray(values, float)) @ q.T


@pytest.mark.parametrize("seed", range(20))
def test_counts_of_positive_pivots(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 40))
    a = rng.standard_normal((size, size))
    a = a + a.T
    if seed % 3 == 0:
        np.fill_diagonal(a, 0)
    assert whitening.positive_pivots(a) == int((np.linalg.eigvalsh(a) > 0).sum())


@pytest.mark.parametrize(
    "values",
    [[9, 5, 5, 5, 1], [4, 4, 4, 4, 4, 4], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0.1], [100, 1e-3, 1e-5, 1e-7], list(np.linspace(1, 2, 64)), [3, 0, 0], [2], [0, 0]],
)
def test_leading_eigenpairs(values):
    v = symmetric(values, 3)
    v = (v + v.T) / 2
    found, vectors = whitening.leading_eigenpairs(v, 4)
    want = [x for x in sorted(values, reverse=True)[:4] if x > 0]
    np.testing.assert_allclose(found, want, rtol=0, atol=1e-12 * max(values + [1]))
    np.testing.assert_allclose(v @ vectors, vectors * found, atol=1e-12 * max(values + [1]))
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(found)), atol=1e-12)


def test_whitening_of_the_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op12_whitening"](spark, sf_dir).collect(), rows)
