"""Whitening against dense eigenvectors, exact integers and the identity."""

import math

import numpy as np
import pytest

from evenhand.llm import whitening
from evenhand.llm.queries import QUERIES


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 150])
def test_components_are_eigenvectors(n):
    draw = np.random.default_rng(n)
    m = draw.standard_normal((n, n)) * np.logspace(0, -3, n)
    a = m @ m.T
    values, vectors = whitening.components(a)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-9, atol=1e-13 * values[0])
    assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * values[0] * max(n, 10)
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12


def test_ties_and_flat_directions():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((9, 9)))[0]
    for want in ([5, 5, 5, 2, 2, 1, 0, 0, 0], [3] * 9, [0] * 9, [1e6, 1, 1, 1, 1, 1, 1, 1, 1e-6]):
        values, vectors = whitening.components(q @ np.diag(want) @ q.T)
        assert np.allclose(values, want, atol=1e-9) and np.abs(vectors.T @ vectors - np.eye(9)).max() < 1e-12
    assert len(whitening.components(q @ np.diag(range(9)) @ q.T, 4)[0]) == 4


def test_sign_of_an_indefinite_matrix():
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((20, 20)))[0]
    e = np.concatenate([-np.logspace(0, -6, 10), np.logspace(-6, 2, 10)])
    assert np.abs(whitening._polar(q @ np.diag(e) @ q.T) - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-8


def check(rows, table):
    """Rows of the query against a dense computation over ``vec_id, vector`` pairs."""
    ids = [i for i, _ in table]
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for _, v in table], dtype=np.int64)
    n, sums = len(x), x.sum(axis=0)
    v = np.cov(x.T.astype(float), bias=True).reshape(x.shape[1], -1)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    many = min(32, int((e > 1e-12 * e[0]).sum()))
    assert len(rows) == many * n and {r.component for r in rows} == set(range(1, many + 1))
    found = {(r.vec_id, r.component): r for r in rows}
    for i, row in zip(ids, x):
        assert found[i, 1].deviation == sum(int(n * a - s) ** 2 for a, s in zip(row.tolist(), sums.tolist()))
    white = np.array([[found[i, k + 1].whitened for k in range(many)] for i in ids])
    want = (x - sums / n) @ u[:, :many] / np.sqrt(e[:many])
    assert np.abs(np.abs(white) - np.abs(want)).max() < 1e-6
    assert all(abs(found[ids[0], k + 1].explained - e[k] / v.trace()) < 1e-9 for k in range(many))
    error = np.abs(np.cov(white.T, bias=True).reshape(many, -1) - np.eye(many)).max()
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and abs(rows[0].identity_error - error) < 1e-9 and error < 1e-8


def test_given_embeddings(spark, sf):
    table = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check(QUERIES["op13_whitening"](spark, sf).collect(), table)


def test_odd_vectors(spark):
    draw = np.random.default_rng(3)
    good = [(k, [float(c) for c in v]) for k, v in enumerate(draw.standard_normal((60, 4)).round(3))]
    good += [(100, good[0][1]), (101, [0.0, -0.0, 1e3, -1e3])]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0]), (203, [1.0, float("nan"), 0.0, 0.0]), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    schema = "vec_id bigint, embedding array<float>, v int, at string, component int, n int"
    df = spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in good + bad], schema)
    check(whitening.whitened_components(df).collect(), [(i, np.array(v, dtype=np.float32)) for i, v in good])
    nulls = whitening.whitened_components(spark.createDataFrame([(None, [1.0, 2.0]), (None, [2.0, 1.0]), (1, [0.0, 0.0])], "vec_id bigint, embedding array<float>")).collect()
    assert len(nulls) == 6 and sum(r.vec_id is None for r in nulls) == 4


def test_no_variance_and_no_rows(spark):
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(3)], "vec_id bigint, embedding array<float>")
    assert whitening.whitened_components(same).collect() == []
    assert whitening.whitened_components(same.limit(0)).collect() == []


def test_entries_beyond_64_bits(spark):
    huge = spark.createDataFrame([(0, [3e38, 1.0]), (1, [-3e38, 2.0]), (2, [0.0, 3.0])], "vec_id bigint, embedding array<float>")
    assert {r.deviation for r in whitening.whitened_components(huge).collect()} <= {None, *range(10**6)}
