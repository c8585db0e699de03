"""Whitening against dense eigenvectors."""

import numpy as np
import pytest

from leafgrade.llm import queries
from leafgrade.llm.whitening import above, cuts, feast, inertia, leading, whiten


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, x string, n string")


def dense(vectors, k):
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(float)) + 100_000
    c = x - x.mean(0)
    v = c.T @ c / len(x)
    e, u = np.linalg.eigh(v)
    return x, e[::-1][:k], u[:, ::-1][:, :k], c, v


def test_rows_equal_dense_eigenvectors(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.standard_normal((700, 12)) @ rng.standard_normal((12, 12)) / 8).astype(np.float32)
    x, e, u, c, v = dense(vectors, 8)
    rows = {r.vec_id: r for r in whiten(table(spark, [(i, w.tolist()) for i, w in enumerate(vectors)]).repartition(5)).collect()}
    got = np.array([rows[i].whitened for i in range(700)])
    want = c @ u / np.sqrt(e)
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-9
    assert np.allclose(rows[0].explained, e / np.trace(v), rtol=1e-12) and rows[0].identity_error < 1e-10
    exact = [sum((700 * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(0))) for r in x]
    assert [rows[i].deviation for i in range(700)] == exact and {r.n for r in rows.values()} == {700}


def test_layout_does_not_matter(spark):
    rng = np.random.default_rng(9)
    t = table(spark, [(i, w.tolist()) for i, w in enumerate(rng.standard_normal((90, 5)).astype(np.float32))])
    a, b = ({r.vec_id: r.whitened for r in whiten(t.repartition(n)).collect()} for n in (1, 7))
    assert a == b


def test_odd_rows(spark):
    good = [(1, [0.1, 0.2, 0.3]), (1, [0.1, 0.2, 0.3]), (None, [0.4, 0.1, 0.0]), (3, [0.0, 0.7, 0.2]), (4, [0.9, 0.3, 0.6])]
    bad = [(5, None), (6, []), (7, [1.0, float("nan"), 2.0]), (8, [float("inf"), 1.0, 1.0]), (9, [None, 1.0, 1.0]), (10, [1.0, 2.0])]
    rows = whiten(table(spark, good + bad)).collect()
    assert sorted((r.vec_id or 0) for r in rows) == [0, 1, 1, 3, 4] and all(len(r.whitened) == 3 and r.n == 5 for r in rows)
    same = whiten(table(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect()
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in same] == [([], 0, [], 0.0)] * 2
    line = whiten(table(spark, [(i, [0.1 * i, 0.2 * i]) for i in range(9)])).collect()
    assert all(1 <= len(r.whitened) <= 2 and r.identity_error < 1e-6 for r in line)
    assert whiten(table(spark, bad[:5])).collect() == [] == whiten(table(spark, [])).collect()


def test_query_columns(spark, tmp_path):
    rng = np.random.default_rng(2)
    table(spark, [(i, w.tolist()) for i, w in enumerate(rng.standard_normal((40, 9)).astype(np.float32))]).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = queries.op11_whiten_embeddings(spark, str(tmp_path)).collect()
    assert len(rows) == 320 and sorted({r.component for r in rows}) == list(range(1, 9))
    share = [next(r.explained for r in rows if r.component == c) for c in range(1, 9)]
    assert share == sorted(share, reverse=True) and abs(sum(share)) < 1


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 5, 3, 3, 3, 2, 1, 0, 0], [9, 8, 7, 6, 5, 4, 3, 2, 1, 1e-3], [4, 1, 1, 1, 1, 1, 1, 1, 1, 1], [2.0], [1, 1 - 1e-9, 0.5]])
def test_contours_find_all(spark, values):
    rng = np.random.default_rng(1)
    turn, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    v = turn @ np.diag(np.array(values, float)) @ turn.T
    v = (v + v.T) / 2
    k = min(8, int((np.array(values) > 0).sum()))
    value, vector = leading(spark, v, 8)
    assert np.allclose(value, np.sort(values)[::-1][:k], atol=1e-11) and np.abs(v @ vector - vector * value).max() < 1e-11
    assert np.abs(vector.T @ vector - np.eye(k)).max() < 1e-12
    for low, high in cuts(v, k):
        assert len(feast(v, low, high)[0]) == above(v, low) - above(v, high)


def test_inertia_of_random_matrices():
    rng = np.random.default_rng(6)
    assert inertia(np.array([[0, 1.0], [1, 0]])) == (1, 1) and inertia(np.zeros((3, 3))) == (0, 0)
    for _ in range(100):
        a = rng.integers(-2, 3, (6, 6)).astype(float)
        e = np.linalg.eigvalsh(a + a.T)
        if np.abs(e).min() > 1e-9:
            assert inertia(a + a.T) == ((e > 0).sum(), (e < 0).sum())
