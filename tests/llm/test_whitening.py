import numpy as np
import pytest

from tests.conftest import SF, SMALL
from tidemark.llm import queries
from tidemark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, x string, n int"


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, v, "clash", 7) for i, v in enumerate(vectors)], SCHEMA)


def brute(x, k=32):
    """Mean, eigenvalues, unit vectors and exact deviations by numpy's own solver."""
    x = np.array(x, np.int64)
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return c, e[::-1][:k], u[:, ::-1][:, :k], deviation, e.sum()


@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (64, 64), (200, 33), (40, 90)])
def test_factor_and_rotations(shape):
    r = np.random.default_rng(3)
    a = r.normal(size=shape) * 10.0 ** r.integers(-1, 3, shape[1])
    s = a.T @ a
    order, factor = W.pivoted_cholesky(s)
    assert np.allclose(factor @ factor.T, s[order][:, order], rtol=0, atol=1e-12 * s.max())
    assert np.allclose(factor, np.tril(factor)) and (np.diff(np.diag(factor)) <= 0).all()
    values, vectors = W.principal(s)
    want = np.linalg.svd(a, compute_uv=False)[: len(values)] ** 2
    assert len(values) == min(shape) and np.allclose(values, want, rtol=1e-6, atol=1e-13 * s.max())
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, s, atol=1e-11 * s.max())


@pytest.mark.parametrize("folder", [SMALL, SF])
def test_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = [r.vec_id for r in rows]
    assert len(set(ids)) == len(ids)
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding] for r in rows]
    c, e, u, deviation, total = brute(x)
    got = {}
    for r in queries.op12_whitening(spark, folder).collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(ids) and all(sorted(g) == list(range(1, 33)) for g in got.values())
    z = np.array([[got[i][k].whitened for k in range(1, 33)] for i in ids])
    want = c @ u / np.sqrt(e)
    sign = np.sign((z * want).sum(0))
    assert np.abs(z - want * sign).max() < 1e-9
    first = [got[i][1] for i in ids]
    assert [r.deviation for r in first] == deviation and {r.n for r in first} == {len(ids)}
    assert np.allclose([got[ids[0]][k].explained for k in range(1, 33)], e / total, rtol=1e-10)
    assert len({r.identity_error for r in first}) == 1 and first[0].identity_error < 1e-10
    assert np.abs(z.T @ z / len(z) - np.eye(32)).max() < 1e-10


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 3.0], [1.0, 2.5, 3.0], [4.0, -1.0, 3.0], [4.0, -1.0, 3.0], [-0.001, 0.0, 3.0]]
    bad = [None, [], [1.0, None, 2.0], [nan, 1.0, 2.0], [inf, 0.0, 0.0], [0.0, -inf, 0.0], [1.0, 2.0], [1.0] * 4]
    docs = frame(spark, bad).union(frame(spark, good, 100)).union(spark.createDataFrame([(None, good[0], "c", 1)], SCHEMA))
    rows = W.on_grid(docs)
    model = W.fit(rows)
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in [*good, good[0]]]
    c, e, u, deviation, total = brute(x)
    assert model.n == 6 and len(model.values) == 2  # the third entry never varies
    assert np.allclose(model.values, e[:2]) and np.isclose(model.total, total)
    found = W.whitened(rows, model).collect()
    assert sorted(r.vec_id or -1 for r in found) == [-1, 100, 101, 102, 103, 104]
    assert sorted(r.deviation for r in found) == sorted(deviation)
    assert W.by_component(rows, model).count() == 12


def test_nothing_to_fit(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[3.0, 4.0]] * 5):
        rows = W.on_grid(frame(spark, vectors))
        assert W.fit(rows) is None
        out = W.by_component(rows, None)
        assert out.count() == 0
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries(spark):
    """Entries that no long sum can hold are centred as doubles; deviations beyond a long are null."""
    r = np.random.default_rng(4)
    rows = W.on_grid(frame(spark, (r.normal(size=(50, 3)) * 1e15).tolist()))
    model = W.fit(rows)
    assert not model.exact and model.identity_error < 1e-9
    assert all(x.deviation is None for x in W.whitened(rows, model).collect())
    rows = W.on_grid(frame(spark, (r.normal(size=(50, 3)) * 1e8).tolist()))
    model = W.fit(rows)
    assert model.exact and all(x.deviation is None for x in W.whitened(rows, model).collect())
