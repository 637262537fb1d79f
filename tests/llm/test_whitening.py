import math

import numpy as np
import pytest

from strataflow.llm import whitening
from strataflow.llm.queries import op12_whitening


def fixed(vectors):
    return np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000


def want(x):
    """Exact deviations, eigenvalues in falling order, unit eigenvectors as rows, trace."""
    n, sums = len(x), [int(v) for v in x.sum(axis=0)]
    dev = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    d = np.array([[n * int(v) - s for v, s in zip(row, sums)] for row in x], dtype=np.float64) / n
    _, singular, right = np.linalg.svd(d, full_matrices=False)
    return dev, singular**2 / n, right, d


def test_table_against_eigenvectors(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = [r.vec_id for r in table]
    dev, e, w, d = want(fixed([r.embedding for r in table]))
    rows = op12_whitening(spark, sf).collect()
    assert len(rows) == len(ids) * 32
    got = {(r.vec_id, r.component): r for r in rows}
    for c in range(32):
        y = np.array([got[i, c + 1].whitened for i in ids])
        plain = d @ w[c] / math.sqrt(e[c])
        sign = 1 if abs(y - plain).max() < abs(y + plain).max() else -1
        assert np.allclose(sign * y, plain, atol=1e-8)
        assert math.isclose(got[ids[0], c + 1].explained, e[c] / e.sum(), rel_tol=1e-9)
    assert [got[i, 1].deviation for i in ids] == dev
    assert {r.n for r in rows} == {len(ids)} and max(r.identity_error for r in rows) < 1e-10


def frame(spark, vectors):
    return spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("scales", [[1, 1, 1], [1e6, 1, 1e-1], [1e7, 1e3, 0.5, 0, 0]])
def test_ill_conditioned_and_singular(spark, scales):
    rng = np.random.default_rng(7)
    turn = np.linalg.qr(rng.normal(size=(len(scales),) * 2))[0] if 0 not in scales else np.eye(len(scales))
    vectors = (rng.normal(size=(400, len(scales))) * scales) @ turn
    df = frame(spark, vectors.tolist())
    model = whitening.fit(df)
    dev, e, w, d = want(fixed(vectors))
    rank = sum(s > 0 for s in scales)
    assert len(model.variances) == rank
    assert np.allclose(model.variances, e[:rank], rtol=1e-6)
    assert model.identity_error < 1e-6
    got = {r.vec_id: r for r in whitening.whiten(df, model).collect()}
    y = np.array([got[i].whitened for i in range(400)])
    assert np.allclose(y.T @ y / 400, np.eye(rank), atol=1e-6)
    assert [got[i].deviation for i in range(400)] == [v if v < 2**63 else None for v in dev]


def test_repeated_dimension_is_left_out(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 4))
    model = whitening.fit(frame(spark, np.hstack([base, base]).tolist()))
    assert len(model.variances) == 4 and model.identity_error < 1e-9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [3.0, 5.0], None), (3, None, "b"), (4, [1.0, None], "b"), (5, [nan, 0.0], "b"), (6, [0.0, -inf], "b"), (7, [], "b"), (8, [4.0], "b"), (9, [0.5, 0.25], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, deviation string").repartition(3)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).collect()
    x = fixed([[1, 2], [1, 2], [3, 5], [0, 0], [4, 0], [0.5, 0.25]])
    dev = want(x)[0]
    assert model.centre.n == 6 and len(model.variances) == 2
    assert sorted(r.deviation for r in got) == sorted(dev)
    assert sum(r.vec_id is None for r in got) == 1 and sum(r.vec_id == 1 for r in got) == 2


def test_empty_equal_and_huge(spark):
    empty = frame(spark, [[1.0]]).limit(0)
    model = whitening.fit(empty)
    assert len(model.variances) == 0 and whitening.whiten(empty, model).count() == 0
    same = frame(spark, [[1.0, 2.0]] * 5)
    model = whitening.fit(same)
    assert [list(r.whitened) for r in whitening.whiten(same, model).collect()] == [[]] * 5
    huge = frame(spark, [[1e300, 1.0], [-1e300, 2.0], [1e10, 3.0], [0.0, 0.0]])
    rows = whitening.whiten(huge, whitening.fit(huge)).collect()
    assert len(rows) == 4 and all(r.deviation is None for r in rows)


def test_no_vector_is_usable(spark):
    df = spark.createDataFrame([(1, None), (2, [float("nan")])], "vec_id long, embedding array<float>")
    assert whitening.whiten(df, whitening.fit(df)).count() == 0
