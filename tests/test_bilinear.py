"""The bilinear form against the closed solution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorascope.operators import bilinear


def data(seed, n, d, m, noise=0.1):
    rng = np.random.default_rng(seed)
    x, e, w = rng.normal(size=(n, d)), rng.normal(size=(n, m)), rng.normal(size=(d, m))
    return x, e, ((x @ w) * e).sum(1) + 0.5 + noise * rng.normal(size=n)


def frame(spark, x, e, y):
    return spark.createDataFrame([(i, a.tolist(), b.tolist(), float(c)) for i, (a, b, c) in enumerate(zip(x, e, y))], "id int, x array<double>, e array<double>, y double")


@pytest.mark.parametrize("ones", [True, False])
def test_equals_the_closed_solution(spark, ones):
    x, e, y = data(1, 80, 4, 3)
    form = bilinear.fit(frame(spark, x, e, y).repartition(5), 4, 3, ridge=0.5, ones=ones)
    one, two = ((np.hstack([z, np.ones((len(z), 1))]) if ones else z) for z in (x, e))
    rows = np.einsum("ni,nj->nij", one, two).reshape(len(x), -1)
    want = np.linalg.solve(rows.T @ rows + 0.5 * np.eye(rows.shape[1]), rows.T @ y)
    assert np.allclose(form.weights.ravel(), want, atol=1e-7) and 0 < form.passes <= rows.shape[1] + 3
    got = {r["id"]: r["score"] for r in bilinear.scored(frame(spark, x, e, y), form).collect()}
    assert np.allclose([got[i] for i in range(len(x))], rows @ want, atol=1e-6)


def test_same_again(spark):
    rows = frame(spark, *data(2, 40, 3, 2)).repartition(4, "id")
    a, b = (bilinear.fit(rows, 3, 2) for _ in range(2))
    assert np.allclose(a.weights, b.weights, atol=1e-12) and a.passes == b.passes


def test_odd_rows(spark):
    none = frame(spark, *data(3, 3, 2, 2)).limit(0)
    assert not bilinear.fit(none, 2, 2).weights.any() and bilinear.fit(none, 2, 2).passes == 0
    with pytest.raises(ValueError, match="unknowns"):
        bilinear.fit(none, 2, 2, most=3)
    with pytest.raises(Exception, match="vectors of 3 numbers"):
        bilinear.fit(frame(spark, *data(3, 3, 2, 2)), 3, 2)


def test_learns_entities_of_sentences(spark):
    """Sentences as sums of their words' vectors, entities as unit vectors: those that belong together score higher."""
    rng = np.random.default_rng(4)
    topics = rng.normal(size=(3, 6))
    rows = [(topics[t] + 0.3 * rng.normal(size=6), np.eye(3)[e], float(t == e)) for t in rng.integers(3, size=60) for e in range(3)]
    df = frame(spark, *zip(*rows))
    found = bilinear.scored(df, bilinear.fit(df, 6, 3))
    assert found.agg(F.avg(((F.col("score") >= 0.5) == (F.col("y") == 1)).cast("double"))).first()[0] > 0.95
