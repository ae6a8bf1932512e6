"""Iterative scaling in tasks against the one on the driver."""

import random
from collections import Counter

import numpy as np
import pytest

from agorascope.operators import maxent as M

COLUMNS = "features array<int>, label int"


def instances(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        f = [rng.randrange(-1, 3), rng.randrange(2), rng.choice([-1, -1, 0])]
        out.append((f, 1 + (f[0] == 2 or rng.random() < 0.3)))
    return out


def test_weights_are_those_of_the_driver(spark):
    df = spark.createDataFrame(instances(1, 300), COLUMNS).repartition(5)
    want, found = M.train(df, rounds=4), M.train_in_tasks(df, rounds=4, per_task=5)
    assert set(found.weights) == set(want.weights) and found.labels == want.labels == 2
    assert all(found.weights[k] == pytest.approx(x, abs=1e-9) for k, x in want.weights.items())


def test_a_position_that_never_fires(spark):
    df = spark.createDataFrame([([0, -1], 1), ([1, -1], 2), ([1, -1], 2), ([1, -1], 1)], COLUMNS)
    want, found = M.train(df, rounds=3), M.train_in_tasks(df, rounds=3)
    assert set(found.weights) == set(want.weights) == {(i, v, y) for i, v in [(0, 0), (0, 1)] for y in (1, 2)}
    assert all(found.weights[k] == pytest.approx(x, abs=1e-9) for k, x in want.weights.items())


def chances(model, f):
    z = np.array([sum(model.weights.get((i, v, y), 0.0) for i, v in enumerate(f)) for y in range(1, model.labels + 1)])
    return np.exp(z) / np.exp(z).sum()


def together_by_loops(given, rounds):
    """All functions solved from the same probabilities, round by round."""
    counts = Counter((tuple(f), y) for f, y in given)
    vectors, n = sorted({f for f, _ in counts}), len(given)
    weights = {(i, v, y): 0.0 for i in range(3) for v in range(max(f[i] for f in vectors) + 1) for y in (1, 2)}
    for _ in range(rounds):
        p, after = {f: chances(M.MaxEnt(weights, 2), f) for f in vectors}, dict(weights)
        for i, v, y in weights:
            at = [f for f in vectors if f[i] == v]
            mass = np.array([(counts[f, 1] + counts[f, 2]) / n * p[f][y - 1] for f in at])
            after[i, v, y] += M.solved(sum(counts[f, y] for f in at) / n, mass, np.array([sum(x >= 0 for x in f) for f in at], float), 50, 1e-3)
        weights = after
    return M.MaxEnt(weights, 2)


def test_together_equals_loops_which_meet_the_drivers_probabilities(spark):
    given = instances(2, 200)
    found, want = M.train_in_tasks(spark.createDataFrame(given, COLUMNS), rounds=3, together=True, per_task=4), together_by_loops(given, 3)
    assert set(found.weights) == set(want.weights) and all(found.weights[k] == pytest.approx(x, abs=1e-9) for k, x in want.weights.items())
    counts = Counter((tuple(f), y) for f, y in given)
    last, sequence = together_by_loops(given, 200), M.fit(sorted((f, y, n) for (f, y), n in counts.items()), 200)
    assert all(np.allclose(chances(last, f), chances(sequence, f), atol=1e-5) for f, _ in given)


def test_runs_go_on_and_end_when_nothing_moves(spark, tmp_path):
    df = spark.createDataFrame(instances(3, 80), COLUMNS)
    whole = M.train_in_tasks(df, rounds=3, together=True)
    M.train_in_tasks(df, rounds=1, together=True, path=str(tmp_path / "run"))
    assert M.train_in_tasks(df, rounds=3, together=True, path=str(tmp_path / "run")).weights == whole.weights
    still = spark.createDataFrame([([0], 1), ([0], 2)], COLUMNS)  # nothing to learn
    M.train_in_tasks(still, rounds=50, path=str(tmp_path / "still"))
    assert M.descent.latest(spark, str(tmp_path / "still")).epoch == 1


def test_more_cells_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_CELLS", 5)
    df = spark.createDataFrame(instances(4, 100), COLUMNS)
    with pytest.raises(ValueError):
        M.train(df)
    assert M.train_in_tasks(df, rounds=2, together=True).labels == 2


def test_odd_instances(spark):
    df = spark.createDataFrame([([0, 1], 1), ([1, 0], 2), (None, 1), ([0, None], 1), ([0, 1], None)], COLUMNS)
    found = M.train_in_tasks(df, rounds=2)
    want = M.train_in_tasks(spark.createDataFrame([([0, 1], 1), ([1, 0], 2)], COLUMNS), rounds=2)
    assert found.weights == want.weights
    for bad in ([], [([0], 1), ([0, 1], 2)]):
        with pytest.raises(ValueError):
            M.train_in_tasks(spark.createDataFrame(bad, COLUMNS))
