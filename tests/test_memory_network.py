"""The network's gradient, its training in parts, and what it learns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorascope.operators import memory_network as N

SHAPE = N.Shape(entities=5, words=12, width=3, hidden=4, memory=6)


def rows(seed, n):
    """A thread's sentence that has word 0 is about what the sentence before is about, else about its own entities."""
    rng, out = random.Random(seed), []
    for i in range(n):
        words, entities, gold = [], [], []
        for _ in range(rng.randrange(1, 8)):
            follows = bool(words) and rng.random() < 0.5
            words.append([rng.randrange(2, 12) for _ in range(rng.randrange(4))] + ([0] if follows else [1]))
            entities.append([] if follows else rng.sample(range(5), rng.randrange(1, 3)))
            gold = gold if follows else entities[-1]
        out.append((f"{seed}-{i:04d}", words, entities, sorted(gold)))
    return out


def test_gradient_equals_differences():
    data = N.arrays(SHAPE, *zip(*(r[1:] for r in rows(1, 12))))
    flat = SHAPE.start(2, 0.5)
    _, gradient = N.passed(SHAPE, flat, *data)
    loss = lambda x: np.square(N.passed(SHAPE, x, data[0], data[1], None)[0] - data[2]).sum()
    for k in range(len(flat)):
        step = np.zeros_like(flat)
        step[k] = 1e-6
        assert gradient[k] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-6, rel=1e-4, abs=1e-5), k


def test_forward_equals_loops():
    flat = SHAPE.start(5, 0.5)
    p = SHAPE.views(flat)
    for _, words, entities, gold in rows(3, 20):
        words, entities = words[-6:], entities[-6:]
        said = [sum((p["vectors"][w] for w in own), np.zeros(3)) for own in words]
        memory = []
        for t, named in enumerate(entities):
            row = np.zeros(5)
            row[named] = 1
            for j in range(t):
                z = np.concatenate([said[j], said[t]]) @ p["first"] @ p["second"]
                row += memory[j] / (1 + np.exp(-(p["scale"][0] * z + p["shift"][0])))
            memory.append(np.minimum(row, 1))
        bags, marks, _ = N.arrays(SHAPE, [words], [entities], [gold])
        assert np.allclose(N.passed(SHAPE, flat, bags, marks, None)[0][0], memory[-1])


def test_gradients_don_t_depend_on_partitions(spark):
    data = rows(4, 50)
    flat = SHAPE.start(1)
    want = N.passed(SHAPE, flat, *N.arrays(SHAPE, *zip(*(r[1:] for r in data))))[1]
    found = [N.gradients(N.dealt(spark.createDataFrame(data, N.CASE).repartition(k), 20, 4), SHAPE, flat, 4) for k in (1, 7)]
    assert (found[0][0] == found[1][0]).all() and found[0][1:] == found[1][1:] and found[0][2] == 50
    assert np.allclose(found[0][0], want)


def test_resumed_run_equals_an_unbroken_one(spark, tmp_path):
    cases, held = spark.createDataFrame(rows(6, 45), N.CASE), spark.createDataFrame(rows(7, 20), N.CASE)
    how = dict(batch=20, shards=2, rate=0.05)  # two whole batches and a part of one
    whole = N.train(cases, held, SHAPE, epochs=4, **how)
    N.train(cases, held, SHAPE, str(tmp_path / "run"), epochs=2, **how)
    resumed = N.train(cases, held, SHAPE, str(tmp_path / "run"), epochs=4, **how)
    assert resumed.epoch == 4 and resumed.steps == whole.steps == 12
    assert (resumed.flat == whole.flat).all() and resumed.losses == whole.losses and resumed.rate == whole.rate
    assert N.train(cases, held, SHAPE, epochs=9, rate=1e-6).epoch == 0  # below the least rate


def test_it_learns_what_follows(spark):
    cases, held = spark.createDataFrame(rows(8, 300), N.CASE), spark.createDataFrame(rows(9, 150), N.CASE)
    run = N.train(cases, held, SHAPE, epochs=25, batch=100, rate=0.1, shards=2)
    right = N.answers(held, run).agg(F.avg((F.array_sort("answer") == F.array_sort("gold")).cast("double"))).first()[0]
    before = N.answers(held, N.Run(SHAPE, SHAPE.start(0), 0.1)).agg(F.avg((F.array_sort("answer") == F.array_sort("gold")).cast("double"))).first()[0]
    assert right >= before + 0.15 and run.losses[-1][1] < run.losses[0][1]


def test_cases_of_threads(spark):
    turns = spark.createDataFrame([(1, k, ["a", "b"] if k % 2 else [], [k % 5]) for k in range(9)] + [(2, 0, ["a"], [])], "c long, t long, tokens array<string>, e array<int>")
    got = {r["case"]: r for r in N.cases_of(turns, "c", "t", "tokens", "e", "e", SHAPE).collect()}
    assert len(got) == 10 and [len(got[f"1-{k}"]["words"]) for k in range(9)] == [1, 2, 3, 4, 5, 6, 6, 6, 6]
    assert got["1-8"]["entities"] == [[3], [4], [0], [1], [2], [3]] and got["2-0"]["entities"] == [[]]
    assert N.train(spark.createDataFrame([], N.CASE), spark.createDataFrame([], N.CASE), SHAPE, epochs=3).epoch == 0
