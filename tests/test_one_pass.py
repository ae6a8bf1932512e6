"""Work that is done once: marks looked at, passes over rows, and weights found by their place."""

import numpy as np
import pytest

from agorascope.functions import sentences as N
from agorascope.operators import bilinear, maxent


def test_only_marks_are_looked_at(monkeypatch):
    asked, closing = [], N.closing
    monkeypatch.setattr(N, "closing", lambda t, i, p: asked.append(t[i]) or closing(t, i, p))
    assert N.split_sentences("가나다 abc 1.5 (!) 좋아요\n네ㅋㅋ 끝. 다음^^") == ["가나다 abc 1.5 (!) 좋아요", "네ㅋㅋ", "끝.", "다음^^"]
    assert asked and set(asked) <= set("!?;.\n\r" + N.EMOTICON)


def test_same_cuts_as_sign_by_sign(monkeypatch):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("ab1 요다ㅋㅎ^.!?;()\n\r"), size=40)) for _ in range(200)]
    got = [N.split_sentences(t) for t in texts]

    class Every:
        def search(self, t, i=0):
            return type("At", (), {"start": lambda _: i})() if i < len(t) else None

    monkeypatch.setattr(N, "MARK", Every())
    assert got == [N.split_sentences(t) for t in texts]


def test_few_unknowns_take_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x, e = rng.normal(size=(60, 3)), rng.normal(size=(60, 2))
    rows = spark.createDataFrame([(a.tolist(), b.tolist(), float(a.sum() * b[0])) for a, b in zip(x, e)], "x array<double>, e array<double>, y double")
    passes, summed = [], bilinear._summed
    monkeypatch.setattr(bilinear, "_summed", lambda *a: passes.append(1) or summed(*a))
    one = bilinear.fit(rows, 3, 2)
    assert len(passes) == 1
    monkeypatch.setattr(bilinear, "GRAM", 0)
    many = bilinear.fit(rows, 3, 2)
    assert len(passes) > 3 and np.allclose(one.weights, many.weights, atol=1e-7)


def test_shares(spark):
    rows = spark.createDataFrame([(1, [0, 2, 2, 0]), (2, []), (3, [1])], "id int, x array<int>").repartition(2)
    assert {r["id"]: r["x"] for r in bilinear.shares(rows, "x", 3).collect()} == {1: [0.5, 0.0, 0.5], 2: [0.0, 0.0, 0.0], 3: [0.0, 1.0, 0.0]}


def test_weights_by_place(spark):
    """Also of positions without weights, and of values that are negative, null or never seen."""
    model = maxent.MaxEnt({(0, 0, 1): 0.5, (0, 2, 2): 1.5, (2, 1, 1): -0.7, (2, 1, 2): 0.3, (2, 0, 3): 2.0}, 3)
    vectors = [[0, 5, 1], [2, 0, 1], [1, 1, 0], [-1, -1, -1], [9, 9, 9], [0, 0, 0, 7], [2], []]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*vectors, [None, 0, 1]])], "id int, features array<int>")
    got = {r["id"]: r["predicted"] for r in maxent.classify(rows, model).collect()}
    assert [got[i] for i in range(len(vectors))] == [model.classify(v) for v in vectors] and got[len(vectors)] == 2
    with pytest.raises(ValueError, match="places"):
        maxent.classify(rows, model, most=8)
