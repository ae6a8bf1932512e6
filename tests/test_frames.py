"""Frames as columns against the plain greedy match."""

import random

from agorascope.operators import frames as R

FRAMES = {"a": [("x", "Actor"), ("y", "Target")], "b": [("y", "Actor"), ("y", "Target"), ("z", "Place")], "c": [], "'": [("'", "Odd")]}
KIND = "id long, tokens array<struct<word:string,tags:array<string>>>"


def sentences(seed, n):
    rng = random.Random(seed)
    tags = lambda: rng.choice([None, [], ["x"], ["y"], ["x", "y"], ["z", None], ["'"]])
    return [(i, [(rng.choice(["a", "b", "c", "'", "d", None]), tags()) for _ in range(rng.randrange(8))]) for i in range(n)]


def plain(tokens):
    return [(w, None if t is None else tuple(t)) for w, t in tokens or []]


def wanted(tokens, frames):
    return [a for h in R.heads(tokens, frames) for a in R.match(tokens, frames[h])[2]]


def test_completeness_equals_the_plain_match(spark):
    given = [*sentences(1, 400), (900, None)]
    got = {r["id"]: r for r in R.with_completeness(spark.createDataFrame(given, KIND), FRAMES).collect()}
    for id, tokens in given:
        own = plain(tokens)
        assert (got[id]["complete"], got[id]["open"]) == (R.complete(own, FRAMES), [a[1] for a in wanted(own, FRAMES)]), tokens
    assert {r["complete"] for r in got.values()} == {True, False} and len(got) == len(given)


def test_recovery_equals_the_plain_match(spark):
    given = [(i, t, c) for (i, t), (_, c) in zip(sentences(2, 400), sentences(3, 400))] + [(900, None, [("d", ["x"])]), (901, [("a", ["q"])], None)]
    frame = spark.createDataFrame(given, KIND.replace("tokens", "target") + ", context array<struct<word:string,tags:array<string>>>")
    got = {r["id"]: r["recovered"] for r in R.recovered(frame, FRAMES).collect()}
    for id, target, context in given:
        assert got[id] == [t[0] for t, _ in R.match(plain(context), wanted(plain(target), FRAMES))[0]], (target, context)
    assert sum(map(bool, got.values())) > 50


def test_no_python_worker(spark):
    rows = spark.createDataFrame(sentences(4, 3), KIND).selectExpr("id", "tokens", "tokens AS target", "tokens AS context")
    for found in (R.with_completeness(rows, FRAMES), R.recovered(rows, FRAMES), R.with_completeness(rows, {})):
        assert "Python" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 3
