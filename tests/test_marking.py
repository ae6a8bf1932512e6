"""Marked pairs and affinities over documents as rows, against plain counts and the joins of mining.py."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorascope.operators import marking, mining


def documents(seed=1, n=60):
    rng = np.random.default_rng(seed)
    docs = [(int(i % 50), [f"w{x}" for x in rng.zipf(1.6, size=rng.integers(0, 25)) if x < 30]) for i in range(n)]  # ten ids twice
    return [*docs, (98, None), (99, [])]


def frame(spark, docs, doc="doc"):
    return spark.createDataFrame(docs, f"{doc} int, tokens array<string>").repartition(3)


@pytest.mark.parametrize("held, most", [(4 << 20, 1_000), (8, 1_000), (4 << 20, 0)])
def test_marked_pairs(spark, monkeypatch, held, most):
    """Also where a task holds few counts at a time, and where the names are too many to be sent."""
    monkeypatch.setattr(marking, "HELD", held)
    monkeypatch.setattr(marking, "PAIRS", held)
    docs, marks, least = documents(), ["w1", "w3", "w29", "nowhere"], 3
    sets = {}
    for d, t in docs:
        sets.setdefault(d, set()).update(t or [])
    kept = {w for w, c in Counter(w for s in sets.values() for w in s).items() if c >= least}
    want = Counter((w, m) for s in sets.values() for m in marks for w in s if m in s and w != m and {w, m} <= kept)
    rows = marking.item_rows(frame(spark, docs))
    got = marking.marked_pairs(rows, spark.createDataFrame([(m,) for m in marks], "item string"), least, most=most)
    assert {(r["item"], r["mark"]): r["support"] for r in got.collect()} == {k: n for k, n in want.items() if n >= least}


@pytest.mark.parametrize("most", [1_000, 0])
def test_affinity(spark, most):
    cases = frame(spark, documents(2), "case")
    lifts = spark.createDataFrame([("a", f"w{i}", 0.3 * i) for i in range(1, 9)] + [("b", "w1", 5.0), ("b", "w2", 0.25), ("c", "w1", 9.0)], "entity string, token string, lift double")
    each = cases.select("case", F.explode("tokens").alias("token"), F.array(F.lit("a"), F.lit("b")).alias("_e"))
    asked = each.select("case", "token", F.explode("_e").alias("entity"))
    rows = lambda df: sorted((r["case"], r["entity"], round(r["average"], 9), round(r["best"], 9)) for r in df.collect())
    got = rows(marking.affinity(cases, ["a", "b"], lifts, most=most))
    assert got == rows(mining.affinity(asked, lifts)) and len(got) > 80
    assert marking.affinity(cases.limit(0), ["a", "b"], lifts, most=most).collect() == []
    assert {(r["average"], r["best"]) for r in marking.affinity(cases, ["z"], lifts, most=most).collect()} == {(1.0, 1.0)}


def test_no_word_is_shuffled(spark):
    """A case's words are looked up where they are: what is gathered is by case alone."""
    lifts = spark.createDataFrame([("a", "w1", 2.0)], "entity string, token string, lift double")
    found = marking.affinity(frame(spark, documents(), "case"), ["a"], lifts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(case" in plan and "token" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
