"""Many sentences solved together against one at a time, and counts that leave a task as counts."""

import random

import numpy as np
from pyspark.sql import functions as F

from agorascope.operators import tagger


def together(model, sentences):
    number = {}
    ids = np.array([number.setdefault(w, len(number)) for s in sentences for w in s], np.int64)
    forms, kinds, cuts, which = model.solve(list(number), ids, np.array([len(s) for s in sentences]))
    path = iter(which)
    return [[(forms[k], model.tags[kinds[k]]) for p in [next(path) for _ in s] for k in range(cuts[p], cuts[p + 1])] for s in sentences]


def test_batches_find_what_single_sentences_find(monkeypatch):
    """Few weights, so that many paths tie; words in groups of several sizes; a dictionary may hold the tag of unknown signs."""
    rng = random.Random(3)
    for _ in range(80):
        monkeypatch.setattr(tagger, "GROUP", rng.choice([50, 1_000, 1_000_000]))
        tags = rng.sample(["N", "V", "J", "E", tagger.UNKNOWN], rng.randrange(1, 5))
        weight = lambda: rng.choice([-100, -200, -300, -500])
        forms = [("".join(rng.choice("abc가") for _ in range(rng.randrange(1, 4))), rng.choice(tags), weight()) for _ in range(rng.randrange(15))]
        pairs = [(rng.choice(["^", *tags, tagger.UNKNOWN]), rng.choice(["$", *tags, tagger.UNKNOWN]), weight()) for _ in range(10)]
        model, sentences = tagger.Model(forms, pairs, -400, -300), [["".join(rng.choice("abcx가") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(6))] for _ in range(20)]
        want = [tagger.merged(model.sentence(s)[1], [len(w) for w in s]) for s in sentences]
        assert together(tagger.Batches(forms, pairs, -400, -300), sentences) == want
    assert together(tagger.Batches([], [], -400, -300), [[], []]) == [[], []]


def test_slices_and_parts_change_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(k, None if k % 7 == 0 else ["ab", "", None, "xa"][: k % 5] + ["b"] * (k % 3)) for k in range(60)], "id int, words array<string>")
    tables = spark.createDataFrame([("a", "N", -1.0), ("ab", "V", -1.0), ("b", "J", -1.0)], "form string, tag string, weight double"), spark.createDataFrame([("^", "N", -0.5), ("N", "J", -0.5)], "a string, b string, weight double")
    ask = lambda: {r["id"]: r["tagged"] for r in tagger.tagged(rows.coalesce(1), F.col("words"), *tables).collect()}
    whole = ask()
    assert len(whole) == 60 and whole[7] == [] and "".join(m["word"] for m in whole[4]) == "abxab"
    monkeypatch.setattr(tagger, "SLICE", 1)
    monkeypatch.setattr(tagger, "PART", 3)
    assert ask() == whole


def test_counts_leave_a_task_as_counts(spark):
    """The same dictionary and transitions as from a row a word, without a window or a shuffled row a word."""
    rng = random.Random(4)
    rows = [(k, [(w, "N" if w in "ab" or rng.random() < 0.5 else "V") for w in (rng.choice("abcdefg") for _ in range(rng.randrange(6)))]) for k in range(300)]
    listed = spark.createDataFrame([(k, [w for w, _ in x], [t for _, t in x]) for k, x in rows] + [(300, None, None)], "id int, forms array<string>, tags array<string>")
    each = spark.createDataFrame([(k, i, *x) for k, xs in rows for i, x in enumerate(xs)], "id int, pos int, form string, tag string")
    counts = tagger.counted(listed, F.col("forms"), F.col("tags"))
    told = lambda tables: [sorted((r[0], r[1], round(r[2], 9)) for r in t.collect()) for t in tables]
    assert told(tagger.weighed(counts)) == told(tagger.trained(each))
    often = {(f, t) for _, xs in rows for f, t in xs if sum((f, t) in x for _, x in rows) >= 60}
    assert {r[:2] for r in told(tagger.weighed(counts, 60))[0]} == often
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.index("Exchange") < plan.index("MapInArrow") and plan.count("Exchange") == 1
