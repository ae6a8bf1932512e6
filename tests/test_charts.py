"""Charts filled together: against all trees, at mixed lengths, and clauses without a shuffled node."""

import random

from pyspark.sql import functions as F

from agorascope.operators import frames, grammar

from test_tagger import RULES, derivations

NAMED = [(k, " ".join(x)) for k, x in enumerate([("N", "V"), ("V",), ("N", "V", "N", "J", "V"), ("J",), (), ("N", "V")])]


def test_charts_of_many_sentences(monkeypatch):
    rng, chart = random.Random(5), grammar.Grammar(RULES)
    tags = [tuple(rng.choice("NJVEZ") for _ in range(rng.randrange(7))) for _ in range(200)]
    whole = chart.trees(tags)
    for x, (weight, nodes) in zip(tags, whole):
        every = list(derivations(list(x), "S", 0, len(x)))
        assert weight == (max(every) if every else None)
        assert [i for *_, i in nodes if i >= 0] == list(range(len(x))) and chart.trees([x]) == [(weight, nodes)]
    filled = []
    monkeypatch.setattr(grammar.Grammar, "charts", lambda self, t, f=grammar.Grammar.charts: (filled.append(len(t)), f(self, t))[1])
    assert chart.trees(tags * 3) == whole * 3
    assert sum(filled) == len({x for x in tags if x}) and len(filled) == len({len(x) for x in tags if x})
    monkeypatch.setattr(grammar, "CELLS", 1)
    assert chart.trees(tags) == whole


def test_ties_go_to_the_shorter_left_part():
    chart = grammar.Grammar([("S", "S", "S", -5), ("S", "a", None, -1)])
    assert [(p, t) for p, t, i in chart.trees([("a",) * 3])[0][1] if i < 0] == [(-1, "S"), (0, "S"), (0, "S"), (3, "S"), (3, "S")]
    assert chart.trees([("a",) * 400])[0][0] == -399 * 5 - 400


def test_grammars_of_many_symbols():
    """More symbols and rules than two bytes number; those that don't occur cost no charts."""
    more = [(f"X{k}", f"X{k + 1}", f"Y{k % 300}", -1) for k in range(20_000)] + [(f"Z{k}", "N", None, -9_000) for k in range(300)]
    tags = [("N", "V"), ("N", "J", "V", "E")]
    assert grammar.Grammar(RULES + more).trees(tags) == grammar.Grammar(RULES).trees(tags)


def test_clauses_without_a_shuffled_node(spark, monkeypatch):
    words = F.transform(F.filter(F.split("text", " "), lambda x: x != ""), lambda t: F.struct(F.concat(F.lit("the"), t).alias("word"), t.alias("pos")))
    rows = spark.createDataFrame([*NAMED, (6, None)], "id int, text string").withColumn("tagged", words)
    rules = spark.createDataFrame([(p, a, b, w / 1000) for p, a, b, w in RULES], "parent string, left string, right string, weight double")
    told = lambda df: sorted(tuple(r) for r in df.collect())
    within = lambda entity: frames.clauses_within(grammar.with_trees(rows, F.col("tagged"), rules), "tree", entity)
    for entity in ("theV", "theN", "x"):
        assert told(within(entity)) == told(frames.lowest_clauses(grammar.parsed(rows, "id", F.col("tagged"), rules), entity))
    assert told(within("theV")) and "Exchange" not in within("theV")._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(grammar, "PART", 2)
    assert told(within("theV")) == told(frames.lowest_clauses(grammar.parsed(rows, "id", F.col("tagged"), rules), "theV"))
