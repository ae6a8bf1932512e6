"""The tagger against all paths, and the chart parser against all trees."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from agorascope.functions.text import content_words
from agorascope.operators import frames, grammar, tagger

FORMS = [("a", "N", -1000), ("ab", "N", -1500), ("b", "J", -700), ("b", "V", -900), ("ba", "V", -800), ("c", "E", -300), ("bc", "E", -1200), ("abc", "N", -2500), ("가", "N", -500), ("가다", "V", -400)]
PAIRS = [("^", "N", -200), ("^", "V", -900), ("N", "J", -100), ("N", "V", -800), ("V", "E", -50), ("J", "N", -400), ("E", "N", -500), ("E", "$", -100), ("J", "$", -600), ("N", "$", -700), ("N", "N", -1100)]
UNKNOWN, MISSING = -4000, -3000


def paths(word):
    """All ways to cut and tag a word."""
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        for form, tag, weight in [*FORMS, *([(word[:1], tagger.UNKNOWN, UNKNOWN)] if n == 1 else [])]:
            if form == word[:n]:
                for rest in paths(word[n:]):
                    yield ((form, tag, weight), *rest)


def value(path):
    pairs = {(a, b): w for a, b, w in PAIRS}
    tags = ["^", *(t for _, t, _ in path), "$"]
    return sum(w for *_, w in path) + sum(pairs.get(x, MISSING) for x in itertools.pairwise(tags)), -len(path)


def test_best_of_all_paths():
    model, rng = tagger.Model(FORMS, PAIRS, UNKNOWN, MISSING, kept=3), random.Random(1)
    weight = {(f, t): w for f, t, w in FORMS}
    for _ in range(300):
        words = ["".join(rng.choice("abcx가다") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4))]
        best = max(value(tuple(m for part in each for m in part)) for each in itertools.product(*map(lambda w: list(paths(w)), words)))
        score, found = model.sentence(words)
        assert "".join(f for f, _ in found) == "".join(words)
        assert (score, -len(found)) == best == value([(f, t, weight.get((f, t), UNKNOWN)) for f, t in found])
    assert len(model.solved) <= 3 and model.sentence([]) == (0, [])


def test_unknown_characters_are_one_morpheme():
    assert tagger.merged([("a", "N"), ("x", "Unknown"), ("y", "Unknown"), ("z", "Unknown"), ("b", "J")], [3, 2]) == [("a", "N"), ("xy", "Unknown"), ("z", "Unknown"), ("b", "J")]


def tables(spark):
    return spark.createDataFrame([(f, t, w / 1000) for f, t, w in FORMS], "form string, tag string, weight double"), spark.createDataFrame([(a, b, w / 1000) for a, b, w in PAIRS], "a string, b string, weight double")


def test_tagged_rows(spark):
    rows = spark.createDataFrame([(1, "ab bac"), (2, None), (3, ""), (4, "가다 xyz"), (5, "ab bac")], "id int, text string")
    got = {r["id"]: r for r in tagger.tagged(rows, F.split("text", " "), *tables(spark), UNKNOWN / 1000, MISSING / 1000).withColumn("content", content_words(F.col("tagged"), ("N", "V"))).collect()}
    model = tagger.Model(FORMS, PAIRS, UNKNOWN, MISSING)
    for r in got.values():
        words = [w for w in (r["text"] or "").split(" ") if w]
        assert [(m["word"], m["pos"]) for m in r["tagged"]] == tagger.merged(model.sentence(words)[1], [len(w) for w in words])
        assert r["content"] == [m["word"] for m in r["tagged"] if m["pos"] in ("N", "V")]
    assert got[2]["tagged"] == got[3]["tagged"] == [] and ("xyz", "Unknown") in [(m["word"], m["pos"]) for m in got[4]["tagged"]]
    with pytest.raises(ValueError, match="more than 3 rows"):
        tagger.tagged(rows, F.split("text", " "), *tables(spark), most=3)


def test_counted_model(spark):
    tokens = [(1, 0, "a", "N"), (1, 1, "b", "J"), (2, 0, "a", "N"), (2, 1, "c", "N"), (2, 2, "b", "J"), (3, 0, "b", "V")]
    forms, pairs = tagger.trained(spark.createDataFrame(tokens, "id int, pos int, form string, tag string"))
    assert {(r["form"], r["tag"]): round(math.exp(r["weight"]), 6) for r in forms.collect()} == {("a", "N"): 0.666667, ("c", "N"): 0.333333, ("b", "J"): 1, ("b", "V"): 1}
    assert {(r["a"], r["b"]): round(math.exp(r["weight"]), 6) for r in pairs.collect()} == {("^", "N"): 0.666667, ("^", "V"): 0.333333, ("N", "J"): 0.666667, ("N", "N"): 0.333333, ("J", "$"): 1, ("V", "$"): 1}


def test_model_files(spark, tmp_path):
    (tmp_path / "w").write_text("가/N -1.5\n//S -0.25\n/ -1\n1/2/M -3\n")
    (tmp_path / "t").write_text("-bnk -0.4\nbnk-N -1\nN-J -2.5\nJ-bnk -0.5\n")
    assert {tuple(r) for r in tagger.read_dictionary(spark, str(tmp_path / "w")).collect()} == {("가", "N", -1.5), ("/", "S", -0.25), ("1/2", "M", -3.0)}
    assert {tuple(r) for r in tagger.read_transitions(spark, str(tmp_path / "t")).collect()} == {("bnk", "N", -1.0), ("N", "J", -2.5), ("J", "bnk", -0.5), ("^", "N", -1.0), ("J", "$", -0.5)}


RULES = [("S", "NP", "VP", -100), ("S", "S", "S", -900), ("NP", "N", None, -300), ("NP", "N", "NP", -500), ("NP", "NP", "J", -200), ("VP", "V", None, -250), ("VP", "NP", "VP", -600), ("VP", "VP", "E", -150), ("X", "VP", None, -10), ("S", "X", None, -2000), ("VP", "X", None, -5)]


def derivations(tags, symbol, i, j, depth=3):
    """Weights of all trees of a span, with at most ``depth`` rules of one child in a row."""
    if j == i + 1 and tags[i] == symbol:
        yield 0
    for parent, left, right, weight in RULES:
        if parent == symbol:
            if right is None:
                if depth:
                    yield from (weight + w for w in derivations(tags, left, i, j, depth - 1))
            else:
                for k in range(i + 1, j):
                    lefts = list(derivations(tags, left, i, k))
                    if lefts:
                        yield from (weight + a + b for a in lefts for b in derivations(tags, right, k, j))


def weight_of(nodes, tags):
    """A tree's weight by its rules, its leaves in order."""
    children = {n: [m for m in nodes if m[1] == n[0]] for n in nodes}
    assert [(m[2]) for m in nodes if not children[m]] == tags
    total = 0
    for n, below in children.items():
        if below:
            total += max(w for p, left, right, w in RULES if p == n[2] and [left, *([right] if right else [])] == [m[2] for m in below])
    return total


def test_best_of_all_trees():
    chart = grammar.Grammar(RULES)
    parsed = 0
    for n in range(1, 6):
        for tags in itertools.product("NJVE", repeat=n):
            tags = list(tags)
            words = [f"w{i}" for i in range(n)]
            weight, nodes = chart.parse(words, tags, "S")
            every = list(derivations(tags, "S", 0, n))
            assert weight == (max(every) if every else None)
            assert [m[3] for m in nodes if m[3]] == words and all(m[1] < m[0] for m in nodes)
            if every:
                parsed += 1
                assert weight_of(nodes, tags) == weight and nodes[0][2] == "S"
            else:
                assert nodes[0][2] == grammar.FRAGMENT
    assert parsed > 20 and chart.parse([], [], "S") == (None, [])
    with pytest.raises(ValueError, match="at most 0"):
        grammar.Grammar([("S", "N", None, 5)])


def test_clauses_of_parsed_sentences(spark):
    """Text to morphemes to trees to the lowest clauses that hold an entity."""
    rows = spark.createDataFrame([(1, "ab ba c"), (2, None), (3, "a b ba a bac"), (4, "c c")], "id int, text string")
    morphemes = tagger.tagged(rows, F.split("text", " "), *tables(spark), UNKNOWN / 1000, MISSING / 1000)
    rules = spark.createDataFrame([(p, a, b, w / 1000) for p, a, b, w in RULES], "parent string, left string, right string, weight double")
    nodes = grammar.parsed(morphemes, "id", F.col("tagged"), rules)
    chart = grammar.Grammar(RULES)
    got = {}
    for r in sorted(nodes.collect(), key=lambda r: (r["id"], r["node"])):
        got.setdefault(r["id"], []).append((r["node"], r["parent"], r["type"], r["text"]))
    want = {r["id"]: chart.parse([m["word"] for m in r["tagged"]], [m["pos"] for m in r["tagged"]], "S")[1] for r in morphemes.collect()}
    assert got == {k: x for k, x in want.items() if x}
    clauses = {(r["id"], r["text"]) for r in frames.lowest_clauses(nodes, "ba").collect()}
    assert (1, "ab ba c") in clauses and all("ba" in text for _, text in clauses)


def test_what_a_worker_holds_is_bounded(spark, monkeypatch):
    """Long words, each solved for all pairs of tags: morphemes bound what is kept, not only words; parts change no result."""
    monkeypatch.setattr(tagger, "SOLVED", 500)
    model, rng = tagger.Model(FORMS, PAIRS, UNKNOWN, MISSING), random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(12)) for _ in range(400)]
    first = [model.sentence([w]) for w in words]
    held = sum(len(path) for kept in (model.solved, model.older) for each in kept.values() for *_, path in each.values())
    most = max(sum(len(path) for *_, path in model.word(w).values()) for w in words)
    assert held <= 2 * (500 + most) and [model.sentence([w]) for w in words] == first
    rows = spark.createDataFrame([(k, words[k : k + k % 5]) for k in range(60)], "id int, words array<string>")
    ask = lambda: {r["id"]: r["tagged"] for r in tagger.tagged(rows, F.col("words"), *tables(spark), UNKNOWN / 1000, MISSING / 1000).collect()}
    whole = ask()
    monkeypatch.setattr(tagger, "PART", 7)
    assert ask() == whole and whole[5] == []
