"""Pairs of few items, supports of categories, and neighbours and omissions by documents."""

import random

import pytest
from pyspark.sql import functions as F

from agorascope.operators import clusters as C
from agorascope.operators import mining


def lines(seed, n=40):
    rng = random.Random(seed)
    return {d: set(rng.choices("abcdefg", k=rng.randrange(1, 6))) for d in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(d, x) for d, items in docs.items() for x in items], "doc long, item string")


@pytest.mark.parametrize("kind", ["document", "posting"])
def test_few_pairs_need_no_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(mining, "pair_counts", None)
    docs = lines(1)
    mult = {(d, x): 1 + (d + ord(x)) % 3 for d, items in docs.items() for x in items}
    found = frame(spark, docs).withColumn("mult", (1 + (F.col("doc") + F.ascii("item")) % 3).cast("long"))
    want = {}
    for d, items in docs.items():
        for a in items:
            for b in items:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + (min(mult[d, a], mult[d, b]) if kind == "posting" else 1)
    got = {(r["a"], r["b"]): r["support"] for r in mining.pair_support(found, 5, kind).collect()}
    assert got == {k: n for k, n in want.items() if n >= 5} and got


def test_posting_support_comes_from_the_words(spark):
    items = spark.createDataFrame([(1, "aa"), (1, "bb"), (1, "c"), (2, "aa"), (2, "c"), (3, "dd")], "doc long, item string")
    members = items.select("item", F.concat(F.lit("#"), F.length("item").cast("string")).alias("category")).distinct()
    found = mining.postings(items, members)
    want = {r["item"]: r["support"] for r in mining.support(found, "posting").collect()}
    got = {r["item"]: r["support"] for r in mining.posting_support(mining.support(mining.postings(items)), members).collect()}
    assert got == want and got["#2"] == 4


def test_neighbours_and_omissions_join_no_items_with_items(spark):
    docs = lines(2)
    edges = [("a", "b", 0.9), ("b", "a", 0.2), ("c", "a", 0.6), ("d", "g", 0.55), ("e", "f", 0.8), ("c", "b", 0.7)]
    table = spark.createDataFrame(edges, "target string, dependent string, probability double")
    near = {x: {b for a, b, _ in edges if a == x} | {a for a, b, _ in edges if b == x} for x in "abcdefg"}
    found = C.neighbour_state(frame(spark, docs), table.select("target", "dependent"))
    assert {(r["doc"], r["item"]): r["n_near"] for r in found.collect()} == {(d, x): len(near[x] & items) for d, items in docs.items() for x in items}
    want = {}
    for d, items in docs.items():
        for a, b, p in edges:
            if p >= 0.5 and b in items and a not in items and a in docs.get(d - 1, ()):
                want[d, a] = max(p, want.get((d, a), 0))
    rows = frame(spark, docs)
    found = C.omissions(rows, rows.select((F.col("doc") + 1).alias("doc"), "item"), table)
    assert {(r["doc"], r["omitted"]): r["probability"] for r in found.collect()} == want and want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" not in plan
