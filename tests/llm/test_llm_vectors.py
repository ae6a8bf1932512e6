"""Operators on vectors against brute force."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorascope.llm import ann_forest, embed_dedup, toxicity

BAD = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 3, []]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    rows = []
    for b in rng.standard_normal((60, 16)):
        b /= np.linalg.norm(b)
        rows.append(b)
        for c in (0.9005, 0.92, 0.97):
            o = rng.standard_normal(16)
            o -= o @ b * b
            rows.append((c * b + np.sqrt(1 - c * c) * o / np.linalg.norm(o)) * rng.uniform(0.5, 3))
    rows += [rows[0] + 0.01 * rng.standard_normal(16) for _ in range(50)]
    rows += [rows[4]] * 20
    return [[float(np.float32(x)) for x in v] for v in rows]


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate([*vectors, *BAD])], "vec_id long, embedding array<float>, label int")


def cosines(vectors):
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


def test_embedding_links(spark, vectors):
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicates(table(spark, vectors), block=32).collect()}
    near = cosines(vectors) >= 0.9
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    links = np.array([got[i]["n_links"] for i in range(len(vectors))])
    assert (links <= want).all() and links.sum() >= 0.9995 * want.sum()
    for i in range(len(vectors), len(vectors) + len(BAD)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) and got[i]["component_id"] <= i for i in got)
    assert {got[i]["component_id"] for i in range(4, 8)} == {got[i]["component_id"] for i in [4, *range(290, 310)]}


@pytest.mark.parametrize("most_sent", [10**6, 0])
def test_nearest_neighbours(spark, vectors, most_sent):
    got = collections.defaultdict(dict)
    for r in ann_forest.nearest(table(spark, vectors), F.col("vec_id") % 7 == 0, block=500, most_sent=most_sent).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    near = cosines(vectors)
    hits = total = 0
    for q in range(0, len(vectors), 7):
        order = sorted((-near[q, j], j) for j in range(len(vectors)) if j != q)[:5]
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        assert all(abs(near[q, j] - s) < 1e-9 for j, s in got[q].values())
        assert [s for _, (_, s) in sorted(got[q].items())] == sorted((s for _, s in got[q].values()), reverse=True)
        hits += len({j for _, j in order} & {j for j, _ in got[q].values()})
        total += 5
    assert hits >= 0.9 * total
    assert set(got) == set(range(0, len(vectors), 7))


def test_the_share_that_is_scored_falls(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((400, 24))
    shares = []
    for n in (1_000, 8_000):
        x = (centres[rng.integers(0, 400, n)] + 0.7 * rng.standard_normal((n, 24))).astype(np.float32)
        rows, counted = [(i, v.tolist()) for i, v in enumerate(x)], []
        found = ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, counted=counted).collect()
        near = cosines(x.astype(np.float64))
        hits = 0
        for q in range(0, n, 50):
            near[q, q] = -2
            hits += len(set(np.argsort(-near[q], kind="stable")[:5]) & {r["vec_id"] for r in found if r["query_id"] == q})
        assert hits >= 0.9 * len(found) and len(found) == 5 * (n // 50)
        shares.append(sum(counted) / (n // 50) / n)
    assert shares[1] < 0.8 * shares[0] and shares[1] < 0.2, shares


def test_a_third_of_all_vectors_are_equal(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [float(x) for x in rng.standard_normal(3)]) for i in range(300)]
    got = collections.defaultdict(list)
    for r in ann_forest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got[0] == [3, 6, 9, 12, 15] and got[150] == [0, 3, 6, 9, 12] and all(len(got[q]) == 5 for q in range(0, 300, 50))


def test_few_candidates_and_ties(spark):
    rows = spark.createDataFrame([(50, [1.0, 0.0]), (3, [0.0, 1.0]), (2, [0.0, 1.0]), (9, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann_forest.nearest(rows, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(50, 1, 2, 0.0), (50, 2, 3, 0.0)]


def test_rotations_are_orthogonal_and_tables_reach_the_recall():
    x = embed_dedup.unit(np.random.default_rng(1).standard_normal((300, 16)))
    for r in embed_dedup.learn(x, 16, 2):
        assert np.allclose(r @ r.T, np.eye(16), atol=1e-9)
    plan = embed_dedup.Tables(10**6, 64, 0.9, 0.9999)
    agree = 1 - np.arccos(0.9) / np.pi
    assert 1 - (1 - agree**plan.bits) ** plan.tables >= 0.9999 and plan.count * (64 // plan.bits) >= plan.tables


def test_each_length_links_by_itself(spark):
    rng = np.random.default_rng(5)
    rows = [[1.0, 2.0], [2.0, 4.0]] + [[float(x) for x in rng.standard_normal(3)] for _ in range(5)] + [[1.0, 2.0, 0.0], [5.0], [7.0], [-7.0]]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embed_dedup.near_duplicates(table(spark, rows), sample=4).collect()}
    every = [*rows, [1.0] * 3]  # BAD has such a vector
    for i, v in enumerate(rows):
        near = [j for j, w in enumerate(every) if j != i and len(w) == len(v) and np.dot(v, w) >= 0.9 * np.linalg.norm(v) * np.linalg.norm(w)]
        assert got[i][0] == len(near), v
    assert got[0][1] == got[1][1] == 0 and got[8] == (1, 8) and got[9] == (1, 8) and got[10] == (0, 10)


def test_toxicity_on_held_out_documents(spark):
    p = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{p}/labels.parquet")
    rows = toxicity.scores(spark.read.parquet(f"{p}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["score"] for r in rows if r["toxic"] == 1]
    clean = [r["score"] for r in rows if r["toxic"] == 0]
    better = np.mean([[a > b for b in clean] for a in toxic])
    assert better > 0.85 and np.mean([s >= 0.5 for s in clean]) < 0.05


def test_neutral_mentions_count_less_with_swaps(spark):
    """Identity terms stand in most toxic texts but in few clean ones; the penalty takes their weight away."""
    rng = np.random.default_rng(8)
    filler = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(filler, 12))
        toxic = i % 3 == 0
        if toxic:
            words += ["insult"] if rng.random() < 0.9 else []
        if rng.random() < (0.9 if toxic else 0.1):
            words += ["muslims"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")

    def neutral(weight):
        chosen, w, bias = toxicity.train(docs, marks, "doc_id", "text", 1000, 500, weight, 1e-4, 400)
        z = lambda t: bias + w[toxicity.Chooser(chosen).text(t)].sum()
        return z("the muslims met today") - z("the christians met today"), z("insult") - z("")

    plain, swapped = neutral(0.0), neutral(20.0)
    assert plain[0] > 0.5 and abs(swapped[0]) < 0.5 * plain[0] and swapped[1] > 1


def test_scores_equal_a_plain_version(spark):
    """Feature choice and scores over dictionaries of words; the fit itself is the operator's."""
    p = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{p}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{p}/labels.parquet")
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    held = lambda t: {f for w in set(toxicity.words(t)) for f in toxicity.features(w)}
    bags = {k: held(docs[k]) for k in marks}
    n = collections.Counter(marks.values())
    counts = [collections.Counter(f for k, b in bags.items() if marks[k] == y for f in b) for y in (0, 1)]
    scored = []
    for f in counts[0].keys() | counts[1].keys():
        c, t = counts[0][f], counts[1][f]
        score = abs(np.log((t + 0.5) / (n[1] + 1)) - np.log((c + 0.5) / (n[0] + 1))) / np.sqrt(1 / (t + 0.5) + 1 / (c + 0.5))
        if t + c >= 5 and score > 2.5:
            scored.append((-score, f))
    chosen = [f for _, f in sorted(scored)[:2000]]
    chosen += [f for f in dict.fromkeys(f for g in toxicity.IDENTITY for w in g for f in toxicity.features(w)) if f not in set(chosen)]
    row = lambda features: np.array([f in features for f in chosen], np.float32)
    twins = {k: " ".join(w) for k in marks if (w := toxicity.swapped(toxicity.words(docs[k])))}
    empty = np.zeros((0, len(chosen)), np.float32)
    a, b = (np.stack(x) if twins else empty for x in ([row(bags[k]) for k in twins], [row(held(t)) for t in twins.values()]))
    w, bias = toxicity.fit(np.stack([row(bags[k]) for k in marks]), np.array(list(marks.values()), np.float32), a, b, 1.0, 1e-4, 400)
    got = {r["doc_id"]: r for r in toxicity.scores(spark.read.parquet(f"{p}/documents.parquet"), labels).collect()}
    for k, t in docs.items():
        want = 1 / (1 + np.exp(-(bias + (w * row(held(t))).sum())))
        assert abs(got[k]["score"] - want) < 2e-3 and got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0), k


def test_one_document_an_id_is_learned_from(spark):
    rows = [(1, f"bad insult {i}") for i in range(40)] + [(i, "kind word") for i in range(2, 12)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1)] + [(i, 0) for i in range(2, 12)], "doc_id long, toxic int")
    chosen, _, _ = toxicity.train(docs, marks, "doc_id", "text", 1000, 500, 1.0, 1e-4, 10)
    assert chosen == []  # no feature is in five documents that differ in their label
    assert toxicity.scores(docs, marks).count() == 50


def test_swaps():
    assert toxicity.swapped(["the", "women", "gay"]) == ["the", "men", "straight"] and toxicity.swapped(["none"]) is None
