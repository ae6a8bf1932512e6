import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from agorascope.operators import clusters as C
from agorascope.operators import entities as E
from agorascope.operators import frames as R
from agorascope.operators import labels as L
from agorascope.operators import maxent as M
from agorascope.operators import mining, vocab
from agorascope.operators import sampling as S
from agorascope.operators import threads as H
from agorascope.operators.steps import Steps, components


def test_itemsets_match_brute_force(spark):
    rng = random.Random(4)
    docs = [sorted(rng.sample(range(9), rng.randint(1, 6))) for _ in range(60)]
    rows = spark.createDataFrame([(d, i) for d, items in enumerate(docs) for i in items], "doc long, item long")
    got = {tuple(r["items"]): r["support"] for r in mining.itemsets(mining.postings(rows), 8, levels=4).collect()}
    want = {}
    for k in range(1, 5):
        for s in combinations(range(9), k):
            n = sum(set(s) <= set(d) for d in docs)
            if n >= 8:
                want[s] = n
    assert got == want


def test_posting_support_counts_categories(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "c")], "doc long, item string")
    members = spark.createDataFrame([("a", "V"), ("b", "V"), ("c", "W")], "item string, category string")
    found = mining.postings(rows, members)
    assert {r["item"]: r["support"] for r in mining.support(found, "posting").collect()} == {"a": 2, "b": 1, "c": 2, "V": 3, "W": 2}
    pairs = {(r["a"], r["b"]): r["support"] for r in mining.pair_support(found, 1, "posting", mining.sharing(members)).collect()}
    assert pairs[("V", "W")] == 2 and ("V", "a") not in pairs and pairs[("W", "a")] == 2


def test_candidates_join_prefixes(spark):
    sets = spark.createDataFrame([([1, 2, 4],), ([1, 2, 6],), ([1, 3, 4],)], "items array<int>")
    assert [r["items"] for r in mining.candidates(sets).collect()] == [[1, 2, 4, 6]]


def test_vocabulary_and_padding(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "zz"]), (2, [])], "doc long, tokens array<string>")
    tokens = vocab.exploded(docs, "doc", F.col("tokens"))
    words = vocab.vocabulary(tokens)
    assert {r["token"]: r["idx"] for r in words.collect()} == {"a": 5, "b": 6, "zz": 7}
    found = vocab.index_tokens(tokens, words.where("token <> 'zz'"), "doc", size=5).first()
    assert found["ids"] == [6, 5, 1, 0, 0]


def test_affinity_of_unknown_words_is_one(spark):
    asked = spark.createDataFrame([(1, "e", "x"), (1, "e", "y")], "case long, entity string, token string")
    lifts = spark.createDataFrame([("e", "x", 4.0)], "entity string, token string, lift double")
    r = mining.affinity(asked, lifts).first()
    assert (r["average"], r["best"]) == (2.5, 2.5)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(40, 41), (41, 40), (7, 7)]
    got = {r["node"]: r["root"] for r in components(Steps(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 21)}, 41: 40}


def leaders(n, edges, order):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    of = {}
    for i in order:
        if i not in of:
            of[i] = i
            for j in near[i]:
                of.setdefault(j, i)
    return of


def test_leader_clusters_equal_the_sequential_pass(spark):
    rng = random.Random(7)
    n = 40
    edges = [(a, b) for a, b in combinations(range(n), 2) if rng.random() < 0.08]
    order = list(range(n))
    rng.shuffle(order)
    points = spark.createDataFrame([(i, order.index(i)) for i in range(n)], "id long, p long")
    got = {r["id"]: r["leader"] for r in C.leader_clusters(points, spark.createDataFrame(edges, "a long, b long"), priority="p").collect()}
    assert got == leaders(n, edges, order)


def test_pivot_and_block_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 4))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    want = {(a, b) for a, b in combinations(range(60), 2) if ((x[a] - x[b]) ** 2).sum() < 2.0}
    assert {(r["a"], r["b"]) for r in C.pivot_edges(points, 2.0).collect()} == want
    assert {(r["a"], r["b"]) for r in C.block_edges(points, 2.0**0.5, "euclidean", block=16).collect()} == want
    product = {(a, b) for a, b in combinations(range(60), 2) if np.abs(x[a] - x[b]).prod() < 0.4**4}
    assert {(r["a"], r["b"]) for r in C.block_edges(points, 0.4, "product", block=16).collect()} == product


def test_kmeans_and_outliers(spark):
    rows = [(0, [0.0, 0.0]), (1, [10.0, 0.0]), (2, [0.2, 0.0]), (3, [10.2, 0.0]), (4, [30.0, 0.0])]
    got = {r["id"]: r["cluster"] for r in C.kmeans(spark.createDataFrame(rows, "id long, vector array<double>"), 2, eps=8.0).collect()}
    assert got[0] == got[2] == 0 and got[1] == got[3] == 1 and got[4] == 2


def test_dbscan(spark):
    rows = [(i, [float(i) * 0.1]) for i in range(6)] + [(6, [0.9]), (9, [50.0])]
    points = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {r["id"]: (r["cluster"], r["core"]) for r in C.dbscan(points, C.pivot_edges(points, 0.41**2), least=4).collect()}
    assert got[0] == (0, True) and got[6] == (0, False) and got[9] == (None, False)


def test_chain_context(spark):
    edges = spark.createDataFrame([(3, 2), (2, 1), (5, 5)], "child long, parent long")
    chains = H.ancestors(edges)
    assert {(r["child"], r["ancestor"], r["depth"]) for r in chains.collect()} == {(3, 2, 1), (2, 1, 1), (3, 1, 2)}
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (3, 1, "e")], "post long, pos long, text string")
    got = {(r["post"], r["pos"]): r["context"] for r in H.reply_context(rows, chains).collect()}
    assert got[(3, 1)] == ["a", "b", "c", "d"] and got[(1, 0)] == [] and got[(2, 0)] == ["a", "b"]


def test_cycles_end(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "child long, parent long")
    assert {(r["child"], r["ancestor"]) for r in H.ancestors(edges).collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    up = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "node string, parent string")
    got = R.closure(spark.createDataFrame([(1, "a")], "start long, node string"), up).collect()
    assert {(r["node"], r["depth"]) for r in got} == {("a", 0), ("b", 1), ("c", 2)}


def cases(spark):
    rows = [("c1", "나는 SM5 탄다", ["K5 좋다", "별로"]), ("c2", "글쎄", ["K5 산다", "SM5 K7 본다", "음"]), ("c3", "글쎄", [])]
    return E.with_mentions(spark.createDataFrame(rows, "case string, target string, context array<string>"), [(1, "sm5"), (2, "k5"), (3, "k7")])


def test_solvers(spark):
    got = {r["case"]: (r["t"], r["r"], r["f"], r["o"]) for r in cases(spark).select("case", E.target_only().alias("t"), E.recent().alias("r"), E.recents_first().alias("f"), E.first_only().alias("o")).collect()}
    assert got == {"c1": ([1], [1], [1], [2]), "c2": ([], [1, 3], [1], [2]), "c3": ([], [], [], [])}


def test_hidden_scores(spark):
    found = cases(spark).withColumn("gold", F.array(F.lit(1), F.lit(2))).withColumn("answer", E.recent())
    r = E.hidden_scores(found, "gold", "answer").first()
    assert (r["tp"], r["fp"], r["fn"]) == (1, 1, 4)  # explicit groups of the target count on neither side


def test_labels(spark):
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y")], "id long, label string")
    assert [(r["id"], r["label"], r["n"]) for r in L.unanimous(rows, "id", "label").collect()] == [(1, "x", 2)]
    assert [(r["label"], r["n"], r["total"]) for r in L.majority(rows, ["id"], least=2).orderBy("id").collect()] == [("x", 2, 2), ("x", 1, 2)]


def test_folds_keep_groups_together(spark):
    rows = spark.range(60).select(F.col("id"), (F.col("id") % 13).alias("g"))
    dealt = S.group_folds(rows, "g", 3)
    assert dealt.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["n"] for r in dealt.select("g", "fold").distinct().groupBy("fold").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [4, 4, 5]
    a, b = S.split(rows, 0.3, "id")
    assert a.count() + b.count() == 60 and a.join(b, "id").count() == 0


def test_negatives_are_no_positives(spark):
    left, right = spark.range(20).select(F.col("id").alias("a")), spark.range(20).select(F.col("id").alias("b"))
    positives = left.select("a", F.col("a").alias("b"))
    got = {(r["a"], r["b"]) for r in S.negatives(left, right, positives, per=2).collect()}
    assert len(got) == 40 and all(a != b for a, b in got) and {a for a, _ in got} == set(range(20))
    # all but one or two of the right side are positives
    most = left.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("b")).where("b <> (a + 1) % 20 AND (a > 4 OR b <> a + 2)")
    got = {(r["a"], r["b"]) for r in S.negatives(left, right, most, per=2).collect()}
    assert got == {(a, (a + 1) % 20) for a in range(20)} | {(a, a + 2) for a in range(5)}
    assert S.negatives(left, right.limit(0), positives).collect() == []


def test_frames():
    frames = {"drive": [("human", "Actor"), ("vehicle", "Target")]}
    me, car, it = ("I", ("human",)), ("car", ("vehicle", "thing")), ("it", None)
    assert R.complete([], frames) and R.complete([it], frames)
    assert R.complete([me, car, ("drive", None)], frames) and not R.complete([me, ("drive", None)], frames)
    pairs, left, open_ = R.match([car, it], frames["drive"])
    assert [p[0] for p in pairs] == [car] and left == [it] and open_ == [("human", "Actor")]


def test_recovery(spark):
    frames = {"drive": [("human", "Actor"), ("vehicle", "Target")]}
    kind = "target array<struct<word:string,tags:array<string>>>, context array<struct<word:string,tags:array<string>>>"
    rows = spark.createDataFrame([([("drive", None)], [("we", ["human"]), ("bus", ["vehicle"])]), ([], [])], kind)
    assert [r["recovered"] for r in R.recovered(rows, frames).collect()] == [["we", "bus"], []]


def test_trees(spark):
    text = "(S (NP (N cat)) (S (VP (V sees) (N dog))))"
    assert R.parse_tree(text)[0] == (0, -1, "S", "") and len(R.parse_tree(text)) == 7
    rows = [(1, text), (2, "(S (S (N cat)) (S (S (N cat) (V and) (N cat)) (V naps)))"), (3, "(X (N cat))"), (4, None)]
    nodes = R.trees(spark.createDataFrame(rows, "id long, tree string"), "id", "tree")
    found = lambda entity: sorted((r["id"], r["text"]) for r in R.lowest_clauses(nodes, entity).collect())
    assert found("dog") == [(1, "sees dog")] and found("cow") == []
    assert found("cat") == [(1, "cat sees dog"), (2, "cat"), (2, "cat and cat")]


def test_maxent_learns_and_scores_alike(spark):
    rows = [([1, 0], 2)] * 8 + [([0, 1], 1)] * 8 + [([1, 1], 1)] * 3 + [([1, -1], 2)] * 2
    df = spark.createDataFrame(rows, "features array<int>, label int")
    model = M.train(df, rounds=50)
    got = {(tuple(r["features"])): r["predicted"] for r in M.classify(df.distinct(), model).collect()}
    assert all(got[f] == model.classify(list(f)) for f in got)
    assert got[(1, 0)] == 2 and got[(0, 1)] == 1


def test_chains_of_any_depth(spark):
    n = 150
    edges = spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent"))
    got = H.ancestors(edges).groupBy("child").agg(F.count("*").alias("n"), F.max("depth").alias("d")).collect()
    assert {r["child"]: (r["n"], r["d"]) for r in got} == {i: (i, i) for i in range(1, n)}
    several = spark.createDataFrame([(5, 1), (5, 3), (3, 1)], "child long, parent long")
    assert {(r["child"], r["ancestor"]) for r in H.ancestors(several).collect()} == {(5, 3), (5, 1), (3, 1)}
    up = spark.range(80).select(F.col("id").alias("node"), (F.col("id") + 1).alias("parent"))
    assert R.closure(spark.createDataFrame([(1, 0)], "start long, node long"), up).count() == 81


def test_running_values_equal_arrays(spark):
    rng = random.Random(5)
    rows = [(c, t, [g for g in range(4) if rng.random() < 0.3]) for c in range(6) for t in range(9)]
    found = H.mentions_so_far(spark.createDataFrame(rows, "c long, t long, groups array<int>"), "c", "t", "groups").collect()
    for r in found:
        before = [g for c, t, g in rows if c == r["c"] and t < r["t"] and g]
        assert r["newest"] == (before[-1] if before else []) and r["oldest"] == (before[0] if before else [])
        assert r["seen"] == list(dict.fromkeys(x for g in [*before, r["groups"]] for x in g))


def test_mentions_join_equals_patterns(spark):
    texts = ["SM5 탄다", "현대SM5", "xSM5", "아현대", "9sm5 and k5", "A\\E b", "", "k5.k5?sm5", "né k7", "ék7 k7"]
    forms = [(1, "sm5"), (2, "k5"), (3, "k7"), (4, "현대"), (5, "\\E b"), (6, "A\\E")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    by_pattern = rows.select("id", F.explode(E.mentioned(F.col("text"), forms)).alias("g")).collect()
    by_join = E.mentions(rows, spark.createDataFrame(forms, "group_id int, form string"), "id", "text").collect()
    assert {(r["id"], r["g"]) for r in by_pattern} == {(r["id"], r["group_id"]) for r in by_join} and by_pattern
    assert E.mentions(rows, spark.createDataFrame([], "group_id int, form string"), "id", "text").collect() == []


def test_numbers_are_dense_in_any_ranges(spark):
    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 20, "0").alias("w")).repartition(7)
    got = {r["w"]: r["n"] for r in vocab.numbered(rows, "w", 5, "n").collect()}
    assert got == {str(i).zfill(20): i + 5 for i in range(1000)}


def test_vector_matrix(spark):
    words = spark.createDataFrame([("a", 5), ("b", 6), ("c", 7)], "token string, idx long")
    vectors = spark.createDataFrame([("c", [1.0, 2.0]), ("b", [3.0, 4.0])], "word string, vector array<float>")
    got = {r["row"]: (r["token"], r["vector"]) for r in vocab.vector_matrix(words, vectors, 2).collect()}
    assert sorted(got) == list(range(8)) and got[0] == (None, [0.0, 0.0]) and got[5] == ("b", [3.0, 4.0]) and got[6] == ("c", [1.0, 2.0]) and got[7][0] == "a"
    assert all(-0.25 <= x <= 0.25 for i in (1, 2, 3, 4, 7) for x in got[i][1])


def test_edges_in_many_cells(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((150, 3)), 0.01 * rng.standard_normal((50, 3))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    want = {(a, b) for a, b in combinations(range(200), 2) if ((x[a] - x[b]) ** 2).sum() < 0.1}
    found = C.pivot_edges(points, 0.1, block=16).collect()
    assert {(r["a"], r["b"]) for r in found} == want and len(found) == len(want)
    assert all(abs(r["d2"] - ((x[r["a"]] - x[r["b"]]) ** 2).sum()) < 1e-12 for r in found)


def test_leader_sweep(spark):
    points = spark.createDataFrame([(i, [float(i)]) for i in range(12)], "id long, vector array<double>")
    got = C.multi_leader(points, [0.0, 1.0, 200.0]).collect()
    leaders_of = lambda e: {r["leader"] for r in got if r["eps"] == e}
    assert len(leaders_of(0.0)) == 12 and len(leaders_of(200.0)) == 1 and 4 <= len(leaders_of(1.0)) <= 6
    assert all(abs(r["id"] - r["leader"]) <= 1 for r in got if r["eps"] == 1.0)


def test_itemset_order_and_categories(spark):
    sets = spark.createDataFrame([([2, 3],), ([1],), ([1, 9],)], "items array<int>")
    assert [r["items"] for r in mining.ordered(sets).collect()] == [[1], [1, 9], [2, 3]]
    tokens = spark.createDataFrame([(1, 0, "x"), (1, 1, "b"), (1, 2, "a"), (2, 0, "x")], "doc long, pos long, item string")
    members = spark.createDataFrame([("a", "V"), ("b", "V")], "item string, category string")
    assert [tuple(r) for r in vocab.contains_category(tokens, members).collect()] == [(1, "V")]
    assert [tuple(r) for r in vocab.first_of_category(tokens, members).collect()] == [(1, "V", "b")]
    indexed = spark.createDataFrame([(1, [5, 1000003, 9])], "doc long, ids array<long>")
    words = spark.createDataFrame([("w", 5)], "token string, idx long")
    clusters = spark.createDataFrame([(3, "b"), (3, "a")], "cluster_id long, word string")
    assert vocab.readable(indexed, words, clusters, "doc").first()["text"] == "w g[a,b,]"
    items = spark.createDataFrame([(7,), (8,)], "item long")
    assert {r["item"] for r in vocab.with_clusters(items, spark.createDataFrame([(7, 2)], "item long, cluster_id long")).collect()} == {1000002, 8}
    lines = spark.createDataFrame([("a", 9, 0), ("a", 4, 1)], "word string, idx long, line_no long")
    assert vocab.reversed_vocabulary(lines, "line_no").first()["idx"] == 4 and vocab.reversed_vocabulary(lines).first()["idx"] == 9


def test_label_helpers(spark):
    rows = spark.createDataFrame([([1], [1]), ([1], [1, 2]), ([1, 2], [1]), ([1], [2])], "g array<int>, f array<int>")
    assert tuple(L.estimate_summary(rows, "g", "f").first()) == (4, 1, 1, 1, 1)
    marks = spark.createDataFrame([("1",), ("2",), ("3",), ("x",)], "label string")
    assert [r[0] for r in marks.select(L.recoded(F.col("label"))).collect()] == ["positive", "neutral", "negative", None]
    assert [r[0] for r in marks.select(L.recoded(F.col("label"), neutral=False)).collect()] == ["positive", None, "negative", None]
    assert L.sentiment_only(marks).count() == 3 and L.label_counts(marks).count() == 4
    assert tuple(L.success(marks, F.col("label") == "1").first()) == (4, 1, 0.25)
    guesses = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "a")], "t string, g string")
    assert {tuple(r) for r in L.confusion(guesses, "t", "g").collect()} == {("a", "a", 2), ("a", "b", 1)}
    assert tuple(L.fold_summary(spark.createDataFrame([(1.0,), (3.0,)], "s double"), "s").first()) == (2.0, 1.0)
    posts = spark.createDataFrame([(1, 5), (1, 3), (2, 4)], "thread long, pos long")
    assert [(r["thread"], r["pos"]) for r in L.regrouped(posts, "thread", "pos").orderBy("begin", "pos").collect()] == [(1, 3), (1, 5), (2, 4)]


def test_affinity_solver_and_groups(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case long")
    scores = spark.createDataFrame([(1, 7, 2.5), (1, 8, 2.0), (2, 7, float("nan"))], "case long, entity int, best double")
    assert {r["case"]: r["answer"] for r in E.by_affinity(cases, scores).collect()} == {1: [7], 2: [], 3: []}
    entities = spark.createDataFrame([(3, "a"), (9, "b"), (9, "c"), (12, "d")], "group_id int, form string")
    found = E.present_groups(entities, spark.createDataFrame([(9,), (12,)], "group_id int"))
    assert {(r["form"], r["new_id"]) for r in found.collect()} == {("b", 1), ("c", 1), ("d", 2)}


def test_context_solvers(spark):
    forms = [(1, "sm5"), (2, "k5")]
    rows = [("c1", "engine sounds great", ["the sm5 engine", "k5 wheels"]), ("c2", "wheels again", ["sm5 engine here", "no idea", "k5 wheels"])]
    found = E.with_mentions(spark.createDataFrame(rows, "case string, target string, context array<string>"), forms)
    got = {r["case"]: (r["c"], r["k"]) for r in found.select("case", E.by_context(forms).alias("c"), E.cascade(forms).alias("k")).collect()}
    assert got == {"c1": ([1], [1]), "c2": ([2], [2])}


def test_word_graph(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "doc long, item string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "target string, dependent string")
    assert {(r["doc"], r["item"]): r["n_near"] for r in C.neighbour_state(docs, edges).collect()} == {(1, "a"): 2, (1, "b"): 1, (1, "c"): 1, (2, "a"): 0}
    assert {(r["doc"], r["item"]) for r in C.word_context(docs, edges).collect()} == {(1, "b"), (1, "c"), (2, "a")}
    likely = spark.createDataFrame([("b", "a", 0.9), ("c", "a", 0.2)], "target string, dependent string, probability double")
    now, before = spark.createDataFrame([(2, "a")], "doc long, item string"), spark.createDataFrame([(2, "b"), (2, "c")], "doc long, item string")
    assert [tuple(r) for r in C.omissions(now, before, likely).collect()] == [(2, "b", 0.9)]


def test_random_context_and_first_mention(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"]), (2, ["x"])], "id long, tokens array<string>")
    r = H.random_context(rows, "id", width=2).collect()
    assert len(r) == 1 and (r[0]["left"] + [r[0]["word"]] + r[0]["right"]) == r[0]["tokens"][max(0, r[0]["at"] - 2) : r[0]["at"] + 3]
    turns = spark.createDataFrame([(1, 0, []), (1, 1, [4]), (1, 2, [5]), (2, 0, [])], "g long, t long, e array<int>")
    assert [tuple(r) for r in H.first_mention(turns, "g", "t", "e").collect()] == [(1, [4])]
