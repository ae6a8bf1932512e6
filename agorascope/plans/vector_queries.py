"""Queries over embeddings, hierarchies, sentences and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import sentences as N
from ..functions import text as T
from ..operators import clusters as C
from ..operators import entities as E
from ..operators import frames as R
from ..operators import maxent, mining, models
from ..operators import sampling as S
from .tables import spread, table, words
from .thread_queries import cases, with_gold

NEAR = 1.25
#: Frames whose heads are common words and whose arguments are told by their first letter.
FIRST_LETTERS = {"of": [("t", "Actor"), ("e", "Target")], "and": [("a", "Actor"), ("z", "Target")]}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def eps_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.pivot_edges(points(spark, sf_dir), NEAR)
    return found.withColumn("d2", F.round("d2", 6))


def eps_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.near_components(points(spark, sf_dir), NEAR)


def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.near_leaders(points(spark, sf_dir), [1.5]).select("id", "leader")


def dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dense_clusters(points(spark, sf_dir), 1.5)


def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One assignment to the first five vectors: cluster sizes and mean squared distance."""
    p = points(spark, sf_dir)
    seeds = [(i, [float(x) for x in r["vector"]]) for i, r in enumerate(p.orderBy("id").limit(5).collect())]
    return C.assigned(p, seeds).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("d2"), 6).alias("d2"))


def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.kmeans(points(spark, sf_dir), 10, eps=1.0)


def vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of each vector against the one before it."""
    p = points(spark, sf_dir)
    b = p.select((F.col("id") + 1).alias("id"), F.col("vector").alias("w"))
    v, w = F.col("vector"), F.col("w")
    return p.join(b, "id").select("id", F.round(A.squared_distance(v, w), 5).alias("d2"), F.round(A.manhattan(v, w), 5).alias("d1"), F.round(A.dot(v, w), 5).alias("dot"))


def hypernym_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers belong to nations, these to regions, these to the world."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    up = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent")).unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("parent")))
    starts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("start"), F.concat(F.lit("n"), "c_nationkey").alias("node"))
    return R.closure(starts, up)


def scf_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns tagged by a word's first letter, judged by a frame whose head is a common word."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.latin_tokens(F.col("text")).alias("words"))
    tokens = F.transform("words", lambda w: F.struct(w.alias("word"), F.array(F.substring(w, 1, 1)).alias("tags")))
    found = R.with_completeness(rows.select("conv_id", "turn", tokens.alias("tokens")), FIRST_LETTERS)
    return found.select("conv_id", "turn", "complete", F.array_join("open", ",").alias("open"))


def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", N.sentences("text").alias("s"))
    return found.select("doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences"))


def simple_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").repartition("doc_id").select("doc_id", T.simple_sentences(F.col("text")).alias("s"))
    return found.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "\n")).alias("sentences"))


def maxent_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of the entity candidates of all cases, by a model fitted on them."""
    rows = E.training_rows(with_gold(cases(spark, sf_dir)), "gold")
    found = maxent.classify(rows, maxent.train(rows))
    return found.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def sentiment_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training accuracy of a quality classifier, by label."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.split("text", " ").alias("tokens"), F.col("quality").cast("double").alias("label"))
    model = models.text_classifier(docs, "label")
    return model.transform(docs).groupBy("label").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def lda_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have each of 20 topics as their greatest."""
    docs = words(spark, sf_dir).where("tokens IS NOT NULL").repartition("doc")
    found = models.topic_arrays(models.topics(docs), docs)
    top = F.array_position("topic_vector", F.array_max("topic_vector")) - 1
    return found.groupBy(top.alias("topic")).agg(F.count("*").alias("n"))


def leader_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders in a seeded order for the toolkit's eleven distances: clusters and points of each. The table's vectors have
    length 1, and these distances are of longer ones: twenty times as long, they lie on both sides of the usual distance."""
    found = C.multi_leader(points(spark, sf_dir).withColumn("vector", F.transform("vector", lambda x: x.cast("double") * 20)))
    sizes = found.groupBy("eps", "leader").agg(F.count("*").alias("n"))
    return sizes.groupBy("eps").agg(F.count("*").alias("clusters"), F.sum("n").alias("points"))


def dbscan_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core points, and the components that they make."""
    return C.dense_clusters(points(spark, sf_dir), NEAR, least=4).where("core").select("id", "cluster")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of two clusterings: customers by nation and by segment, as (word, clustering, category)."""
    customer = table(spark, sf_dir, "customer")
    one = customer.select(F.col("c_custkey").alias("word"), F.lit(0).alias("clustering"), F.col("c_nationkey").cast("string").alias("category"))
    return one.unionByName(customer.select(F.col("c_custkey").alias("word"), F.lit(1).alias("clustering"), F.col("c_mktsegment").alias("category")))


def categories_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a brand and a size that share no part."""
    part = table(spark, sf_dir, "part")
    of = lambda k, c: part.select(F.col("p_partkey").alias("word"), F.lit(k).alias("clustering"), F.col(c).cast("string").alias("category"))
    members = of(0, "p_brand").unionByName(of(1, "p_size"))
    key = F.struct("clustering", "category")
    one, two = members.where("clustering = 0").select(key.alias("x")).distinct(), members.where("clustering = 1").select(key.alias("y")).distinct()
    pairs = one.join(F.broadcast(two), F.col("x.clustering") < F.col("y.clustering"))  # 25 by 50
    return C.different(members, pairs).select(F.col("x.category").alias("brand"), F.col("y.category").alias("size"))


def category_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = clustered(spark, sf_dir)
    found = C.words_of(members, members.where("clustering = 1").select("clustering", "category").distinct())
    return found.select("category", F.size("words").cast("long").alias("n"), F.md5(F.array_join(F.col("words").cast("array<string>"), ",")).alias("words"))


def items_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers with their categories, counted."""
    members = clustered(spark, sf_dir)
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("word")).distinct()
    found = C.expanded(items.withColumn("word", F.col("word").cast("string")), members.withColumn("word", F.col("word").cast("string")))
    return found.groupBy("clustering").agg(F.count("*").alias("n"))


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, item): the kinds of lines that orders have."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("doc"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("item")).distinct()


def dependencies_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, dependent, probability) of kinds of lines that go together"""
    found = mining.postings(lines_of(spark, sf_dir))
    return mining.conditional(mining.pair_support(found, 20), mining.frequent_items(found, 20))


def lone_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of line stands beside at most one that depends on it or on which it depends."""
    edges = dependencies_of(spark, sf_dir).where("probability >= 0.17").select("target", "dependent")
    return C.word_context(lines_of(spark, sf_dir), edges).groupBy("item").agg(F.count("*").alias("n"))


def omitted_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order lacks that the order before had and that its lines depend on, counted."""
    docs = lines_of(spark, sf_dir)
    found = C.omissions(docs, docs.select((F.col("doc") + 1).alias("doc"), "item"), dependencies_of(spark, sf_dir), 0.15)
    return found.groupBy("omitted").agg(F.count("*").alias("n"), F.round(F.max("probability"), 6).alias("probability"))


def first_dependents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies by their first dependent, and by the words of a category that stands first."""
    found = dependencies_of(spark, sf_dir).select("target", F.array(F.concat(F.lit("#"), F.substring("dependent", 1, 1))).alias("dependents"), "probability")
    members = lines_of(spark, sf_dir).select(F.concat(F.lit("#"), F.substring("item", 1, 1)).alias("category"), F.col("item").alias("word")).distinct()
    return C.dependency_index(found, members).groupBy("first").agg(F.count("*").alias("n"))


def scf_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open arguments of each turn, filled from the turn before it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.latin_tokens(F.col("text")).alias("words"))
    tokens = F.transform("words", lambda w: F.struct(w.alias("word"), F.array(F.substring(w, 1, 1)).alias("tags")))
    before = F.lag(tokens).over(Window.partitionBy("conv_id").orderBy("turn"))
    found = R.recovered(rows.select("conv_id", "turn", tokens.alias("target"), before.alias("context")), FIRST_LETTERS)
    return found.select("conv_id", "turn", F.array_join("recovered", ",").alias("recovered"))


def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each labelled document two others that neither are nor follow it: how many were drawn, all different, and how
    many of these are among the positives."""
    labels = table(spark, sf_dir, "labels")
    positives = labels.select(F.col("doc_id").alias("a"), F.explode(F.array("doc_id", F.col("doc_id") + 1)).alias("b"))
    found = S.negatives(labels.select(F.col("doc_id").alias("a")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("b")), positives, per=2)
    found = found.join(positives.withColumn("_wrong", F.lit(1)), ["a", "b"], "left")
    return found.groupBy("a").agg(F.count_distinct("b").alias("n"), F.count("*").alias("n_drawn"), F.count("_wrong").alias("n_positive"))


QUERIES = [
    eps_edges, eps_components, leader_clusters, leader_sweep, dbscan, dbscan_cores, kmeans_step, kmeans, vector_measures, hypernym_closure, categories_apart, category_words, items_expanded, lone_items,
    omitted_items, first_dependents, scf_complete, scf_recover, negative_pairs, split_sentences, simple_sentences, maxent_fit, sentiment_lr, lda_topics,
]

_VECTORS = "v AS (SELECT vec_id AS id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)"
_EDGES = """p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
edges AS (SELECT * FROM (SELECT l.id AS a, r.id AS b, pow(list_distance(l.e, r.e), 2) AS d2 FROM p l JOIN p r ON l.id < r.id) WHERE d2 < {limit})"""

_DEPENDS = """items AS (SELECT DISTINCT l_orderkey AS doc, l_returnflag || l_linenumber AS item FROM lineitem), freq AS (SELECT item, count(*) AS n FROM items GROUP BY item HAVING count(*) >= 20),
pairs AS (SELECT l.item AS a, r.item AS b, count(*) AS n FROM items l JOIN items r ON l.doc = r.doc AND l.item <> r.item GROUP BY ALL HAVING count(*) >= 20),
deps AS (SELECT a AS target, b AS dependent, pairs.n / CAST(freq.n AS DOUBLE) AS p FROM pairs JOIN freq ON b = item)"""

SQL = {
    "eps_edges": f"WITH {_EDGES.format(limit=NEAR)} SELECT a, b, round(d2, 6) AS d2 FROM edges",
    "eps_components": f"""WITH RECURSIVE {_EDGES.format(limit=NEAR)}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT id, id AS other FROM p UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.other = e.a)
SELECT id, min(other) AS cluster FROM reach GROUP BY id""",
    "dbscan": f"""WITH RECURSIVE {_EDGES.format(limit=1.5)}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
cores AS (SELECT a AS id FROM both_ways GROUP BY a HAVING count(*) + 1 >= 5), near AS (SELECT a, b FROM both_ways WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)),
reach AS (SELECT id, id AS other FROM cores UNION SELECT r.id, e.b FROM reach r JOIN near e ON r.other = e.a),
inner_ AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id), border AS (SELECT a AS id, min(cluster) AS cluster FROM both_ways JOIN inner_ ON b = inner_.id GROUP BY a)
SELECT p.id, coalesce(i.cluster, b.cluster) AS cluster, i.id IS NOT NULL AS core FROM p LEFT JOIN inner_ i ON p.id = i.id LEFT JOIN border b ON p.id = b.id""",
    "dbscan_cores": f"""WITH RECURSIVE {_EDGES.format(limit=NEAR)}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
cores AS (SELECT a AS id FROM both_ways GROUP BY a HAVING count(*) + 1 >= 4), near AS (SELECT a, b FROM both_ways WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)),
reach AS (SELECT id, id AS other FROM cores UNION SELECT r.id, e.b FROM reach r JOIN near e ON r.other = e.a)
SELECT id, min(other) AS cluster FROM reach GROUP BY id""",
    "categories_apart": """SELECT b AS brand, CAST(s AS VARCHAR) AS size FROM (SELECT DISTINCT p_brand AS b FROM part) CROSS JOIN (SELECT DISTINCT p_size AS s FROM part)
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_brand = b AND p_size = s)""",
    "category_words": "SELECT c_mktsegment AS category, count(*) AS n, md5(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey)) AS words FROM customer GROUP BY 1",
    "items_expanded": """WITH b AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_nationkey, c_mktsegment FROM customer JOIN b ON c_custkey = k)
SELECT CAST(NULL AS INTEGER) AS clustering, count(*) AS n FROM b UNION ALL SELECT 0, count(DISTINCT c_nationkey) FROM c UNION ALL SELECT 1, count(DISTINCT c_mktsegment) FROM c""",
    "lone_items": f"""WITH {_DEPENDS}, near AS (SELECT target AS item, dependent AS other FROM deps WHERE p >= 0.17 UNION SELECT dependent, target FROM deps WHERE p >= 0.17),
c AS (SELECT i.doc, i.item, count(o.item) AS n FROM items i LEFT JOIN near USING (item) LEFT JOIN items o ON o.doc = i.doc AND o.item = near.other GROUP BY i.doc, i.item)
SELECT item, count(*) AS n FROM c WHERE n <= 1 GROUP BY item""",
    "omitted_items": f"""WITH {_DEPENDS}, needed AS (SELECT i.doc, target AS omitted, max(p) AS p FROM items i JOIN deps ON i.item = dependent AND p >= 0.15 GROUP BY ALL),
found AS (SELECT n.* FROM needed n JOIN items b ON b.doc + 1 = n.doc AND b.item = n.omitted LEFT JOIN items o ON o.doc = n.doc AND o.item = n.omitted WHERE o.doc IS NULL)
SELECT omitted, count(*) AS n, round(max(p), 6) AS probability FROM found GROUP BY omitted""",
    "first_dependents": f"""WITH {_DEPENDS}, f AS (SELECT '#' || left(dependent, 1) AS first FROM deps)
SELECT first, count(*) AS n FROM f GROUP BY first UNION ALL SELECT item, count(*) FROM f JOIN (SELECT DISTINCT item FROM items) ON '#' || left(item, 1) = first GROUP BY item""",
    "negative_pairs": "SELECT doc_id AS a, CAST(2 AS BIGINT) AS n, CAST(2 AS BIGINT) AS n_drawn, CAST(0 AS BIGINT) AS n_positive FROM labels",
    "simple_sentences": r"""WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?…][''"]?)\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(l, lambda x: regexp_replace(x, '^[.!?…\s]+', '')), lambda x: x <> '') AS l FROM p)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_sentences, md5(array_to_string(l, chr(10))) AS sentences FROM s""",
    "kmeans_step": """WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cluster, e FROM (SELECT * FROM p ORDER BY id LIMIT 5)),
d AS (SELECT p.id, cluster, pow(list_distance(p.e, c.e), 2) AS d2 FROM p CROSS JOIN c), best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, cluster) AS r FROM d)
SELECT cluster, count(*) AS n, round(avg(d2), 6) AS d2 FROM best WHERE r = 1 GROUP BY cluster""",
    "vector_measures": f"""WITH {_VECTORS} SELECT a.id, round(sum((a.x - b.x) * (a.x - b.x)), 5) AS d2, round(sum(abs(a.x - b.x)), 5) AS d1, round(sum(a.x * b.x), 5) AS dot
FROM v a JOIN v b ON a.id = b.id + 1 AND a.k = b.k GROUP BY a.id""",
    "hypernym_closure": """SELECT c_custkey AS start, 'n' || c_nationkey AS node, 0 AS depth FROM customer UNION ALL SELECT c_custkey, 'r' || n_regionkey, 1 FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_custkey, 'world', 2 FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
