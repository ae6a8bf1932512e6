"""Queries over tokens and itemsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators import entities, marking, mining, projections, vocab
from ..operators.steps import Steps
from .tables import ITEMS, LEAST, MARKED_LEAST, TOKENS, table, turns, word_items, words

#: Words of several languages, as entities for affinities.
ENTITIES = ("and", "der", "les", "que")


def token_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.document_counts(vocab.exploded(words(spark, sf_dir), "doc", F.col("tokens")), "doc").where("n_docs >= 20").select("token", "n_docs", "n")


def pairs_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = mining.postings(word_items(spark, sf_dir))
    items = Steps(spark, "pairs").save(mining.frequent_items(found, LEAST))
    return items, mining.pair_support(found, LEAST, items=items)


def pair_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(spark, sf_dir)[1]


def pair_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, pairs = pairs_of(spark, sf_dir)
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return mining.lift(pairs, items, n).withColumn("lift", F.round("lift", 6))


def cond_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, pairs = pairs_of(spark, sf_dir)
    return mining.conditional(pairs, items).withColumn("probability", F.round("probability", 6))


def turn_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, item): turns are posts, and their words items."""
    posts = turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("doc"), word_tokens(F.col("text")).alias("tokens"))
    return posts.select("doc", F.explode(F.array_distinct("tokens")).alias("item"))


def itemsets_k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the words of turns, which are as short as posts."""
    sets = projections.mined(turn_items(spark, sf_dir), LEAST, levels=3, closed=False)
    return sets.select(F.array_join("items", " ").alias("items"), "size", "support")


def itemsets_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ten levels of the words of turns, by their closed sets, which tell the support of every other."""
    sets = projections.mined(turn_items(spark, sf_dir), LEAST, levels=10)
    return sets.select(F.array_join("items", " ").alias("items"), "size", "support")


def itemsets_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sets of up to three words of whole documents; of more words there are too many to list."""
    sets = projections.mined(word_items(spark, sf_dir), LEAST, levels=3, closed=False)
    return sets.select(F.array_join("items", " ").alias("items"), "size", "support")


def itemsets_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the categories of the words' lengths, no set of which holds an item twice: neither a word and its category."""
    items = turn_items(spark, sf_dir)
    members = length_members(items)
    sets = projections.mined(mining.postings(items, members), LEAST, levels=3, closed=False, same=mining.sharing(members))
    return sets.select(F.array_join("items", " ").alias("items"), "size", "support")


def length_members(items: DataFrame) -> DataFrame:
    """Words belong to the category of their length."""
    return items.select("item", F.concat(F.lit("#"), F.length("item").cast("string")).alias("category")).distinct()


def category_support_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Steps(spark, "supports").save(mining.support(mining.postings(word_items(spark, sf_dir))))
    return mining.posting_support(words, length_members(words)).where("support >= 100")


def category_pairs_posting(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = word_items(spark, sf_dir)
    members = length_members(items)
    found = mining.postings(items, members).where("item LIKE '#%'")
    return mining.pair_support(found, LEAST, "posting")


def support_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.supports_except(mining.postings(word_items(spark, sf_dir)), "the").where("support >= 5")


def support_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.support_without(mining.postings(word_items(spark, sf_dir)), "and", "with")


def marked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marking.item_rows(words(spark, sf_dir))
    items = marking.item_supports(rows, MARKED_LEAST)
    marked = items.where(F.col("item").startswith("th") & (F.length("item") <= 4)).select("item")
    return marking.marked_pairs(rows, marked, MARKED_LEAST, items)


def basket_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship days and flags that orders have together: itemsets over another kind of document."""
    lines = table(spark, sf_dir, "lineitem")
    items = lines.select(F.col("l_orderkey").alias("doc"), F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("item"))
    return mining.pair_support(mining.postings(items), LEAST)


def itemset_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = spark.createDataFrame([(["and", "the"],), (["of", "the", "with"],), (["a", "in", "nowhere"],)], "items array<string>")
    return mining.itemset_support(mining.postings(word_items(spark, sf_dir)), sets).select(F.array_join("items", " ").alias("items"), "support")


def complete_sentence_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.split("text", " ", -1).alias("tokens"))
    return mining.token_bags(words).where("n > 1").select(F.md5(F.array_join("bag", " ")).alias("bag"), "n")


def vocab_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocab.vocabulary(vocab.exploded(words(spark, sf_dir), "doc", F.col("tokens")), least=20)


def index_pad80(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = vocab.exploded(words(spark, sf_dir), "doc", F.col("tokens"))
    found = vocab.index_tokens(tokens.where("pos < 80"), vocab.vocabulary(tokens, least=20), "doc", size=80)
    return found.select("doc", F.array_join("ids", " ").alias("ids"))


def ids_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = vocab.exploded(words(spark, sf_dir), "doc", F.col("tokens"))
    known = vocab.vocabulary(tokens, least=20)
    return vocab.texts_of(vocab.index_tokens(tokens, known, "doc"), known, "doc").select("doc", F.md5("text").alias("text"))


def oov_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = vocab.exploded(words(spark, sf_dir), "doc", F.col("tokens"))
    return vocab.unknown_rate(tokens, vocab.vocabulary(tokens, least=20)).withColumn("rate", F.round("rate", 6))


def entity_lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, token, lift) of tokens with each of the entities, in documents"""
    rows = marking.item_rows(words(spark, sf_dir))
    items = marking.item_supports(rows, LEAST)
    marked = spark.createDataFrame([(e,) for e in ENTITIES], "item string")
    pairs = marking.marked_pairs(rows, marked, LEAST, items).select(F.col("item").alias("a"), F.col("mark").alias("b"), "support")
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    return mining.lift(pairs, items, n).select(F.col("b").alias("entity"), F.col("a").alias("token"), "lift")


def affinity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and best-three lift of each document's tokens to each entity."""
    found = marking.affinity(words(spark, sf_dir).withColumnRenamed("doc", "case"), list(ENTITIES), entity_lifts(spark, sf_dir))
    return found.withColumn("average", F.round("average", 6)).withColumn("best", F.round("best", 6))


def solver_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's entities by affinity: those whose best three lifts average above 2."""
    cases = turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("case"), word_tokens(F.col("text")).alias("tokens"))
    scores = marking.affinity(cases, list(ENTITIES), entity_lifts(spark, sf_dir))
    found = entities.by_affinity(cases.select("case"), scores, kind="string")
    return found.select("case", F.array_join("answer", ",").alias("answer"))


QUERIES = [
    token_doc_freq, pair_support, pair_lift, cond_probability, itemsets_k3, category_support_posting, category_pairs_posting, support_except, support_without, marked_pairs,
    basket_pairs, itemset_support, complete_sentence_table, vocab_index, index_pad80, ids_to_text, oov_rate, affinity_scores, solver_affinity, itemsets_apart, itemsets_closed, itemsets_documents,
]

_FREQ = f"freq AS (SELECT item, count(*) AS support FROM items GROUP BY item HAVING count(*) >= {LEAST})"
_PAIRS = f"""kept AS (SELECT doc, item FROM items WHERE item IN (SELECT item FROM freq)),
pairs AS (SELECT l.item AS a, r.item AS b, count(*) AS support FROM kept l JOIN kept r ON l.doc = r.doc AND l.item < r.item GROUP BY l.item, r.item HAVING count(*) >= {LEAST})"""
_LIFTS = """lifts AS (SELECT a, b, p.support, (p.support / n) / ((x.support / n) * (y.support / n)) AS lift FROM pairs p JOIN freq x ON a = x.item JOIN freq y ON b = y.item
  CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents))"""
_NAMES = ", ".join(f"'{e}'" for e in ENTITIES)
_ENTITY = f"""pairs AS (SELECT l.item AS a, r.item AS b, count(*) AS support FROM items l JOIN items r ON l.doc = r.doc AND l.item <> r.item
  WHERE r.item IN ({_NAMES}) AND l.item IN (SELECT item FROM freq) AND r.item IN (SELECT item FROM freq) GROUP BY ALL HAVING count(*) >= {LEAST}), {_LIFTS}"""
_SCORES = f"""each AS (SELECT "case", token, entity, coalesce(lift, 1.0) AS lift FROM said CROSS JOIN (SELECT unnest([{_NAMES}]) AS entity) LEFT JOIN lifts ON a = token AND b = entity),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "case", entity ORDER BY lift DESC) AS r FROM each),
scores AS (SELECT "case", entity, avg(lift) AS average, avg(lift) FILTER (WHERE r <= 3) AS best FROM ranked GROUP BY "case", entity)"""
_VOCAB = "vocab AS (SELECT token, 4 + row_number() OVER (ORDER BY token) AS idx FROM (SELECT token FROM tokens GROUP BY token HAVING count(*) >= 20))"
_SAID = "string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')"
_TURNS = f"items AS (SELECT DISTINCT doc, item FROM (SELECT conv_id || '-' || turn AS doc, unnest({_SAID}) AS item FROM conversations) WHERE item <> '')"

SQL = {
    "token_doc_freq": f"WITH {TOKENS} SELECT token, count(DISTINCT doc) AS n_docs, count(*) AS n FROM tokens GROUP BY token HAVING count(DISTINCT doc) >= 20",
    "pair_support": f"WITH {ITEMS}, {_FREQ}, {_PAIRS} SELECT * FROM pairs",
    "pair_lift": f"WITH {ITEMS}, {_FREQ}, {_PAIRS}, {_LIFTS} SELECT a, b, support, round(lift, 6) AS lift FROM lifts",
    "cond_probability": f"""WITH {ITEMS}, {_FREQ}, {_PAIRS}, both_ways AS (SELECT a AS target, b AS dependent, support FROM pairs UNION ALL SELECT b, a, support FROM pairs)
SELECT target, dependent, b.support, round(b.support / CAST(f.support AS DOUBLE), 6) AS probability FROM both_ways b JOIN freq f ON dependent = f.item""",
    "itemsets_k3": f"""WITH {_TURNS}, {_FREQ},
kept AS (SELECT * FROM items WHERE item IN (SELECT item FROM freq)),
two AS (SELECT l.item AS a, r.item AS b, count(*) AS support FROM kept l JOIN kept r ON l.doc = r.doc AND l.item < r.item GROUP BY ALL HAVING count(*) >= {LEAST}),
three AS (SELECT x.item AS a, y.item AS b, z.item AS c, count(*) AS support FROM kept x JOIN kept y ON x.doc = y.doc AND x.item < y.item JOIN kept z ON x.doc = z.doc AND y.item < z.item
  GROUP BY ALL HAVING count(*) >= {LEAST})
SELECT item AS items, 1 AS size, support FROM freq UNION ALL SELECT a || ' ' || b, 2, support FROM two UNION ALL SELECT a || ' ' || b || ' ' || c, 3, support FROM three""",
    "itemsets_apart": f"""WITH {_TURNS}, short AS (SELECT * FROM items),
postings AS (SELECT doc, item, item AS w, 0 AS l, 1 AS mult FROM short UNION ALL SELECT doc, '#' || length(item), NULL, length(item), count(*) FROM short GROUP BY doc, length(item)),
freq AS (SELECT item, CAST(sum(mult) AS BIGINT) AS support FROM postings GROUP BY item HAVING sum(mult) >= {LEAST}),
kept AS (SELECT * FROM postings WHERE item IN (SELECT item FROM freq)),
two AS (SELECT x.doc, x.item AS a, y.item AS b, x.w AS wa, y.w AS wb, x.l AS la, y.l AS lb, least(x.mult, y.mult) AS mult FROM kept x JOIN kept y ON x.doc = y.doc AND x.item < y.item
  WHERE NOT (coalesce(length(y.w), -1) = x.l OR coalesce(length(x.w), -1) = y.l)),
three AS (SELECT a, b, z.item AS c, least(two.mult, z.mult) AS mult FROM two JOIN kept z ON two.doc = z.doc AND b < z.item
  WHERE NOT (coalesce(length(z.w), -1) IN (la, lb) OR coalesce(length(wa), -1) = z.l OR coalesce(length(wb), -1) = z.l))
SELECT item AS items, 1 AS size, support FROM freq UNION ALL SELECT a || ' ' || b, 2, CAST(sum(mult) AS BIGINT) FROM two GROUP BY a, b HAVING sum(mult) >= {LEAST}
UNION ALL SELECT a || ' ' || b || ' ' || c, 3, CAST(sum(mult) AS BIGINT) FROM three GROUP BY a, b, c HAVING sum(mult) >= {LEAST}""",
    "category_support_posting": f"""WITH {ITEMS}, postings AS (SELECT doc, item, 1 AS mult FROM items UNION ALL SELECT doc, '#' || length(item), count(*) FROM items GROUP BY doc, length(item))
SELECT item, CAST(sum(mult) AS BIGINT) AS support FROM postings GROUP BY item HAVING sum(mult) >= 100""",
    "category_pairs_posting": f"""WITH {ITEMS}, postings AS (SELECT doc, '#' || length(item) AS item, count(*) AS mult FROM items GROUP BY doc, length(item)),
freq AS (SELECT item FROM postings GROUP BY item HAVING sum(mult) >= {LEAST})
SELECT l.item AS a, r.item AS b, CAST(sum(least(l.mult, r.mult)) AS BIGINT) AS support FROM postings l JOIN postings r ON l.doc = r.doc AND l.item < r.item
WHERE l.item IN (SELECT item FROM freq) AND r.item IN (SELECT item FROM freq) GROUP BY ALL HAVING sum(least(l.mult, r.mult)) >= {LEAST}""",
    "support_except": f"WITH {ITEMS} SELECT item, count(*) AS support FROM items WHERE doc NOT IN (SELECT doc FROM items WHERE item = 'the') GROUP BY item HAVING count(*) >= 5",
    "support_without": f"WITH {ITEMS} SELECT count(*) AS support FROM items WHERE item = 'and' AND doc NOT IN (SELECT doc FROM items WHERE item = 'with')",
    "marked_pairs": f"""WITH {ITEMS}, freq AS (SELECT item FROM items GROUP BY item HAVING count(*) >= {MARKED_LEAST}) SELECT l.item, r.item AS mark, count(*) AS support FROM items l JOIN items r ON l.doc = r.doc AND l.item <> r.item
WHERE r.item LIKE 'th%' AND length(r.item) <= 4 AND l.item IN (SELECT item FROM freq) AND r.item IN (SELECT item FROM freq) GROUP BY ALL HAVING count(*) >= {MARKED_LEAST}""",
    "basket_pairs": """WITH items AS (SELECT DISTINCT l_orderkey AS doc, l_returnflag || '-' || l_linestatus || '-' || l_linenumber AS item FROM lineitem),
freq AS (SELECT item FROM items GROUP BY item HAVING count(*) >= 20)
SELECT l.item AS a, r.item AS b, count(*) AS support FROM items l JOIN items r ON l.doc = r.doc AND l.item < r.item
WHERE l.item IN (SELECT item FROM freq) AND r.item IN (SELECT item FROM freq) GROUP BY ALL HAVING count(*) >= 20""",
    "itemset_support": f"""WITH {ITEMS}, sets AS (SELECT unnest([['and', 'the'], ['of', 'the', 'with'], ['a', 'in', 'nowhere']]) AS s), each AS (SELECT s, unnest(s) AS item FROM sets),
held AS (SELECT s, doc FROM each JOIN items USING (item) GROUP BY s, doc HAVING count(*) = len(s))
SELECT array_to_string(sets.s, ' ') AS items, count(held.doc) AS support FROM sets LEFT JOIN held ON sets.s = held.s GROUP BY sets.s""",
    "complete_sentence_table": "SELECT md5(array_to_string(list_sort(string_split(text, ' ')), ' ')) AS bag, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "vocab_index": f"WITH {TOKENS}, {_VOCAB} SELECT token, idx FROM vocab",
    "index_pad80": f"""WITH {TOKENS}, {_VOCAB}, ids AS (SELECT doc, list(coalesce(idx, 1) ORDER BY pos) AS l FROM tokens LEFT JOIN vocab USING (token) WHERE pos < 80 GROUP BY doc)
SELECT doc, array_to_string(list_concat(l, list_resize(CAST([] AS BIGINT[]), 80 - len(l), 0)), ' ') AS ids FROM ids""",
    "ids_to_text": f"WITH {TOKENS}, {_VOCAB} SELECT doc, md5(string_agg(token, ' ' ORDER BY pos)) AS text FROM tokens JOIN vocab USING (token) GROUP BY doc",
    "oov_rate": f"WITH {TOKENS}, {_VOCAB} SELECT count(*) AS n, count(*) FILTER (WHERE idx IS NULL) AS n_unknown, round(avg(CASE WHEN idx IS NULL THEN 1.0 ELSE 0.0 END), 6) AS rate FROM tokens LEFT JOIN vocab USING (token)",
    "affinity_scores": f"""WITH {ITEMS}, {TOKENS}, {_FREQ}, {_ENTITY}, said AS (SELECT doc AS "case", token FROM tokens), {_SCORES}
SELECT "case", entity, round(average, 6) AS average, round(best, 6) AS best FROM scores""",
    "solver_affinity": f"""WITH {ITEMS}, {_FREQ}, {_ENTITY}, said AS (SELECT * FROM (SELECT conv_id || '-' || turn AS "case", unnest({_SAID}) AS token FROM conversations) WHERE token <> ''), {_SCORES}
SELECT c."case", coalesce(string_agg(entity, ',' ORDER BY entity), '') AS answer FROM (SELECT conv_id || '-' || turn AS "case" FROM conversations) c
LEFT JOIN (SELECT * FROM scores WHERE best > 2) s ON c."case" = s."case" GROUP BY 1""",
}
