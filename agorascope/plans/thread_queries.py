"""Queries over threads, entities and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import entities as E
from ..operators import labels as L
from ..operators import sampling as S
from ..operators import threads as H
from .tables import ENTITIES, dictionary, entities_sql, table, turns


def prev_turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn's text with the one before it; a conversation's first turn has the last of the conversation before."""
    sentences = turns(spark, sf_dir).select(F.col("conv_id").alias("post"), F.col("turn").alias("pos"), "text")
    parents = sentences.select("post").distinct().select("post", (F.col("post") - 1).alias("parent"))
    return H.previous_pairs(sentences, parents)


def thread_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.earlier(turns(spark, sf_dir), "conv_id", "turn", "text")
    return found.select("conv_id", "turn", "n_before", F.md5(F.array_join("context", "\n")).alias("context"))


def ancestor_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts answer the post with half their number: a forest of the conversations."""
    edges = turns(spark, sf_dir).select(F.col("conv_id").alias("child"), F.expr("CASE WHEN conv_id >= 2 THEN conv_id DIV 2 END").alias("parent")).distinct()
    return H.ancestors(edges).select("child", "ancestor", F.col("depth").cast("long").alias("depth"))


def reply_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    sentences = turns(spark, sf_dir).select(F.col("conv_id").alias("post"), F.col("turn").alias("pos"), "text")
    edges = sentences.select(F.col("post").alias("child"), F.expr("CASE WHEN post >= 2 THEN post DIV 2 END").alias("parent")).distinct()
    found = H.reply_context(sentences, H.ancestors(edges))
    return found.select("post", "pos", F.size("context").cast("long").alias("n_context"), F.md5(F.array_join("context", "\n")).alias("context"))


def kwic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("tokens", F.split("text", " ", -1))
    return H.in_context(rows, F.lit("the")).select("conv_id", "turn", "at", F.array_join("left", " ").alias("left_words"), F.array_join("right", " ").alias("right_words"))


def role_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.islands(turns(spark, sf_dir).select("conv_id", "turn", "role"), "turn", "role", "conv_id")


def running_token_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).withColumn("tokens", F.split("text", " ", -1))
    return H.running_bags(rows, "conv_id", "turn", below=60).select("conv_id", "turn", F.array_join("bag", " ").alias("bag"))


def mentions_in_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that contain another role's name's first letters, within their conversation."""
    rows = turns(spark, sf_dir).withColumn("user", F.substring("role", 1, 2))
    return L.named_in_thread(rows.select("conv_id", "turn", "text"), rows, "conv_id", "text", "user").select("conv_id", "turn", "named")


def mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text, target_groups): turns with the groups that they mention"""
    return turns(spark, sf_dir).select("conv_id", "turn", "text", E.mentioned(F.col("text"), ENTITIES).alias("target_groups"))


def running_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case, target_groups, newest, oldest): each turn with what its conversation has mentioned so far, without its
    earlier texts."""
    found = H.running_mentions(mentioning(spark, sf_dir), "conv_id", "turn", "target_groups")
    return found.withColumn("case", F.concat_ws("-", "conv_id", "turn"))


def judged_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with seen, all that has been mentioned so far, from which the gold comes."""
    found = H.mentions_so_far(mentioning(spark, sf_dir), "conv_id", "turn", "target_groups")
    return found.withColumn("case", F.concat_ws("-", "conv_id", "turn"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case, target, context, target_groups, context_groups): each turn with its conversation's earlier turns, for the
    solvers that read these texts. Mentions are found once for each turn and gathered."""
    found = H.earlier(mentioning(spark, sf_dir).withColumn("entry", F.struct("text", F.col("target_groups").alias("groups"))), "conv_id", "turn", "entry")
    return found.select(
        F.concat_ws("-", "conv_id", "turn").alias("case"), F.col("text").alias("target"), F.transform("context", lambda e: e["text"]).alias("context"), "target_groups", F.transform("context", lambda e: e["groups"]).alias("context_groups")
    )


def listed(groups: Column) -> Column:
    return F.array_join(F.array_sort(groups).cast("array<string>"), ",")


def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")
    return E.mentions(rows, dictionary(spark), "id", "text").select("id", "group_id", "form")


def solver_target_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_cases(spark, sf_dir).select("case", listed(E.target_only()).alias("answer"))


def solver_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_cases(spark, sf_dir).select("case", listed(E.running_recent()).alias("answer"))


def solver_recents_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_cases(spark, sf_dir).select("case", listed(E.running_recents_first()).alias("answer"))


def solver_first_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_cases(spark, sf_dir).select("case", listed(E.running_first_only()).alias("answer"))


def solver_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case", listed(E.by_context(ENTITIES)).alias("answer"))


def solver_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("case", listed(E.cascade(ENTITIES)).alias("answer"))


def with_gold(found: DataFrame) -> DataFrame:
    """A gold derived from the data: the case's groups with an odd number."""
    return found.withColumn("gold", F.filter("seen" if "seen" in found.columns else E.all_groups(), lambda g: g % 2 == 1))


def ea_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_gold(judged_cases(spark, sf_dir)).withColumn("answer", E.running_first_only())
    return E.accuracy(found, "gold", "answer").withColumn("accuracy", F.round("accuracy", 6))


def ea_precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_gold(judged_cases(spark, sf_dir)).withColumn("answer", E.running_first_only())
    out = E.hidden_scores(found, "gold", "answer")
    return out.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


def last_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("conv_id", "turn", E.mentioned(F.col("text"), ENTITIES).alias("groups"))
    found = H.last_mention(rows, "conv_id", "turn", "groups")
    return found.select("conv_id", "turn", F.array_join(F.col("last_entities").cast("array<string>"), ",").alias("last_entities"), "distance")


def entity_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each case's groups; distances are in turns."""
    return E.features(cases(spark, sf_dir)).select("case", "group", *E.FEATURES)


def dictionary_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(turns(spark, sf_dir), "text", ENTITIES, ENTITIES[2:]).withColumn("ratio", F.round("ratio", 6))


def label_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return L.labelled(labels.withColumn("o", F.col("quality")), docs.withColumn("p", F.col("n_chars")), "doc_id", "o", "p").select("doc_id", "quality", "toxic", "lang", "n_chars")


def unanimous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.unanimous(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


def majority_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.majority(table(spark, sf_dir, "events"), ["user_id"], "event_type")
    return found.withColumn("share", F.round("share", 6))


def parent_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events answer their user's event before."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("event_type").alias("label"))
    edges = events.select("id", F.lag("id").over(Window.partitionBy("user_id").orderBy("id")).alias("parent_id")).where("parent_id IS NOT NULL")
    pairs = L.parent_pairs(events, edges, ["id"], ["user_id"])
    return L.agreement(pairs).withColumn("share", F.round("share", 6))


def agreement_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-table join with a filter, over labels and documents."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.where("toxic = 1").join(docs, "doc_id").select("doc_id", F.md5("text").alias("content"))


def spam_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a strong word or more than two weak ones; stand-ins for the Korean lists."""
    strong, weak = ["!!", "###"], ["$$$", "%%%", "***", "&&&", " | ", " | "]
    return table(spark, sf_dir, "documents").where(T.is_spam(F.col("text"), strong, weak)).select("doc_id")


def related_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("sentences"))
    found = rows.select("doc_id", T.related_text(F.col("sentences"), F.lit("with")).alias("related"))
    return found.where("related <> ''").select("doc_id", F.length("related").alias("n_chars"), F.md5("related").alias("related"))


def first_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = ["License", "password", "@mail", "the "]
    return table(spark, sf_dir, "documents").select("doc_id", T.first_keyword(F.col("text"), words).alias("keyword"))


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("value"))
    return lines.where(F.length("value") > 1000).select("doc_id", F.length("value").alias("n_chars"))


def unlabelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


def thread_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.group_folds(turns(spark, sf_dir).select("conv_id", "turn"), "conv_id", 3)


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id", 10)


QUERIES = [
    prev_turn_pairs, thread_context, ancestor_chain, reply_context, kwic, role_islands, running_token_bags, mentions_in_thread, entity_mentions, solver_target_only, solver_recent,
    solver_recents_first, solver_first_only, solver_context, solver_cascade, ea_accuracy, ea_precision_recall, last_mentions, entity_features, dictionary_coverage, label_join, unanimous,
    majority_share, parent_label_agreement, agreement_contents, spam_filter, related_sentences, first_keywords, long_lines, unlabelled_documents, thread_folds, stratified_folds,
]

_GROUPS = f"""groups AS (SELECT conv_id, turn, text, list_distinct_in_order AS groups FROM (
  SELECT conv_id, turn, text, (SELECT coalesce(list(g ORDER BY i), []) FROM (SELECT g, min(i) AS i FROM (SELECT unnest(h) AS g, generate_subscripts(h, 1) AS i) WHERE g IS NOT NULL GROUP BY g)) AS list_distinct_in_order
  FROM (SELECT conv_id, turn, text, {entities_sql('text')} AS h FROM conversations)))"""
_CASES = f"""{_GROUPS},
earlier AS (SELECT c.conv_id, c.turn, e.turn AS seen, e.groups FROM groups c JOIN groups e ON c.conv_id = e.conv_id AND e.turn < c.turn WHERE len(e.groups) > 0),
newest AS (SELECT conv_id, turn, max_by(groups, seen) AS newest, min_by(groups, seen) AS oldest FROM earlier GROUP BY conv_id, turn),
cases AS (SELECT g.conv_id || '-' || g.turn AS "case", g.conv_id, g.turn, g.groups, coalesce(newest, []) AS newest, coalesce(oldest, []) AS oldest FROM groups g LEFT JOIN newest n ON g.conv_id = n.conv_id AND g.turn = n.turn)"""


def _answer(expression: str) -> str:
    return f"WITH {_CASES} SELECT \"case\", array_to_string(list_sort({expression}), ',') AS answer FROM cases"


_RECENT = "CASE WHEN len(groups) > 0 THEN groups ELSE newest END"
_FIRST = "CASE WHEN len(oldest) > 0 THEN oldest ELSE groups END"
_GOLD = f"""{_CASES}, every AS (SELECT c.conv_id, c.turn, unnest(e.groups) AS g FROM groups c JOIN groups e ON c.conv_id = e.conv_id AND e.turn <= c.turn),
answers AS (SELECT conv_id, turn, unnest({_FIRST}) AS g FROM cases),
gold AS (SELECT DISTINCT * FROM every WHERE g % 2 = 1), explicit AS (SELECT conv_id, turn, unnest(groups) AS g FROM groups)"""
_FOREST = """edges AS (SELECT DISTINCT conv_id AS child, conv_id // 2 AS parent FROM conversations WHERE conv_id >= 2),
chain AS (SELECT child, parent AS ancestor, 1 AS depth FROM edges WHERE child <> parent UNION ALL SELECT c.child, e.parent, c.depth + 1 FROM chain c JOIN edges e ON c.ancestor = e.child)"""

SQL = {
    "prev_turn_pairs": """WITH last AS (SELECT conv_id, max_by(text, turn) AS t FROM conversations GROUP BY conv_id),
each AS (SELECT conv_id, turn, text, lag(text) OVER w AS before, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT e.conv_id AS post, turn AS pos, CASE WHEN r = 1 THEN l.t ELSE before END AS previous, text FROM each e LEFT JOIN last l ON l.conv_id = e.conv_id - 1 WHERE CASE WHEN r = 1 THEN l.t ELSE before END IS NOT NULL""",
    "thread_context": """SELECT c.conv_id, c.turn, CAST(count(e.turn) AS INTEGER) AS n_before, md5(coalesce(string_agg(e.text, chr(10) ORDER BY e.turn), '')) AS context
FROM conversations c LEFT JOIN conversations e ON c.conv_id = e.conv_id AND e.turn < c.turn GROUP BY c.conv_id, c.turn""",
    "ancestor_chain": f"WITH RECURSIVE {_FOREST} SELECT child, ancestor, CAST(depth AS BIGINT) AS depth FROM chain",
    "reply_context": f"""WITH RECURSIVE {_FOREST}, above AS (SELECT child, -depth AS d, turn, text FROM chain JOIN conversations ON ancestor = conv_id),
context AS (SELECT c.conv_id, c.turn, a.d, a.turn AS at, a.text FROM conversations c JOIN above a ON c.conv_id = a.child
  UNION ALL SELECT c.conv_id, c.turn, 0, e.turn, e.text FROM conversations c JOIN conversations e ON c.conv_id = e.conv_id AND e.turn < c.turn)
SELECT c.conv_id AS post, c.turn AS pos, count(x.text) AS n_context, md5(coalesce(string_agg(x.text, chr(10) ORDER BY x.d, x.at), '')) AS context
FROM conversations c LEFT JOIN context x ON c.conv_id = x.conv_id AND c.turn = x.turn GROUP BY c.conv_id, c.turn""",
    "kwic": """WITH t AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), found AS (SELECT conv_id, turn, w, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS "at", array_to_string(list_slice(w, greatest(i - 5, 1), i - 1), ' ') AS left_words, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS right_words FROM found WHERE x = 'the'""",
    "role_islands": """WITH c AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS change FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, CAST(sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS run FROM c""",
    "running_token_bags": """WITH words AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations)
SELECT c.conv_id, c.turn, string_agg(w.w, ' ' ORDER BY w.w) AS bag FROM conversations c JOIN words w ON c.conv_id = w.conv_id AND w.turn <= c.turn GROUP BY c.conv_id, c.turn HAVING count(*) < 60""",
    "mentions_in_thread": "SELECT c.conv_id, c.turn, u.named FROM conversations c JOIN (SELECT DISTINCT conv_id, left(role, 2) AS named FROM conversations) u ON c.conv_id = u.conv_id AND contains(c.text, u.named)",
    "entity_mentions": " UNION ALL ".join(
        f"SELECT conv_id || '-' || turn AS id, CAST({g} AS INTEGER) AS group_id, '{f}' AS form FROM conversations WHERE regexp_matches(text, '(?i)(^|[. \\n?]|[^\\p{{Ll}}\\p{{Lu}}]){f}')" for g, f in ENTITIES
    ),
    "solver_target_only": _answer("groups"),
    "solver_recent": _answer(_RECENT),
    "solver_recents_first": _answer("CASE WHEN len(groups) > 0 THEN groups ELSE list_slice(newest, 1, 1) END"),
    "solver_first_only": _answer(_FIRST),
    "ea_accuracy": f"""WITH {_GOLD}, wrong AS (SELECT conv_id, turn FROM ((SELECT * FROM gold EXCEPT SELECT * FROM answers) UNION (SELECT * FROM answers EXCEPT SELECT * FROM gold)) GROUP BY ALL)
SELECT count(*) AS n, count(*) FILTER (WHERE w.turn IS NULL) AS n_right, round(avg(CASE WHEN w.turn IS NULL THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM cases c LEFT JOIN wrong w ON c.conv_id = w.conv_id AND c.turn = w.turn""",
    "ea_precision_recall": f"""WITH {_GOLD}, really AS (SELECT * FROM gold EXCEPT SELECT * FROM explicit), got AS (SELECT * FROM answers EXCEPT SELECT * FROM explicit),
s AS (SELECT (SELECT count(*) FROM (SELECT * FROM really INTERSECT SELECT * FROM got)) AS tp, (SELECT count(*) FROM (SELECT * FROM got EXCEPT SELECT * FROM really)) AS fp, (SELECT count(*) FROM (SELECT * FROM really EXCEPT SELECT * FROM got)) AS fn),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END AS recall FROM s)
SELECT tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall + 0.01), 6) AS f FROM p""",
    "last_mentions": f"""WITH {_GROUPS}, e AS (SELECT c.conv_id, c.turn, max(x.turn) AS seen, max_by(x.groups, x.turn) AS g FROM groups c LEFT JOIN groups x ON c.conv_id = x.conv_id AND x.turn < c.turn AND len(x.groups) > 0 GROUP BY c.conv_id, c.turn)
SELECT conv_id, turn, coalesce(array_to_string(g, ','), '') AS last_entities, coalesce(turn - seen, -1) AS distance FROM e""",
    "entity_features": f"""WITH {_CASES}, said AS (SELECT c.conv_id, c.turn, e.turn AS at, unnest(e.groups) AS g FROM groups c JOIN groups e ON c.conv_id = e.conv_id AND e.turn <= c.turn),
ranked AS (SELECT conv_id, turn, g, row_number() OVER (PARTITION BY conv_id, turn ORDER BY count(*) DESC, g) AS r FROM said GROUP BY conv_id, turn, g),
far AS (SELECT c.conv_id, c.turn, c.turn - max(x.turn) AS d FROM groups c JOIN groups x ON c.conv_id = x.conv_id AND x.turn < c.turn AND len(x.groups) > 0 GROUP BY c.conv_id, c.turn)
SELECT "case", r.g AS "group", CAST(len(groups) > 0 AS INTEGER) AS has_entity, 0 AS comparative, CAST(coalesce(d, -1) AS INTEGER) AS distance, CAST(list_contains(newest, r.g) AS INTEGER) AS as_previous,
  CAST(list_contains(oldest, r.g) AS INTEGER) AS as_first, CAST(r.r = 1 AS INTEGER) AS most_frequent, CAST(list_contains(groups, r.g) AS INTEGER) AS current
FROM cases c JOIN ranked r ON c.conv_id = r.conv_id AND c.turn = r.turn LEFT JOIN far ON c.conv_id = far.conv_id AND c.turn = far.turn""",
    "dictionary_coverage": f"""WITH {_GROUPS}, s AS (SELECT sum(len(groups)) AS f, sum(len(list_distinct(list_slice({entities_sql('text')}, 3, 9)))) AS p FROM groups)
SELECT CAST(f AS BIGINT) AS n_full, CAST(p AS BIGINT) AS n_part, round(p / CAST(f AS DOUBLE), 6) AS ratio FROM s""",
    "label_join": "SELECT doc_id, quality, toxic, lang, n_chars FROM labels JOIN documents USING (doc_id)",
    "unanimous": "SELECT o_custkey, min(o_orderpriority) AS label, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = 1",
    "majority_share": """WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM e)
SELECT user_id, event_type AS label, n, CAST(total AS BIGINT) AS total, round(n / CAST(total AS DOUBLE), 6) AS share FROM r WHERE k = 1 AND total >= 4""",
    "parent_label_agreement": """WITH p AS (SELECT event_type AS child, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS parent FROM events)
SELECT parent AS parent_label, count(*) AS n, count(*) FILTER (WHERE parent = child) AS agree, round(count(*) FILTER (WHERE parent = child) / CAST(count(*) AS DOUBLE), 6) AS share FROM p WHERE parent IS NOT NULL GROUP BY parent""",
    "agreement_contents": "SELECT doc_id, md5(text) AS content FROM labels JOIN documents USING (doc_id) WHERE toxic = 1",
    "spam_filter": """SELECT doc_id FROM documents WHERE contains(text, '!!') OR contains(text, '###')
OR contains(text, '$$$')::INT + contains(text, '%%%')::INT + contains(text, '***')::INT + contains(text, '&&&')::INT + 2 * contains(text, ' | ')::INT > 2""",
    "related_sentences": """WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
r AS (SELECT doc_id, string_agg(s, '' ORDER BY i) AS related FROM s WHERE contains(s, 'with') GROUP BY doc_id)
SELECT doc_id, CAST(length(related) AS INTEGER) AS n_chars, md5(related) AS related FROM r""",
    "first_keywords": "SELECT doc_id, CASE WHEN contains(text, 'License') THEN 'License' WHEN contains(text, 'password') THEN 'password' WHEN contains(text, '@mail') THEN '@mail' WHEN contains(text, 'the ') THEN 'the ' ELSE '' END AS keyword FROM documents",
    "long_lines": "SELECT doc_id, CAST(length(value) AS INTEGER) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents) WHERE length(value) > 1000",
    "unlabelled_documents": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "thread_folds": """WITH g AS (SELECT conv_id, row_number() OVER (ORDER BY md5('0:' || conv_id), conv_id) - 1 AS r FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, turn, CAST(r % 3 AS INTEGER) AS fold FROM conversations JOIN g USING (conv_id)""",
    "stratified_folds": "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5('0:' || doc_id), doc_id) - 1) % 10 AS INTEGER) AS fold FROM labels",
}
