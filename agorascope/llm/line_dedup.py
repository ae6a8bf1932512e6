"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

Each line that is not blank is hashed, and a rolling hash runs over the hashes of each two neighbours. A chunk ends between
two lines whose rolling hash occurs nowhere else, as no repeated passage can hold both, or whose rolling hash is divisible
by ``divisor``; so boundaries depend on the lines around them only, an insertion moves none but those next to it, and a
repeated passage is cut alike wherever it stands, whatever stands before and after it. Chunks are grouped by their whole
text (that is the byte comparison); all but the first occurrence are met again. Met chunks that stand side by side, where
their two neighbouring lines stood side by side before, are one passage; passages of at least ``min_lines`` lines go,
with the blank lines in them. A line that is repeated by itself stays.

Scale: rolling hashes are shuffled twice (to be counted, and to find the repeated ones again), each as a hash and a place;
the documents' texts twice (to be cut, to get their result), and the texts of chunks that may be repeated once, after a
map-side combine. Joins with the one row of a frequent rolling hash or chunk are salted. Steps in the shared folder hold
hashes and places only. Nothing is collected.

Edge cases: null text stays null and has no lines; empty text is one empty line; blank lines (of spaces or nothing) belong
to the passage around them and are in none by themselves; rows with the same id and text count as one occurrence and get
the same result; a null id sorts before all others. Columns of the input keep their names and values, but the text's and
those called n_lines or n_removed, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, covered, row_key, salted_join

ADDED = ("n_lines", "n_removed")


def with_lines(docs: DataFrame, text: str) -> DataFrame:
    """Adds _lines, and _full: the places of lines that are not blank."""
    out = docs.withColumn("_lines", F.split(F.col(text), "\n", -1))
    return out.withColumn("_full", F.filter(F.transform("_lines", lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull()))


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def rolling_hashes(docs: DataFrame) -> DataFrame:
    """(_key, _id, _k, _roll): of each line k that is not blank and the next such line; a line's hash takes 60 bits."""
    hashes = F.transform("_full", lambda i: line_hash(F.get(F.col("_lines"), i)))
    each = with_lines(docs, "_text").withColumn("_h", hashes)
    roll = F.transform(F.slice("_h", F.lit(1), F.greatest(F.size("_h") - 1, F.lit(0))), lambda h, k: F.shiftleft(h, 1).bitwiseXOR(F.get(F.col("_h"), k + 1)))
    # the outer form: a plain explode lets Spark infer a filter, which it pushes down by writing all steps out in it
    return each.select("_key", "_id", F.posexplode_outer(roll).alias("_k", "_roll")).where(F.col("_roll").isNotNull())


def chunks(docs: DataFrame, seams: DataFrame) -> DataFrame:
    """(_key, _id, _s, _e, _on, _t): the chunks that may be repeated, from line s to line e of those that are not blank;
    on: the lines on both sides of the boundary before stood side by side before. seams: (_key, _seams)."""
    # one sign for each seam: "." for one that is in no passage, else cut or not, and first or not
    gap = lambda k, i: k - F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col("_seams"), i - 1)["k"]) - 1
    sign = lambda x: F.when(x["cut"], F.when(x["first"], "C").otherwise("c")).otherwise("u")
    marks = F.array_join(F.transform("_seams", lambda x, i: F.concat(F.repeat(F.lit("."), gap(x["k"], i)), sign(x))), "")
    out = docs.join(seams, "_key").select("_key", "_id", "_text", F.split(marks, "").alias("_m"))
    out = with_lines(out, "_text")
    mark = lambda k: F.coalesce(F.when(k >= 0, F.get(F.col("_m"), k)), F.lit("."))
    units = F.sequence(F.lit(0), F.size("_full") - 1)
    inside = lambda k: (mark(k - 1) != ".") | (mark(k) != ".")
    out = out.withColumn("_starts", F.filter(units, lambda k: inside(k) & (mark(k - 1) != "u")))
    out = out.withColumn("_ends", F.filter(units, lambda k: inside(k) & (mark(k) != "u")))

    def chunk(s, i):
        e = F.get(F.col("_ends"), i)
        first, last = F.get(F.col("_full"), s), F.get(F.col("_full"), e)
        return F.struct(s.alias("s"), e.alias("e"), (mark(s - 1) == "c").alias("on"), F.array_join(F.slice(F.col("_lines"), first + 1, last - first + 1), "\n").alias("t"))

    out = out.select("_key", "_id", F.explode_outer(F.transform("_starts", chunk)).alias("_c"))
    return out.select("_key", "_id", F.col("_c.s").alias("_s"), F.col("_c.e").alias("_e"), F.col("_c.on").alias("_on"), F.col("_c.t").alias("_t"))


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", divisor: int = 4, min_lines: int = 2) -> DataFrame:
    """The input's columns with the deduplicated text, and n_lines, n_removed (lines)."""
    steps = Steps(docs.sparkSession, "lines")
    docs, names = covered(docs, ADDED)
    id, text = names[id], names[text]
    base = docs.withColumn("_key", row_key(id, text))
    texts = base.select("_key", F.col(id).alias("_id"), F.col(text).alias("_text"))

    rolls = rolling_hashes(texts).select("_key", "_k", "_roll", F.struct("_id", "_key", "_k").alias("_here"))
    repeated = rolls.groupBy("_roll").agg(F.min("_here").alias("_first"), F.max("_here").alias("_last"), F.count("*").alias("_many"))
    repeated = steps.save(repeated.where(F.col("_first") != F.col("_last")).drop("_last"))
    seams = salted_join(rolls, repeated, ["_roll"], "_here", "_many")
    seam = F.struct(F.col("_k").alias("k"), (F.col("_here") == F.col("_first")).alias("first"), (F.col("_roll") % divisor == 0).alias("cut"))
    seams = seams.groupBy("_key").agg(F.array_sort(F.collect_set(seam)).alias("_seams"))

    each = chunks(texts, seams).withColumn("_here", F.struct("_id", "_key", "_s")).withColumns({"_x": F.xxhash64("_t"), "_md": F.unhex(F.md5("_t"))})
    groups = each.groupBy("_t").agg(F.min("_here").alias("_first"), F.max("_here").alias("_last"), F.count("*").alias("_many"))
    groups = groups.select(F.xxhash64("_t").alias("_x"), F.unhex(F.md5("_t")).alias("_md"), "_first", "_last", "_many")
    # one text for a pair of hashes, and at least two places
    groups = groups.groupBy("_x", "_md").agg(F.count("*").alias("_texts"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_many").alias("_many"))
    groups = steps.save(groups.where((F.col("_texts") == 1) & (F.col("_first") != F.col("_last"))).drop("_texts", "_last"))
    places = each.select("_key", "_s", "_e", "_on", "_here", "_x", "_md")
    met = salted_join(places, groups, ["_x", "_md"], "_here", "_many").where(F.col("_here") != F.col("_first"))
    met = met.select("_key", "_s", "_e", "_on").distinct()

    order = Window.partitionBy("_key").orderBy("_s")
    apart = ~F.coalesce(F.col("_on") & (F.lag("_e").over(order) == F.col("_s") - 1), F.lit(False))
    passages = met.withColumn("_new", apart.cast("int")).withColumn("_p", F.sum("_new").over(order))
    passages = passages.groupBy("_key", "_p").agg(F.min("_s").alias("s"), F.max("_e").alias("e")).where(F.col("e") - F.col("s") + 1 >= min_lines)
    gone = passages.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_gone"))

    out = with_lines(base.join(gone, "_key", "left"), text)
    # what stays lies between the passages, which are in order and apart
    place = lambda g: F.struct(F.get(F.col("_full"), g["s"]).alias("s"), F.get(F.col("_full"), g["e"]).alias("e"))
    end = F.array(F.struct(F.size("_lines").alias("s"), F.size("_lines").alias("e")))
    out = out.withColumn("_gone", F.concat(F.transform("_gone", place), end))

    def between(g, k):
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("_gone"), k - 1)["e"] + 1)
        return F.slice(F.col("_lines"), start + 1, F.greatest(g["s"] - start, F.lit(0)))

    out = out.withColumn("_kept", F.flatten(F.transform("_gone", between)))
    whole = F.col("_gone").isNull()
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("_lines"))
    out = out.withColumn("n_lines", n.cast("long")).withColumn("n_removed", F.when(whole, F.lit(0)).otherwise(n - F.size("_kept")).cast("long"))
    out = out.withColumn(text, F.when(whole, F.col(text)).otherwise(F.array_join("_kept", "\n")))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *ADDED)


def sql(divisor: int = 4, min_lines: int = 2, source: str = "documents") -> str:
    """DuckDB SQL for line_dedup over rows with distinct ids."""
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM {source} WHERE text IS NOT NULL),
u AS (
  SELECT doc_id, line, i, row_number() OVER w - 1 AS k, CAST('0x' || md5(line)[1:15] AS BIGINT) AS h
  FROM l WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, xor(h << 1, lead(h) OVER (PARTITION BY doc_id ORDER BY k)) AS roll FROM u),
seam AS (
  SELECT doc_id, k, CASE WHEN roll IS NULL OR n = 1 THEN '.' WHEN roll % {divisor} <> 0 THEN 'u' WHEN f = 1 THEN 'C' ELSE 'c' END AS m
  FROM (SELECT *, count(*) OVER (PARTITION BY roll) AS n, row_number() OVER (PARTITION BY roll ORDER BY doc_id, k) AS f FROM r)),
b AS (
  SELECT u.*, m, coalesce(lag(m) OVER (PARTITION BY u.doc_id ORDER BY u.k), '.') AS before FROM u JOIN seam USING (doc_id, k)),
c AS (
  SELECT *, sum(CASE WHEN before = 'u' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS c FROM b WHERE before <> '.' OR m <> '.'),
chunk AS (SELECT doc_id, c, min(k) AS s, max(k) AS e, min(i) AS first, max(i) AS last, arg_min(before, k) = 'c' AS joined FROM c GROUP BY doc_id, c),
t AS (
  SELECT chunk.*, x.t FROM chunk JOIN (
    SELECT chunk.doc_id, chunk.c, string_agg(line, chr(10) ORDER BY i) AS t FROM chunk JOIN l ON l.doc_id = chunk.doc_id AND l.i BETWEEN first AND last GROUP BY ALL) x USING (doc_id, c)),
met AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS f FROM t) WHERE f > 1),
p AS (
  SELECT *, sum(CASE WHEN joined AND prior = s - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS p
  FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), -1) AS prior FROM met)),
gone AS (SELECT doc_id, p, min(first) AS first, max(last) AS last FROM p GROUP BY doc_id, p HAVING max(e) - min(s) + 1 >= {min_lines}),
kept AS (
  SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE gone.p IS NULL), '') AS text, count(*) AS n_lines, count(gone.p) AS n_removed
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i BETWEEN first AND last GROUP BY l.doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM {source} d LEFT JOIN kept k USING (doc_id)"""
