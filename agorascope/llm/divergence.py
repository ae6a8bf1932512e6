"""Source divergence audit: how do the sources of a language differ in their terms, and by which terms?

Terms are runs of letters A to Z and of signs beyond ASCII, with A to Z lower-cased. Each language keeps the terms of at
least ``least`` of its documents. A group (language, source) gives each kept term the share
p = 1 + floor(10^9 (n + 5) / (N + 5 V)), n its occurrences in the group, N their sum over the V kept terms; the language
as a whole gives q alike. Two sources differ by the sum of |p - p'| over all kept terms; a source's own terms are those
with n > 0 and p > q, by p - q.

Kept terms are dealt to chunks by a hash. In each chunk a language's terms are a sorted array; searchsorted makes the
groups' terms to ids, bincount makes ids to one dense vector a group, and ids have the terms' UTF-8 order, so that the
greatest values of a vector are found with ties in that order. Shares are whole numbers, computed without rounding for
counts below 9 * 10^15.

Scale: texts are read once, in parts, and leave a task as counts. What a task holds is one chunk of about ``chunk`` terms
for two blocks of about ``block`` sources; a language with many sources has as many such tasks as pairs of blocks. Joins
with a language's or a group's one row are salted. The counts, the kept counts and the chunks' sums are written to the
shared folder, nothing is collected but the number of chunks.

Edge cases: null text, language and source are empty strings; a group without terms has n = 0 for all terms; a language
that keeps no term has differences of 0 and no terms; repeated rows count as documents each; other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, groups, released, salted_join, shuffle_partitions, smaller, word_parts, word_table

BILLION, PRIOR = 1_000_000_000, 5
LETTERS = word_table(lambda c: c >= 0x80 or chr(c).isalpha())
KEYS = ["lang", "chunk", "bi", "bj"]
TERM, SOURCE, COUNT = 0, 1, 2


def term_counts(docs: DataFrame, held: int = 300_000) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; one row with the empty term for each group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        in_docs: dict[tuple, Counter] = {}

        def rows() -> pa.RecordBatch:
            lang, source, term, many, docs_of = [], [], [], [], []
            for (a, b), each in n.items():
                term += [b"", *each]
                many += [0, *each.values()]
                docs_of += [0, *map(in_docs[a, b].__getitem__, each)]
                lang += [a] * (len(each) + 1)
                source += [b] * (len(each) + 1)
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(many, pa.int64()), pa.array(docs_of, pa.int64())], ["lang", "source", "term", "n", "docs"])

        size = 0
        for batch in smaller(batches, 2):
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                own: Counter = Counter()
                for part in word_parts(text.as_py() or b"", LETTERS):
                    own.update(part)
                if (a, b) not in n:
                    n[a, b], in_docs[a, b] = Counter(), Counter()
                before = len(n[a, b])
                n[a, b].update(own)
                in_docs[a, b].update(own.keys())
                size += len(n[a, b]) - before
                if size > held:
                    yield rows()
                    n, in_docs, size = {}, {}, 0
        if n:
            yield rows()

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = texts.mapInArrow(released(count), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(n: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (n + 5) / total), by long division in three steps of 10^3."""
    out, rest = np.divmod(n + PRIOR, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def compared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of each chunk and pair of blocks: the pairs' sums of differences, and each source's ``most`` first terms."""
    for group in groups(batches, KEYS):
        lang, same = group["lang"][0].as_py(), group["bi"][0].as_py() == group["bj"][0].as_py()
        kind, side, n, total = (group[c].to_numpy() for c in ("kind", "side", "n", "total"))
        terms = np.array(group["term"].cast(pa.binary()).filter(pa.array(kind == TERM)).to_pylist(), object)  # in order
        source_rows = np.nonzero(kind == SOURCE)[0]
        names = group["source"].take(pa.array(source_rows)).to_pylist()
        sides, totals = side[source_rows], total[source_rows]
        at = {name: i for i, name in enumerate(names)}
        rows = kind == COUNT
        ids = np.searchsorted(terms, np.array(group["term"].cast(pa.binary()).filter(pa.array(rows)).to_pylist(), object))
        whose = np.array([at[s] for s in group["source"].filter(pa.array(rows)).to_pylist()], np.int64)
        counts = np.bincount(whose * len(terms) + ids.astype(np.int64), n[rows], len(names) * len(terms)).astype(np.int64).reshape(len(names), len(terms))
        p = shares(counts, np.maximum(totals, 1)[:, None])
        source, item, part, value = [], [], [], []
        for i, name in enumerate(names):
            others = np.arange(i + 1, len(names)) if same else np.nonzero(sides == 1)[0] if sides[i] == 0 else []
            if len(others):
                sums = np.abs(p[others] - p[i]).sum(1)
                source += [name] * len(others)
                item += [names[j] for j in others]
                part += ["pair"] * len(others)
                value += sums.tolist()
        if same and len(terms):
            f = p - shares(n[kind == TERM], total[kind == TERM])
            f[counts == 0] = 0
            for i, name in enumerate(names):
                best = np.nonzero(f[i] > 0)[0]
                best = best[np.lexsort((best, -f[i][best]))[:most]]
                source += [name] * len(best)
                item += [t.decode() for t in terms[best]]
                part += ["term"] * len(best)
                value += f[i][best].tolist()
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(source, pa.string()), pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least: int = 30, most: int = 50, chunk: int = 512, block: int = 256) -> DataFrame:
    """(lang, source, part, item, value, rank) of a table (text, lang, source)."""
    spark = docs.sparkSession
    steps = Steps(spark, "divergence")
    counts = steps.save(term_counts(docs))
    terms = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= least).drop("docs")
    terms = steps.save(terms)
    kept = steps.save(counts.where("term <> ''").select("lang", "source", "term", "n").join(terms.select("lang", "term"), ["lang", "term"]))

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("N"), F.count("*").alias("distinct"))
    each = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["N", "distinct"])
    langs = each.groupBy("lang").agg(F.count("*").alias("n_groups"), F.sum("N").alias("all_n"))
    langs = steps.save(langs.join(terms.groupBy("lang").agg(F.count("*").alias("V")), "lang", "left").na.fill(0, ["V"]))
    widest = langs.agg(F.max("V").alias("v")).first()["v"] or 0
    n_chunks = max(1, -(-widest // chunk))

    blocks = F.ceil(F.col("n_groups") / F.lit(block)).cast("int")
    of_lang = langs.select("lang", "n_groups", "V", blocks.alias("nb"), (F.col("all_n") + PRIOR * F.col("V")).alias("lang_total"))
    each = salted_join(each, of_lang, ["lang"], "source", "n_groups")
    each = steps.save(each.select("lang", "source", "nb", F.pmod(F.xxhash64(F.lit(5), "source"), "nb").cast("int").alias("b"), (F.col("N") + PRIOR * F.col("V")).alias("total"), "distinct"))

    in_chunk = F.pmod(F.xxhash64(F.lit(11), "term"), F.lit(n_chunks)).cast("int").alias("chunk")

    def dealt(rows: DataFrame, kind: int, n: Column, total: Column) -> DataFrame:
        """One row for each pair of blocks that the row's block is in."""
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        bi, bj = F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj")
        side = F.when(F.col("b") <= F.col("o"), 0).otherwise(1).alias("side")
        return rows.select("lang", "chunk", bi, bj, F.lit(kind).alias("kind"), "term", "source", side, n.alias("n"), total.alias("total"))

    zero = F.lit(0).cast("long")
    diagonal = salted_join(terms, of_lang.where("V > 0"), ["lang"], "term", "V").withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("source", F.lit(""))
    rows = dealt(diagonal.select("*", in_chunk), TERM, F.col("all"), F.col("lang_total")).where("bi = bj OR side = 0")
    rows = rows.unionByName(dealt(each.withColumn("term", F.lit("")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1)))), SOURCE, zero, F.col("total")))
    counted = salted_join(kept, each.where("distinct > 0"), ["lang", "source"], "term", "distinct")
    rows = rows.unionByName(dealt(counted.select("*", in_chunk), COUNT, F.col("n"), zero))
    rows = rows.repartition(max(shuffle_partitions(spark), 1), *KEYS).sortWithinPartitions(*KEYS, "kind", "term", "source")
    found = rows.mapInArrow(released(lambda b: compared(b, most)), "lang string, source string, part string, item string, value long")
    found = steps.save(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))

    pairs = found.where("part = 'pair'")
    pairs = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), "part", F.col("source").alias("item"), "value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    first = found.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= most)
    return pairs.withColumn("rank", rank).select(*columns).unionByName(first.select(*columns))


def sql(least: int = 30, most: int = 50, source: str = "documents") -> str:
    """DuckDB SQL for audit."""
    share = f"1 + ({BILLION}::HUGEINT * (%s + {PRIOR})) // (%s + {PRIOR} * V)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM {source}),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {least}),
langs AS (SELECT l.lang, count(k.term) AS V, coalesce(sum(k.n), 0) AS M FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0) AS N FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share % ("coalesce(c.n, 0)", "g.N")} AS p, {share % ("k.n", "M")} AS q
  FROM g JOIN langs USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= {most}"""
