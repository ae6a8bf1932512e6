"""Mixing sources to target weights by apportioned blocks of words.

Sources, in the order of their code points and null last, weigh ``weights``, repeating. Their targets share the words of
all documents by weight; no target exceeds ``most`` times its source's words, and what that leaves over is shared again by
weight. A source's documents are dealt to shards of about ``shard`` documents by a keyed hash, and each shard has its part
of the target. All targets together are round(words / block) blocks of ``block`` words: these go one after the other to the
shard with the highest quotient target / (2 k + 1), k the blocks that it has (Sainte-Lague), ties to the first source and
shard. Within a shard the documents stand in a ring in keyed order; the shard's quota are the blocks from a keyed one on,
once round the ring or more, so whole documents are taken but for two at the ends.

Scale: the texts are read once and leave as sizes. A source that holds a third of all documents is many shards, and the
join with its one row is salted; a window sees one shard. Blocks are not listed: the quotient that as many quotients reach
as there are blocks is found by sums over the shards for some divisors at a time, ties beyond it are ranked in ranges.
What is collected are single rows of sums.

Edge cases: null and blank texts have no words and nothing is taken; a source without words has target 0; a null id hashes
like an empty one; equal rows are documents each, which may be taken differently; other columns are not read; no
documents, no rows. Nothing depends on the order or partitions of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.vocab import numbered
from .common import Steps, salted_join

BLANKS = r"\x20\x09-\x0D"


def n_words(text: str) -> Column:
    """The number of runs of other than blanks, without a list of them."""
    marks = F.regexp_replace(text, f"[{BLANKS}]*[^{BLANKS}]+[{BLANKS}]*", "x")
    return F.when(F.col(text).rlike(f"[^{BLANKS}]"), F.length(marks)).otherwise(0).cast("long")


def hashed(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Adds target to (skey, source_size, n_docs); skey orders the sources, null last."""
    spark = sources.sparkSession
    placed = numbered(sources.withColumn("_by", F.struct(F.col("skey") == "n", "skey")), "_by", 0, "_n")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    placed = Steps(spark, "targets").save(placed.select("skey", "source_size", "n_docs", weight.cast("long").alias("w")))
    total, capped, free = placed.agg(F.sum("source_size").alias("t"), F.lit(0).alias("c"), F.sum("w").alias("w")).first()
    if not total:
        return placed.select("skey", "source_size", "n_docs", F.lit(0.0).alias("target"))
    cap = (F.lit(most) * F.col("source_size")).cast("long")
    while True:  # the level only rises, so a source that stops stays so
        level = F.col("w") * F.lit(float(total - capped)) / F.lit(float(free)) if free else F.lit(float("inf"))
        stops = cap.cast("double") <= level
        c, w = placed.agg(F.coalesce(F.sum(F.when(stops, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~stops, F.col("w"))), F.lit(0))).first()
        if (c, w) == (capped, free):
            return placed.select("skey", "source_size", "n_docs", F.when(stops, cap.cast("double")).otherwise(level).alias("target"))
        capped, free = c, w


def seats(parties: DataFrame, house: int, points: int = 32, rounds: int = 16) -> DataFrame:
    """Adds quota: how many of the ``house`` highest quotients t / (2 k + 1) are a party's; ties to the least (skey, shard)."""
    total, top, n = parties.agg(F.sum("t"), F.max("t"), F.count("*")).first()
    if not house or not total:
        return parties.withColumn("quota", F.lit(0).cast("long"))
    reach = lambda x: F.floor((F.col("t") / F.lit(x) + 1) / 2)  # noqa: E731  how many quotients are x or more
    low, high = total / (2 * house + n) * (1 - 1e-9), top * (1 + 1e-9)
    if 2 * house > n:
        high = min(high, total / (2 * house - n) * (1 + 1e-9))
    for _ in range(rounds):
        tried = [low + (high - low) * i / (points - 1) for i in range(points)]
        counts = parties.agg(*[F.sum(reach(x)) for x in tried]).first()
        low = max((x for x, c in zip(tried, counts) if c >= house), default=low)
        high = min((x for x, c in zip(tried, counts) if c <= house and x >= low), default=high)
        if house in counts or high - low <= 1e-13 * high:
            break
    sure = parties.withColumn("quota", reach(high))
    rest = house - sure.agg(F.sum("quota")).first()[0]
    if rest <= 0:
        return sure
    # quotients between low and high: the first ``rest`` of them in order
    more = sure.withColumn("k", F.explode(F.sequence(F.col("quota"), reach(low)))).select("skey", "shard", F.struct((-F.col("t") / (2 * F.col("k") + 1)).alias("q"), "skey", "shard", "k").alias("_by"))
    won = numbered(more, "_by", 1, "_n").where(F.col("_n") <= rest).groupBy("skey", "shard").agg(F.count("*").alias("more"))
    return sure.join(won, ["skey", "shard"], "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0))).drop("more")


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 16, shard: int = 1_024, seed: int = 13) -> DataFrame:
    """(id, size, source_size, target, taken) of every document."""
    steps = Steps(docs.sparkSession, "mixing")
    skey = F.when(F.col(source).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(source).cast("string")))
    digest = hashed(seed, F.coalesce(F.col(id).cast("string"), F.lit("")))
    sized = docs.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("_t"), skey.alias("skey"), digest.alias("h"))
    sized = steps.save(sized.select("_id", "skey", "h", n_words("_t").alias("size")))
    sources = steps.save(targets(sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")), weights, most))
    placed = salted_join(sized, sources, ["skey"], "h", "n_docs")
    shards = F.ceil(F.col("n_docs") / F.lit(shard)).cast("long")
    placed = steps.save(placed.withColumn("shard", F.pmod(number(F.col("h")), shards)).drop("n_docs"))
    part = F.when(F.col("source_size") > 0, F.col("target") * F.col("a") / F.col("source_size")).otherwise(0.0)
    parties = placed.groupBy("skey", "shard").agg(F.sum("size").alias("a"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    parties = steps.save(parties.select("skey", "shard", "a", part.alias("t")))
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    quotas = seats(parties, (2 * words + block) // (2 * block))
    begins = F.pmod(number(hashed(seed, F.col("skey"), F.col("shard").cast("string"))), F.greatest(F.ceil(F.col("a") / F.lit(block)).cast("long"), F.lit(1))) * block
    quotas = quotas.select("skey", "shard", "a", begins.alias("begin"), (begins + F.least(F.col("quota") * block, F.col("a") * most)).alias("end"))
    ring = Window.partitionBy("skey", "shard").orderBy("h", "_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    laid = placed.withColumn("at", F.sum("size").over(ring) - F.col("size")).join(quotas, ["skey", "shard"])
    until = lambda z: F.floor(F.col(z) / F.col("a")) * F.col("size") + F.least(F.greatest(F.col(z) % F.col("a") - F.col("at"), F.lit(0)), F.col("size"))  # noqa: E731  the document's words before z
    taken = F.when(F.col("size") > 0, until("end") - until("begin")).otherwise(0).cast("long")
    return laid.select(F.col("_id").alias(id), "size", "source_size", "target", taken.alias("taken"))


def sql(weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block: int = 16, shard: int = 1_024, seed: int = 13, source: str = "documents") -> str:
    """DuckDB SQL for mix, which lists every quotient."""
    number = lambda digest: f"CAST('0x' || substr({digest}, 1, 8) AS BIGINT)"
    until = lambda z: f"({z} // a) * size + least(greatest({z} % a - pos, 0), size)"
    return rf"""
WITH d AS (SELECT doc_id, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, coalesce('v' || source, 'n') AS skey,
  len(regexp_extract_all(coalesce(text, ''), '[^{BLANKS}]+')) AS size FROM {source}),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM d GROUP BY skey),
w AS (SELECT *, [{", ".join(map(str, weights))}][1 + (row_number() OVER (ORDER BY skey = 'n', skey) - 1) % {len(weights)}] AS w, sum(source_size) OVER () AS total FROM s),
o AS (
  SELECT *, coalesce(sum({most} * source_size) OVER before, 0) AS c, sum(w) OVER after AS f FROM w
  WINDOW before AS (ORDER BY {most} * source_size / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  after AS (ORDER BY {most} * source_size / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
stop AS (SELECT c, f FROM o WHERE {most} * source_size > w * (total - c)::DOUBLE / f::DOUBLE ORDER BY {most} * source_size / w, skey LIMIT 1),
g AS (
  SELECT skey, source_size, n_docs, total, CASE WHEN total = 0 THEN 0.0::DOUBLE
    WHEN {most} * source_size <= coalesce(w * (total - (SELECT c FROM stop))::DOUBLE / (SELECT f FROM stop)::DOUBLE, 'inf'::DOUBLE) THEN ({most} * source_size)::DOUBLE
    ELSE w * (total - (SELECT c FROM stop))::DOUBLE / (SELECT f FROM stop)::DOUBLE END AS target FROM o),
p AS (SELECT d.*, g.source_size, g.target, g.total, {number("h")} % CAST(ceil(n_docs / {shard}) AS BIGINT) AS shard FROM d JOIN g USING (skey)),
party AS (SELECT skey, shard, CAST(sum(size) AS BIGINT) AS a, any_value(CAST((2 * total + {block}) // {2 * block} AS BIGINT)) AS house, CASE WHEN any_value(source_size) > 0 THEN any_value(target) * CAST(sum(size) AS BIGINT)::DOUBLE / any_value(source_size)::DOUBLE ELSE 0 END AS t FROM p GROUP BY skey, shard),
q AS (SELECT skey, shard, house, t, unnest(range(0, CAST(t / {block} AS BIGINT) + 8)) AS k FROM party WHERE t > 0),
won AS (SELECT skey, shard FROM (SELECT skey, shard, house, row_number() OVER (ORDER BY t / (2 * k + 1) DESC, skey, shard, k) AS r FROM q) WHERE r <= house),
quota AS (
  SELECT party.skey, party.shard, a, {number("md5('%d:' || party.skey || ':' || party.shard)" % seed)} % greatest(CAST(ceil(a / {block}) AS BIGINT), 1) * {block} AS b, least(coalesce(n, 0) * {block}, {most} * a) AS l
  FROM party LEFT JOIN (SELECT skey, shard, count(*) AS n FROM won GROUP BY ALL) x ON x.skey = party.skey AND x.shard = party.shard),
laid AS (SELECT p.*, a, b, b + l AS e, CAST(sum(size) OVER (PARTITION BY skey, shard ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS pos FROM p JOIN quota USING (skey, shard))
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 THEN ({until("e")}) - ({until("b")}) ELSE 0 END AS taken FROM laid"""
