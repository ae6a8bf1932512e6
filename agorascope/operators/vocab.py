"""Vocabularies, and texts as ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import padded
from .steps import Steps


def exploded(docs: DataFrame, id: str, tokens: Column) -> DataFrame:
    """(id, pos, token)"""
    return docs.select(id, F.posexplode(tokens).alias("pos", "token"))


def token_counts(tokens: DataFrame, token: str = "token") -> DataFrame:
    """(token, n): how often each occurs."""
    return tokens.groupBy(token).agg(F.count("*").alias("n"))


def document_counts(tokens: DataFrame, id: str, token: str = "token") -> DataFrame:
    """(token, n_docs, n): in how many documents and how often each occurs."""
    each = tokens.groupBy(id, token).agg(F.count("*").alias("n"))
    return each.groupBy(token).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"))


def vocabulary(tokens: DataFrame, first: int = 5, least: int = 1) -> DataFrame:
    """(token, idx): ids from ``first`` in the order of the tokens."""
    words = token_counts(tokens).where(F.col("n") >= least).select("token")
    return numbered(words, "token", first)


def numbered(rows: DataFrame, by: str, first: int = 0, name: str = "idx") -> DataFrame:
    """Dense numbers in the order of a distinct column, without a single sorting task: Spark parts the column into sampled
    ranges of like size, each is sorted by itself and written, and the ranges' sizes are summed up."""
    steps = Steps(rows.sparkSession, "numbered")
    placed = steps.save(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a range
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    at = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_before") + at + first).cast("long")).drop("_at", "_part", "_before")


def index_tokens(tokens: DataFrame, vocab: DataFrame, id: str, unknown: int = 1, size: int | None = None) -> DataFrame:
    """(id, ids): tokens in order as ids, ``unknown`` for others, cut or filled with 0 to ``size``."""
    found = tokens.join(vocab, "token", "left").withColumn("idx", F.coalesce("idx", F.lit(unknown)))
    out = found.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("pos", "idx"))).alias("_p")).select(id, F.transform("_p", lambda x: x["idx"]).alias("ids"))
    return out if size is None else out.withColumn("ids", padded(F.col("ids"), size, F.lit(0).cast("long")))


def texts_of(indexed: DataFrame, vocab: DataFrame, id: str, sep: str = " ") -> DataFrame:
    """(id, text): ids in order as words; ids without a word are left out."""
    each = indexed.select(id, F.posexplode("ids").alias("pos", "idx")).join(vocab, "idx")
    return each.groupBy(id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), sep).alias("text"))


def unknown_rate(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(n, n_unknown, rate)"""
    found = tokens.join(vocab.select("token", F.lit(True).alias("known")), "token", "left")
    return found.agg(F.count("*").alias("n"), F.count_if(F.col("known").isNull()).alias("n_unknown"), F.avg(F.col("known").isNull().cast("double")).alias("rate"))


def only_known(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    return tokens.join(vocab.select("token"), "token", "left_semi")


def with_clusters(tokens: DataFrame, clusters: DataFrame, offset: int = 1_000_000) -> DataFrame:
    """Token ids of clustered items become their cluster's id above ``offset``; tokens and clusters by item."""
    found = tokens.join(clusters, "item", "left")
    return found.withColumn("item", F.coalesce(F.col("cluster_id") + F.lit(offset), F.col("item"))).drop("cluster_id")


def reversed_vocabulary(vocab: DataFrame, order: str | None = None) -> DataFrame:
    """(word, idx): of repeated words the id of the last line; ``order`` names a column of line numbers, without one the
    greatest id is the last."""
    return vocab.groupBy("word").agg(F.max_by("idx", order or "idx").alias("idx"))


def vector_matrix(vocab: DataFrame, vectors: DataFrame, dim: int, first: int = 5, seed: int = 0, width: float = 0.25) -> DataFrame:
    """(row, token, vector): a dense embedding matrix as rows. Rows 0 to first - 1 are the reserved ids, row 0 (padding)
    of zeros; then come the vocabulary's words that have a vector, in the order of their ids, and then the others."""
    found = vectors_for(vocab, vectors, dim, seed, width)
    placed = numbered(found.withColumn("_key", F.concat(F.when(F.col("known"), "0").otherwise("1"), F.lpad(F.col("idx").cast("string"), 20, "0"))), "_key", first, "row")
    draw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(F.col("row") == 0, 0.0).otherwise((F.pmod(F.xxhash64(F.lit(seed), F.col("row"), i), F.lit(1 << 30)) / F.lit(float(1 << 30)) * 2 - 1) * width).cast("float"))
    reserved = vocab.sparkSession.range(first).select(F.col("id").alias("row")).select("row", F.lit(None).cast("string").alias("token"), draw.alias("vector"))
    return reserved.unionByName(placed.select(F.col("row").cast("long").alias("row"), "token", "vector"))


def vectors_for(vocab: DataFrame, vectors: DataFrame, dim: int, seed: int = 0, width: float = 0.25) -> DataFrame:
    """(idx, token, vector, known): words without a vector get one drawn by a keyed hash from (-width, width)."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: ((F.pmod(F.xxhash64(F.lit(seed), F.col("token"), i), F.lit(1 << 30)) / F.lit(float(1 << 30)) * 2 - 1) * width).cast("float"))
    found = vocab.join(vectors.select(F.col("word").alias("token"), "vector"), "token", "left")
    return found.select("idx", "token", F.coalesce("vector", drawn).alias("vector"), F.col("vector").isNotNull().alias("known"))


def readable(indexed: DataFrame, vocab: DataFrame, members: DataFrame, id: str, most: int = 10, offset: int = 1_000_000) -> DataFrame:
    """(id, text): ids as words; an id above ``offset`` is a cluster and is shown as g[...] with its first ``most`` words.
    members (cluster_id, word)."""
    named = members.groupBy("cluster_id").agg(F.slice(F.array_sort(F.collect_set("word")), 1, most).alias("_w"))
    shown = named.select((F.col("cluster_id") + F.lit(offset)).alias("idx"), F.concat(F.lit("g["), F.array_join("_w", ","), F.lit(",]")).alias("token"))
    return texts_of(indexed, vocab.select("idx", "token").unionByName(shown), id)


def contains_category(items: DataFrame, members: DataFrame, id: str = "doc") -> DataFrame:
    """(id, category) of documents (id, item) that hold a word of it; members (item, category)."""
    return items.join(members, "item").select(id, "category").distinct()


def first_of_category(tokens: DataFrame, members: DataFrame, id: str = "doc") -> DataFrame:
    """(id, category, item): the first token of each category in a document (id, pos, item)."""
    return tokens.join(members, "item").groupBy(id, "category").agg(F.min_by("item", "pos").alias("item"))
