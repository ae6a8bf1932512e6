"""Reply chains and the context of sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import Steps


def ancestors(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, ancestor, depth from 1) along edges(child, parent), to any depth. A post has one parent: of several edges
    of a post that with the greatest parent counts, the others are no replies.

    Path doubling: each round joins the chains found so far with themselves, so a chain of d posts takes log2 d rounds.
    A cycle ends where a post would come again: its depths are less than its length, so a round finds nothing more.
    """
    steps = Steps(edges.sparkSession, "ancestors")
    reach = 1
    chains = steps.save(edges.where(F.col(parent).isNotNull()).groupBy(F.col(child).alias("child")).agg(F.max(parent).alias("ancestor")).where("child <> ancestor").withColumn("depth", F.lit(1)))
    while True:
        far = chains.where(F.col("depth") == reach).select("child", F.col("ancestor").alias("via"))
        ahead = chains.select(F.col("child").alias("via"), F.col("ancestor").alias("next"), F.col("depth").alias("d"))
        more = far.join(ahead, "via").where("next <> child").select("child", F.col("next").alias("ancestor"), (F.col("d") + reach).alias("depth"))
        more = steps.save(more)
        if not more.limit(1).count():
            break
        chains = steps.save(chains.unionByName(more).groupBy("child", "ancestor").agg(F.min("depth").alias("depth")))
        reach *= 2
    return chains


def reply_context(sentences: DataFrame, chains: DataFrame, post: str = "post", pos: str = "pos", text: str = "text") -> DataFrame:
    """(post, pos, target, context): before each sentence those of its post's ancestors, oldest first, then the post's own earlier ones."""
    own = Window.partitionBy(post).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    each = sentences.select(post, pos, F.col(text).alias("target"), F.collect_list(text).over(own).alias("_own"))
    whole = sentences.groupBy(post).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]).alias("_texts"))
    above = chains.join(whole.withColumnRenamed(post, "ancestor"), "ancestor").groupBy(F.col("child").alias(post)).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "_texts"))), lambda x: x["_texts"])).alias("_above"))
    empty = F.array().cast("array<string>")
    return each.join(above, post, "left").select(post, pos, "target", F.concat(F.coalesce("_above", empty), "_own").alias("context"))


def earlier(rows: DataFrame, group: str, pos: str, text: str) -> DataFrame:
    """Rows with n_before and context, the group's earlier texts in order."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("context", F.collect_list(text).over(w)).withColumn("n_before", F.size("context"))


def running_mentions(rows: DataFrame, group: str, pos: str, entities: str) -> DataFrame:
    """Rows with newest and oldest, the entities of the nearest and of the earliest row before that has any (else empty):
    running values, so that no row carries the rows before it."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    some = F.when(F.size(entities) > 0, F.col(entities))
    empty = F.array().cast(rows.schema[entities].dataType)
    return rows.withColumn("newest", F.coalesce(F.last(some, ignorenulls=True).over(w), empty)).withColumn("oldest", F.coalesce(F.first(some, ignorenulls=True).over(w), empty))


def mentions_so_far(rows: DataFrame, group: str, pos: str, entities: str) -> DataFrame:
    """As running_mentions, and seen, the distinct entities up to this row in the order of their first row: from each
    entity's first place in its group, a list as long as the dictionary at most."""
    empty = F.array().cast(rows.schema[entities].dataType)
    firsts = rows.select(F.col(group), F.col(pos).alias("_at"), F.posexplode(entities).alias("_k", "_e")).groupBy(group, "_e").agg(F.min(F.struct("_at", "_k")).alias("_p"))
    firsts = firsts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_p", "_e"))).alias("_firsts"))
    out = running_mentions(rows, group, pos, entities).join(firsts, group, "left")
    here = F.transform(F.filter("_firsts", lambda f: f["_p"]["_at"] <= F.col(pos)), lambda f: f["_e"])
    return out.withColumn("seen", F.coalesce(here, empty)).drop("_firsts")


def previous_pairs(sentences: DataFrame, parents: DataFrame, post: str = "post", pos: str = "pos", text: str = "text") -> DataFrame:
    """(post, pos, previous, text): the sentence before, for a post's first the last of its parent post."""
    last = sentences.groupBy(F.col(post).alias("parent")).agg(F.max_by(text, pos).alias("_last"))
    before = F.lag(text).over(Window.partitionBy(post).orderBy(pos))
    each = sentences.withColumn("_before", before).join(parents, post, "left").join(last, "parent", "left")
    first = F.row_number().over(Window.partitionBy(post).orderBy(pos)) == 1
    return each.withColumn("previous", F.when(first, F.col("_last")).otherwise(F.col("_before"))).where("previous IS NOT NULL").select(post, pos, "previous", text)


def in_context(rows: DataFrame, keyword: Column, tokens: str = "tokens", width: int = 5) -> DataFrame:
    """(..., at, left, word, right): each token that is the keyword, with at most ``width`` tokens at either side."""
    each = rows.select("*", F.posexplode(tokens).alias("at", "word")).where(F.col("word") == keyword)
    left = F.slice(tokens, F.greatest(F.col("at") - width + 1, F.lit(1)), F.least(F.col("at"), F.lit(width)))
    return each.withColumn("left", left).withColumn("right", F.slice(tokens, F.col("at") + 2, width))


def random_context(rows: DataFrame, id: str, tokens: str = "tokens", width: int = 5, least: int = 4, seed: int = 0) -> DataFrame:
    """A drawn position's context of each row with at least ``least`` tokens; the draw is a hash of the id."""
    kept = rows.where(F.size(tokens) >= least).withColumn("at", F.pmod(F.xxhash64(F.lit(seed), id), F.size(tokens)).cast("int"))
    left = F.slice(tokens, F.greatest(F.col("at") - width + 1, F.lit(1)), F.least(F.col("at"), F.lit(width)))
    return kept.withColumn("left", left).withColumn("word", F.get(tokens, F.col("at"))).withColumn("right", F.slice(tokens, F.col("at") + 2, width))


def last_mention(rows: DataFrame, group: str, pos: str, entities: str) -> DataFrame:
    """Rows with last_entities, of the nearest earlier row that has any, and distance to it, -1 without one."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    has = F.size(entities) > 0
    found = F.last(F.when(has, F.col(entities)), ignorenulls=True).over(w)
    at = F.max(F.when(has, F.col(pos))).over(w)
    empty = F.array().cast(rows.schema[entities].dataType)
    return rows.withColumn("last_entities", F.coalesce(found, empty)).withColumn("distance", F.coalesce(F.col(pos) - at, F.lit(-1)))


def first_mention(rows: DataFrame, group: str, pos: str, entities: str) -> DataFrame:
    """(group, first_entities): those of the earliest row that has any."""
    return rows.where(F.size(entities) > 0).groupBy(group).agg(F.min_by(entities, pos).alias("first_entities"))


def islands(rows: DataFrame, order: str, value: str, group: str) -> DataFrame:
    """Rows with the number, from 1, of their run of equal consecutive values within a group."""
    w = Window.partitionBy(group).orderBy(order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_change")


def running_bags(rows: DataFrame, group: str, pos: str, tokens: str = "tokens", below: int = 30) -> DataFrame:
    """(group, pos, bag): for each row the sorted tokens of its group so far, where fewer than ``below``."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    few = rows.withColumn("_total", F.sum(F.size(tokens)).over(w)).where(F.col("_total") < below)  # a group's first rows only
    return few.select(group, pos, F.array_sort(F.flatten(F.collect_list(tokens).over(w))).alias("bag"))
