"""Frequent itemsets with categories, lift and conditional probabilities.

Documents are postings(doc, item, mult). A word's multiplicity in a document is 1; a category's is the number of the
document's distinct words that belong to it. The support of an itemset is the sum over documents of its least
multiplicity ("posting"), or the number of documents that hold all its items ("document"). Support never grows with
more items, so each level starts from what the level before has kept; levels are written as they are found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import subsets
from .cooccurrence import pair_counts
from .steps import Steps
from .vocab import numbered

#: So many names go to every task; more are joined by shuffles.
MOST_NAMES = 1_000_000
#: The pairs of so few items are counted without blocks.
FEW = 256


def sent(names: DataFrame, n: int) -> DataFrame:
    """A table of names for joins with pairs, which are many more than names and should not be shuffled for them."""
    return F.broadcast(names) if n <= MOST_NAMES else names


def postings(tokens: DataFrame, members: DataFrame | None = None, doc: str = "doc", item: str = "item") -> DataFrame:
    """(doc, item, mult) of (doc, item) rows; members (item, category) adds a posting for each category."""
    words = tokens.select(F.col(doc).alias("doc"), F.col(item).alias("item")).distinct().withColumn("mult", F.lit(1).cast("long"))
    if members is None:
        return words
    held = words.join(members.distinct(), "item").groupBy("doc", "category").agg(F.count("*").alias("mult"))
    return words.unionByName(held.select("doc", F.col("category").alias("item"), "mult"))


def support(found: DataFrame, kind: str = "document") -> DataFrame:
    """(item, support)"""
    return found.groupBy("item").agg((F.sum("mult") if kind == "posting" else F.count("*")).alias("support"))


def frequent_items(found: DataFrame, least: int, kind: str = "document") -> DataFrame:
    return support(found, kind).where(F.col("support") >= least)


def coded(items: DataFrame) -> DataFrame:
    """(item, id): items by dense numbers in their order, so that pairs are counted by one number each."""
    return numbered(items.select("item"), "item", 0, "id")


def pair_support(found: DataFrame, least: int, kind: str = "document", same: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    """(a, b, support) of frequent pairs a < b; ``same`` (a, b) lists pairs that share a word and never go together.

    Each document's frequent items are gathered as numbers once, and pairs are counted in blocks (cooccurrence.py). The
    lists of numbers are written while the plan is built. ``items``: the frequent items, if they are known.
    """
    ids = coded(frequent_items(found, least, kind) if items is None else items)
    n = ids.count()
    if n <= FEW:
        counted = _few_pairs(found, ids, least, kind)
        names = lambda c: F.broadcast(ids.select(F.col("item").alias(c), F.col("id").alias(f"_{c}")))
        out = counted.join(names("a"), "_a").join(names("b"), "_b").select("a", "b", "support")
        return out if same is None else out.join(same, ["a", "b"], "left_anti")
    # of few items narrow ranges, so that there are blocks for many tasks; a block takes 268 MB at most, weighed half of that
    width = min(4_096 if kind == "posting" else 8_192, max(1_024, 1 << (n // 16).bit_length()))
    counted = pair_counts(item_lists(found, ids, n), least, kind == "posting", width)
    names = lambda c: sent(ids.select(F.col("item").alias(c), F.col("id").alias(f"_{c}")), n)
    out = counted.withColumnsRenamed({"a": "_a", "b": "_b"}).join(names("a"), "_a").join(names("b"), "_b").select("a", "b", "support")
    return out if same is None else out.join(same, ["a", "b"], "left_anti")


def _few_pairs(found: DataFrame, ids: DataFrame, least: int, kind: str) -> DataFrame:
    """(_a, _b, support) of few items: a task's counts are at most all pairs of these, so it counts before anything is shuffled."""
    lists = found.join(F.broadcast(ids), "item").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "mult"))).alias("_l"))
    two = lambda x, i: F.transform(F.slice("_l", i + 2, F.size("_l")), lambda y: F.struct(x["id"].alias("_a"), y["id"].alias("_b"), F.least(x["mult"], y["mult"]).alias("m")))
    each = lists.select(F.explode(F.flatten(F.transform("_l", two))).alias("p")).select("p.*")
    measure = F.sum("m") if kind == "posting" else F.count("*")
    return each.groupBy("_a", "_b").agg(measure.alias("support")).where(F.col("support") >= least)


def item_lists(found: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc, ids ascending, mults): each document's numbered items, written once; ``n``: how many ids there are."""
    kept = found.join(sent(ids, n), "item").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "mult"))).alias("_l"))
    lists = kept.select("doc", F.transform("_l", lambda x: x["id"]).alias("ids"), F.transform("_l", lambda x: x["mult"].cast("long")).alias("mults"))
    return Steps(found.sparkSession, "lists").save(lists)


def sharing(members: DataFrame) -> DataFrame:
    """(a, b), a < b: items and categories that share a word."""
    each = members.select("item", F.col("category").alias("x")).unionByName(members.select("item", F.col("item").alias("x"))).distinct()
    two = each.alias("l").join(each.alias("r"), "item").where("l.x < r.x")
    return two.select(F.col("l.x").alias("a"), F.col("r.x").alias("b")).distinct()


def itemsets(found: DataFrame, least: int, levels: int = 10, kind: str = "document", same: DataFrame | None = None) -> DataFrame:
    """(items in order, size, support) of all frequent itemsets of at most ``levels`` items.

    A level's sets have dense numbers; a document's set grows by one item, and the grown ones are counted by a number made
    of the set's and the item's. From the third level on only candidates grow all of whose subsets are frequent; pairs of
    ``same`` don't, and so are in no greater set either.
    """
    steps = Steps(found.sparkSession, "itemsets")
    ones = steps.save(frequent_items(found, least, kind))
    ids = coded(ones)
    out = ones.select(F.array("item").alias("items"), F.lit(1).alias("size"), "support")
    if levels < 2:
        return out
    kept = steps.save(found.join(ids, "item").select("doc", F.col("id").alias("next"), F.col("mult").alias("m")))
    level = kept.select("doc", F.col("next").alias("set"), F.col("next").alias("last"), F.col("m").alias("mult"))
    sets = ids.select(F.col("id").alias("set"), F.array("id").alias("items"))
    apart = None
    if same is not None:
        number = lambda c: ids.select(F.col("item").alias(c), F.col("id").alias(f"_{c}"))
        apart = same.join(number("a"), "a").join(number("b"), "b").select((F.shiftleft(F.least("_a", "_b"), 32) + F.greatest("_a", "_b")).alias("key"))
    measure = F.sum("mult") if kind == "posting" else F.count("*")
    for size in range(2, levels + 1):
        if size == 2:
            grown = level.join(kept, "doc").where("next > last")
        else:
            able = able_candidates(sets.select("items")).select(F.slice("items", F.lit(1), F.lit(size - 1)).alias("items"), F.element_at("items", -1).alias("next"))
            grown = level.join(able.join(sets, "items").select("set", "next"), "set").join(kept, ["doc", "next"])
        grown = grown.select("doc", (F.shiftleft("set", 32) + F.col("next")).alias("key"), F.least("mult", "m").alias("mult"))
        if apart is not None and size == 2:
            grown = grown.join(apart, "key", "left_anti")
        if size < levels:  # the next level starts from it
            grown = steps.save(grown)
        after = numbered(grown.groupBy("key").agg(measure.alias("support")).where(F.col("support") >= least), "key", 0, "_set")
        if not after.limit(1).count():
            break
        after = after.withColumn("_old", F.shiftright("key", 32)).withColumn("_next", F.col("key").bitwiseAND(F.lit(2**32 - 1)))
        after = steps.save(after.join(sets.select(F.col("set").alias("_old"), "items"), "_old").select("key", "support", F.col("_set").alias("set"), F.concat("items", F.array("_next")).alias("items")))
        named = after.select("set", "support", F.posexplode("items").alias("_k", "id")).join(ids, "id").groupBy("set", "support").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "item"))), lambda x: x["item"]).alias("items"))
        out = out.unionByName(named.select("items", F.lit(size).alias("size"), "support"))
        if size < levels:
            level = grown.join(after.select("key", "set"), "key").select("doc", "set", F.col("key").bitwiseAND(F.lit(2**32 - 1)).alias("last"), "mult")
            sets = after.select("set", "items")
    return out


def candidates(sets: DataFrame) -> DataFrame:
    """Prefix join: itemsets of a level that agree but for their last item, put together."""
    head = F.slice("items", F.lit(1), F.size("items") - 1)
    last = F.element_at("items", -1)
    a = sets.select(head.alias("head"), last.alias("x"), "items")
    b = sets.select(head.alias("head"), last.alias("y"))
    return a.join(b, "head").where("x < y").select(F.concat("items", F.array("y")).alias("items"))


def able_candidates(sets: DataFrame) -> DataFrame:
    """The candidates of a level all of whose subsets of that level are among ``sets``."""
    found = candidates(sets)
    each = found.select("items", F.explode(subsets(F.col("items"))).alias("_part")).join(sets.select(F.col("items").alias("_part")), "_part")
    return each.groupBy("items").agg(F.count("*").alias("_n")).where(F.col("_n") == F.size("items")).select("items")


def itemset_support(found: DataFrame, sets: DataFrame, kind: str = "document") -> DataFrame:
    """(items, support) of given itemsets, 0 for those that never occur."""
    wanted = sets.select("items").distinct()
    each = wanted.select("items", F.explode("items").alias("item")).join(found, "item")
    held = each.groupBy("items", "doc").agg(F.count("*").alias("n"), F.min("mult").alias("mult")).where(F.col("n") == F.size("items"))
    measure = F.sum("mult") if kind == "posting" else F.count("*")
    return wanted.join(held.groupBy("items").agg(measure.alias("support")), "items", "left").select("items", F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def lift(pairs: DataFrame, items: DataFrame, n_docs: DataFrame) -> DataFrame:
    """(a, b, support, lift): the pair's share over the product of the items' shares; n_docs holds one row (n). The items
    are counted first, and written for that."""
    items = Steps(pairs.sparkSession, "items").save(items) if getattr(items, "_step_path", None) is None else items
    known = lambda item, n: sent(items.select(F.col("item").alias(item), F.col("support").alias(n)), items.count())
    out = pairs.join(known("a", "na"), "a").join(known("b", "nb"), "b")
    n = F.col("n").cast("double")  # of the one row that n_docs has
    return out.crossJoin(F.broadcast(n_docs)).select("a", "b", "support", ((F.col("support") / n) / ((F.col("na") / n) * (F.col("nb") / n))).alias("lift"))


def support_without(found: DataFrame, target, other) -> DataFrame:
    """(support): documents that hold ``target`` but not ``other``."""
    held = found.where(F.col("item") == target).select("doc").distinct()
    return held.join(found.where(F.col("item") == other).select("doc"), "doc", "left_anti").agg(F.count("*").alias("support"))


def supports_except(found: DataFrame, other) -> DataFrame:
    """(item, support): of each item, the documents that hold it but not ``other``."""
    return found.join(found.where(F.col("item") == other).select("doc").distinct(), "doc", "left_anti").groupBy("item").agg(F.count("*").alias("support"))


def conditional(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(target, dependent, support, probability) of both directions: the share of the dependent's documents that hold
    the target. This is our definition; the original's body is missing."""
    items = Steps(pairs.sparkSession, "items").save(items) if getattr(items, "_step_path", None) is None else items
    ways = F.array(F.struct(F.col("a").alias("target"), F.col("b").alias("dependent")), F.struct(F.col("b").alias("target"), F.col("a").alias("dependent")))
    both = pairs.select("support", F.explode(ways).alias("_w")).select("_w.target", "_w.dependent", "support")  # pairs are counted once
    known = sent(items.select(F.col("item").alias("dependent"), F.col("support").alias("n")), items.count())
    return both.join(known, "dependent").select("target", "dependent", "support", (F.col("support") / F.col("n")).alias("probability"))


def marked_pairs(found: DataFrame, marked: DataFrame, least: int = 10, kind: str = "document") -> DataFrame:
    """(item, mark, support): frequent pairs of any item and a marked one; marked (item)."""
    kept = found.join(frequent_items(found, least, kind).select("item"), "item", "left_semi")
    marks = kept.join(marked.select("item"), "item", "left_semi").select("doc", F.col("item").alias("mark"), F.col("mult").alias("m"))
    measure = F.sum(F.least("mult", "m")) if kind == "posting" else F.count("*")
    return kept.join(marks, "doc").where("item <> mark").groupBy("item", "mark").agg(measure.alias("support")).where(F.col("support") >= least)


def posting_support(words: DataFrame, members: DataFrame) -> DataFrame:
    """(item, support) of words and their categories as of ``postings``, by postings, from the words' own supports (item,
    support): a category counts once for each of its words in a document, so its support is the sum of theirs."""
    held = words.join(members.distinct(), "item").select(F.col("category").alias("item"), "support")
    return words.select("item", "support").unionByName(held).groupBy("item").agg(F.sum("support").alias("support"))


def affinity(asked: DataFrame, lifts: DataFrame, top: int = 3) -> DataFrame:
    """(case, entity, average, best): the mean lift of the case's tokens to the entity, and that of its ``top`` greatest;
    a missing lift is 1. asked (case, entity, token), a row a token; lifts (entity, token, lift)."""
    each = asked.join(lifts, ["entity", "token"], "left").withColumn("lift", F.coalesce("lift", F.lit(1.0)))
    out = each.groupBy("case", "entity").agg(F.avg("lift").alias("average"), F.sort_array(F.collect_list("lift"), asc=False).alias("_l"))
    best = F.slice("_l", 1, top)
    return out.select("case", "entity", "average", (F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)).alias("best"))


def sizes(found: DataFrame, words_below: int = 10_000_000) -> DataFrame:
    """(n_items, max_word): the postings' number, and the greatest word id, at least 5."""
    return found.agg(F.count("*").alias("n_items"), F.greatest(F.lit(5), F.max(F.when(F.col("item") < words_below, F.col("item")))).alias("max_word"))


def token_bags(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(bag, n): documents with the same tokens in any order, counted."""
    return docs.groupBy(F.array_sort(tokens).alias("bag")).agg(F.count("*").alias("n"))


def ordered(sets: DataFrame) -> DataFrame:
    """Itemsets (items) by size, then item by item."""
    return sets.orderBy(F.size("items"), "items")
