"""Entity dictionaries, solvers that assign entities to a target sentence, and their evaluation.

A dictionary is (group_id, pos, form): several forms name one group, the first is its name. Cases are rows with an
array of context sentences, oldest first, and a target sentence. Mentions are matched by code, all forms at once in one
pattern pass per form over each distinct sentence; the dictionary is a bounded parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import COMPARATIVE, Tokenizer, contains_any, entity_pattern, key_tokens, latin_tokens

Dictionary = list[tuple[int, str]]  # (group, form) in dictionary order


def dictionary_of(entities: DataFrame, most: int = 500) -> Dictionary:
    """The forms in order; a dictionary of more than ``most`` forms is refused, as each form becomes a pattern of the plan;
    ``mentions`` joins dictionaries of any size."""
    rows = entities.select("group_id", "pos", "form").orderBy("group_id", "pos").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} forms")
    return [(r["group_id"], r["form"]) for r in rows]


def mentioned(text: Column, entities: Dictionary, latin_rule: bool = True) -> Column:
    """The distinct groups whose forms begin in the text, in dictionary order."""
    hits = [F.when(text.rlike(entity_pattern(form, latin_rule)), F.lit(group)) for group, form in entities]
    return F.array_distinct(F.filter(F.array(*hits), lambda g: g.isNotNull()))


def mentions(sentences: DataFrame, entities: DataFrame, id: str, text: str) -> DataFrame:
    """(id, group_id, form) as an equi-join, for dictionaries of any size: at each place where a form may begin, the
    beginnings of all lengths that forms have are looked up. Lengths are collected, a row each. Rows of equal id and text
    count once."""
    forms = entities.select("group_id", "form", F.lower("form").alias("_key")).where("form <> ''").distinct()
    lengths = sorted(r["n"] for r in forms.select(F.length("_key").alias("n")).distinct().collect())
    if not lengths:
        return sentences.select(id).join(forms.select("group_id", "form"), F.lit(False))
    low = F.lower(text)
    # what follows each place where a form may begin: the start, after a stop, blank, line end or question mark, or a cased letter after anything else
    places = r"(?s)(?:^|(?<=[. \n?])|(?<=[^\p{Ll}\p{Lu}])(?=[\p{Ll}\p{Lu}]))(?=(.{1,%d}))" % lengths[-1]
    tails = sentences.select(F.col(id).alias("_id"), F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(places), F.lit(1)))).alias("_tail"))
    keys = tails.select("_id", F.explode(F.array(*[F.when(F.length("_tail") >= n, F.left("_tail", F.lit(n))) for n in lengths])).alias("_key")).where("_key IS NOT NULL")
    return keys.join(forms, "_key").select(F.col("_id").alias(id), "group_id", "form").distinct()


def with_mentions(cases: DataFrame, entities: Dictionary, target: str = "target", context: str = "context") -> DataFrame:
    """Adds target_groups and context_groups (one array a context sentence)."""
    return cases.withColumn("target_groups", mentioned(F.col(target), entities)).withColumn("context_groups", F.transform(context, lambda s: mentioned(s, entities)))


def all_groups() -> Column:
    return F.array_distinct(F.concat(F.col("target_groups"), F.flatten("context_groups")))


def _nonempty() -> Column:
    return F.filter("context_groups", lambda g: F.size(g) > 0)


def _or_empty(groups: Column) -> Column:
    return F.coalesce(groups, F.array().cast("array<int>"))


def target_only() -> Column:
    return F.col("target_groups")


def recent() -> Column:
    """The target's groups, else those of the newest context sentence that has any."""
    return F.when(F.size("target_groups") > 0, F.col("target_groups")).otherwise(_or_empty(F.try_element_at(_nonempty(), F.lit(-1))))


def recents_first() -> Column:
    """As recent, but only the first group of a context sentence."""
    return F.when(F.size("target_groups") > 0, F.col("target_groups")).otherwise(F.slice(_or_empty(F.try_element_at(_nonempty(), F.lit(-1))), 1, 1))


def first_only() -> Column:
    """The groups of the earliest sentence that has any, the target last."""
    every = F.filter(F.concat(F.col("context_groups"), F.array("target_groups")), lambda g: F.size(g) > 0)
    return _or_empty(F.try_element_at(every, F.lit(1)))


# The same over running values (threads.mentions_so_far), where no row carries the sentences before it:
# target_groups, newest and oldest.


def running_recent() -> Column:
    return F.when(F.size("target_groups") > 0, F.col("target_groups")).otherwise(F.col("newest"))


def running_recents_first() -> Column:
    return F.when(F.size("target_groups") > 0, F.col("target_groups")).otherwise(F.slice("newest", 1, 1))


def running_first_only() -> Column:
    return F.when(F.size("oldest") > 0, F.col("oldest")).otherwise(F.col("target_groups"))


def by_affinity(cases: DataFrame, scores: DataFrame, least: float = 2.0, kind: str = "int") -> DataFrame:
    """Cases (case) with answer: groups whose best affinity is above ``least``; scores (case, entity, best), entities of type ``kind``."""
    found = scores.where((F.col("best") > least) & ~F.isnan("best")).groupBy("case").agg(F.sort_array(F.collect_set("entity")).alias("answer"))
    return cases.join(found, "case", "left").withColumn("answer", F.coalesce("answer", F.array().cast(f"array<{kind}>")))


def context_words(sentence: Column, group: int, entities: Dictionary, size: int = 3, tokenizer: Tokenizer = latin_tokens) -> Column:
    """Content tokens around the first token that is part of one of the group's forms, if the sentence holds a form."""
    forms = [f for g, f in entities if g == group]
    tokens = key_tokens(sentence, tokenizer)
    part = lambda t: F.exists(F.array(*map(F.lit, forms)), lambda f: F.contains(F.lower(f), t))
    place = F.array_position(F.transform(tokens, part), True).cast("int")
    around = F.concat(F.slice(tokens, F.greatest(place - size, F.lit(1)), F.least(place - 1, F.lit(size))), F.slice(tokens, place + 1, size))
    empty = F.array().cast("array<string>")
    return F.when(contains_any(F.lower(sentence), [f.lower() for f in forms]) & (place > 0), around).otherwise(empty)


def group_context(context: Column, group: int, entities: Dictionary, most: int = 10, tokenizer: Tokenizer = latin_tokens) -> Column:
    """The first ``most`` distinct context words, newest sentence first."""
    return F.slice(F.array_distinct(F.flatten(F.reverse(F.transform(context, lambda s: context_words(s, group, entities, tokenizer=tokenizer))))), 1, most)


def by_context(entities: Dictionary, target: str = "target", context: str = "context", least: int = 1, tokenizer: Tokenizer = latin_tokens) -> Column:
    """Groups mentioned anywhere in the case whose context words the target shares at least ``least`` of."""
    words = key_tokens(F.col(target), tokenizer)
    hits = []
    for group in dict.fromkeys(g for g, _ in entities):
        shared = F.size(F.array_intersect(words, group_context(F.col(context), group, entities, tokenizer=tokenizer)))
        hits.append(F.when(F.array_contains(all_groups(), group) & (shared >= least), F.lit(group)))
    return F.filter(F.array(*hits), lambda g: g.isNotNull())


def cascade(entities: Dictionary, target: str = "target", context: str = "context", tokenizer: Tokenizer = latin_tokens) -> Column:
    """Groups whose label reaches the target: from the oldest sentence on, a sentence has a label if it mentions the
    group or shares a token with the sentences so far that have it. A mention contributes the words around it, another
    sentence all its content tokens. Labels stay with the sentence they were computed for; the target's explicit groups
    are always in the answer."""
    hits = []
    for group in dict.fromkeys(g for g, _ in entities):
        forms = [f for g, f in entities if g == group]

        sentences = F.concat(F.col(context), F.array(target))
        reached = _label_reaches(sentences, group, forms, entities, tokenizer)
        hits.append(F.when(F.array_contains(all_groups(), group) & reached, F.lit(group)))
    return F.array_union("target_groups", F.filter(F.array(*hits), lambda g: g.isNotNull()))


def _label_reaches(sentences: Column, group: int, forms: list[str], entities: Dictionary, tokenizer: Tokenizer) -> Column:
    """Whether the last sentence has the group's label; the words of labelled sentences are kept newest first, and a
    sentence is compared with the first ten of them."""

    def step(state: Column, s: Column) -> Column:
        tokens = key_tokens(s, tokenizer)
        explicit = F.lit(False)
        for f in forms:
            explicit = explicit | s.rlike(entity_pattern(f))
        has = explicit | (F.size(F.array_intersect(tokens, F.slice(state["words"], 1, 10))) > 0)
        new = F.when(explicit, context_words(s, group, entities, tokenizer=tokenizer)).otherwise(tokens)
        return F.struct(has.alias("label"), F.when(has, F.concat(new, state["words"])).otherwise(state["words"]).alias("words"))

    start = F.struct(F.lit(False).alias("label"), F.array().cast("array<string>").alias("words"))
    return F.aggregate(sentences, start, step, lambda state: state["label"])


def union(a: Column, b: Column) -> Column:
    return F.array_union(a, b)


def exclusive(a: Column, b: Column) -> Column:
    return F.array_except(a, b)


def named(entities: Dictionary) -> dict[int, str]:
    """Each group's name, its first form."""
    out: dict[int, str] = {}
    for group, form in entities:
        out.setdefault(group, form)
    return out


def accuracy(cases: DataFrame, gold: str, found: str) -> DataFrame:
    """(n, n_right, accuracy): equal as sets."""
    right = (F.size(F.array_except(gold, found)) == 0) & (F.size(F.array_except(found, gold)) == 0)
    return cases.agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"), F.avg(right.cast("double")).alias("accuracy"))


def hidden_scores(cases: DataFrame, gold: str, found: str, explicit: str = "target_groups", epsilon: float = 0.01) -> DataFrame:
    """(tp, fp, fn, precision, recall, f) over groups that the target does not mention; ``epsilon`` guards f."""
    real, got = F.array_except(gold, explicit), F.array_except(found, explicit)
    sums = cases.agg(
        F.sum(F.size(F.array_intersect(real, got))).alias("tp"), F.sum(F.size(F.array_except(got, real))).alias("fp"), F.sum(F.size(F.array_except(real, got))).alias("fn")
    )
    p = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    return sums.withColumn("precision", p).withColumn("recall", r).withColumn("f", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + epsilon))


def features(cases: DataFrame, target: str = "target") -> DataFrame:
    """A row for each case and mentioned group: (..., group, has_entity, comparative, distance, as_previous, as_first,
    most_frequent, current). The distance is that to the nearest context sentence with a mention, -1 without one."""
    each = cases.withColumn("group", F.explode(all_groups()))
    newest = F.array_position(F.transform(F.reverse("context_groups"), lambda g: F.size(g) > 0), True).cast("int")
    counts = F.concat(F.col("target_groups"), F.flatten("context_groups"))
    times = lambda g: F.size(F.filter(counts, lambda x: x == g))
    most = F.array_max(F.transform(F.array_distinct(counts), lambda g: F.struct(times(g).alias("n"), (-g).alias("g"))))
    return each.select(
        *cases.columns,
        "group",
        (F.size("target_groups") > 0).cast("int").alias("has_entity"),
        contains_any(F.col(target), COMPARATIVE).cast("int").alias("comparative"),
        F.when(newest == 0, -1).otherwise(newest).alias("distance"),
        F.coalesce(F.array_contains(F.try_element_at(_nonempty(), F.lit(-1)), F.col("group")), F.lit(False)).cast("int").alias("as_previous"),
        F.coalesce(F.array_contains(F.try_element_at(_nonempty(), F.lit(1)), F.col("group")), F.lit(False)).cast("int").alias("as_first"),
        (-most["g"] == F.col("group")).cast("int").alias("most_frequent"),
        F.array_contains("target_groups", F.col("group")).cast("int").alias("current"),
    )


FEATURES = ["has_entity", "comparative", "distance", "as_previous", "as_first", "most_frequent", "current"]


def training_rows(cases: DataFrame, gold: str) -> DataFrame:
    """(label, features): label 2 for groups of the gold that the target does not mention, 1 for all other candidates."""
    hidden = F.array_except(gold, "target_groups")
    return features(cases).select(F.when(F.array_contains(hidden, F.col("group")), 2).otherwise(1).alias("label"), F.array(*FEATURES).alias("features"))


def coverage(sentences: DataFrame, text: str, entities: Dictionary, part: Dictionary) -> DataFrame:
    """(n_full, n_part, ratio): groups found with the whole dictionary and with a part of its forms."""
    both = sentences.agg(F.sum(F.size(mentioned(F.col(text), entities))).alias("n_full"), F.sum(F.size(mentioned(F.col(text), part))).alias("n_part"))
    return both.withColumn("ratio", F.try_divide(F.col("n_part").cast("double"), F.col("n_full")))


def present_groups(entities: DataFrame, labels: DataFrame) -> DataFrame:
    """Dictionary groups that occur among the labels (group_id), with new numbers from 1 in order."""
    kept = entities.join(labels.select("group_id").distinct(), "group_id", "left_semi")
    return kept.withColumn("new_id", F.dense_rank().over(Window.orderBy("group_id")))
