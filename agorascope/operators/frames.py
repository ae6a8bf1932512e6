"""Word categories from a hypernym hierarchy, subcategorisation frames, and parse trees."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import Steps

# Tags that restrict arguments, and the six frames as head, then tag and role of each argument.
HUMAN = "person 0,individual 0,someone 0,somebody 0,mortal 0,human 0,soul 0 어떤__사람|156508_인간|"
VEHICLE = "vehicle 0 운송_수단/"
ENTITY = "entity 0 "
OBJECT = "object 0,physical_object 0 "
FRAMES = {
    "타다": [(HUMAN, "Actor"), (VEHICLE, "Target")],
    "보다": [(HUMAN, "Actor"), (ENTITY, "Target")],
    "이쁘다": [(HUMAN, "Actor"), (ENTITY, "Target")],
    "예쁘다": [(HUMAN, "Actor"), (ENTITY, "Target")],
    "살다": [(HUMAN, "Actor"), (OBJECT, "Target")],
    "사다": [(HUMAN, "Actor"), (OBJECT, "Target")],
}

Frames = dict[str, list[tuple[str, str]]]


def closure(starts: DataFrame, parents: DataFrame) -> DataFrame:
    """(start, node, depth): all nodes reachable from each start along parents(node, parent), itself at depth 0, each
    at its least depth. One round a level, as many as there are; what has been reached is not followed again, so cycles end."""
    steps = Steps(starts.sparkSession, "closure")
    edges = parents.select("node", "parent").where("parent IS NOT NULL").distinct()
    front = steps.save(starts.select("start", F.col("node")).distinct().withColumn("depth", F.lit(0)))
    found = front
    depth = 0
    while True:
        depth += 1
        more = front.join(edges, "node").select("start", F.col("parent").alias("node")).distinct().join(found.select("start", "node"), ["start", "node"], "left_anti")
        front = steps.save(more.withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        found = found.unionByName(front)
    return found


def categories(words: DataFrame, translations: DataFrame, synsets: DataFrame) -> DataFrame:
    """(word, tags): each dictionary word's own and inherited tags, nearest first.

    words (word_id, word); translations (synset_id, word_id, name); synsets (synset_id, offset, name, parents array).
    A tag is the synset's name, a blank and its translated name or -. Words without a translation have no row.
    """
    own = translations.groupBy("word_id").agg(F.max("synset_id").alias("synset_id")).join(synsets.select("synset_id", "offset"), "synset_id")
    translated = translations.join(synsets.select("synset_id", "offset"), "synset_id").groupBy("offset").agg(F.max("name").alias("translated"))
    tags = synsets.select("offset", "name").distinct().join(translated, "offset", "left").select(F.col("offset").alias("node"), F.concat("name", F.lit(" "), F.coalesce("translated", F.lit("-"))).alias("tag"))
    reach = closure(own.select(F.col("word_id").alias("start"), F.col("offset").alias("node")), synsets.select(F.col("offset").alias("node"), F.explode("parents").alias("parent")))
    each = reach.join(tags, "node").join(words, F.col("start") == F.col("word_id"))
    return each.groupBy("word").agg(F.transform(F.array_sort(F.collect_set(F.struct("depth", "node", "tag"))), lambda x: x["tag"]).alias("tags"))


def tagged(tokens: DataFrame, tags: DataFrame) -> DataFrame:
    """Tokens (..., word) with their tags, null for unknown words."""
    return tokens.join(tags, "word", "left")


def sentences_tagged(tokens: DataFrame, tags: DataFrame, id: str, pos: str = "pos") -> DataFrame:
    """(id, tokens: array of (word, tags) in order)"""
    each = tagged(tokens, tags)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), "word", "tags"))), lambda x: F.struct(x["word"].alias("word"), x["tags"].alias("tags")))
    return each.groupBy(id).agg(listed.alias("tokens"))


def fits(token: tuple[str, tuple[str, ...] | None], tag: str) -> bool:
    return token[1] is not None and tag in token[1]


def match(tokens: list, arguments: list) -> tuple[list, list, list]:
    """Greedily, argument by argument: the first token left that fits; tokens equal to a taken one go too.

    Returns the pairs, the tokens left and the arguments without a token."""
    left, pairs, open_ = list(tokens), [], []
    for argument in arguments:
        taken = next((t for t in left if fits(t, argument[0])), None)
        if taken is None:
            open_.append(argument)
        else:
            pairs.append((taken, argument))
            left = [t for t in left if t != taken]
    return pairs, left, open_


def heads(tokens: list, frames: Frames) -> list[str]:
    return [w for w, _ in tokens if w in frames]


def complete(tokens: list, frames: Frames) -> bool:
    """Every frame whose head occurs finds all its arguments, each in a token of its own; true without any frame."""
    for head in heads(tokens, frames):
        left = list(tokens)
        for tag, _ in frames[head]:
            at = next((i for i, t in enumerate(left) if fits(t, tag)), None)
            if at is None:
                return False
            del left[at]
    return True


TOKENS, ARGUMENTS = "array<struct<word:string,tags:array<string>>>", "array<struct<tag:string,role:string>>"


def listed(tokens: Column) -> Column:
    """Tokens (word, tags), none where they are null."""
    return F.coalesce(F.transform(tokens, lambda t: F.struct(t["word"].alias("word"), t["tags"].alias("tags"))), F.array().cast(TOKENS))


def arguments_of(frame: list[tuple[str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(role).alias("role")) for tag, role in frame]).cast(ARGUMENTS)


def that_fit(tokens: Column, argument: Column) -> Column:
    return F.filter(tokens, lambda t: F.array_contains(t["tags"], argument["tag"]))


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is worked out once, however often it is named there."""
    return F.transform(F.array(value), of)[0]


def matched(tokens: Column, arguments: Column) -> Column:
    """``match`` as a column: (left, taken, open), taken the words; one pass over the arguments, which are few."""

    def next_(state: Column, argument: Column) -> Column:
        def with_found(found: Column) -> Column:
            left = F.when(found.isNull(), state["left"]).otherwise(F.filter(state["left"], lambda t: ~t.eqNullSafe(found)))
            taken = F.when(found.isNull(), state["taken"]).otherwise(F.concat(state["taken"], F.array(found["word"])))
            open_ = F.when(found.isNull(), F.concat(state["open"], F.array(argument))).otherwise(state["open"])
            return F.struct(left.alias("left"), taken.alias("taken"), open_.alias("open"))

        return bound(F.try_element_at(that_fit(state["left"], argument), F.lit(1)), with_found)

    start = F.struct(tokens.alias("left"), F.array().cast("array<string>").alias("taken"), F.array().cast(ARGUMENTS).alias("open"))
    return F.aggregate(arguments, start, next_)


def filled(tokens: Column, arguments: Column) -> Column:
    """Whether each argument finds a token of its own, equal ones counted by themselves."""

    def next_(state: Column, argument: Column) -> Column:
        fit = F.transform(state["left"], lambda t: F.coalesce(F.array_contains(t["tags"], argument["tag"]), F.lit(False)))
        without = lambda at: F.struct(F.filter(state["left"], lambda t, i: i != at - 1).alias("left"), (state["all"] & (at > 0)).alias("all"))
        return bound(F.array_position(fit, True).cast("int"), without)

    return F.aggregate(arguments, F.struct(tokens.alias("left"), F.lit(True).alias("all")), next_, lambda state: state["all"])


def of_heads(tokens: Column, frames: Frames, of: Callable[[list], Column], kind: str) -> Column:
    """``of`` the frame of each word that is a head, in the words' order; worked out once a frame whose head occurs."""
    if not frames:
        return F.array().cast(f"array<{kind}>")
    names = F.array(*map(F.lit, frames))

    def of_words(words: Column) -> Column:
        each = F.array(*[F.when(F.array_contains(words, head), of(frame)) for head, frame in frames.items()])
        return bound(each, lambda found: F.transform(words, lambda w: F.element_at(found, F.array_position(names, w).cast("int"))))

    return bound(F.filter(F.transform(tokens, lambda t: t["word"]), lambda w: w.isin(*frames)), of_words)


def open_arguments(tokens: Column, frames: Frames) -> Column:
    """The arguments (tag, role) that no token fills, of all heads in turn."""
    return F.flatten(of_heads(tokens, frames, lambda frame: matched(tokens, arguments_of(frame))["open"], ARGUMENTS))


def with_completeness(sentences: DataFrame, frames: Frames = FRAMES) -> DataFrame:
    """Adds complete, and open: the roles of arguments that no token fills."""

    def judged(tokens: Column) -> Column:
        whole = F.forall(of_heads(tokens, frames, lambda frame: filled(tokens, arguments_of(frame)), "boolean"), lambda x: x)
        return F.struct(whole.alias("complete"), F.transform(open_arguments(tokens, frames), lambda a: a["role"]).alias("open"))

    out = sentences.withColumn("_j", bound(listed(F.col("tokens")), judged))
    return out.select(*sentences.columns, F.col("_j.complete").alias("complete"), F.col("_j.open").alias("open"))


def recovered(pairs: DataFrame, frames: Frames = FRAMES, target: str = "target", context: str = "context") -> DataFrame:
    """Adds recovered: context words that fill the target's open arguments; both columns are arrays of (word, tags)."""
    wanted = bound(listed(F.col(target)), lambda tokens: open_arguments(tokens, frames))
    return pairs.withColumn("recovered", matched(listed(F.col(context)), wanted)["taken"])


def parse_tree(text: str) -> list[tuple[int, int, str, str]]:
    """(node, parent, type, text) of a bracketed tree, the root's parent -1; leaves have a text."""
    out: list[list] = []
    path: list[int] = []
    at = 0
    while at < len(text):
        c = text[at]
        if c == "(":
            end = at + 1
            while end < len(text) and text[end] not in " ()":
                end += 1
            out.append([len(out), path[-1] if path else -1, text[at + 1 : end], ""])
            path.append(len(out) - 1)
            at = end
        elif c == ")":
            if path:
                path.pop()
            at += 1
        else:
            end = at
            while end < len(text) and text[end] not in "()":
                end += 1
            if path and text[at:end].strip():
                out[path[-1]][3] = text[at:end].strip()
            at = end
    return [tuple(r) for r in out]


def trees(rows: DataFrame, id: str, text: str) -> DataFrame:
    """(id, node, parent, type, text) of bracketed trees."""

    @F.pandas_udf("array<struct<node:int,parent:int,type:string,text:string>>")
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("node", "parent", "type", "text"), r)) for r in parse_tree(t or "")])

    return rows.select(id, F.explode(parsed(text)).alias("_n")).select(id, "_n.*")


def clauses_of(tree: list, entity: str, clause: str) -> list[tuple[int, str]]:
    """The lowest clauses of one tree's (node, parent, type, text), whose parents come before their children."""
    children, holds, done, out = {}, set(), set(), []
    for node, parent, *_ in tree:
        children.setdefault(parent, []).append(node)
    texts = {node: text for node, _, _, text in tree}
    for node, parent, kind, text in reversed(tree):
        if text and entity in text:
            holds.add(node)
        if kind == clause and node in holds and node not in done:
            words, stack = [], [node]
            while stack:
                n = stack.pop()
                if texts[n]:
                    words.append(texts[n])
                stack += reversed(children.get(n, []))
            out.append((node, " ".join(words)))
            done.add(node)
        for marks in (holds, done):
            if node in marks:
                marks.add(parent)
    return out[::-1]


def lowest_clauses(nodes: DataFrame, entity: str, clause: str = "S", id: str = "id") -> DataFrame:
    """(id, node, text): of each tree the clauses nearest above a leaf that holds the entity, but those that have such a
    clause below them; a clause's text is that of its leaves in order. nodes: as ``trees`` gives them. A tree is one
    sentence, so its nodes are gathered as one row and passed through once, however deep it is."""
    whole = nodes.groupBy(id).agg(F.array_sort(F.collect_list(F.struct("node", "parent", "type", "text"))).alias("_tree"))
    return clauses_within(whole, "_tree", entity, clause, id)


def clauses_within(rows: DataFrame, tree: str, entity: str, clause: str = "S", id: str = "id") -> DataFrame:
    """The same of rows with trees, as arrays of (node, parent, type, text) in the nodes' order. Trees without a leaf that holds the
    entity have no such clause, and leave before Python."""

    @F.pandas_udf("array<struct<node:int,text:string>>")
    def found(trees: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("node", "text"), c)) for c in clauses_of([tuple(n[x] for x in ("node", "parent", "type", "text")) for n in tree], entity, clause)] for tree in trees])

    held = rows.where(F.exists(tree, lambda n: F.contains(n["text"], F.lit(entity))))
    return held.select(id, F.explode(found(tree)).alias("_c")).select(id, "_c.*")
