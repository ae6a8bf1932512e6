"""Morphemes and their parts of speech: a lattice over a dictionary, and a hidden Markov model's best path through it.

The dictionary (form, tag, weight) holds log P(form | tag), the transitions (a, b, weight) log P(b | a); "^" stands before
a sentence and "$" behind it. Both are tables, read from a model's files or counted from tagged sentences. All forms of the
dictionary that begin at a place of a word are edges of its lattice, found by their lengths in one table; a character of its own
is one more, with the weight ``unknown`` and the tag UNKNOWN, so every word has a path. A transition that no row has costs
``missing``. Weights count in whole thousandths, so that sums are exact.

A word is solved once for each pair of a first and a last tag, whatever stands beside it; a sentence is the best chain of
its words' pairs. Sentences are tasks' rows; a task solves many of them together (``Batches``): the distinct words of a slice of
rows as arrays, place by place, then all its sentences, word by word. A slice has a bounded number of words, but one sentence at
least, and leaves in parts of bounded size; what is sent to the tasks are the two tables, whose sizes are checked. ``Model`` solves
one sentence; it keeps the words it has solved, up to a bound of words and of morphemes; of two such sets the older one goes.

Ties go to fewer morphemes, then to the smaller tag, from the end. Neighbouring unknown characters are one morpheme.
Null text has no morphemes (an empty array), and so has a text without words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

UNKNOWN, BEGIN, END = "Unknown", "^", "$"
Path = tuple[int, int, tuple[tuple[str, str], ...]]  # score, minus the number of morphemes, morphemes


#: What a task hands over, and what one set of solved words holds: so many morphemes at most, and a sentence or word more.
PART, SOLVED = 100_000, 300_000
#: A slice's words times pairs of tags, and what a group of words solved together holds: places times pairs of tags.
SLICE, GROUP = 6_000_000, 4_000_000
#: Scores and numbers of morphemes as one number, score * COUNT - morphemes; what is below half of NEVER can't be reached.
COUNT, NEVER = 1 << 22, -(1 << 60)


class Model:
    """The dictionary, and what has been solved."""

    def __init__(self, forms: list[tuple[str, str, int]], pairs: list[tuple[str, str, int]], unknown: int, missing: int, kept: int = 20_000):
        # a form with one tag, as most are, is held as a tuple that all forms of that tag and weight share
        self.forms: dict[str, tuple[tuple[str, int], ...]] = {}
        self.longest: dict[str, int] = {}  # form, by its first two characters
        shared: dict = {}
        for form, tag, weight in forms:
            known = dict(self.forms.get(form, ()))
            known[tag] = max(weight, known.get(tag, weight))
            each = tuple(known.items())
            self.forms[form] = shared.setdefault(each, each)
            if len(form) > self.longest.get(form[:2], 0):
                self.longest[form[:2]] = len(form)
        self.pairs = {(a, b): w for a, b, w in pairs}
        self.unknown, self.missing, self.kept, self.solved = unknown, missing, kept, {}
        self.older, self.held = {}, 0

    def edges(self, word: str, at: int) -> Iterator[tuple[int, str, int]]:
        """(end, tag, weight) of the morphemes that begin at a place."""
        yield at + 1, UNKNOWN, self.unknown
        for end in range(at + 1, min(len(word), at + max(1, self.longest.get(word[at : at + 2], 1))) + 1):
            for tag, weight in self.forms.get(word[at:end], ()):
                yield end, tag, weight

    def step(self, a: str, b: str) -> int:
        return self.pairs.get((a, b), self.missing)

    def word(self, word: str) -> dict[tuple[str, str], Path]:
        """The best path of a word for each pair of its first and last tag."""
        found = self.solved.get(word)
        if found is not None:
            return found
        found = self.older.get(word)
        if found is not None:
            return self.keep(word, found)
        # at each place, by (first, last): score, count, and the edge that led there
        best: list[dict] = [{} for _ in range(len(word) + 1)]
        for at in range(len(word)):
            for end, tag, weight in self.edges(word, at):
                came = [((tag, tag), (weight, -1), None)] if at == 0 else [((f, tag), (s + self.step(last, tag) + weight, n - 1), (at, (f, last))) for (f, last), (s, n, _) in best[at].items()]
                for key, value, back in came:
                    old = best[end].get(key)
                    if old is None or value > old[:2] or (value == old[:2] and back and old[2] and back[1] < old[2][1]):
                        best[end][key] = (*value, back)
        found = {}
        for key in best[-1]:
            score, n, back = best[-1][key]
            morphemes, end, now = [], len(word), key
            while True:
                at = back[0] if back else 0
                morphemes.append((word[at:end], now[1]))
                if not back:
                    break
                end, now = at, back[1]
                back = best[end][now][2]
            found[key] = (score, n, tuple(reversed(morphemes)))
        return self.keep(word, found)

    def keep(self, word: str, found: dict[tuple[str, str], Path]) -> dict[tuple[str, str], Path]:
        if len(self.solved) >= self.kept or self.held >= SOLVED:
            self.older, self.solved, self.held = self.solved, {}, 0
        self.solved[word] = found
        self.held += sum(len(path) for _, _, path in found.values())
        return found

    def sentence(self, words: list[str]) -> tuple[int, list[tuple[str, str]]]:
        """The best path's score and morphemes."""
        if not words:
            return 0, []
        now, chain = {BEGIN: (0, 0)}, []
        for word in words:
            after: dict[str, tuple] = {}
            for (first, last), (score, n, _) in self.word(word).items():
                for a, (s, m) in now.items():
                    value = (s + self.step(a, first) + score, m + n)
                    old = after.get(last)
                    if old is None or value > old[:2] or (value == old[:2] and (a, first) < old[2:]):
                        after[last] = (*value, a, first)
            chain.append(after)
            now = {tag: x[:2] for tag, x in after.items()}
        tag = min(now, key=lambda t: (-now[t][0] - self.step(t, END), -now[t][1], t))
        score, parts = now[tag][0] + self.step(tag, END), []
        for word, column in zip(reversed(words), reversed(chain)):
            _, _, a, first = column[tag]
            parts.append(self.word(word)[first, tag][2])
            tag = a
        return score, [m for part in reversed(parts) for m in part]


class _Group:
    """Words solved together: the best path of each for each pair of its first and last tag, and the ways back."""

    def __init__(self, words: list[str], of: "Batches"):
        """Words by rising length."""
        self.words, n, longest, tags = words, len(words), len(words[-1]), len(of.tags)
        self.lengths = lengths = np.array([len(w) for w in words])
        keys, forms = [], []  # edges: (end, begin, word) as one number, form
        known, reach = of.forms.get, of.longest.get
        for i, w in enumerate(words):
            for at in range(len(w)):
                for end in range(at + 1, min(len(w), at + reach(w[at : at + 2], 1)) + 1):
                    form = known(w[at:end])
                    if form is not None:
                        keys.append((end * longest + at) * n + i)
                        forms.append(form)
        key, form = np.array(keys, np.int64), np.array(forms, np.int64)
        many = of.starts[form + 1] - of.starts[form]
        at = np.arange(many.sum()) + np.repeat(of.starts[form] - (np.cumsum(many) - many), many)
        key, tag, weight = np.repeat(key, many), of.tag[at], of.weight[at]
        order = np.argsort(key, kind="stable")
        key, tag, weight = key[order], tag[order], weight[order]
        cuts = np.append(np.flatnonzero(np.diff(key // n, prepend=-1)), len(key))
        groups: dict[int, list] = {}
        for a, b in zip(cuts[:-1], cuts[1:]):
            end, begin = divmod(int(key[a] // n), longest)
            groups.setdefault(end, []).append((begin, key[a:b] % n, tag[a:b], weight[a:b]))
        shape = (longest + 1, n, tags, tags)
        came, came_last = np.full(shape, NEVER), np.zeros(shape, np.int16)  # to a place, with the step to the next tag
        self.begin, self.last = np.zeros(shape, np.int32), np.zeros(shape, np.int16)
        self.best = np.full(shape[1:], NEVER)
        for end in range(1, longest + 1):
            here, begin, last = np.full(shape[1:], NEVER), self.begin[end], self.last[end]
            alive = np.arange(np.searchsorted(lengths, end), n)
            own = (end - 1, alive, np.full(len(alive), of.other), np.full(len(alive), of.unknown))
            for at, w, tag, weight in sorted([own, *groups.get(end, ())], key=lambda g: g[0]):
                if at == 0:
                    fresh = weight * COUNT - 1
                    better = fresh > here[w, tag, tag]
                    here[w[better], tag[better], tag[better]] = fresh[better]
                    continue
                value, by = came[at, w, :, tag] + (weight * COUNT - 1)[:, None], came_last[at, w, :, tag]
                old = here[w, :, tag]
                # of equals the smaller tag before, then the earlier place
                i, f = np.nonzero((value > old) | ((value == old) & (by < last[w, :, tag])))
                x, t = w[i], tag[i]
                here[x, f, t], begin[x, f, t], last[x, f, t] = value[i, f], at, by[i, f]
            here[here < NEVER // 2] = NEVER
            done = lengths == end
            self.best[done] = here[done]
            if end < longest:
                first = np.searchsorted(lengths, end + 1)
                now, by = came[end, first:], came_last[end, first:]
                for t in range(tags):
                    value = here[first:, :, t, None] + of.steps[t] * COUNT
                    better = value > now
                    now[better] = value[better]
                    by[better] = t
                now[now < NEVER // 2] = NEVER

    def paths(self, word: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[list[tuple[str, int]]]:
        """Of words (their places) with a first and a last tag: the morphemes."""
        out: list[list] = [[] for _ in word]
        which, end, tag = np.arange(len(word)), self.lengths[word], last
        while len(which):
            begin = self.begin[end, word, first, tag]
            for k, w, a, b, t in zip(which.tolist(), word.tolist(), begin.tolist(), end.tolist(), tag.tolist()):
                out[k].append((self.words[w][a:b], t))
            tag = self.last[end, word, first, tag]
            more = begin > 0
            which, word, first, tag, end = which[more], word[more], first[more], tag[more], begin[more]
        return [path[::-1] for path in out]


class Batches:
    """The dictionary and the transitions as arrays, and sentences solved many at once: what ``Model`` finds, ties included."""

    def __init__(self, forms: list[tuple[str, str, int]], pairs: list[tuple[str, str, int]], unknown: int, missing: int):
        self.tags = sorted({UNKNOWN, *(tag for _, tag, _ in forms)})
        number = {t: k for k, t in enumerate(self.tags)}
        self.unknown, self.other = unknown, number[UNKNOWN]
        known: dict[str, dict[int, int]] = {}
        self.longest: dict[str, int] = {}  # form, by its first two characters
        for form, tag, weight in forms:
            of = known.setdefault(form, {})
            of[number[tag]] = max(weight, of.get(number[tag], weight))
            if len(form) > self.longest.get(form[:2], 0):
                self.longest[form[:2]] = len(form)
        self.forms = {form: k for k, form in enumerate(known)}
        self.starts = np.cumsum([0, *(len(of) for of in known.values())])
        self.tag = np.array([t for of in known.values() for t in of], np.int64)
        self.weight = np.array([w for of in known.values() for w in of.values()], np.int64)
        weight = {(a, b): w for a, b, w in pairs}
        to = lambda a: [weight.get((a, b), missing) for b in self.tags]
        self.steps = np.array([to(a) for a in self.tags], np.int64)
        self.begins, self.ends = np.array(to(BEGIN), np.int64), np.array([weight.get((a, END), missing) for a in self.tags], np.int64)

    def solve(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Sentences as numbers of distinct words, one after the other, and their sizes. Morphemes of distinct paths (forms, tags),
        the first morpheme of each path and behind the last, and the path of each word of the sentences."""
        tags = len(self.tags)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        place, groups, at = np.empty(len(words), np.int64), [], 0
        place[order] = np.arange(len(words))
        ranked = [words[k] for k in order]
        chain = np.empty((len(words), tags + 1, tags), np.int64)  # of the tag before (the last: none) and the last tag
        firsts = np.empty(chain.shape, np.int16)
        steps = np.concatenate([self.steps, self.begins[None]]) * COUNT
        while at < len(ranked):
            n = max(1, GROUP // (len(ranked[at]) + 1) // tags**2)
            while n > 1 and (len(ranked[min(at + n, len(ranked)) - 1]) + 1) * n * tags**2 > 2 * GROUP:
                n = (n + 1) // 2
            group = _Group(ranked[at : at + n], self)
            n = len(group.words)
            for a in range(tags + 1):
                value = group.best + steps[a][None, :, None]
                firsts[at : at + n, a] = value.argmax(1)
                chain[at : at + n, a] = value.max(1)
            groups.append((at, group))
            at += n
        word = place[ids]
        long = np.argsort(-sizes, kind="stable")
        starts, many = (np.cumsum(sizes) - sizes)[long], sizes[long]
        long = many > 0
        starts, many = starts[long], many[long]
        back = np.empty((len(word), tags), np.int16)
        alive = np.searchsorted(-many, -np.arange(many[0] if len(many) else 0), "left")  # with more words than that
        final = np.empty(len(many), np.int64)
        now = chain[word[starts], tags]
        for k in range(len(alive)):
            if k:
                at = starts[: alive[k]] + k
                value = now[: alive[k], :, None] + chain[word[at], :tags]
                back[at] = value.argmax(1)
                now = value.max(1)
                now -= now.max(1)[:, None]
            over = alive[k + 1] if k + 1 < len(alive) else 0
            final[over : alive[k]] = (now[over:] + self.ends * COUNT).argmax(1)
        last, first = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
        tag = final
        for k in range(len(alive) - 1, -1, -1):
            ending = final.copy()[: alive[k]]
            if k + 1 < len(alive):
                ending[: alive[k + 1]] = tag
            at = starts[: alive[k]] + k
            before = back[at, ending] if k else np.full(len(at), tags)
            last[at], first[at] = ending, firsts[word[at], before, ending]
            tag = before
        paths, which = np.unique((word * tags + first) * tags + last, return_inverse=True)
        forms, kinds, cuts = [], [], [0]
        word, first, last = paths // tags**2, paths // tags % tags, paths % tags
        for at, group in groups:
            a, b = np.searchsorted(word, [at, at + len(group.words)])
            for path in group.paths(word[a:b] - at, first[a:b], last[a:b]):
                own = len(forms)
                for form, kind in path:
                    if kind == self.other and len(forms) > own and kinds[-1] == kind:
                        forms[-1] += form  # neighbouring unknown characters of a word are one morpheme
                    else:
                        forms.append(form)
                        kinds.append(kind)
                cuts.append(len(forms))
        return forms, np.array(kinds, np.int64), np.array(cuts), which


def merged(morphemes: list[tuple[str, str]], lengths: list[int]) -> list[tuple[str, str]]:
    """Neighbouring unknown characters of a word as one morpheme; lengths: the words'."""
    out, left, ends = [], 0, iter(lengths)
    for form, tag in morphemes:
        fresh = left == 0
        left = (next(ends) if fresh else left) - len(form)
        if tag == UNKNOWN and not fresh and out[-1][1] == UNKNOWN:
            out[-1] = (out[-1][0] + form, tag)
        else:
            out.append((form, tag))
    return out


def collected(table: DataFrame, names: list[str], most: int) -> list[tuple]:
    rows = table.select(*names, F.round(F.col("weight") * 1000).cast("long")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows to send to every task")
    return [tuple(r) for r in rows]


def tagged(rows: DataFrame, words: Column, dictionary: DataFrame, transitions: DataFrame, unknown: float = -12.0, missing: float = -9.0, most: int = 1_000_000, name: str = "tagged") -> DataFrame:
    """The rows with an array of (word, pos): the morphemes of an array of words, as ``content_words`` takes them."""
    forms, pairs = collected(dictionary.where("form <> ''"), ["form", "tag"], most), collected(transitions, ["a", "b"], most)
    limits = round(unknown * 1000), round(missing * 1000)

    kind = ArrayType(StructType([StructField("word", StringType()), StructField("pos", StringType())]))
    given = rows.withColumn("_words", words)
    schema = StructType([*given.drop("_words", name).schema.fields, StructField(name, kind)])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Batches(forms, pairs, *limits)
        most = max(1, SLICE // len(model.tags) ** 2)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_words"))
            others = batch.select(schema.names[:-1])
            begins = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0)))])
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(begins, begins[start] + most, "right")) - 1)
                # without null and empty words; the words of null are none
                own = column.slice(start, end - start)
                coded = own.flatten().dictionary_encode()
                words = coded.dictionary.to_pylist()
                ids = np.asarray(coded.indices.fill_null(-1)).astype(np.int64)
                real = np.array([bool(w) for w in words] + [False])[ids]
                before = np.concatenate([[0], np.cumsum(real)])
                cuts = before[begins[start : end + 1] - begins[start]]
                named = np.flatnonzero([bool(w) for w in words])
                number = np.zeros(len(words), np.int64)
                number[named] = np.arange(len(named))
                found, kinds, ends, path = model.solve([words[k] for k in named], number[ids[real]], np.diff(cuts))
                many = np.diff(ends)[path]
                total = np.concatenate([[0], np.cumsum(many)])
                of_row = total[cuts]
                pool, names = pa.array(found, pa.string()), pa.array(model.tags, pa.string())
                at = 0
                while at < end - start:
                    to = max(at + 1, int(np.searchsorted(of_row, of_row[at] + PART, "left")))
                    to = min(to, end - start)
                    a, b = cuts[at], cuts[to]
                    places = np.arange(total[b] - total[a]) + np.repeat(ends[path[a:b]] - (total[a:b] - total[a]), many[a:b])
                    each = pa.StructArray.from_arrays([pool.take(pa.array(places)), names.take(pa.array(kinds[places]))], ["word", "pos"])
                    rows = others.slice(start + at, to - at)
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(of_row[at : to + 1] - of_row[at], pa.int32()), each)], schema.names)
                    at = to
                start = end

    return given.drop(name).mapInArrow(solve, schema)


def trained(tokens: DataFrame, id: str = "id", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Dictionary and transitions as counted in tagged sentences (id, pos, form, tag)."""
    share = lambda counts, by: counts.join(F.broadcast(counts.groupBy(by).agg(F.sum("n").alias("all"))), by).withColumn("weight", F.log(F.col("n") / F.col("all")))  # noqa: E731  one row a tag
    dictionary = share(tokens.groupBy("form", "tag").agg(F.count("*").alias("n")), "tag").select("form", "tag", "weight")
    order = Window.partitionBy(id).orderBy(pos)
    steps = tokens.select(F.coalesce(F.lag("tag").over(order), F.lit(BEGIN)).alias("a"), F.col("tag").alias("b"))
    last = tokens.groupBy(id).agg(F.max_by("tag", pos).alias("a")).select("a", F.lit(END).alias("b"))
    counts = steps.unionByName(last).groupBy("a", "b").agg(F.count("*").alias("n"))
    return dictionary, share(counts, "a").select("a", "b", "weight")


def counted(rows: DataFrame, forms: Column, tags: Column) -> DataFrame:
    """(step, a, b, n, n_rows) of tagged sentences as arrays of forms and tags: how often each form (a) has a tag (b) and in how many
    rows, and each tag (a) is followed by one (b), ends included. Only counts leave a task; rows without words count for nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(0).value_lengths().fill_null(0)).astype(np.int64)
            form, tag = (batch.column(k).flatten().dictionary_encode() for k in (0, 1))
            if not len(form):
                continue
            names, kinds = form.dictionary, pa.concat_arrays([tag.dictionary, pa.array([BEGIN, END], pa.string())])
            word, t, most = np.asarray(form.indices).astype(np.int64), np.asarray(tag.indices).astype(np.int64), len(kinds)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pairs, n = np.unique(word * most + t, return_counts=True)
            each = np.unique(np.searchsorted(pairs, word * most + t) * len(sizes) + row) // len(sizes)
            first = np.r_[True, row[1:] != row[:-1]]
            begin, end = np.flatnonzero(first), np.r_[np.flatnonzero(first)[1:], len(t)] - 1
            step = np.bincount(np.concatenate([t[:-1][~first[1:]] * most + t[1:][~first[1:]], (most - 2) * most + t[begin], t[end] * most + most - 1]), minlength=most**2)
            steps = np.flatnonzero(step)
            out = [(False, names.take(pa.array(pairs // most)), pairs % most, n, np.bincount(each, minlength=len(pairs))), (True, kinds.take(pa.array(steps // most)), steps % most, step[steps], np.zeros(len(steps), int))]
            for which, a, b, n, rows in out:
                yield pa.RecordBatch.from_arrays([pa.array([which] * len(a), pa.bool_()), a, kinds.take(pa.array(b)), pa.array(n, pa.int64()), pa.array(rows, pa.int64())], ["step", "a", "b", "n", "n_rows"])

    each = rows.select(forms.alias("forms"), tags.alias("tags")).mapInArrow(count, "step boolean, a string, b string, n long, n_rows long")
    return each.groupBy("step", "a", "b").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows"))


def weighed(counts: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Dictionary and transitions of counts, of the dictionary the forms and tags that at least so many rows have."""
    share = lambda rows, by: rows.join(F.broadcast(rows.groupBy(by).agg(F.sum("n").alias("all"))), by).withColumn("weight", F.log(F.col("n") / F.col("all")))  # noqa: E731  one row a tag
    forms = share(counts.where("NOT step"), "b").where(F.col("n_rows") >= least)
    return forms.select(F.col("a").alias("form"), F.col("b").alias("tag"), "weight"), share(counts.where("step"), "a").select("a", "b", "weight")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(form, tag, weight) from lines "form/tag weight"; a form may hold slashes, a line without a form has form ''."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^(.*)/([^/\s]*)\s+(\S+)\s*$", 1).alias("form"), F.regexp_extract("value", r"^(.*)/([^/\s]*)\s+(\S+)\s*$", 2).alias("tag"), F.expr(r"try_cast(regexp_extract(value, '(\\S+)\\s*$', 1) AS double)").alias("weight")).where("tag <> '' AND weight IS NOT NULL")


def read_transitions(spark: SparkSession, path: str, begin: str = "bnk", end: str = "bnk") -> DataFrame:
    """(a, b, weight) from lines "a-b weight"; the tags that stand for a sentence's ends there become "^" and "$"."""
    pattern = r"^([^\s-]+)-([^\s-]+)\s+(\S+)\s*$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    found = spark.read.text(path).where(F.col("value").rlike(pattern)).select(part(1).alias("a"), part(2).alias("b"), part(3).cast("double").alias("weight"))
    ends = found.where((F.col("a") == begin) | (F.col("b") == end))
    named = ends.select(F.when(F.col("a") == begin, BEGIN).otherwise(F.col("a")).alias("a"), F.when(F.col("b") == end, END).otherwise(F.col("b")).alias("b"), "weight")
    return found.unionByName(named)
