"""Sentences to trees: a chart parser (CKY) over a weighted grammar that is a table.

A grammar (parent, left, right, weight) has rules of two children, or of one where right is null; its leaves are parts of
speech. A chart holds, for each span of a sentence's words, the best weight of each symbol; a span's entries come from the
entries of its two parts, and then from rules of one child, whose best chains are put together beforehand. Weights are logs
of probabilities, so a chain never gains by a cycle; they count in whole thousandths, and sums are exact. Ties go to the
rule that comes first in the order of its symbols, and to the shorter left part.

A sentence that the start symbol doesn't derive becomes one node FRAGMENT over its leaves. The work of a sentence grows with
the cube of its words; each is a row, and sentences are dealt to tasks by Spark. A task fills the charts of sentences of one
length together, as arrays, one for each distinct row of parts of speech. The grammar is sent to the tasks, its size is checked.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

FRAGMENT = "FRAGMENT"


#: What is no derivation; the places times symbols of the charts that are filled together; nodes in a part that leaves a task.
NEVER, CELLS, PART = -(1 << 60), 4_000_000, 100_000
LEAF = 1 << 30


class Grammar:
    def __init__(self, rules: list[tuple[str, str, str | None, int]], start: str = "S"):
        if any(w > 0 for *_, w in rules):
            raise ValueError("weights are logs of probabilities, at most 0")
        self.symbols = sorted({start, *(x for rule in rules for x in rule[:3] if x is not None)})
        self.number = {x: k for k, x in enumerate(self.symbols)}
        self.parents = {parent for parent, *_ in rules}  # other symbols have one word
        self.pairs: list[tuple[str, str, str, int]] = []
        ones: dict[str, list] = defaultdict(list)
        for parent, left, right, weight in sorted(rules, key=lambda r: (r[0], r[1], r[2] or "", -r[3])):
            if right is None:
                ones[left].append((parent, weight))
            else:
                self.pairs.append((parent, left, right, weight))
        # from each symbol upwards: the best chain of single-child rules to each symbol above it
        self.above: list[tuple[str, str, int, tuple]] = []
        for low in sorted(ones):
            best, front = {low: (0, ())}, [low]
            while front:
                after = []
                for x in front:
                    for parent, weight in ones.get(x, ()):
                        value = best[x][0] + weight
                        if parent not in best or value > best[parent][0]:
                            best[parent] = (value, (*best[x][1], parent))
                            after.append(parent)
                front = after
            self.above += [(low, top, w, chain) for top, (w, chain) in best.items() if top != low]

    def raised(self, best: np.ndarray, how: np.ndarray) -> None:
        """Adds what rules of one child make of spans' symbols; ``how`` is the rule of two, or less than 0 for a chain."""
        own = best.copy()
        for k, (low, top, weight, _) in enumerate(self.above):
            value, at = own[self.number[low]] + weight, self.number[top]
            better = (value > best[at]) & (value > NEVER // 2)
            best[at][better] = value[better]
            how[at][better] = -1 - k

    def charts(self, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of sentences of one length (a row each, numbers of symbols): by symbol, sentence, first word and number of words, the best
        weight, how it came about, and the words of the left part."""
        many, n = tags.shape
        kinds = len(self.symbols) + 1  # the last: all parts of speech that no rule has
        best = np.full((kinds, many, n, n + 1), NEVER)
        ends = np.full((kinds, many, n + 1, n + 1), NEVER)  # the same by the place behind the last word
        how, parts = np.zeros(best.shape, np.int32), np.zeros(best.shape, np.int16 if n < 1 << 15 else np.int32)
        seen = np.zeros(kinds, bool)  # symbols that any span has
        for size in range(1, n + 1):
            now, of = np.full((kinds, many, n - size + 1), NEVER), np.zeros((kinds, many, n - size + 1), how.dtype)
            part = np.zeros(now.shape, parts.dtype)
            if size == 1:
                np.put_along_axis(now, tags[None], 0, 0)
                np.put_along_axis(of, tags[None], LEAF, 0)
            for k, (parent, left, right, weight) in enumerate(self.pairs if size > 1 else ()):
                low = 1 if right in self.parents else size - 1
                high = size - 1 if left in self.parents else 1
                if low > high or not (seen[self.number[left]] and seen[self.number[right]]):
                    continue
                value = best[self.number[left]][:, : n - size + 1, low : high + 1] + ends[self.number[right]][:, size:, size - high : size - low + 1][:, :, ::-1]
                at = value.argmax(2)
                value = np.take_along_axis(value, at[:, :, None], 2)[:, :, 0] + weight
                at += low
                p = self.number[parent]
                better = (value > NEVER // 2) & ((value > now[p]) | ((value == now[p]) & (at < part[p])))
                now[p][better], of[p][better], part[p][better] = value[better], k, at[better]
            self.raised(now, of)
            best[:, :, : n - size + 1, size], how[:, :, : n - size + 1, size], parts[:, :, : n - size + 1, size] = now, of, part
            ends[:, :, size:, size] = now
            seen |= (now > NEVER // 2).any((1, 2))
        return best, how, parts

    def trees(self, tags: list[tuple[str, ...]], start: str = "S") -> list[tuple[int | None, list[tuple[int, str, int]]]]:
        """Of each sentence the best tree's weight, none for a fragment, and its nodes (parent, type, word or -1) in preorder."""
        out: list = [(None, [])] * len(tags)
        found: dict[tuple, list[int]] = defaultdict(list)
        for k, x in enumerate(tags):
            if x:
                found[x].append(k)
        lengths: dict[int, list] = defaultdict(list)
        for x in found:
            lengths[len(x)].append(x)
        for n, each in lengths.items():
            together = max(1, CELLS // (len(self.symbols) * n * n))
            for a in range(0, len(each), together):
                group = each[a : a + together]
                best, how, parts = self.charts(np.array([[self.number.get(t, len(self.symbols)) for t in x] for x in group]))
                for i, x in enumerate(group):
                    tree = self.tree(x, start, best[:, i], how[:, i], parts[:, i])
                    for k in found[x]:
                        out[k] = tree
        return out

    def tree(self, tags: tuple[str, ...], start: str, best: np.ndarray, how: np.ndarray, parts: np.ndarray) -> tuple[int | None, list[tuple[int, str, int]]]:
        n, at = len(tags), self.number.get(start, len(self.symbols))
        weight = int(best[at, 0, n])
        if weight < NEVER // 2:
            return None, [(-1, FRAGMENT, -1)] + [(0, t, i) for i, t in enumerate(tags)]
        out: list[tuple[int, str, int]] = []
        stack = [(at, 0, n, -1)]
        while stack:
            symbol, i, size, parent = stack.pop()
            k = int(how[symbol, i, size])
            if k == LEAF:
                out.append((parent, tags[i], i))
            elif k < 0:
                low, _, _, chain = self.above[-1 - k]
                for x in reversed(chain):
                    out.append((parent, x, -1))
                    parent = len(out) - 1
                stack.append((self.number[low], i, size, parent))  # no chain leads to low, else one from further below would be better
            else:
                out.append((parent, self.symbols[symbol], -1))
                parent, left = len(out) - 1, int(parts[symbol, i, size])
                _, one, two, _ = self.pairs[k]
                stack.append((self.number[two], i + left, size - left, parent))
                stack.append((self.number[one], i, left, parent))
        return weight, out

    def parse(self, words: list[str], tags: list[str], start: str) -> tuple[int | None, list[tuple[int, int, str, str]]]:
        """The best tree's weight, and its nodes (node, parent, type, text) in preorder; no weight for a fragment."""
        weight, nodes = self.trees([tuple(tags)], start)[0]
        return weight, [(k, parent, kind, words[i] if i >= 0 else "") for k, (parent, kind, i) in enumerate(nodes)]


def with_trees(rows: DataFrame, tagged: Column, grammar: DataFrame, start: str = "S", most: int = 1_000_000, name: str = "tree") -> DataFrame:
    """The rows with an array of (node, parent, type, text): the trees of arrays of (word, pos)."""
    rules = [tuple(r) for r in grammar.select("parent", "left", "right", F.round(F.col("weight") * 1000).cast("long")).limit(most + 1).collect()]
    if len(rules) > most:
        raise ValueError(f"more than {most} rules to send to every task")
    given = rows.withColumn("_tagged", tagged)
    node = StructType([StructField("node", IntegerType()), StructField("parent", IntegerType()), StructField("type", StringType()), StructField("text", StringType())])
    schema = StructType([*given.drop("_tagged", name).schema.fields, StructField(name, ArrayType(node))])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chart = Grammar(rules, start)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_tagged"))
            others = batch.select(schema.names[:-1])
            sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
            begins = np.concatenate([[0], np.cumsum(sizes)])
            at = 0
            while at < len(sizes):
                to = min(len(sizes), max(at + 1, int(np.searchsorted(begins, begins[at] + PART, "left"))))
                words, tags = (x.to_pylist() for x in column.slice(at, to - at).flatten().flatten())
                cuts = (begins[at : to + 1] - begins[at]).tolist()
                ids, parents, kinds, texts, ends = [], [], [], [], [0]
                for a, (_, nodes) in zip(cuts, chart.trees([tuple(tags[a:b]) for a, b in zip(cuts, cuts[1:])], start)):
                    for k, (parent, kind, i) in enumerate(nodes):
                        ids.append(k)
                        parents.append(parent)
                        kinds.append(kind)
                        texts.append(words[a + i] if i >= 0 else "")
                    ends.append(len(ids))
                each = pa.StructArray.from_arrays([pa.array(ids, pa.int32()), pa.array(parents, pa.int32()), pa.array(kinds, pa.string()), pa.array(texts, pa.string())], ["node", "parent", "type", "text"])
                yield pa.RecordBatch.from_arrays([*others.slice(at, to - at).columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], schema.names)
                at = to

    return given.drop(name).mapInArrow(solve, schema)


def parsed(rows: DataFrame, id: str, tagged: Column, grammar: DataFrame, start: str = "S", most: int = 1_000_000) -> DataFrame:
    """(id, node, parent, type, text) of the trees of arrays of (word, pos), as ``lowest_clauses`` takes them."""
    trees = with_trees(rows.select(id, tagged.alias("_t")), F.col("_t"), grammar, start, most, "_n").drop("_t")
    return trees.select(id, F.explode("_n").alias("_n")).select(id, "_n.*")
