"""Approximate nearest neighbours by a forest of hash prefixes.

Each tree gives a vector a long string: two symbols, each naming the direction, of ``WIDTH`` random ones and their
opposites, to which the vector is nearest, then ``SIGNS`` signs of random projections. Nothing is fitted, and every vector
is indexed once for the whole table. A query descends to the longest prefix at which vectors meet it in any tree; then all
trees ascend together, level by level, and the vectors that share a prefix of that length with the query are candidates,
scored by the cosine of the original vectors in double precision. The topmost levels also take the next best directions
of the query for a symbol, which is a prefix between two lengths; above them is the root, where every vector is a
candidate. Two vectors of cosine s share a level's prefix in a tree with a chance p(s) that is known from the level alone
(``chances``), so a vector as near as the k-th best found so far has been met with a chance of 1 - (1 - p)^trees;
a query's ascent ends when this is at least ``recall``, whatever the data look like.

Equal vectors are one class that is searched for once, with its k + 1 smallest ids. Candidates a query grow more slowly
than the table, as neighbours come closer.

Scale: the strings are made once and written with their vectors, as segments of the trees' arrays. While the waiting
queries' prefixes are at most ``MOST_SENT``, they are sent to every task, which sorts a segment's strings by tree, looks
the prefixes up, scores the vectors that it finds and gives back k a query; no pair leaves a task. Beyond that number both
sides are shuffled by (tree, prefix), the most frequent prefixes salted, and pairs are scored in blocks of about ``block``
by their candidate. Queries that reach the root meet all vectors in blocks. Each step is written to the shared
checkpoint folder.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; a query finds vectors of its
own length only, never its own row but other rows of equal id; with fewer than k candidates all are returned; ties go to
the smaller id, a null id first; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Steps, groups, kept, salted_join
from .embed_dedup import matrix, unit, usable

WIDTH, SIGNS, POOL = 32, 40, 1_024
SYMBOL = (2 * WIDTH).bit_length() - 1
BITS = 2 * SYMBOL + SIGNS
#: Levels from the longest prefix up: its bits, and how many of the query's directions count for the first and second symbol.
LEVELS = [(BITS, 1, 1), (28, 1, 1), (20, 1, 1), (16, 1, 1), (2 * SYMBOL, 1, 1), (2 * SYMBOL, 1, 2), (2 * SYMBOL, 1, 4), (2 * SYMBOL, 2, 4)]
DIRECTIONS = 4
MOST_SENT = 4_000_000


class Forest:
    """Strings of vectors of one length."""

    def __init__(self, dim: int, trees: int, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.trees = trees
        self.pool = rng.standard_normal((dim, POOL)).astype(np.float32)
        self.symbols = np.stack([rng.choice(POOL, WIDTH, replace=False) for _ in range(2 * trees)])
        self.signs = np.stack([rng.choice(POOL, SIGNS, replace=False) for _ in range(trees)])

    def strings(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors the strings by tree, and the best DIRECTIONS symbols for both places of each tree."""
        y = x.astype(np.float32) @ self.pool
        near = y[:, self.symbols.ravel()].reshape(len(x), 2 * self.trees, WIDTH)
        size = np.abs(near)
        best = np.argpartition(-size, DIRECTIONS - 1, axis=2)[:, :, :DIRECTIONS]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(size, best, 2), axis=2, kind="stable"), 2)
        best = best + WIDTH * (np.take_along_axis(near, best, 2) < 0)
        best = best.reshape(len(x), self.trees, 2, DIRECTIONS).astype(np.int64)
        bits = np.zeros((len(x), self.trees, 8), np.uint8)
        bits[:, :, 8 - SIGNS // 8 :] = np.packbits((y[:, self.signs.ravel()] >= 0).reshape(len(x), self.trees, SIGNS), axis=2)
        signs = bits.view(">u8")[:, :, 0].astype(np.int64)
        return (best[:, :, 0, 0] << (SYMBOL + SIGNS)) | (best[:, :, 1, 0] << SIGNS) | signs, best


def chances(s: np.ndarray, draws: int = 20_000, seed: int = 3) -> np.ndarray:
    """For cosines s, and each level, the chance that two vectors share its prefix in one tree."""
    rng = np.random.default_rng(seed)
    a, z = rng.standard_normal((2, draws, WIDTH))
    order = np.argsort(-np.abs(a), axis=1)[:, :DIRECTIONS]
    out = np.zeros((len(LEVELS), len(s)))
    for k, c in enumerate(s):
        b = c * a + np.sqrt(1 - c * c) * z
        top = np.abs(b).argmax(axis=1)
        at = np.arange(draws)
        same = (order == top[:, None]) & ((a[at, top] >= 0) == (b[at, top] >= 0))[:, None]
        among = same.mean(axis=0).cumsum()  # among the best 1, 2, ... directions
        sign = 1 - np.arccos(np.clip(c, -1, 1)) / np.pi
        out[:, k] = [among[r1 - 1] * among[r2 - 1] * sign ** (bits - 2 * SYMBOL) for bits, r1, r2 in LEVELS]
    return out


def least_cosines(trees: int, recall: float) -> list[float]:
    """For each level the least cosine of a k-th neighbour with which the ascent may end there; 2: never."""
    s = np.linspace(0, 1, 101)
    met = 1 - (1 - chances(s)) ** trees >= recall
    return [float(s[m][0]) if (m := np.logical_and.accumulate(row[::-1])[::-1]).any() else 2.0 for row in met]


def coded(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                dims = batch.column(2).to_numpy()
                for d in np.unique(dims).tolist():
                    forest = kept(("forest", d, trees), lambda: Forest(d, trees))  # noqa: B023
                    part = batch.take(pa.array(np.nonzero(dims == d)[0]))
                    x = unit(matrix(part.column(1), d))
                    strings, best = forest.strings(x)
                    asks = part.column(3).to_numpy(zero_copy_only=False)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * trees, pa.int32()), pa.array(strings.ravel()))
                    # of queries also the directions, a byte each
                    more = pa.array([b.astype(np.uint8).tobytes() if q else None for b, q in zip(best, asks)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.einsum("ij,ij->i", x, x)), lists, more], ["node", "vector", "dim", "asks", "self", "strings", "best"])

    return run


def prefixes(trees: int, r1: int, r2: int):
    """The queries' (dim, key, q) for a level of two symbols with several directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, dim, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
                best = np.frombuffer(raw, np.uint8).reshape(trees, 2, DIRECTIONS).astype(np.int64)
                keys = (best[:, 0, :r1, None] << SYMBOL) | best[:, 1, None, :r2] | (np.arange(trees) << BITS)[:, None, None]
                keys = keys.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), dim, np.int32)), pa.array(keys), pa.array(np.full(len(keys), node, np.int64))], ["dim", "key", "q"])

    return run


def probed(k: int, trees: int, bits: int, asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """Segments (node, dim, vector, strings) against queries by vector length: their nodes, unit vectors, and (query, key)
    by tree, a key being a prefix of ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            dims = whole.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                if d not in asked:
                    continue
                names, vectors, keys = asked[d]
                part = whole.take(pa.array(np.nonzero(dims == d)[0]))
                node, x = part.column(0).to_numpy(), unit(matrix(part.column(2), d))
                strings = part.column(3).flatten().to_numpy().reshape(len(node), trees) >> (BITS - bits)
                orders = np.argsort(strings, axis=0, kind="stable")
                for at in range(0, len(names), 1_000):
                    some = slice(at, at + 1_000)
                    met = np.zeros((len(names[some]), len(node)), bool)
                    for t in range(trees):
                        order = orders[:, t]
                        held = strings[order, t]
                        key = keys[some, t]  # a row a query, a column a probe
                        low, high = np.searchsorted(held, key), np.searchsorted(held, key, "right")
                        many = (high - low).ravel()
                        if not many.any():
                            continue
                        ends = np.cumsum(many)
                        rows = order[np.repeat(low.ravel() - ends + many, many) + np.arange(ends[-1])]
                        met[np.repeat(np.repeat(np.arange(len(met)), key.shape[1]), many), rows] = True
                    i, j = np.nonzero(met)
                    other = names[some][i] != node[j]
                    i, j = i[other], j[other]
                    if len(i):
                        score = np.concatenate([np.einsum("ij,ij->i", x[j[lo : lo + 20_000]], vectors[some][i[lo : lo + 20_000]]) for lo in range(0, len(i), 20_000)])
                        out = best_of(names[some][i], node[j], score, k)
                        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.append(np.int64(len(i)), np.zeros(out.num_rows - 1, np.int64)))], ["q", "node", "score", "pairs"])

    return run


def best_of(q: np.ndarray, node: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """Each query's k best and whatever ties with the k-th."""
    order = np.lexsort((-score, q))
    q, node, score = q[order], node[order], score[order]
    first = np.nonzero(np.diff(q, prepend=q[0] - 1))[0]
    size = np.diff(np.append(first, len(q)))
    least = score[first + np.minimum(size, k) - 1]
    stay = score >= np.repeat(least, size)
    return pa.RecordBatch.from_arrays([pa.array(q[stay]), pa.array(node[stay]), pa.array(score[stay])], ["q", "node", "score"])


def scored(k: int):
    """Rows of a block: candidates' vectors (kind 0), queries' (1), and pairs (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["dim", "block"]):
            kind, dim = t["kind"].to_numpy(), t["dim"][0].as_py()
            q, node = t["q"].to_numpy(), t["node"].to_numpy()
            sides = []
            for side, names in ((0, node), (1, q)):
                at = np.nonzero(kind == side)[0]
                at = at[np.argsort(names[at])]
                sides.append((names[at], unit(matrix(t["vector"].take(pa.array(at)), dim))))
            pairs = kind == 2
            if not pairs.any():
                continue
            q, node = q[pairs], node[pairs]
            (nodes, x), (asked, y) = sides
            i, j = np.searchsorted(nodes, node), np.searchsorted(asked, q)
            score = np.concatenate([np.einsum("ij,ij->i", x[i[lo : lo + 20_000]], y[j[lo : lo + 20_000]]) for lo in range(0, len(i), 20_000)])
            yield best_of(q, node, score, k)

    return run


def scanned(k: int):
    """Rows of a block of vectors, and of the queries (asks) that meet it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["dim", "block"]):
            asks, node, x = t["asks"].to_numpy(zero_copy_only=False), t["node"].to_numpy(), unit(matrix(t["vector"], t["dim"][0].as_py()))
            here, asking = np.nonzero(~asks)[0], np.nonzero(asks)[0]
            for lo in range(0, len(asking), 256):
                some = asking[lo : lo + 256]
                if not len(here):
                    break
                # the einsum's own order of additions, so that equal pairs have equal scores on all ways
                i, j = (a.ravel() for a in np.meshgrid(some, here, indexing="ij"))
                near = np.concatenate([np.einsum("ij,ij->i", x[j[a : a + 20_000]], x[i[a : a + 20_000]]) for a in range(0, len(i), 20_000)])
                other = node[i] != node[j]
                if other.any():
                    yield best_of(node[i[other]], node[j[other]], near[other], k)

    return run


FOUND = "q long, node long, score double"


def nearest(
    vectors: DataFrame, queries: Column, id: str = "vec_id", vector: str = "embedding", k: int = 5, recall: float = 0.95, trees: int = 256, block: int = 250_000, most_sent: int = MOST_SENT, counted: list | None = None
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``queries`` holds, against all others. ``counted``, if given,
    gets the number of scored pairs of each level."""
    spark = vectors.sparkSession
    steps = Steps(spark, "forest")
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")).where(usable(F.col("vector")))
    rows = rows.withColumn("class", F.unhex(F.md5(F.array_join(F.transform("vector", lambda x: (x + F.lit(0)).cast("string")), ","))))
    rows = steps.save(rows.withColumn("row", F.monotonically_increasing_id()))
    heads = rows.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("id", "row"))).where(F.col("r") <= k + 1)
    heads = heads.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("members"))
    classes = rows.groupBy("class").agg(F.first("vector").alias("vector"), F.max("asks").alias("asks")).join(heads, "class")
    classes = steps.save(classes.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node")))
    kind = classes.schema["vector"].dataType.simpleString()
    forest = steps.save(classes.select("node", "vector", "dim", "asks").mapInArrow(coded(trees), f"node long, vector {kind}, dim int, asks boolean, self double, strings array<long>, best binary"))
    vectors_of = classes.select("node", "dim", "vector")

    def keys(df: DataFrame, bits: int) -> DataFrame:
        each = df.select("node", "dim", F.posexplode("strings").alias("tree", "s"))
        return each.select("dim", (F.shiftleft(F.col("tree").cast("long"), BITS) + F.shiftright("s", BITS - bits)).alias("key"), "node")

    def met(index: DataFrame, asked: DataFrame) -> DataFrame:
        hot = F.broadcast(index.groupBy("dim", "key").count().orderBy(F.desc("count"), "dim", "key").limit(1_000).select("dim", "key", F.lit(True).alias("_hot")))
        salted = index.join(hot, ["dim", "key"], "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("node"), F.lit(64)).cast("int")).otherwise(0)).drop("_hot")
        copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0)))
        return salted.join(asked.join(hot, ["dim", "key"], "left").withColumn("_salt", F.explode(copies)).drop("_hot"), ["dim", "key", "_salt"])

    def ranked(found: DataFrame) -> DataFrame:
        """(q, node, score, members, r): each query's k best classes."""
        named = found.join(classes.select("node", "members"), "node")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "members")
        return steps.save(named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k))

    def looked_up(waiting: DataFrame, bits: int, r1: int, r2: int) -> DataFrame:
        """By segments; the waiting queries, whose prefixes are few enough, go to every task."""
        held = waiting.select("node", "dim", "vector", "strings", "best").toArrow()  # at most MOST_SENT prefixes
        dims, asked = held["dim"].to_numpy(), {}
        for d in np.unique(dims).tolist():
            part = held.take(pa.array(np.nonzero(dims == d)[0]))
            if r2 > 1:
                best = np.frombuffer(b"".join(part["best"].to_pylist()), np.uint8).reshape(-1, trees, 2, DIRECTIONS).astype(np.int64)
                probes = ((best[:, :, 0, :r1, None] << SYMBOL) | best[:, :, 1, None, :r2]).reshape(len(best), trees, -1)
            else:
                probes = part["strings"].combine_chunks().flatten().to_numpy().reshape(-1, trees, 1) >> (BITS - bits)
            asked[d] = (part["node"].to_numpy(), unit(matrix(part["vector"], d)), probes)
        found = steps.save(forest.select("node", "dim", "vector", "strings").mapInArrow(probed(k, trees, bits, asked), FOUND + ", pairs long"))
        if counted is not None:
            counted.append(found.agg(F.sum("pairs")).first()[0] or 0)
        return found.drop("pairs")

    def shuffled(waiting: DataFrame, bits: int, r1: int, r2: int) -> DataFrame:
        """By pairs: both sides meet by prefix, and pairs are scored in blocks by their candidate."""
        asked = keys(waiting, bits).withColumnRenamed("node", "q") if r2 == 1 else waiting.select("node", "dim", "best").mapInArrow(prefixes(trees, r1, r2), "dim int, key long, q long")
        pairs = steps.save(met(keys(forest, bits), asked).where("q <> node").select("q", "node", "dim").distinct())
        n = pairs.count()
        if counted is not None:
            counted.append(n)
        placed = pairs.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(max(1, -(-n // block)))))
        none = F.lit(None).cast(classes.schema["vector"].dataType)
        parts = placed.select("dim", "block", F.lit(2).alias("kind"), "q", "node", none.alias("vector"))
        parts = parts.unionByName(placed.select("dim", "block", "node").distinct().join(vectors_of.drop("dim"), "node").select("dim", "block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("q"), "node", "vector"))
        parts = parts.unionByName(placed.select("dim", "block", F.col("q").alias("node")).distinct().join(vectors_of.drop("dim"), "node").select("dim", "block", F.lit(1).alias("kind"), F.col("node").alias("q"), F.lit(-1).cast("long").alias("node"), "vector"))
        return parts.repartition("dim", "block").sortWithinPartitions("dim", "block").mapInArrow(scored(k), FOUND)

    waiting = steps.save(forest.where("asks").select("node", "dim", "vector", "strings", "best"))
    answers, asking = [], waiting.count()
    for (bits, r1, r2), least in zip(LEVELS, least_cosines(trees, recall)):
        if not asking:
            break
        if least > 1:
            continue
        top = ranked((looked_up if asking * trees * r1 * r2 <= most_sent else shuffled)(waiting, bits, r1, r2))
        done = steps.save(top.where((F.col("r") == k) & (F.col("score") >= least)).select("q"))
        answers.append(top.join(done, "q", "left_semi"))
        rest = steps.save(waiting.join(done.select(F.col("q").alias("node")), "node", "left_anti"))
        steps.drop(waiting)
        waiting, asking = rest, rest.count()
    if asking:
        blocks = F.lit(max(1, -(-classes.count() // 4_096)))
        here = vectors_of.select("dim", F.pmod(F.xxhash64(F.lit(6), "node"), blocks).alias("block"), "node", "vector", F.lit(False).alias("asks"))
        there = waiting.select("node").join(vectors_of, "node").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1)).alias("block"), "node", "vector", F.lit(True).alias("asks"))
        if counted is not None:
            counted.append(asking * classes.count())
        answers.append(ranked(here.unionByName(there).repartition("dim", "block").sortWithinPartitions("dim", "block").mapInArrow(scanned(k), FOUND)))
    # each query class with its best classes' smallest members, its own among them
    own = forest.where("asks").select(F.col("node").alias("q"), F.col("self").alias("score")).join(classes.select(F.col("node").alias("q"), "members"), "q")
    every = own.select("q", "score", F.explode("members").alias("m"))
    for top in answers:
        every = every.unionByName(top.select("q", "score", F.explode("members").alias("m")))
    lists = every.groupBy("q").agg(F.collect_list(F.struct("score", "m")).alias("found"))  # at most (k + 1) squared members
    asked = rows.where("asks").join(classes.select("class", F.col("node").alias("q")), "class").select("q", F.col("id").alias("query_id"), F.col("row").alias("query_row"))
    lists = lists.join(asked.groupBy("q").agg(F.count("*").alias("n")), "q")
    each = salted_join(asked, lists, ["q"], "query_row", "n").select("query_id", "query_row", F.explode("found").alias("f"))
    each = each.where(F.col("f.m.row") != F.col("query_row")).select("query_id", "query_row", F.col("f.m.id").alias("vec_id"), F.col("f.m.row").alias("vec_row"), F.col("f.score").alias("score"))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
