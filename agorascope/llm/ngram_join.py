"""Near-duplicate join on word n-grams with Bayesian candidate pruning.

A document is the set of its n-grams of ``words`` lower-cased words between white space (a shorter text is one n-gram),
held as 64-bit hashes. Two documents link when the Jaccard similarity of their sets is at least ``threshold``.

1. One pass over the texts gives each document its set's digest and MinHash values. Documents with equal sets form a
   class, which is counted with its size and never expanded into pairs.
2. Bands of MinHash values propose candidates (a pair at the threshold is missed with a chance of 3 in a million).
   Buckets with the same members are compared once. Pairs are compared value by value in steps: with m of n values
   equal and a uniform prior, the posterior chance that the similarity reaches the threshold is
   P(Binomial(n + 1, threshold) <= m); below ``tolerance`` the pair is dropped. A pair counts in the first band only in
   which it agrees, so in one bucket. Of each bucket the classes that are in a pair are noted.
3. The noted classes meet again in their buckets with their sets. Pairs that pass the same pruning, which are those of
   step 2, are verified exactly, by counting common n-grams, and only these are links.

Scale: what is shuffled is the documents' MinHash values once, 16 bytes a band, the texts once (for step 3), and the
sets of documents that have a candidate, once a bucket in which they have one. A bucket of any size is dealt into pairs
of blocks of at most about ``block`` rows and ``BLOCK_BYTES`` of sets, so no task holds it whole; tasks return a count and
a smallest neighbour for each row, never pairs. Keys with many rows are salted where they are joined. Every step is
written to the shared checkpoint folder; nothing but small counts reaches the driver.

Edge cases: null, empty and blank texts have no n-grams and link with nothing; repeated rows are members of one class
(each counts the others as links); a null id names no component that has another id, and its row is not kept
there; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, Steps, components, groups, kept, local_roots, released, salted_join, smaller

HASHES, ROWS, STEP = 96, 4, 16
BLOCK_BYTES = 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Hashed word n-grams; words repeat, so their hashes are kept in a memo of bounded size."""

    def __init__(self, words: int, memo: int = 100_000):
        self.words, self.memo = words, Memo(memo)
        rng = np.random.default_rng(20240229)
        self.key = rng.integers(0, 2**63, (HASHES, 1), dtype=np.uint64)
        self.odd = rng.integers(0, 2**63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def grams(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the text's n-grams."""
        words = (text or "").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.memo.find(set(words), lambda new: [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in new])
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        k = min(self.words, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)

    def minhash(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(HASHES, 2**64 - 1, np.uint64)
        for at in range(0, len(grams), 4096):
            part = (grams[None, at : at + 4096] ^ self.key) * self.odd
            np.minimum(least, part.min(axis=1), out=least)
        return (least >> np.uint64(32)).astype("<u4")


def digest(grams: np.ndarray) -> bytes:
    return hashlib.md5(grams.tobytes()).digest()


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number n of compared values, the fewest equal ones with which a pair stays."""
    out = []
    for n in range(HASHES + 1):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance or m == n:
                break
            m += 1
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, same: bool, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks of MinHash rows that incremental comparison leaves; i < j where the blocks are one."""
    left, right = [], []
    for at in range(0, len(a), 256):
        part = a[at : at + 256]
        hits = np.zeros((len(part), len(b)), np.uint8)
        for k in range(STEP):
            hits += part[:, k, None] == b[None, :, k]
        i, j = np.nonzero(hits >= least[STEP])
        i = i + at
        if same:
            i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    hits = np.zeros(len(i), np.int32)
    for k in range(0, HASHES, STEP):
        for at in range(0, len(i), 100_000):
            w = slice(at, at + 100_000)
            hits[w] += (a[i[w], k : k + STEP] == b[j[w], k : k + STEP]).sum(axis=1, dtype=np.int32)
        stay = hits >= least[k + STEP]
        i, j, hits = i[stay], j[stay], hits[stay]
    return i, j


def values(column: pa.ChunkedArray, width: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def pairs_of(t: pa.Table, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the pairs of a bucket's two blocks that pruning leaves and that agree in no band before the bucket's."""
    side, sig = t["side"].to_numpy(), values(t["sig"], HASHES, "<u4")
    one = np.nonzero(side == 0)[0]
    two = one if t["bi"][0] == t["bj"][0] else np.nonzero(side == 1)[0]
    i, j = surviving(sig[one], sig[two], one is two, least)
    i, j = one[i], two[j]
    first = [np.empty(0, bool)]
    for at in range(0, len(i), 20_000):
        w = slice(at, at + 20_000)
        agree = (sig[i[w]] == sig[j[w]]).reshape(-1, HASHES // ROWS, ROWS).all(axis=2)
        first.append(agree.any(axis=1) & (agree.argmax(axis=1) == t["band"][0].as_py()))
    first = np.concatenate(first)
    return i[first], j[first]


BUCKET = ["key", "bi", "bj"]


def candidates(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, BUCKET):
            i, j = pairs_of(t, least)
            if len(i):
                t = t.drop_columns("sig").take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks()
                yield from t.select(["key", "band", "bi", "bj", "side", "node"]).to_batches()

    return run


def exact_links(least: list[int], threshold: Fraction):
    num, den = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, BUCKET):
            _, first = np.unique(t["node"].to_numpy(), return_index=True)  # a repeated row brings its class again
            t = t.take(pa.array(np.sort(first)))
            i, j = pairs_of(t, least)
            if not len(i):
                continue
            node, size = t["node"].to_numpy(), t["size"].to_numpy()
            sizes = pc.binary_length(t["grams"]).to_numpy().astype(np.int64) // 8
            _, place = np.unique(values(t["grams"], 1, "<u8").ravel(), return_inverse=True)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            mark = np.zeros(len(place) + 1, np.int64)
            links, pairs = np.zeros(len(node), np.int64), []
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            cuts = np.nonzero(np.diff(i, prepend=-1))[0].tolist() + [len(i)]
            for lo, hi in zip(cuts, cuts[1:]):
                a, others = i[lo], j[lo:hi]
                own = place[starts[a] : starts[a + 1]]
                mark[own] = 1
                for at in range(0, len(others), 256):
                    some = others[at : at + 256]
                    offsets = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    common = np.add.reduceat(mark[np.concatenate([place[starts[b] : starts[b + 1]] for b in some])], offsets)
                    ok = some[common * den >= num * (sizes[a] + sizes[some] - common)]
                    links[a] += size[ok].sum()
                    links[ok] += size[a]
                    pairs += [(int(a), int(b)) for b in ok]
                mark[own] = 0
            up = np.array(local_roots(len(node), pairs))
            own = np.nonzero(links)[0]
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(links[own]), pa.array(node[up[own]])], ["node", "links", "to"])

    return run


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, tolerance: float = 1e-5, block: int = 512) -> DataFrame:
    """One row a document: id, n_links (documents linked directly), component_id (smallest id reachable by links), kept
    (its id is the component's), set_digest (equal for equal sets; null without n-grams)."""
    spark = docs.sparkSession
    steps = Steps(spark, "ngram")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    least = least_matches(threshold, tolerance)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = kept(("shingler", words), lambda: Shingler(words))
        for batch in smaller(batches, 1):
            out: tuple[list, list, list] = ([], [], [])
            for x in batch.column(1):
                grams = shingler.grams(x.as_py())
                some = len(grams) > 0
                for column, value in zip(out, (digest(grams) if some else None, shingler.minhash(grams).tobytes() if some else None, len(grams))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64())], ["id", "digest", "sig", "grams"])

    signed = steps.save(rows.mapInArrow(released(sign), f"id {kind}, digest binary, sig binary, grams long"))
    classes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.min("sig").alias("sig"), F.max("grams").alias("grams"))
    classes = steps.save(classes.withColumn("node", F.monotonically_increasing_id()))

    bands = F.transform(F.sequence(F.lit(0), F.lit(HASHES // ROWS - 1)), lambda b: F.xxhash64(b, F.substring(F.col("sig"), b * 4 * ROWS + 1, F.lit(4 * ROWS))))
    places = classes.select("node", "grams", F.posexplode(bands).alias("band", "key"))
    buckets = places.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), "node")).alias("y"), F.min("band").alias("band"), F.sum("grams").alias("grams"))
    # of buckets with the same members the one of the least band, in which its pairs agree first
    chosen = buckets.where("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("band", "key", "grams")).alias("c"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(block), F.col("c.grams") * 8 / F.lit(BLOCK_BYTES))).cast("int")
    chosen = steps.save(chosen.select("c.key", "c.band", "n", blocks.alias("blocks")))
    dealt = salted_join(places.select("node", "key"), chosen, ["key"], "node", "n")
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64(F.lit(7), "node"), F.col("blocks")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "key", "band", F.least("_b", "_o").alias("bi"), F.greatest("_b", "_o").alias("bj"), (F.col("_b") > F.col("_o")).cast("int").alias("side"))
    met = dealt.join(classes.select("node", "sig"), "node").repartition(*BUCKET).sortWithinPartitions(*BUCKET)
    noted = steps.save(met.mapInArrow(released(candidates(least)), "key long, band int, bi int, bj int, side int, node long"))

    def regather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = kept(("shingler", words), lambda: Shingler(words))
        for batch in smaller(batches, 0):
            sets = [shingler.grams(x.as_py()) for x in batch.column(0)]
            same = [i for i, (x, d) in enumerate(zip(sets, batch.column(1).to_pylist())) if digest(x) == d]
            if same:
                at = pa.array(same, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(2, 6)), pa.array([sets[i].tobytes() for i in same], pa.binary())], ["node", "size", "sig", "tasks", "grams"])

    tasks = noted.groupBy("node").agg(F.collect_list(F.struct("key", "band", "bi", "bj", "side")).alias("tasks"))
    wanted = classes.drop("grams").join(tasks, "node")
    texts = rows.join(wanted, F.col("id").eqNullSafe(F.col("rep"))).select("text", "digest", "node", "size", "sig", "tasks")
    sets = texts.mapInArrow(released(regather), "node long, size long, sig binary, tasks array<struct<key:long,band:int,bi:int,bj:int,side:int>>, grams binary")
    sets = sets.select("node", "size", "sig", "grams", F.explode("tasks").alias("t")).select("node", "size", "sig", "grams", "t.*")
    found = sets.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(released(exact_links(least, Fraction(str(threshold)))), "node long, links long, to long")
    found = steps.save(found)
    joined = components(steps, found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reps = classes.select("node", "digest", "rep", "size").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = reps.groupBy("root").agg(F.min("rep").alias("component"))
    info = reps.join(least_id, "root").join(links, "node", "left").select("digest", "component", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = signed.select("id", "digest").join(info.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("set_digest"),
    )


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents but one of each group of near duplicates: the one with the smallest id, of equal ids any one row."""
    steps = Steps(docs.sparkSession, "ngram-keep")
    rows = steps.save(docs.withColumn("__nj_row", F.monotonically_increasing_id()))
    name = F.struct(F.col(id).alias("id"), F.col("__nj_row").alias("row"))
    found = near_duplicates(rows.select(name.alias("name"), F.col(text).alias("text")), "name", "text", **options)
    kept = found.where("kept").select(F.col("name.row").alias("__nj_row"))
    return rows.join(kept, "__nj_row", "left_semi").select(*docs.columns)
