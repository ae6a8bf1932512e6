"""Embedding near-duplicates by iterative quantisation.

``rotations`` are learned on at most ``sample`` vectors (the least by a hash of their values): from a random orthogonal
start, codes are the signs of the rotated vectors, and the rotation that brings the vectors closest to their codes
(Procrustes) is taken, again and again; this balances the bits. Each rotation gives a code as long as the vectors; codes
are cut into substrings, and two vectors are compared if they agree in one of them (multi-index tables). The substrings'
length grows with the logarithm of the number of vectors, and their number is what finds a pair at the threshold with
the chance ``recall``; a pair of greater cosine is found more surely. Compared pairs must also have a small Hamming
distance over all codes, and link only if the cosine of the original vectors, in double precision, is at least
``threshold``. Vectors of different lengths have no cosine: each length has rotations, tables and buckets of its own, and
one that is not in the sample has its random starts.

Scale: a vector's code goes to as many buckets as there are tables, and its components only to those in which a pair of
it is left by the codes. A bucket of any size is dealt into pairs of blocks of ``block`` rows; tasks return a count and a
smallest neighbour a row, never pairs. A pair is counted in the first table in which it agrees only. Vectors that are
equal in all components are one class, counted with its size.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing; repeated ids are
separate vectors (each row is counted) and get the smallest id as component; an empty table gives an empty result; a null
id names no component that has another id, and its row is not kept there; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, blocked, components, groups, local_roots


def usable(v: Column) -> Column:
    """Non-null, non-zero and finite in all components."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of doubles from a list column without nulls."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([p.flatten().to_numpy(zero_copy_only=False) for p in parts]).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their greatest component first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def starts(dim: int, count: int, seed: int = 5) -> list[np.ndarray]:
    """Random rotations, the same in every worker."""
    rng = np.random.default_rng([seed, dim])
    return [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)]


def learn(x: np.ndarray, dim: int, count: int, rounds: int = 30) -> list[np.ndarray]:
    """Rotations of dim x dim; x: unit vectors of the sample."""
    out = []
    for r in starts(dim, count):
        for _ in range(rounds if len(x) else 0):
            y = x @ r
            u, _, vt = np.linalg.svd(x.T @ np.where(y >= 0, 1.0, -1.0))
            r = u @ vt
        out.append(r)
    return out


class Tables:
    """How vectors of one length are coded: bits of a substring, tables, rotations, greatest Hamming distance."""

    def __init__(self, n: int, dim: int, threshold: float, recall: float):
        self.dim = dim
        agree = 1 - math.acos(threshold) / math.pi
        self.bits = min(dim, 30, max(4, math.ceil(math.log2(max(n, 2) / 16))))
        self.tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**self.bits))
        self.per = dim // self.bits
        self.count = -(-self.tables // self.per)
        total = dim * self.count
        self.most = min(total, math.ceil(total * (1 - agree) + 6 * math.sqrt(total * agree * (1 - agree))))

    def coded(self, x: np.ndarray, rotations: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of unit vectors the substrings by table, and all signs, packed."""
        signs = np.stack([x @ r >= 0 for r in rotations], axis=1)
        cut = signs[:, :, : self.per * self.bits].reshape(len(x), -1, self.bits)[:, : self.tables]
        return cut @ (1 << np.arange(self.bits)).astype(np.int64), np.packbits(signs.reshape(len(x), -1), axis=1)

    def pairs(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the pairs of two blocks that are near by their codes and agree in no table before the bucket's."""
        side, table = t["side"].to_numpy(), t["table"][0].as_py()
        codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.uint8).reshape(len(side), -1)
        wide = np.zeros((len(side), -(-codes.shape[1] // 8) * 8), np.uint8)
        wide[:, : codes.shape[1]] = codes
        words = wide.view("<u8")
        one = np.nonzero(side == 0)[0]
        two = one if t["bi"][0] == t["bj"][0] else np.nonzero(side == 1)[0]
        left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(one), 256):
            a = one[at : at + 256]
            near = np.zeros((len(a), len(two)), np.uint16)
            for k in range(words.shape[1]):
                near += np.bitwise_count(words[a, k][:, None] ^ words[two, k][None, :])
            i, j = np.nonzero(near <= self.most)
            if one is two:
                i, j = i[i + at < j], j[i + at < j]
            i, j = a[i], two[j]
            for lo in range(0, len(i), 10_000):
                p, q = i[lo : lo + 10_000], j[lo : lo + 10_000]
                apart = np.unpackbits(codes[p] ^ codes[q], axis=1, count=self.dim * self.count).reshape(len(p), self.count, self.dim)
                same = ~apart[:, :, : self.per * self.bits].reshape(len(p), -1, self.bits)[:, : self.tables].any(axis=2)
                ok = same[:, table] & (same.argmax(axis=1) == table)
                left.append(p[ok])
                right.append(q[ok])
        return np.concatenate(left), np.concatenate(right)


BUCKET = ["dim", "table", "bucket", "bi", "bj"]


def candidates(plans: dict[int, Tables]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, BUCKET):
            i, j = plans[t["dim"][0].as_py()].pairs(t)
            if len(i):
                t = t.take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks()
                yield from t.select([*BUCKET, "side", "node"]).to_batches()

    return run


def linked(plans: dict[int, Tables], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, BUCKET):
            plan = plans[t["dim"][0].as_py()]
            node, size = t["node"].to_numpy(), t["size"].to_numpy()
            i, j = plan.pairs(t)
            vectors = unit(matrix(t["vector"], plan.dim))
            links, pairs = np.zeros(len(node), np.int64), []
            for lo in range(0, len(i), 20_000):
                p, q = i[lo : lo + 20_000], j[lo : lo + 20_000]
                ok = np.einsum("ij,ij->i", vectors[p], vectors[q]) >= threshold
                p, q = p[ok], q[ok]
                np.add.at(links, p, size[q])
                np.add.at(links, q, size[p])
                pairs.append((p, q))
            if not links.any():
                continue
            p, q = np.concatenate([x for x, _ in pairs]), np.concatenate([x for _, x in pairs])
            up = np.array(local_roots(len(node), zip(p.tolist(), q.tolist())))
            own = np.nonzero(links)[0]
            yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(links[own]), pa.array(node[up[own]])], ["node", "links", "to"])

    return run


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, recall: float = 0.9999, sample: int = 20_000, block: int = 512) -> DataFrame:
    """One row a vector: id, n_links (other vectors linked directly), component_id, kept (its id is the component's)."""
    spark = vectors.sparkSession
    steps = Steps(spark, "itq")
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).alias("vector"))
    rows = rows.withColumn("fine", usable(F.col("vector")))
    rows = rows.withColumn("class", F.when(F.col("fine"), F.unhex(F.md5(F.array_join(F.transform("vector", lambda x: (x + F.lit(0)).cast("string")), ",")))))
    rows = steps.save(rows.select("id", "class", F.when(F.col("fine"), F.col("vector")).alias("vector")))
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("size"), F.first("vector").alias("vector"))
    classes = steps.save(classes.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node")))
    lengths = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row a length
    chosen = classes.select("vector", "dim", F.xxhash64("class").alias("h"), "class").orderBy("h", "class").limit(sample).collect()  # at most ``sample`` vectors
    plans = {d: Tables(n, d, threshold, recall) for d, n in lengths.items()}
    seen: dict[int, list] = {}
    for r in chosen:
        seen.setdefault(r["dim"], []).append(r["vector"])
    learned = {d: learn(unit(np.array(x, np.float64)), d, plans[d].count) for d, x in seen.items()}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.take(pa.array(np.nonzero(dims == d)[0]))
                keys, codes = plans[d].coded(unit(matrix(part.column(1), d)), learned[d] if d in learned else starts(d, plans[d].count))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * keys.shape[1], pa.int32()), pa.array(keys.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists, pa.array([c.tobytes() for c in codes], pa.binary())], ["node", "dim", "keys", "codes"])

    coded = steps.save(classes.select("node", "vector", "dim").mapInArrow(code, "node long, dim int, keys array<long>, codes binary"))
    places = coded.select("node", "dim", F.posexplode("keys").alias("table", "bucket"))
    met = blocked(places, ["dim", "table", "bucket"], "node", block).join(coded.select("node", "codes"), "node")
    noted = met.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(candidates(plans), "dim int, table int, bucket long, bi int, bj int, side int, node long")
    noted = steps.save(noted)
    whole = noted.join(coded.select("node", "codes"), "node").join(classes.select("node", "size", "vector"), "node")
    found = whole.repartition(*BUCKET).sortWithinPartitions(*BUCKET).mapInArrow(linked(plans, threshold), "node long, links long, to long")
    found = steps.save(found)
    joined = components(steps, found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reps = classes.select("node", "class", "rep", "size").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = reps.groupBy("root").agg(F.min("rep").alias("component"))
    info = reps.join(least, "root").join(links, "node", "left").select(F.col("class").alias("c"), "component", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    out = rows.select("id", "class").join(info, F.col("class") == F.col("c"), "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
