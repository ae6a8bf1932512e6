"""Quality by importance resampling: how much likelier is a text under target than under raw text?

Both are bag models of hashed n-grams: words and runs of signs of the lower-cased text, alone and in pairs, in
``buckets`` buckets. The raw model counts every document, the target model those of at most ``sample`` good labelled
documents (the least by a hash of their id; the bound is this parameter). A document's log weight is the sum of its
n-grams' log ratios. Documents are sampled without replacement by Gumbel top-k: a keyed draw is added to each log
weight, and the k greatest are selected, no more and no fewer. Unless ``k`` is given, k is the ``share`` of all
documents; unless that is given either, it is the share of good ones among all labelled documents and ``spare`` of the
others, as by chance some of these come before some good ones.

Scale: counts leave each task as one row a bucket; the model is ``buckets`` numbers; the k-th greatest value is found by
descending through the 64 bits of an order-preserving key, 16 a round, so that no sort or top-k passes through one task.

Edge cases: null and empty texts have no n-grams and log weight 0; without good labels all weights are 0 and, unless k or
a share is given, all documents are selected; a document is good if one of its labels says so; equal rows draw the same
number, and of rows that tie at the k-th value as many are selected as there is room for; a k beyond the number of rows
selects all; input columns called like the added ones are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, Steps, kept, released, smaller

TOKEN = re.compile(r"\w+|[^\w\s]+")
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
ADDED = ("log_weight", "gumbel_key", "selected")


class Grams:
    """Buckets of a text's n-grams. Parts between blanks repeat: their hashes are kept in a memo of bounded size."""

    def __init__(self, buckets: int, memo: int = 100_000):
        self.buckets, self.memo = np.uint64(buckets), Memo(memo)

    @staticmethod
    def hashes(parts: list[str]) -> list[bytes]:
        return [np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in TOKEN.findall(p)], "<u8").tobytes() for p in parts]

    def of(self, text: str | None) -> np.ndarray:
        parts = (text or "").lower().split()
        known = self.memo.find(set(parts), self.hashes)
        h = np.frombuffer(b"".join([known[p] for p in parts]), "<u8")
        if not len(h):
            return np.empty(0, np.int64)
        one = (h * MIX) >> np.uint64(20)
        two = ((h[:-1] * MIX + h[1:]) * MIX2) >> np.uint64(20)
        return (np.concatenate([one, two]) % self.buckets).astype(np.int64)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Signed 64-bit numbers in the order of the doubles."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_greatest(df: DataFrame, key: str, k: int) -> tuple[int, int] | None:
    """The k-th greatest value of a long column, and how many rows of that value are among the k greatest; None for k < 1
    or beyond the number of rows."""
    if k < 1:
        return None
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        part = df if prefix is None else df.where(F.shiftright(key, shift + 16) == prefix)
        found = part.groupBy(F.shiftright(key, shift).alias("p")).agg(F.count("*").alias("n")).collect()  # at most 65536 rows
        for r in sorted(found, key=lambda r: -r["p"]):
            if r["n"] >= left:
                prefix = r["p"]
                break
            left -= r["n"]
        else:
            return None
    return prefix, left


def good_share(labels: DataFrame) -> float:
    """The share of good ones among labelled documents; 1 without labels."""
    each = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    p = each.agg(F.avg((F.col("q") == 1).cast("double")).alias("p")).first()["p"]
    return 1.0 if p is None else p


def log_ratios(docs: DataFrame, labels: DataFrame, id: str, text: str, buckets: int, sample: int) -> np.ndarray:
    good = labels.where("quality = 1").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    target = {r["doc_id"] for r in good.collect()}  # at most ``sample`` ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = kept(("grams", buckets), lambda: Grams(buckets))
        both = np.zeros((2, buckets), np.int64)
        for batch in smaller(batches, 1):
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = np.bincount(grams.of(t.as_py()), minlength=buckets)
                both[0] += c
                if name in target:
                    both[1] += c
        some = np.nonzero(both[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(both[0][some]), pa.array(both[1][some])], ["bucket", "raw", "good"])

    found = docs.select(id, text).mapInArrow(released(count), "bucket int, raw long, good long")
    found = found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()  # at most ``buckets`` rows
    raw, fine = np.ones(buckets), np.ones(buckets)
    for r in found:
        raw[r["bucket"]] += r["raw"]
        fine[r["bucket"]] += r["good"]
    if not any(r["good"] for r in found):
        return np.zeros(buckets)
    return np.log(fine / fine.sum()) - np.log(raw / raw.sum())


def resample(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", k: int | None = None, share: float | None = None, spare: float = 0.05, buckets: int = 10_000, sample: int = 20_000, seed: int = 1
) -> DataFrame:
    """The documents with log_weight double, gumbel_key double, selected boolean; labels: (doc_id, quality)."""
    steps = Steps(docs.sparkSession, "quality")
    docs = docs.drop(*[c for c in ADDED if c in docs.columns])
    ratio = log_ratios(docs, labels, id, text, buckets, sample)
    at_id, at_text = docs.columns.index(id), docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = kept(("grams", buckets), lambda: Grams(buckets))
        for batch in smaller(batches, at_text):
            weight, drawn = [], []
            for name, t in zip(batch.column(at_id).to_pylist(), batch.column(at_text)):
                t = t.as_py()
                weight.append(float(ratio[grams.of(t)].sum()))
                drawn.append(xxhash.xxh64_intdigest(f"{name}\0{t}".encode("utf-8", "surrogatepass"), seed))
            uniform = ((np.array(drawn, np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
            key = np.array(weight) - np.log(-np.log(uniform))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(weight, pa.float64()), pa.array(key), pa.array(ordered_bits(key))], [*batch.schema.names, "log_weight", "gumbel_key", "__q_order"])

    added = [T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel_key", T.DoubleType()), T.StructField("__q_order", T.LongType())]
    schema = T.StructType([*docs.schema.fields, *added])
    scored = steps.save(docs.mapInArrow(released(score), schema).withColumn("__q_row", F.monotonically_increasing_id()))
    if k is None:
        if share is None:
            share = 1 - (1 - good_share(labels)) * (1 - spare) if ratio.any() else 1.0
        k = math.ceil(share * scored.count())
    found = kth_greatest(scored, "__q_order", k)
    if found is None:
        chosen = F.lit(k > 0)
    else:
        least, room = found
        last, _ = kth_greatest(scored.where(F.col("__q_order") == least), "__q_row", room)
        chosen = (F.col("__q_order") > least) | ((F.col("__q_order") == least) & (F.col("__q_row") >= last))
    return scored.withColumn("selected", chosen).drop("__q_order", "__q_row")
