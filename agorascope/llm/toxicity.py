"""Toxicity by a counterfactually regularised classifier.

Features are the words of the lower-cased text and their beginnings of 4, 5 and 6 letters, present or not, named by
64-bit hashes, so that features don't collide. On at most ``sample`` labelled documents (the least by a hash of their
id; the bound is this parameter) the ``most`` features that tell the classes apart best by log odds are chosen, and a
logistic regression is fitted. For each sampled document that holds identity terms, a counterfactual twin has each of
them swapped for another term of its group, and squared differences between the two scores are penalised; so a group's
mere mention says little.

Scale: the sampled ids are broadcast (at most ``sample``); feature counts are aggregated before they are shuffled, the
driver gets ``most`` features and, of each sampled document, which of these it holds. Scoring is a map over whole
texts; each worker remembers which chosen features a word has in a memo of bounded size.

Edge cases: null and empty texts get the score of no feature; documents with a null id are never learned from and are
not held out; of several documents with one id one is learned from; several labels of one id count as toxic if one does;
labels other than 0 and 1 are not learned from; without both classes every score is the share of toxic labels (0 without
labels); equal texts get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, kept, shuffle_partitions, smaller

WORD = re.compile(r"\w+")
# Identity terms by group; those of a group are swapped for each other.
IDENTITY = [
    ["women", "men", "girls", "boys", "females", "males"],
    ["woman", "man", "girl", "boy", "female", "male"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"],
    ["immigrants", "refugees", "natives", "foreigners", "locals"],
    ["old", "young", "elderly", "teenage"],
    ["deaf", "blind", "disabled", "autistic"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["femmes", "hommes", "filles", "garçons"],
    ["mujeres", "hombres", "chicas", "chicos"],
]


def feature_names(word: str) -> list[str]:
    return ["w" + word, *(f"p{word[:k]}" for k in (4, 5, 6) if len(word) >= k)]


def features(word: str) -> list[int]:
    return [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - 2**63 for x in feature_names(word)]


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def swapped(found: list[str]) -> list[str] | None:
    """The words with each identity term swapped for the next of its group; None without any."""
    after = {t: g[(i + 1) % len(g)] for g in IDENTITY for i, t in enumerate(g)}
    return [after.get(w, w) for w in found] if any(w in after for w in found) else None


def held_out(id: str) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Chooser:
    """Which chosen features the words of a text have."""

    def __init__(self, chosen: list[int]):
        self.place = {f: i for i, f in enumerate(chosen)}
        self.memo = Memo(200_000)

    def of(self, parts: list[str]) -> list[bytes]:
        return [np.array([i for w in WORD.findall(p) for f in features(w) if (i := self.place.get(f)) is not None], "<i4").tobytes() for p in parts]

    def text(self, text: str | None) -> np.ndarray:
        parts = set((text or "").lower().split())
        known = self.memo.find(parts, self.of)
        return np.unique(np.frombuffer(b"".join([known[p] for p in parts]), "<i4"))


def fit(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, swap_weight: float, ridge: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on the logistic loss, with (score of a - score of b)^2 penalised."""
    n, k = x.shape
    share = y.mean()
    w, bias = np.zeros(k, np.float32), float(np.log(share / (1 - share)))
    d = a - b
    step = 1.0 / (0.25 * max(1.0, float(np.square(x).sum(axis=1).mean())) + ridge + (2 * swap_weight * float(np.square(d).sum(axis=1).mean()) if len(d) else 0))
    ahead_w, ahead_b, t = w.copy(), bias, 1.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(x @ ahead_w + ahead_b, -30, 30))) - y) / n
        gw = x.T @ g + ridge * ahead_w
        if len(d):
            gw += 2 * swap_weight / len(d) * (d.T @ (d @ ahead_w))
        new_w, new_b = ahead_w - step * gw, ahead_b - step * float(g.sum())
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w, ahead_b = new_w + (t - 1) / t_next * (new_w - w), new_b + (t - 1) / t_next * (new_b - bias)
        w, bias, t = new_w, new_b, t_next
    return w.astype(np.float64), bias


def train(docs: DataFrame, labels: DataFrame, id: str, text: str, sample: int, most: int, swap_weight: float, ridge: float, rounds: int) -> tuple[list[int], np.ndarray, float]:
    """Chosen features, their weights, the bias."""
    spark = docs.sparkSession
    names = labels.select(F.col("doc_id").alias("__t_id"), F.col("toxic").cast("int").alias("toxic")).where("__t_id IS NOT NULL AND toxic IN (0, 1)")
    names = names.where(~held_out("__t_id")).groupBy("__t_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("__t_id"), "__t_id").limit(sample)
    rows = names.collect()  # at most ``sample`` rows
    toxic = sum(r["toxic"] == 1 for r in rows)
    if not 0 < toxic < len(rows):
        return [], np.zeros(0), 40.0 if toxic else -40.0
    picked = spark.createDataFrame([(r["__t_id"], r["toxic"]) for r in rows], names.schema)
    some = docs.select(F.col(id).alias("__t_id"), F.col(text).alias("text")).join(F.broadcast(picked), "__t_id")
    # one document an id, so that repeated ids don't make the sample greater
    one = F.row_number().over(Window.partitionBy("__t_id").orderBy(F.xxhash64("text"), "text"))
    some = some.withColumn("one", one).where("one = 1").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = (Counter(), Counter())
        for batch in smaller(batches, 0):
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[y].update({f for w in set(words(t)) for f in features(w)})
                totals[y][0] += 1  # the number of documents
        every = list(totals[0].keys() | totals[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.int64()), pa.array([totals[1][f] for f in every], pa.int64()), pa.array([totals[0][f] for f in every], pa.int64())], ["f", "t", "c"])

    counts = some.repartition(shuffle_partitions(spark)).mapInArrow(count, "f long, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    n_toxic = toxic
    n_clean = len(rows) - toxic
    odds = F.log((F.col("t") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / F.lit(n_clean + 1.0))
    score = F.abs(odds) / F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = counts.where("f <> 0 AND t + c >= 5").select("f", score.alias("score")).where("score > 2.5").orderBy(F.desc("score"), "f").limit(most).collect()
    chosen = [r["f"] for r in best]
    chosen += [f for f in dict.fromkeys(f for g in IDENTITY for w in g for f in features(w)) if f not in set(chosen)]
    if not best:
        share = toxic / len(rows)
        return [], np.zeros(0), float(np.log(share / (1 - share)))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = Chooser(chosen)
        for batch in smaller(batches, 0):
            own, twin = [], []
            for t in batch.column(0).to_pylist():
                own.append(chooser.text(t).tolist())
                other = swapped(words(t))
                twin.append(None if other is None else chooser.text(" ".join(other)).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(twin, pa.list_(pa.int32()))], ["toxic", "own", "twin"])

    got = some.mapInArrow(held, "toxic int, own array<int>, twin array<int>").collect()

    def dense(lists: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(lists), len(chosen)), np.float32)
        for i, x in enumerate(lists):
            out[i, x] = 1
        return out

    pairs = [(r["own"], r["twin"]) for r in got if r["twin"] is not None]
    weights, bias = fit(dense([r["own"] for r in got]), np.array([r["toxic"] for r in got], np.float32), dense([p for p, _ in pairs]), dense([q for _, q in pairs]), swap_weight, ridge, rounds)
    return chosen, weights, bias


def scores(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample: int = 12_000, most: int = 2_000, swap_weight: float = 1.0, ridge: float = 1e-4, rounds: int = 400
) -> DataFrame:
    """(id, held_out boolean, score double, predicted int); labels: (doc_id, toxic)."""
    chosen, weights, bias = train(docs, labels, id, text, sample, most, swap_weight, ridge, rounds)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chooser = kept(("toxicity", tuple(chosen)), lambda: Chooser(chosen))
        for batch in smaller(batches, 2):
            z = np.array([bias + weights[chooser.text(t.as_py())].sum() for t in batch.column(2)], np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id, "held_out", "score", "predicted"])

    rows = docs.select(id, held_out(id).alias("held_out"), text)
    return rows.mapInArrow(score, f"`{id}` {rows.schema[id].dataType.simpleString()}, held_out boolean, score double, predicted int")
