"""Maximum entropy by improved iterative scaling over (feature vector, label) counts.

Rows are aggregated to distinct feature vectors and labels, which reach the driver in ``train``, their number checked, and stay a
written table in ``train_in_tasks``, whose tasks sum the expectations. Indicator functions are (position, value >= 0, label); values
never seen at 0 or above fire nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import descent

MOST_CELLS = 200_000


class MaxEnt:
    """weights by (position, value, label); labels from 1."""

    def __init__(self, weights: dict[tuple[int, int, int], float], labels: int):
        self.weights, self.labels = weights, labels

    def score(self, features: list[int], label: int) -> float:
        """The sum over all functions of exp(weight x indicator), as the original classifies."""
        fired = [self.weights[k] for i, v in enumerate(features) if (k := (i, v, label)) in self.weights]
        return len(self.weights) - len(fired) + float(np.exp(fired).sum())

    def classify(self, features: list[int]) -> int:
        return max(range(1, self.labels + 1), key=lambda y: (self.score(features, y), -y))


def cells(rows: DataFrame) -> list[tuple[tuple[int, ...], int, int]]:
    found = rows.groupBy("features", "label").agg(F.count("*").alias("n")).limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} distinct feature vectors and labels")
    return sorted((tuple(r["features"]), r["label"], r["n"]) for r in found)


def train(rows: DataFrame, rounds: int = 200, newton: int = 50, eps: float = 1e-3) -> MaxEnt:
    """rows (features array<int>, label int from 1)."""
    return fit(cells(rows), rounds, newton, eps)


def solved(seen: float, mass: np.ndarray, fired: np.ndarray, newton: int, eps: float) -> float:
    """The change of a weight after which the expectation is what was seen: by Newton's steps, from a share of the instances for each
    number of functions that fire."""
    delta = 0.0
    for _ in range(newton):
        part = mass * np.exp(delta * fired)
        gap, slope = seen - part.sum(), -(part * fired).sum()
        if abs(gap) < 1e-7 or slope == 0:
            return delta
        change = gap / slope
        delta -= change
        if abs(change) < eps:
            return delta
    raise RuntimeError("no convergence")


def fit(found: list[tuple[tuple[int, ...], int, int]], rounds: int = 200, newton: int = 50, eps: float = 1e-3) -> MaxEnt:
    vectors = sorted({f for f, _, _ in found})
    place = {f: i for i, f in enumerate(vectors)}
    labels = max(y for _, y, _ in found)
    width = len(vectors[0])
    names = [(i, v, y) for i in range(width) for v in range(max((f[i] for f in vectors), default=-1) + 1) for y in range(1, labels + 1)]
    total = sum(n for *_, n in found)
    weight_of = np.zeros(len(vectors))  # share of the instances with a feature vector
    seen = np.zeros(len(names))
    index = {k: j for j, k in enumerate(names)}
    for f, y, n in found:
        weight_of[place[f]] += n / total
        for i, v in enumerate(f):
            if (i, v, y) in index:
                seen[index[i, v, y]] += n / total
    # how many functions a vector fires under any label: the same for each
    fired = np.array([sum(v >= 0 for v in f) for f in vectors], float)
    holds = {j: np.array([place[f] for f in vectors if f[i] == v], int) for j, (i, v, y) in enumerate(names)}
    w = np.zeros(len(names))
    z = np.zeros((len(vectors), labels))
    for _ in range(rounds):
        for j, (i, v, y) in enumerate(names):
            at = holds[j]
            if not len(at):
                continue
            e = np.exp(z[at] - z[at].max(axis=1, keepdims=True))
            mass = weight_of[at] * e[:, y - 1] / e.sum(axis=1)
            delta = solved(seen[j], mass, fired[at], newton, eps)
            w[j] += delta
            z[at, y - 1] += delta
    return MaxEnt({k: float(x) for k, x in zip(names, w)}, labels)


@dataclass
class Scaling:
    """All that a run needs to go on: weights by position, value and label, and how far the rounds moved one at most."""

    weights: np.ndarray
    epoch: int = 0
    moved: list[float] = field(default_factory=list)


def expected(vectors: DataFrame, weights: np.ndarray, asked: list[tuple[int, int]], shards: int) -> np.ndarray:
    """How many instances the model expects to have a value and a label: by the asked (position, label), the value, and the number
    of functions that fire. vectors are dealt (features, n)."""
    width, values, _ = weights.shape

    def of_shard(task: pa.Table) -> np.ndarray:
        f = np.asarray(task["features"].combine_chunks().flatten()).reshape(len(task), width)
        n, z = np.asarray(task["n"]), 0.0
        for i in range(width):
            z = z + np.where((f[:, i] >= 0)[:, None], weights[i, f[:, i]], 0.0)
        e = np.exp(z - z.max(1, keepdims=True))
        share, fired = n[:, None] * e / e.sum(1, keepdims=True), (f >= 0).sum(1)
        out = np.zeros((len(asked), values * (width + 1)))
        for k, (i, y) in enumerate(asked):
            on = f[:, i] >= 0
            out[k] = np.bincount(f[on, i] * (width + 1) + fired[on], share[on, y], values * (width + 1))
        return out.ravel()

    found = descent.summed(vectors, of_shard, len(asked) * values * (width + 1), shards)
    return found.reshape(len(asked), values, width + 1)


def train_in_tasks(rows: DataFrame, rounds: int = 200, newton: int = 50, eps: float = 1e-3, together: bool = False, path: str | None = None, per_task: int = 50_000, most: int = 5_000_000) -> MaxEnt:
    """``train`` for any number of cells; rows (features array<int>, all of one length, label int from 1). Rows with a null in them
    are no instances.

    Values of one position exclude each other, so the functions of a position and label are solved from one pass: a round takes as
    many passes as there are positions and labels, in ``train``'s order but for values, and its weights are ``train``'s. With
    ``together`` all are solved from one pass a round; where it converges the probabilities are the same, the weights may
    differ by what no probability depends on. Rounds end when none has moved a weight. Tables are written while this runs; with
    a path each round is kept there, and a run that is there goes on. The driver holds ``most`` weights at most.
    """
    spark = rows.sparkSession
    whole = rows.where(F.col("label").isNotNull() & F.col("features").isNotNull() & ~F.exists("features", lambda v: v.isNull())).select("features", "label")
    cells_ = descent.Steps(spark, "cells").save(whole.groupBy("features", "label").agg(F.count("*").alias("n")))
    width, least, values, labels, total = cells_.agg(F.max(F.size("features")), F.min(F.size("features")), F.max(F.array_max("features")) + 1, F.max("label"), F.sum("n")).first()
    if not total or not width:
        raise ValueError("no instances")
    if width != least:
        raise ValueError("feature vectors of several lengths")
    values = max(values, 1)
    if width * values * labels * (width + 1) > most:
        raise ValueError(f"more than {most} sums to add up")
    seen = np.zeros((width, values, labels))
    each = cells_.select("label", "n", F.posexplode("features").alias("i", "v")).where("v >= 0")
    for r in each.groupBy("i", "v", "label").agg(F.sum("n").alias("n")).collect():  # no more than there are weights
        seen[r["i"], r["v"], r["label"] - 1] = r["n"] / total
    vectors = cells_.groupBy("features").agg(F.sum("n").alias("n")).withColumn("_key", F.array_join("features", ","))
    shards = max(1, -(-vectors.count() // per_task))
    vectors = descent.dealt(vectors, "_key", 1 << 40, shards)
    top = [int(np.flatnonzero(of.sum(1)).max(initial=-1)) for of in seen]  # the greatest value of each position
    run = (descent.latest(spark, path) if path else None) or Scaling(np.zeros(seen.shape))
    pairs = [(i, y) for i in range(width) for y in range(labels)]
    while run.epoch < rounds and not (run.moved and run.moved[-1] == 0):
        farthest = 0.0
        for asked in [pairs] if together else [[p] for p in pairs]:
            mass = expected(vectors, run.weights, asked, shards) / total
            for k, (i, y) in enumerate(asked):
                for v in range(top[i] + 1):
                    delta = solved(seen[i, v, y], mass[k, v], np.arange(width + 1.0), newton, eps)
                    run.weights[i, v, y] += delta
                    farthest = max(farthest, abs(delta))
        run.epoch += 1
        run.moved.append(farthest)
        if path:
            descent.saved(spark, run, path)
    return MaxEnt({(i, v, y + 1): float(run.weights[i, v, y]) for i in range(width) for v in range(top[i] + 1) for y in range(labels)}, labels)


def classify(rows: DataFrame, model: MaxEnt, most: int = 5_000_000) -> DataFrame:
    """Rows (features) with predicted, in DataFrame functions; the weights are one array in the plan, in the order of labels, positions
    and values, so that each is found by its place. Values far apart, whose array were longer than ``most``, are refused."""
    counts: dict[int, int] = {}
    for i, v, _ in model.weights:
        counts[i] = max(counts.get(i, 0), v + 1)
    sizes = [counts.get(i, 0) for i in range(max(counts, default=-1) + 1)]
    starts, stride = [sum(sizes[:i]) for i in range(len(sizes))], sum(sizes)
    if stride * model.labels > most:
        raise ValueError(f"more than {most} places for weights")
    placed = np.zeros(max(1, stride * model.labels))
    for (i, v, y), w in model.weights.items():
        placed[(y - 1) * stride + starts[i] + v] = np.exp(w) - 1.0
    weights, size, start = F.lit(placed.tolist()), F.lit(sizes or [0]), F.lit(starts or [0])

    def score(y: Column) -> Column:
        held = lambda v, i: F.when((v >= 0) & (v < F.get(size, i)), F.get(weights, (y - 1) * stride + F.get(start, i) + v))
        fired = F.transform("features", lambda v, i: F.coalesce(held(v, i), F.lit(0.0)))
        return F.aggregate(fired, F.lit(float(len(model.weights))), lambda a, x: a + x)

    each = F.transform(F.sequence(F.lit(1), F.lit(model.labels)), lambda y: F.struct(score(y).alias("s"), (-y).alias("y")))
    return rows.withColumn("predicted", -F.array_max(each)["y"])


def to_table(spark: SparkSession, model: MaxEnt) -> DataFrame:
    """(position, value, label, weight), to be written."""
    return spark.createDataFrame([(*k, w) for k, w in sorted(model.weights.items())], "position int, value int, label int, weight double")


def from_table(weights: DataFrame) -> MaxEnt:
    rows = weights.limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} weights for one model on the driver")
    return MaxEnt({(r["position"], r["value"], r["label"]): r["weight"] for r in rows}, max(r["label"] for r in rows))
