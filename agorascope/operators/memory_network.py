"""A memory network that assigns entities to sentences, trained by gradients that tasks compute and Spark sums.

A case is the last sentences of a thread, up to ``memory``, the target last: of each its words, as numbers of hashed word
vectors, and its explicit entities, as a row of ones. A memory row is the sentence's own entities and those of the
rows before it, weighted by how much the sentence draws on each (a logistic function of a two-layer form over both
sentences' summed word vectors), no entry above 1. The answer is the target's row; entries of one half and more count.

Each step takes the next batch of cases, the last one of an epoch what is left; a case's batch and shard come from a dense
number, in the order of the cases' names. A shard's rows are one task, which passes forward and back over whole arrays and
returns the gradient in pieces; pieces are summed in two rounds, in the order of the shards, so that a result depends on
neither partitions nor timing. The driver holds the parameters, whose number is checked, and the optimiser's state, and
writes both with the rates and losses to the shared folder after every epoch; a run that finds them there goes on from
the last one. The rate falls by 1.5 when the held-out loss has not fallen, and training ends below ``least_rate``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import descent
from .descent import latest, saved, summed

#: The columns of cases.
CASE = "case string, words array<array<int>>, entities array<array<int>>, gold array<int>"


@dataclass
class Shape:
    """The network's sizes; entities are numbers from 0."""

    entities: int
    words: int = 1_024
    width: int = 8
    hidden: int = 10
    memory: int = 20

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        return [("vectors", (self.words, self.width)), ("first", (2 * self.width, self.hidden)), ("second", (self.hidden,)), ("scale", (1,)), ("shift", (1,))]

    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.parts())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.parts():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start(self, seed: int, spread: float = 0.1) -> np.ndarray:
        flat = np.random.default_rng(seed).normal(0, spread, self.size())
        self.views(flat)["scale"][:] = 1
        return flat


def arrays(shape: Shape, words: list | pa.Array, entities: list | pa.Array, gold: list | pa.Array) -> tuple[np.ndarray, ...]:
    """Cases as (counts of words of each sentence, explicit entities, gold); a case's last sentence is the last row."""
    n, s = len(words), shape.memory
    bags, marks, want = np.zeros((n, s, shape.words)), np.zeros((n, s, shape.entities)), np.zeros((n, shape.entities))
    sentences = pa.list_(pa.list_(pa.int32()))
    words, entities = _column(words, sentences), _column(entities, sentences)
    many = np.asarray(words.value_lengths(), np.int64), np.asarray(entities.value_lengths(), np.int64)
    both, first = np.minimum(np.minimum(*many), s), s - np.minimum(many[0], s)
    for of, lists, count in ((bags, words, many[0]), (marks, entities, many[1])):
        case = np.repeat(np.arange(n), count)
        k = np.arange(len(case)) - np.repeat(np.cumsum(count) - np.minimum(count, s), count)  # from the first that is held
        row = np.where((k >= 0) & (k < both[case]), case * s + first[case] + k, -1)
        own = lists.flatten()
        row = np.repeat(row, np.asarray(own.value_lengths(), np.int64))
        at = row * of.shape[2] + np.asarray(own.flatten(), np.int64)
        np.add.at(of.reshape(-1), at[row >= 0], 1)
    np.minimum(marks, 1, out=marks)
    gold = _column(gold, pa.list_(pa.int32()))
    want[np.repeat(np.arange(n), np.asarray(gold.value_lengths(), np.int64)), np.asarray(gold.flatten(), np.int64)] = 1
    return bags, marks, want


def _column(values: list | pa.Array | pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values if isinstance(values, pa.Array) else pa.array(values, kind)


def passed(shape: Shape, flat: np.ndarray, bags: np.ndarray, marks: np.ndarray, want: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """The target's memory row of each case, and the gradient of the summed squared error."""
    p = shape.views(flat)
    one, two = p["first"][: shape.width] @ p["second"], p["first"][shape.width :] @ p["second"]
    said = bags @ p["vectors"]
    left, right = said @ one, said @ two
    form = left[:, None, :] + right[:, :, None]  # (case, sentence, an earlier one)
    before = np.tril(np.ones((shape.memory, shape.memory)), -1)
    weight = before / (1 + np.exp(-np.clip(p["scale"] * form + p["shift"], -40, 40)))
    rows, open_ = marks.copy(), np.ones_like(marks)
    for t in range(shape.memory):
        raw = np.einsum("nj,nje->ne", weight[:, t], rows * before[t][:, None]) + marks[:, t]
        rows[:, t], open_[:, t] = np.minimum(raw, 1), raw < 1
    if want is None:
        return rows[:, -1], None
    d_rows, d_weight = np.zeros_like(rows), np.zeros_like(weight)
    d_rows[:, -1] = 2 * (rows[:, -1] - want)
    for t in range(shape.memory - 1, -1, -1):
        g = d_rows[:, t] * open_[:, t]
        d_weight[:, t, :t] = np.einsum("ne,nje->nj", g, rows[:, :t])
        d_rows[:, :t] += weight[:, t, :t, None] * g[:, None]
    d_z = d_weight * weight * (1 - weight)
    gradient = np.zeros_like(flat)
    d = shape.views(gradient)
    d["scale"][:], d["shift"][:] = (d_z * form).sum(), d_z.sum()
    d_left, d_right = p["scale"] * d_z.sum(1), p["scale"] * d_z.sum(2)
    d_one, d_two = np.einsum("ns,nsd->d", d_left, said), np.einsum("ns,nsd->d", d_right, said)
    d["first"][:] = np.concatenate([np.outer(d_one, p["second"]), np.outer(d_two, p["second"])])
    d["second"][:] = p["first"].T @ np.concatenate([d_one, d_two])
    d_said = d_left[..., None] * one + d_right[..., None] * two
    d["vectors"][:] = np.einsum("nsw,nsd->wd", bags, d_said)
    return rows[:, -1], gradient


def _of_shard(shape: Shape, flat: np.ndarray, learn: bool = True, slice_: int = 256):
    """Of a shard's rows the summed gradient, if they are learned from, the squared error, and their number."""

    def of_shard(task: pa.Table) -> np.ndarray:
        total, loss = np.zeros(shape.size() if learn else 0), 0.0
        for at in range(0, len(task), slice_):
            part = task.slice(at, slice_)
            bags, marks, want = arrays(shape, *(part[c] for c in ("words", "entities", "gold")))
            found, gradient = passed(shape, flat, bags, marks, want if learn else None)
            if learn:
                total += gradient
            loss += float(np.square(found - want).sum())
        return np.concatenate([total, [loss, len(task)]])

    return of_shard


def gradients(rows: DataFrame, shape: Shape, flat: np.ndarray, shards: int, slice_: int = 256) -> tuple[np.ndarray, float, int]:
    """The summed gradient and squared error over the rows, and their number."""
    whole = summed(rows, _of_shard(shape, flat, slice_=slice_), shape.size() + 2, shards)
    return whole[:-2], float(whole[-2]), int(whole[-1])


def dealt(cases: DataFrame, batch: int, shards: int) -> DataFrame:
    """Cases with a dense number, and by it a batch and a shard; written once."""
    return descent.dealt(cases.select("case", "words", "entities", "gold"), "case", batch, shards)


@dataclass
class Run:
    """All that a run needs to go on."""

    shape: Shape
    flat: np.ndarray
    rate: float
    epoch: int = 0
    steps: int = 0
    m: np.ndarray | None = None
    v: np.ndarray | None = None
    losses: list[tuple[float, float]] = field(default_factory=list)

    def step(self, gradient: np.ndarray, most_norm: float) -> None:
        """Adam, after the gradient's length has been cut to ``most_norm``."""
        norm = float(np.linalg.norm(gradient))
        gradient = gradient * (most_norm / norm) if norm > most_norm else gradient
        self.steps += 1
        self.m = 0.1 * gradient if self.m is None else 0.9 * self.m + 0.1 * gradient
        self.v = 0.001 * gradient**2 if self.v is None else 0.999 * self.v + 0.001 * gradient**2
        self.flat = self.flat - self.rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)


def train(
    cases: DataFrame, held: DataFrame, shape: Shape, path: str | None = None, epochs: int = 1_000, batch: int = 4_096, rate: float = 1e-2, least_rate: float = 1e-5, most_norm: float = 40.0, shards: int = 16, seed: int = 0, most: int = 5_000_000
) -> Run:
    """The network after its epochs; cases and held (case, words, entities, gold), held to anneal the rate by. With a path
    each epoch is written there, and a run that is there goes on."""
    spark = cases.sparkSession
    if shape.size() > most:
        raise ValueError(f"more than {most} parameters to send to every task")
    rows, others = (descent.Batches(c.select("case", "words", "entities", "gold"), "case", batch, shards) for c in (cases, held))
    run = (latest(spark, path) if path else None) or Run(shape, shape.start(seed), rate)
    while run.epoch < epochs and run.rate >= least_rate and rows.n:
        loss = count = 0.0
        for k in range(rows.n):
            whole = rows.summed(k, _of_shard(shape, run.flat), shape.size() + 2)
            run.step(whole[:-2] / int(whole[-1]), most_norm)
            loss, count = loss + float(whole[-2]), count + int(whole[-1])
        part, size = map(float, others.total(_of_shard(shape, run.flat, learn=False), 2))
        run.losses.append((loss / count, part / max(1, size)))
        if len(run.losses) > 1 and run.losses[-1][1] > run.losses[-2][1] * 0.9999:
            run.rate /= 1.5
        run.epoch += 1
        if path:
            saved(spark, run, path)
    rows.close()
    others.close()
    return run


def answers(cases: DataFrame, run: Run, slice_: int = 256) -> DataFrame:
    """(case, gold, answer): the entities whose entry in the target's row is one half or more."""
    shape, flat = run.shape, run.flat

    def answer(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, slice_):
                part = batch.slice(at, slice_)
                bags, marks, _ = arrays(shape, *(part.column(k) for k in (1, 2, 3)))
                found = passed(shape, flat, bags, marks, None)[0]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array([np.nonzero(row >= 0.5)[0].tolist() for row in found], pa.list_(pa.int32()))], ["case", "gold", "answer"])

    return cases.select("case", "words", "entities", "gold").mapInArrow(answer, "case string, gold array<int>, answer array<int>")


def cases_of(turns: DataFrame, group: str, pos: str, tokens: str, entities: str, gold: str, shape: Shape) -> DataFrame:
    """(case, words, entities, gold): each row of a thread with the ``memory`` - 1 before it; words are hashed."""
    near = Window.partitionBy(group).orderBy(pos).rowsBetween(1 - shape.memory, 0)
    hashed = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(shape.words)).cast("int"))
    rows = turns.withColumn("_w", hashed)
    return rows.select(F.concat_ws("-", group, pos).alias("case"), F.collect_list("_w").over(near).alias("words"), F.collect_list(entities).over(near).alias("entities"), F.col(gold).alias("gold"))
