"""Pairs with marked items, and affinities, over documents as rows: no word of a document is shuffled.

Tasks look a document's words up in a list of names that is sent to them, and what they hand over are counts of pairs, summed
up in the task as far as it can hold them, or a row a case. The list has at most ``MOST_NAMES`` names, which is checked; beyond
that the joins of mining.py do the same work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import mining
from .steps import Steps

#: So many pairs are looked at together, and so many counts are held by a task.
PAIRS, HELD = 4 << 20, 4 << 20


def item_rows(words: DataFrame, doc: str = "doc", tokens: str = "tokens") -> DataFrame:
    """(doc, items): the distinct tokens of each document, whose rows may be several; written once."""
    rows = words.select(F.col(doc).alias("doc"), F.array_distinct(tokens).alias("_t")).where(F.size("_t") > 0)
    return Steps(words.sparkSession, "items").save(rows.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("_t"))).alias("items")))


def item_supports(rows: DataFrame, least: int) -> DataFrame:
    """(item, support) of the frequent items of ``item_rows``; written."""
    return Steps(rows.sparkSession, "supports").save(mining.frequent_items(rows.select("doc", F.explode("items").alias("item")), least))


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many values each list has, and all values."""
    offsets = column.offsets.to_numpy()
    return np.diff(offsets), column.values.slice(offsets[0], offsets[-1] - offsets[0])


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.nonzero(np.append(True, keys[1:] != keys[:-1]))[0]
    return keys[first], np.add.reduceat(counts, first)


def _counted(batches: Iterator[pa.RecordBatch], names: pa.Array, mark: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(item, mark, n) by places in ``names``, of lists of items; a key may be handed over several times."""
    n = len(names)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(keys), 100_000):
            k = keys[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k % n), pa.array(k // n), pa.array(counts[s : s + 100_000])], ["_item", "_mark", "n"])

    for batch in batches:
        sizes, values = _flat(batch.column(0))
        place = pc.fill_null(pc.index_in(values, names), -1).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)[place >= 0]
        place = place[place >= 0]
        lengths = np.bincount(row, minlength=len(sizes))
        starts = np.cumsum(lengths) - lengths
        at = np.nonzero(mark[place])[0]
        ends = np.cumsum(lengths[row[at]])
        s = 0
        while s < len(at):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + PAIRS, "right")))
            of = row[at[s:e]]
            k = lengths[of]
            other = place[np.repeat(starts[of] - (np.cumsum(k) - k), k) + np.arange(k.sum())]
            marked = np.repeat(place[at[s:e]], k)
            keys = (marked * n + other)[marked != other]
            s = e
            if len(keys):
                parts.append(np.unique(keys, return_counts=True))
                held += len(parts[-1][0])
            if held > HELD:
                whole = _added(*map(np.concatenate, zip(*parts)))
                parts, held = [whole], len(whole[0])
                if held > HELD // 2:
                    yield from rows(*whole)
                    parts, held = [], 0
    if parts:
        yield from rows(*_added(*map(np.concatenate, zip(*parts))))


def marked_pairs(rows: DataFrame, marked: DataFrame, least: int, items: DataFrame | None = None, most: int = mining.MOST_NAMES) -> DataFrame:
    """(item, mark, support): frequent pairs of any item and a marked one, of ``item_rows``; marked (item). ``items``: their
    ``item_supports`` for the same ``least``, if known. At most ``most`` names pass through the driver."""
    items = item_supports(rows, least) if items is None else items
    if items.count() > most:
        return mining.marked_pairs(rows.select("doc", F.explode("items").alias("item")).withColumn("mult", F.lit(1).cast("long")), marked, least)
    told = items.join(marked.select("item").distinct().withColumn("mark", F.lit(True)), "item", "left").select("item", F.coalesce("mark", F.lit(False)).alias("mark")).toArrow()
    names, mark = told["item"].combine_chunks(), told["mark"].to_numpy()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([names.take(batch.column(0)), names.take(batch.column(1)), batch.column(2)], ["item", "mark", "support"])

    counted = rows.select("items").mapInArrow(lambda b: _counted(b, names, mark), "_item long, _mark long, n long")
    sums = counted.groupBy("_item", "_mark").agg(F.sum("n").alias("support")).where(F.col("support") >= least)
    return sums.mapInArrow(named, "item string, mark string, support long")


def affinity(cases: DataFrame, entities: list[str], lifts: DataFrame, top: int = 3, most: int = mining.MOST_NAMES) -> DataFrame:
    """``mining.affinity`` of each of ``entities`` to all tokens of (case, tokens); lifts (entity, token, lift), a row a pair, of
    which at most ``most`` an entity pass through the driver. A case's rows may be several."""
    lifts = Steps(cases.sparkSession, "lifts").save(lifts.where(F.col("entity").isin(*entities)).select("entity", "token", "lift"))
    if lifts.count() > most * len(entities):
        each = cases.select("case", F.explode("tokens").alias("token"), F.array(*map(F.lit, entities)).alias("_e"))
        return mining.affinity(each.select("case", "token", F.explode("_e").alias("entity")), lifts, top)
    told = lifts.toArrow()
    names = pc.unique(told["token"])
    table = np.ones((len(entities), len(names) + 1))  # the last place is that of any other token
    entity = pc.index_in(told["entity"], pa.array(entities, told["entity"].type)).to_numpy()
    table[entity, pc.index_in(told["token"], names).to_numpy()] = told["lift"].to_numpy()
    known = [np.unique(t) for t in table]
    rank = [len(k) - 1 - np.searchsorted(k, t) for k, t in zip(known, table)]  # 0 is the greatest
    kind = cases.schema["case"].dataType.simpleString()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1_000):
                batch = whole.slice(s, 1_000)
                sizes, values = _flat(batch.column(1))
                place = pc.fill_null(pc.index_in(values, names), len(names)).to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                starts = np.cumsum(sizes) - sizes
                first = np.minimum(sizes, top)
                ends = np.append(0, np.cumsum(np.tile(first, len(entities))))
                totals, tops = np.empty((len(sizes), len(entities))), []
                for e, (k, r) in enumerate(zip(known, rank)):
                    totals[:, e] = np.add.reduceat(table[e][place], starts)
                    order = np.sort(row * len(k) + r[place])  # by row, the greatest first
                    at = np.repeat(starts - (np.cumsum(first) - first), first) + np.arange(first.sum())
                    tops.append(k[len(k) - 1 - order[at] % len(k)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tops)))
                lists = lists.take(pa.array(np.arange(len(sizes) * len(entities)).reshape(len(entities), -1).T.ravel()))  # by row, then by entity
                each = pa.array(np.arange(len(sizes) + 1) * len(entities), pa.int32())
                columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(each, pa.array(totals.ravel())), pa.ListArray.from_arrays(each, lists)]
                yield pa.RecordBatch.from_arrays(columns, ["case", "n", "totals", "tops"])

    found = cases.select("case", "tokens").where(F.size("tokens") > 0).mapInArrow(part, f"case {kind}, n long, totals array<double>, tops array<array<double>>")
    found = found.groupBy("case").agg(F.sum("n").alias("n"), F.collect_list("totals").alias("totals"), F.collect_list("tops").alias("tops"))
    found = found.select("case", "n", "totals", "tops", F.posexplode(F.array(*map(F.lit, entities))).alias("_at", "entity"))
    total = F.aggregate("totals", F.lit(0.0), lambda a, x: a + F.get(x, F.col("_at")))
    best = F.slice(F.sort_array(F.flatten(F.transform("tops", lambda x: F.get(x, F.col("_at")))), asc=False), 1, top)
    return found.select("case", "entity", (total / F.col("n")).alias("average"), (F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)).alias("best"))
