"""What the training-data operators share: workers' memos, row keys, blocked groups."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.steps import Steps, components, salted_join

__all__ = ["Memo", "Steps", "blocked", "components", "covered", "groups", "kept", "local_roots", "released", "row_key", "salted_join", "shuffle_partitions", "smaller", "word_parts", "word_table"]


def kept(key: tuple, make):
    """What ``make`` returns, kept in a worker for its later tasks; only that of the last key, so memory stays bounded."""
    held = sys.__dict__.setdefault("_agorascope_kept", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def smaller(batches: Iterator[pa.RecordBatch], column: int, size: int = 4 << 20, rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of at most ``rows`` rows whose strings in a column take at most ``size``
    bytes, or of one row, so that what a task holds of long texts at once is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.float64)))
        at = 0
        while at < len(ends):
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            upto = min(max(upto, at + 1), at + rows, len(ends))
            yield batch.slice(at, upto - at)
            at = upto


def released(run):
    """The same map over batches, after which a worker gives the memory that is free again back to the system: workers
    that are kept for later tasks would hold it beside those tasks'."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # another C library

    return mapped


class Memo:
    """A dict of bounded size in two generations: what the older one holds is found, and kept if found."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most // 2, {}, {}

    def find(self, keys: set, make) -> dict:
        """A dict that holds at least ``keys``; ``make`` gets the list of unknown ones and returns their values."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        missing = []
        for k in keys:
            if k not in new:
                got = old.get(k)
                if got is None:
                    missing.append(k)
                else:
                    new[k] = got
        if missing:
            new.update(zip(missing, make(missing)))
        return new


def word_table(keeps: Callable[[int], bool]) -> bytes:
    """A table for bytes.translate: A to Z become a to z, bytes that words don't have become blanks."""
    low = [c + 32 if 65 <= c <= 90 else c for c in range(256)]
    return bytes(c if keeps(c) else 32 for c in low)


def word_parts(text: bytes, table: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about ``size`` bytes, so that a long text's words are not held at once."""
    text = text.translate(table)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def row_key(*cols: str) -> Column:
    """128 bits that name a row by its values; null and empty differ."""
    parts = [F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(c).cast("string"))) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\u0000", *parts)))


def covered(docs: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """The columns under names that no added column has, and these names by the input's."""
    names = {c: f"_in{i}" for i, c in enumerate(docs.columns) if c not in without}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocked(rows: DataFrame, keys: list[str], name: str, block: int) -> DataFrame:
    """Deals each group of ``keys`` into tasks (bi, bj) that compare two blocks of at most about ``block`` rows.

    A group of g rows becomes ceil(g / block) blocks by a hash of ``name``; a row goes to the tasks of its block with
    each other block of its group and its own, so no task holds an unbounded group. Groups of one row are left out.
    Adds bi, bj, side (0: in block bi, 1: in block bj only).
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1")
    sizes = sizes.select(*keys, "_n", F.ceil(F.col("_n") / F.lit(block)).cast("int").alias("_nb"))
    dealt = salted_join(rows, sizes, keys, name, "_n").withColumn("_b", F.pmod(F.xxhash64(F.lit(7), name), F.col("_nb")).cast("int"))
    return (
        dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .withColumn("bi", F.least("_b", "_o"))
        .withColumn("bj", F.greatest("_b", "_o"))
        .withColumn("side", F.when(F.col("_b") == F.col("bi"), 0).otherwise(1))
        .drop("_n", "_nb", "_b", "_o")
    )


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition that is sorted by ``keys``, also those that span batches."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        marks = list(zip(*cols))
        start = 0
        for i in range(n):
            if marks[i] != last:
                if i > start:
                    rest.append(batch.slice(start, i - start))
                if rest:
                    yield pa.Table.from_batches(rest)
                rest, start, last = [], i, marks[i]
        rest.append(batch.slice(start))
    if rest:
        yield pa.Table.from_batches(rest)


def local_roots(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    """Union-find over n local rows: each row's smallest reachable index."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [top(x) for x in range(n)]
